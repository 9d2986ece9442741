"""Token ids in flat binary files that are mapped into memory.

A folder holds, for each part, three files of little-endian numbers without headers: the ids of all its documents one after the
other (unsigned, 16 bits if the vocabulary allows, else 32), the place of each document's first id among the ids of *all* parts (64
bits, one more at the end), and the documents' own ids (64 bits). A table `manifest` beside them names the files, so a file
that a lost or repeated task left behind is never read.

Texts are encoded where they are read; from then on only packed ids move. Documents are dealt to parts by ranges of their ids,
one file a part; tokens are counted per part, and a part's base is the prefix sum of the counts before it, so all parts are
written at once. Equal ids may hold any share of the rows: the range goes on by length, checksum and a stored row number.

The tokenizer drops white space and merges inside words only, so a word between spaces has the same ids in any text.
Each Python worker keeps the words that it has met; new ones go through the library together, with a mark between them.

Defined results: a null text is the empty text, whose ids are the end id alone; null ids come first, then ids ascending, repeated
ids by length and checksum; an empty table gives an empty manifest and an empty result; only doc_id and text are read;
bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyband.llm.common import mapped, row_tag, text_or_empty, work_table
from tallyband.operators.prefix import BUCKET, bucketed
from tallyband.storage import work_path

END = 1
#: Tokens of a file, about.
FILE_TOKENS = 1 << 27
#: Bytes of texts that are encoded together; bytes of words and ids that a worker keeps; words in one call of the library.
BATCH_BYTES, KEPT_BYTES, WORDS_EACH = 4_000_000, 200_000_000, 20_000
MARK = "\x01"
ORDER = ["doc_id", "n_tokens", "check", "tag"]
MANIFEST = "part int, base long, n_docs long, n_nulls long, n_tokens long, width int, ids string, offsets string, doc_ids string"


class Words:
    """Ids of words, as bytes, through the tokenizers library."""

    def __init__(self, tokenizer: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.end = np.array([end], self.kind).tobytes()
        (self.mark,) = self._ids([MARK])[0]
        self.kept: dict[str, bytes] = {}
        self.bytes = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        odd = [w for w in new if MARK in w or "<|" in w]  # these could meet the mark or be a special token
        plain = list(set(new).difference(odd)) if odd else new
        for first in range(0, len(plain), WORDS_EACH):
            some = plain[first : first + WORDS_EACH]
            ids = np.array([*self._ids([f" {MARK} ".join(some)])[0], self.mark], self.kind)
            data, at = ids.tobytes(), 0
            for word, stop in zip(some, (np.flatnonzero(ids == self.mark) * self.width).tolist(), strict=True):
                self.kept[word] = data[at:stop]
                at = stop + self.width
        for word, ids in zip(odd, self._ids(odd), strict=True):
            self.kept[word] = np.array(ids, self.kind).tobytes()
        self.bytes += sum(len(w) + len(self.kept[w]) + 150 for w in new)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text and the end id."""
        # lower-casing A-Z here makes fewer words; a special token is only one in its own case
        words = [(x if b"<|" in x else x.lower()).decode("utf-8", "replace").replace("\n", " ").split(" ") for x in texts]
        if self.bytes > KEPT_BYTES:
            self.kept, self.bytes = {}, 0
        new: set[str] = set()
        for own in words:
            new |= set(own).difference(self.kept)
        self._learn(list(new))
        return [b"".join(map(self.kept.__getitem__, own)) + self.end for own in words]


_WORDS: dict[tuple, Words] = {}


def _words(tokenizer: Broadcast, end: int) -> Words:
    """Kept in each Python worker for its next task."""
    key = (zlib.crc32(tokenizer.value.encode()), len(tokenizer.value), end)
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(tokenizer.value, end)
    return _WORDS[key]


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, n_tokens, check, tag, width and data (the ids, packed) of every row, stored. path: a tokenizer file, read by the driver alone."""
    with open(path, encoding="utf-8") as lines:
        tokenizer = docs.sparkSession.sparkContext.broadcast(lines.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer, end)
        for batch in batches:
            sizes = pc.binary_length(batch.column("data")).to_numpy().astype(np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES)) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                some = batch.slice(low, high - low)
                ids = words.encode([x.as_buffer().to_pybytes() for x in some.column("data")])
                lengths = pa.array([len(x) // words.width for x in ids], pa.int64())
                checks = pa.array(list(map(zlib.crc32, ids)), pa.int64())
                packed = pa.array([zlib.compress(x, 1) for x in ids], pa.binary())
                widths = pa.array([words.width] * len(ids), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lengths, checks, some.column("tag"), widths, packed], names=[*ORDER, "width", "data"])

    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_tag(), text_or_empty().cast("binary").alias("data"))
    return work_table(mapped(data, run, "doc_id long, n_tokens long, check long, tag long, width int, data binary"), "token-ids")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _written(folder: str):
    """Rows of whole parts, in order: each part's files, and its row of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, nulls, total, width, place = None, 0, 0, 0, 0, ""
        streams: list = []
        docs = 0

        def closed() -> pa.RecordBatch:
            streams[1].write(np.array([base + total], "<u8").tobytes())
            for stream in streams:
                stream.close()
            names = [f"{place}.{kind}" for kind in ("ids", "offsets", "docs")]
            row = [at, base, docs, nulls, total, width, *names]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[f.split()[0] for f in MANIFEST.split(", ")]).cast(_MANIFEST)

        for batch in batches:
            part = batch.column(BUCKET).to_numpy()
            cut = (np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()
            for low, high in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if low == high:
                    continue
                some = batch.slice(low, high - low)
                if part[low] != at:
                    if streams:
                        yield closed()
                    at, base, width = int(part[low]), some.column("base")[0].as_py(), some.column("width")[0].as_py()
                    # a name of its own for each attempt: only what the manifest names counts
                    place = f"{folder}/{at:05d}-{uuid.uuid4().hex}"
                    files, name = _open(place)
                    files.create_dir(os.path.dirname(name), recursive=True)
                    streams = [files.open_output_stream(f"{name}.{kind}") for kind in ("ids", "offsets", "docs")]
                    docs = nulls = total = 0
                lengths = some.column("n_tokens").to_numpy()
                starts = base + total + np.cumsum(lengths) - lengths
                for x in some.column("data"):
                    streams[0].write(zlib.decompress(x.as_buffer()))
                streams[1].write(starts.astype("<u8").tobytes())
                streams[2].write(some.column("doc_id").fill_null(0).to_numpy().astype("<i8").tobytes())
                docs, nulls, total = docs + len(lengths), nulls + some.column("doc_id").null_count, total + int(lengths.sum())
        if streams:
            yield closed()

    return run


_MANIFEST = pa.schema([pa.field(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in MANIFEST.split(", ")])


def write_token_files(docs: DataFrame, path: str, folder: str, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of all documents under folder (a place that driver and executors share); its manifest."""
    spark = docs.sparkSession
    rows = encoded(docs, path, end)
    many, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // file_tokens))
    parts = bucketed(rows, ORDER, max(1, file_tokens * many // max(1, tokens))).repartition(tasks, BUCKET)
    totals = parts.groupBy(BUCKET).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    bases = totals.select(BUCKET, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    dealt = parts.join(F.broadcast(bases), BUCKET).sortWithinPartitions(BUCKET, *ORDER)
    manifest = mapped(dealt.select(BUCKET, "base", "doc_id", "n_tokens", "width", "data"), _written(folder), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class MappedFile:
    """Numbers of a flat file: mapped into memory where the file is on this machine, else read by ranges."""

    def __init__(self, uri: str, kind: str):
        files, path = _open(uri)
        self.kind, self.width = kind, np.dtype(kind).itemsize
        self.file = pa.memory_map(path) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(path)

    def take(self, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * self.width, start * self.width), self.kind)


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start and ids (array of int) of every document, from the files."""
    return _read(manifest, "ids array<int>", lambda ids: [x.astype(np.int32) for x in ids], pa.list_(pa.int32()))


def digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    out = _read(manifest, "n_tokens long, ids_crc32 long", None, None)
    return out


def _read(manifest: DataFrame, more: str, lists, kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = MappedFile(row["ids"], f"<u{row['width']}")
                offsets, own = MappedFile(row["offsets"], "<u8"), MappedFile(row["doc_ids"], "<i8")
                for first in range(0, row["n_docs"], 4096):
                    n = min(4096, row["n_docs"] - first)
                    at = offsets.take(first, n + 1).astype(np.int64)
                    found = [ids.take(int(a), int(b - a)) for a, b in zip(at[:-1] - row["base"], at[1:] - row["base"], strict=True)]
                    null = np.arange(first, first + n) < row["n_nulls"]  # these come first
                    columns = [pa.array(own.take(first, n), mask=null), pa.array(at[:-1])]
                    if lists is None:
                        columns += [pa.array(np.diff(at)), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    else:
                        columns.append(pa.array(lists(found), kind))
                        names = ["doc_id", "start", "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = max(1, manifest.count())  # a row a file
    return mapped(manifest.repartition(parts, "part"), run, f"doc_id long, start long, {more}")


def token_file_digests(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write all documents, read them back, and digest what the files hold."""
    spark: SparkSession = docs.sparkSession
    return digests(write_token_files(docs, path, folder or work_path(spark, "token-files")))
