"""Byte-level BPE encoding and decoding by folding ranked merges over the distinct words of a corpus.

A task takes whole documents until they hold about BLOCK_CHARS characters, splits them by the fixed pattern and numbers the
block's distinct words; a document becomes the numbers of its words. Words are dealt to parts by a hash. A part gets its words of
all blocks, packed, and makes them distinct; merge_fold() encodes each distinct word once: its bytes become ids, and a
fold of higher-order functions applies, again and again, the merge of lowest rank among the neighbours, read from a rank
map. The map is a constant beside each WORDS_EACH words; as a literal of the plan it takes the driver some 300 MB. The ids go
back to the blocks, packed, which put them in the order of their texts; decoding concatenates the ids' byte pieces.

The rank map holds pairs of ids and their merged id. Every way to cut a known piece into two known pieces is a pair. A
pair stands in one of two slots given by its hashes, so a lookup is two reads of a flat array.

A word is once in the part's rows for each block that has it, however often documents repeat it, so no part is hot. Words of more
than LONG bytes, which would cost the fold the square of their length, are merged with a heap where they are found.

Defined results: a null text is the empty text and has no ids; repeated rows give repeated results; null ids stay null;
an empty table gives an empty result; only doc_id and text are read; bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import heapq
import math
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyband.llm.common import mapped, text_or_empty, work_table

BLOCK_CHARS = 32_000_000
CHUNK_CHARS = 500_000
#: Bytes of a word beyond which it is merged with a heap.
LONG = 64
#: Distinct words of a part, about. Words grow slower than texts, and parts with them.
PART_WORDS = 2_000_000
#: Of the texts, the part that is looked at twice over to tell how many distinct words there are.
SAMPLED = 64
#: Parts for which a block is long enough; with more of them blocks grow, up to MOST_CHARS.
BLOCK_PARTS, MOST_CHARS = 300, 64_000_000
#: Distinct words that are folded in one row, with the rank map beside them.
WORDS_EACH = 20_000
#: In place of a part: a row with the parts of a block's words in the order of their numbers, and a row of documents.
PARTS, DOCUMENTS = 2**31 - 2, 2**31 - 1

#: The white space of the splitting pattern, and the endings it takes as words of their own.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Ids are below it.
NO_MERGE = 1 << 16


def load_ranks(path: str) -> list[bytes]:
    """Pieces by rank, from lines of a base64 piece and its rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    pieces = [b""] * len(pairs)
    for piece, rank in pairs:
        pieces[int(rank)] = base64.b64decode(piece)
    return pieces


# --- splitting texts into words -------------------------------------------------------------------------------------


@cache
def _classes() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            kinds[point] = LETTER
        elif kind == "N":
            kinds[point] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where the splitting pattern starts a word, in the code points of several texts; first: where texts start.

    Words are runs of letters, of numbers or of other characters, with one space before them if there is one, and what
    is left of white space: all but its last character, and that one; all of it at a text's end. An apostrophe
    that starts a word takes one of ENDINGS with it.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = _classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    run = opens.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = points == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~opens[:n]
    start = run[:n] & (space | ~after_blank)
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~opens[1:]  # white space that ends a text stays whole
    start |= last
    at = np.flatnonzero((points == 39) & run[:n] & ~after_blank)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~opens[at + 1]]
    if len(at):
        one, two = points[at + 1], points[np.minimum(at + 2, n - 1)]
        two = np.where((at + 2 < n) & ~opens[np.minimum(at + 2, n)], two, 0)
        for ending in ENDINGS:
            hit = at[(one == ord(ending[0])) & ((two == ord(ending[1])) if len(ending) == 2 else True)]
            start[hit + 1] = False
            stop = hit + 1 + len(ending)
            stop = stop[stop < n]
            stop = stop[~space[stop] & ~opens[stop]]
            start[stop] = True
    return np.flatnonzero(start)


def split_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in order, and how many each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate(([0], np.cumsum(lengths)))
    starts = word_starts(points, edges[:-1][lengths > 0])
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
    offset = np.concatenate(([0], np.cumsum(width)))
    data = joined.encode("utf-8", "replace")
    cuts = offset[np.append(starts, len(points))].tolist()
    words = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return words, np.diff(np.searchsorted(starts, edges))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


# --- merging ----------------------------------------------------------------------------------------------------------


class RankTable:
    """Pairs of ids to merged ids, in a flat array; see the module's docstring."""

    def __init__(self, pieces: list[bytes]):
        ids = {piece: rank for rank, piece in enumerate(pieces)}
        if len(pieces) > 1 << 16:
            raise ValueError("ids need 16 bits")
        pairs = {}
        for piece, rank in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = rank
        self.bytes = [ids[bytes([b])] for b in range(256)]
        bits = max(4, (2 * len(pairs)).bit_length())
        while True:
            self.mask = (1 << bits) - 1
            table = self._placed(pairs)
            if table is not None:
                break
            bits += 1
        self.table = table
        self.pieces = pieces

    def slots(self, key: int) -> tuple[int, int]:
        a, b = key >> 16, key & 0xFFFF
        return (a * 40503 + b * 30011) & self.mask, (a * 9973 + b * 60493 + (b >> 3)) & self.mask

    def _placed(self, pairs: dict[int, int]) -> list[int] | None:
        table = [-1] * (self.mask + 1)
        for key, rank in pairs.items():
            entry = key << 16 | rank
            at = self.slots(key)[0]
            for _ in range(200):
                table[at], entry = entry, table[at]
                if entry < 0:
                    break
                one, two = self.slots(entry >> 16)
                at = two if at == one else one
            else:
                return None
        return table


def _merge_long(word: bytes, table: RankTable) -> np.ndarray:
    """Ids of one word, with a heap of pairs: n log n steps."""
    ids = [table.bytes[b] for b in word]
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]

    def rank(a: int, b: int) -> int:
        key = a << 16 | b
        for slot in table.slots(key):
            if table.table[slot] >> 16 == key:
                return table.table[slot] & 0xFFFF
        return NO_MERGE

    heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank(ids[k], ids[k + 1])) < NO_MERGE]
    heapq.heapify(heap)
    while heap:
        best, k, a, b = heapq.heappop(heap)
        nxt = after[k]
        if ids[k] != a or nxt < 0 or ids[nxt] != b:
            continue  # one of the two has been merged since
        ids[k], ids[nxt] = best, -1
        after[k] = after[nxt]
        if after[k] >= 0:
            before[after[k]] = k
        for one, two in ((before[k], k), (k, after[k])):
            if one >= 0 and two >= 0 and (r := rank(ids[one], ids[two])) < NO_MERGE:
                heapq.heappush(heap, (r, one, ids[one], ids[two]))
    return np.array([i for i in ids if i >= 0], np.int64)


def decode(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, ids.tolist()))


_TABLES: dict[str, RankTable] = {}


def _table(pieces: Broadcast) -> RankTable:
    """The rank table of a broadcast vocabulary, built once in each Python worker."""
    key = hashlib.sha256(b"\0".join(pieces.value)).hexdigest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = RankTable(pieces.value)
    return _TABLES[key]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))


# --- blocks of documents ----------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray, words: bool = False) -> bytes:
    """Numbers go byte by byte, all first bytes before all second ones, which shrinks small numbers well."""
    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in arrays)
    return bz2.compress(raw) if words else zlib.compress(raw, 6)


class _Packed:
    """Arrays of _pack(), one after the other."""

    def __init__(self, data: pa.Scalar, words: bool = False):
        self.raw, self.at = (bz2 if words else zlib).decompress(data.as_buffer()), 0

    def take(self, kind: str, n: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(self.raw, np.uint8, width * n, self.at).reshape(width, n)
        self.at += width * n
        return np.ascontiguousarray(planes.T).reshape(-1).view(kind)

    def number(self) -> int:
        return int(self.take("<u4", 1)[0])


def _count(n: int) -> np.ndarray:
    return np.array([n], "<u4")


def _table_of(names: list[str], types: list[pa.DataType], *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_BLOCK = "block long, part int, data binary"
_BLOCK_NAMES, _BLOCK_TYPES = ["block", "part", "data"], [pa.int64(), pa.int32(), pa.binary()]


def _blocks(parts: int, block_chars: int):
    """Rows of _BLOCK: some documents with the numbers of their words, a block's words of a part, and the parts of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        numbers, chars, held = _Numbers(), 0, 0
        ids: list = []
        texts: list[str] = []

        def numbered() -> pa.RecordBatch:
            words, each = split_words(texts)
            seen = len(numbers)
            codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            # a word that is new in its block has the next number, so 0 will do for it
            new = codes > np.maximum.accumulate(np.concatenate(([seen - 1], codes)))[:-1]
            codes = np.where(new, 0, codes + 1).astype("<u4")
            known = np.array([i is not None for i in ids], np.uint8)
            packed = _pack(_count(len(ids)), known, np.array([i or 0 for i in ids], "<i8"), each.astype("<u4"), _count(seen), _count(len(codes)), codes)
            return _table_of(_BLOCK_NAMES, _BLOCK_TYPES, [block], [DOCUMENTS], [packed])

        def words_of_block() -> pa.RecordBatch:
            words = list(numbers)
            part = np.fromiter((zlib.crc32(w) % parts for w in words), "<u4", len(words))
            order = np.argsort(part, kind="stable")
            used, first = np.unique(part[order], return_index=True)
            packed = []
            for own in np.split(order, first[1:]):
                mine = [words[k] for k in own.tolist()]
                packed.append(_pack(_count(len(mine)), np.fromiter(map(len, mine), "<u4", len(mine)), np.frombuffer(b"".join(mine), np.uint8), words=True))
            return _table_of(_BLOCK_NAMES, _BLOCK_TYPES, [block] * (len(used) + 1), [*used.tolist(), PARTS], [*packed, _pack(_count(len(part)), part)])

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("data"), strict=True):
                ids.append(doc_id)
                texts.append(data.as_buffer().to_pybytes().decode("utf-8", "replace"))
                chars += len(texts[-1])
                held += len(texts[-1]) + 100
                if held >= min(CHUNK_CHARS, block_chars):
                    yield numbered()
                    ids, texts, held = [], [], 0
                    if chars >= block_chars:
                        if numbers:
                            yield words_of_block()
                        block, numbers, chars = block + 1, _Numbers(), 0
        if ids:
            yield numbered()
        if numbers:
            yield words_of_block()

    return run


_WORDS = "block long, part int, words array<binary>, long_ids array<array<int>>, slots array<bigint>, own array<bigint>, data binary"
_WORDS_NAMES = ["block", "part", "words", "long_ids", "slots", "own", "data"]
_WORDS_TYPES = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def _distinct(pieces: Broadcast):
    """From rows of whole parts: the part's distinct words (long ones with their ids) and the rank map, then for each block which words it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, blocks, packed = -1, _Numbers(), [], []
        table = _table(pieces)
        slots, bytes_ = np.array(table.table, np.int64), np.array(table.bytes, np.int64)

        def part() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for first in range(0, len(words), WORDS_EACH):
                own = words[first : first + WORDS_EACH]
                ids = [_merge_long(w, table) if len(w) > LONG else None for w in own]
                yield _table_of(_WORDS_NAMES, _WORDS_TYPES, [None], [at], [own], [ids], [slots], [bytes_], [None])
            n = len(blocks)
            yield _table_of(_WORDS_NAMES, _WORDS_TYPES, blocks, [at] * n, *[[None] * n] * 4, packed)

        for batch in batches:
            for block, mine, data in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if mine != at:
                    if blocks:
                        yield from part()
                    at, numbers, blocks, packed = mine, _Numbers(), [], []
                given = _Packed(data, words=True)
                n = given.number()
                ends = np.cumsum(given.take("<u4", n)).tolist()
                raw = given.raw[given.at :]
                blocks.append(block)
                codes = np.fromiter((numbers[raw[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)), "<u4", n)
                packed.append(_pack(_count(n), codes))
        if blocks:
            yield from part()

    return run


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of _distinct() with all ids: rows of _BLOCK with the ids of a block's words of a part (how many words, ids a word, ids)."""
    at, flats, sizes = -1, [], []
    flat = count = start = np.empty(0, np.int64)
    for batch in batches:
        parts, is_word = batch.column("part").to_numpy(), batch.column("ids").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((parts[1:] != parts[:-1]) | (is_word[1:] != is_word[:-1])) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if low == high:
                continue
            if is_word[low]:
                if parts[low] != at:
                    at, flats, sizes = parts[low], [], []
                ids = batch.column("ids").slice(low, high - low).flatten()  # a list a word
                flats.append(ids.flatten().to_numpy())
                sizes.append(ids.value_lengths().to_numpy())
                continue
            if flats:
                flat, count = np.concatenate(flats), np.concatenate(sizes).astype(np.int64)
                start, flats, sizes = np.cumsum(count) - count, [], []
            packed = []
            for data in batch.column("data").slice(low, high - low):
                given = _Packed(data)
                mine = given.take("<u4", given.number())
                ids = flat[_places(start, count, mine)].astype("<u2")
                packed.append(_pack(_count(len(mine)), count[mine].astype("<u4"), _count(len(ids)), ids))
            n = high - low
            yield _table_of(_BLOCK_NAMES, _BLOCK_TYPES, batch.column("block").slice(low, n).to_pylist(), [int(parts[low])] * n, packed)


def _places(start: np.ndarray, count: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Places of the ids of some words, in order, where a word's ids start and how many there are."""
    many = count[mine]
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[mine] - (ends - many), many)


def _assembled(pieces: Broadcast, emit: Callable[[list, list[np.ndarray], list[bytes]], pa.RecordBatch]):
    """From rows of whole blocks, sorted by part: emit(doc_ids, ids of each text, pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, flats, sizes = -1, [], []
        flat = count = start = np.empty(0, np.int64)
        for batch in batches:
            for own, part, data in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if own != block:
                    block, flats, sizes = own, [], []
                    flat = count = start = np.empty(0, np.int64)
                given = _Packed(data)
                n = given.number()
                if part < PARTS:
                    sizes.append(given.take("<u4", n))
                    flats.append(given.take("<u2", given.number()))
                elif part == PARTS:
                    order = np.argsort(given.take("<u4", n), kind="stable")
                    flat, each = np.concatenate(flats), np.concatenate(sizes).astype(np.int64)
                    count, start = np.empty_like(each), np.empty_like(each)
                    count[order], start[order] = each, np.cumsum(each) - each
                    flats, sizes = [], []
                else:
                    known, ids, each = given.take("u1", n), given.take("<i8", n), given.take("<u4", n)
                    seen = given.number()
                    codes = given.take("<u4", given.number()).astype(np.int64) - 1
                    new = codes < 0
                    codes[new] = seen + np.arange(np.count_nonzero(new))
                    found = flat[_places(start, count, codes)].astype("<u4") if len(codes) else np.empty(0, "<u4")
                    none = np.zeros(1, np.int64)
                    edges = np.concatenate((none, np.cumsum(count[codes]))) if len(codes) else none
                    stops = edges[np.concatenate((none, np.cumsum(each.astype(np.int64))))]
                    yield emit([int(i) if k else None for i, k in zip(ids, known, strict=True)], [found[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)], pieces.value)

    return run


def distinct_words(docs: DataFrame) -> int:
    """About how many distinct words there are, carried on from a part of the texts and twice that part; it decides how the work is dealt, not the result."""
    place = F.pmod(F.xxhash64(text_or_empty()), F.lit(SAMPLED))
    some = docs.select(place.alias("place"), text_or_empty().alias("text")).filter("place < 2")
    words = some.select("place", F.explode(F.split("text", r"\s+")).alias("word"))
    one, two = words.agg(F.approx_count_distinct(F.when(F.col("place") == 0, F.col("word"))), F.approx_count_distinct("word")).first()
    growth = min(1.0, max(0.0, math.log2(two / one))) if one and two else 1.0
    return math.ceil(max(two, 1) * (SAMPLED / 2) ** growth)


def _encoded(docs: DataFrame, path: str, block_chars: int, emit: Callable, schema: str, part_words: int = PART_WORDS) -> DataFrame:
    spark = docs.sparkSession
    ranks = load_ranks(path)
    pieces = spark.sparkContext.broadcast(ranks)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct_words(docs) // part_words))
    block_chars = min(max(block_chars, MOST_CHARS), block_chars * max(1, parts // BLOCK_PARTS))  # else a block has few words for each part
    blocks = work_table(mapped(_rows(docs), _blocks(parts, block_chars), _BLOCK), "bpe-blocks", compression="uncompressed")
    # numbers of tasks are set by hand, since few bytes are much work here
    words = blocks.filter(F.col("part") < PARTS).select("block", "part", "data").repartition(parts, "part").sortWithinPartitions("part")
    words = mapped(words, _distinct(pieces), _WORDS)
    ids = F.transform("words", lambda word, k: F.coalesce(F.get("long_ids", k), merge_fold(word, F.col("slots"), F.col("own"))))
    back = mapped(words.select("block", "part", ids.alias("ids"), "data"), _back, _BLOCK)
    whole = back.unionByName(blocks.filter(F.col("part") >= PARTS)).repartition(parts, "block").sortWithinPartitions("block", "part")
    return mapped(whole, _assembled(pieces, emit), schema)


def encode_documents(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids (array of int) of every row. path: a vocabulary as lines of piece and rank, read by the driver alone."""

    def emit(doc_ids: list, ids: list[np.ndarray], _: list[bytes]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        values = pa.array(np.concatenate(ids).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return _encoded(docs, path, block_chars, emit, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and data (the bytes) of every row of encode_documents()."""
    pieces = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if x is None else b"".join([pieces.value[i] for i in x]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def round_trip_digest(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids."""

    def emit(doc_ids: list, ids: list[np.ndarray], pieces: list[bytes]) -> pa.RecordBatch:
        columns = [
            pa.array(doc_ids, pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(decode(x, pieces)).hexdigest() for x in ids], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, path, block_chars, emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


# --- the fold as a column expression -------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_fold(word: Column, slots: Column, own: Column) -> Column:
    """The ids of a word (binary, not empty). slots, own: the arrays table and bytes of a RankTable."""
    return _let(slots, lambda slots: _let(own, lambda own: _fold(word, slots, own)))


def _fold(word: Column, slots: Column, own: Column) -> Column:
    mask = (F.size(slots) - 1).cast("bigint")
    nothing = F.array(F.lit(None).cast("bigint"))

    def rank(a: Column, b: Column) -> Column:
        """Merged id of two neighbours; NO_MERGE or more where there is none.

        A slot holds the pair and its merged id, so taking the pair away leaves an id only where it is this pair's slot.
        """
        key = F.shiftleft(a, 32).bitwiseOR(F.shiftleft(b, 16))
        one = slots[(a * 40503 + b * 30011).bitwiseAND(mask)].bitwiseXOR(key)
        two = slots[(a * 9973 + b * 60493 + F.shiftright(b, 3)).bitwiseAND(mask)].bitwiseXOR(key)
        # the sign bit marks an empty slot
        return F.coalesce(F.least(one.bitwiseAND(F.lit(2**63 - 1)), two.bitwiseAND(F.lit(2**63 - 1))), F.lit(NO_MERGE))

    def merged(state: Column, _: Column) -> Column:
        """One merge: the leftmost pair of lowest rank becomes one id; its neighbours' ranks are read anew."""
        ids, ranks = state["ids"], state["ranks"]

        def apply(best: Column) -> Column:
            def at_place(at: Column) -> Column:
                left, right = F.array(F.get(ids, at - 2), best), F.array(best, F.get(ids, at + 1))
                new_ids = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(best), F.slice(ids, at + 2, F.size(ids)))
                around = F.zip_with(left, right, rank)
                # ends have a neighbour that is null, whose rank is NO_MERGE: the list keeps one rank too many there
                new_ranks = F.concat(F.slice(ranks, F.lit(1), at - 2), around, F.slice(ranks, at + 2, F.size(ranks)))
                return F.struct(new_ids.alias("ids"), new_ranks.alias("ranks"))

            return F.when(best >= F.lit(NO_MERGE), state).otherwise(_let(F.array_position(ranks, best).cast("int"), at_place))

        return _let(F.array_min(ranks), apply)

    def fold(ids: Column) -> Column:
        # a null before the first and after the last id: ranks has a NO_MERGE at either end, so that it lines up
        ranks = F.zip_with(F.concat(nothing, ids), F.concat(ids, nothing), rank)
        start = F.struct(F.concat(nothing, ids).alias("ids"), ranks.alias("ranks"))
        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, merged, lambda s: F.transform(F.slice(s["ids"], F.lit(2), F.size(s["ids"])), lambda i: i.cast("int")))

    text = F.hex(word)
    places = F.sequence(F.lit(0), F.octet_length(word) - 1)
    return _let(F.transform(places, lambda i: own[F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("int")]), fold)
