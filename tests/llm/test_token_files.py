"""Token files against the tokenizers library, one text at a time, and the files themselves."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyband.llm import token_files
from tallyband.llm.common import vocabulary
from tests.llm.helpers import AWKWARD, docs

PATH = vocabulary("word_bpe_49k.json")


def _expected(rows):
    library = Tokenizer.from_file(PATH)
    ids = [[*library.encode(text or "", add_special_tokens=False).ids, 1] for _, text in rows]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    own = [zlib.crc32(np.array(x, "<u2").tobytes()) for x in ids]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, len(ids[k]), own[k]))
    start, out = 0, []
    for k in order:
        out.append((rows[k][0], start, len(ids[k]), crc[k]))
        start += len(ids[k])
    return out, [ids[k] for k in order]


MORE = [
    (20, "Don't STOP, it's <|endoftext|> and <|ENDOFTEXT|> here\ttab\x0bvertical\x85next em", *[None] * 7),
    (21, "é ́x Å ẛ̣ İstanbul ΣΑΣ ﬁ \x01 a\x01b \x00 \x1c\x1d", *[None] * 7),
    (22, "".join(chr(c) for c in range(0x20, 0x500)) + " " + "".join(chr(c) + " " for c in range(0x500, 0x900)), *[None] * 7),
    (-5, "12345 67,89 ... !!! (a) 'sun' \"q\" re've we'll", *[None] * 7),
]


@pytest.mark.parametrize("file_tokens", [token_files.FILE_TOKENS, 2_000])
def test_against_the_library(spark, tmp_path, file_tokens):
    rows = [*AWKWARD, *MORE]
    manifest = token_files.write_token_files(docs(spark, rows), PATH, f"file://{tmp_path}/out", file_tokens=file_tokens)
    want, ids = _expected([(r[0], r[1]) for r in rows])
    got = sorted(tuple(r) for r in token_files.digests(manifest).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    assert [(d, s, n, c) for s, d, n, c in got] == want
    assert [r.ids for r in token_files.read_documents(manifest).orderBy("start").collect()] == ids
    # the files by themselves: flat numbers, in the order of the bases
    parts = manifest.orderBy("base").collect()
    flat = np.concatenate([np.fromfile(p.ids.removeprefix("file://"), "<u2") for p in parts])
    assert flat.tolist() == [i for x in ids for i in x]
    for p in parts:
        offsets = np.fromfile(p.offsets.removeprefix("file://"), "<u8")
        assert (offsets[0], offsets[-1], len(offsets)) == (p.base, p.base + p.n_tokens, p.n_docs + 1)


def test_words_of_the_corpus(spark, data):
    """Words by themselves have the ids that they have in whole texts."""
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    with open(PATH, encoding="utf-8") as lines:
        words = token_files.Words(lines.read(), 1)
    whole = Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)
    assert words.encode([x.encode() for x in texts]) == [np.array([*e.ids, 1], "<u2").tobytes() for e in whole]


def test_many_rows_of_one_id_are_many_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(7 if k % 3 else k, " ".join(rng.choices("abcde", k=rng.randrange(8)))) for k in range(9000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = token_files.write_token_files(table, PATH, f"file://{tmp_path}/out")
    assert manifest.count() >= 3 and manifest.agg(F.max("n_docs")).first()[0] < 6000
    want, _ = _expected(rows)
    got = sorted(tuple(r) for r in token_files.digests(manifest).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    assert [(d, s, n, c) for s, d, n, c in got] == want


def test_empty_table(spark, tmp_path):
    manifest = token_files.write_token_files(docs(spark, []), PATH, f"file://{tmp_path}/out")
    assert manifest.count() == 0 and token_files.digests(manifest).count() == 0
