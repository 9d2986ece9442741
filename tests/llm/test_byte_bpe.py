import hashlib
import random

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tallyband.llm import byte_bpe
from tallyband.llm.common import vocabulary
from tests.llm.helpers import AWKWARD, docs

ODD = [
    "it's we'll I've 're ''s x's't 'd'll  'm \n's", "a\n\n b  \n", "  lead", "trail   ", "é'S ñ's 日本 12 3½²", " x y　",
    "'", "s'", "'re", "'ver", "\t\tx", "", "a' s", "x'll'", "''", "can't've", "\x1c\x1dz", "😀👍🏽 ok!!!", "a" * 5000, "ab" * 200 + "1234" * 100,
]


@pytest.fixture(scope="module")
def pieces():
    return byte_bpe.load_ranks(vocabulary("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain(pieces):
    import public_tokenizers

    ranks = {piece: rank for rank, piece in enumerate(pieces)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_splitting(plain):
    pattern = regex.compile(plain._pat_str)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("ab'sretvlmd  \n\t1.é日", k=rng.randint(0, 40))) for _ in range(3000)]
    words, sizes = byte_bpe.split_words(texts)
    at = 0
    for text, size in zip(texts, sizes, strict=True):
        assert [w.decode() for w in words[at : at + size]] == pattern.findall(text)
        at += size
    assert at == len(words)


def test_ids_of_long_words(plain, pieces):
    rng, table = random.Random(2), byte_bpe.RankTable(pieces)
    words = [bytes(rng.choices(range(256), k=rng.randint(65, 90))) for _ in range(200)] + [b"ab" * 400, b"\xff" * 300]
    for word in words:
        assert byte_bpe._merge_long(word, table).tolist() == plain._encode_single_piece(word)


@pytest.mark.parametrize("block", [20_000, 8_000_000])
def test_round_trip_of_documents(spark, data, plain, block):
    table = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(docs(spark).select("doc_id", "text"))
    table = table.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    want = []
    for row in table.collect():
        ids = plain.encode_ordinary(row.text or "")
        want.append((row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()))
    path = vocabulary("byte_bpe_50k.tiktoken")
    got = [tuple(r) for r in byte_bpe.round_trip_digest(table, path, block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_encode_then_decode(spark):
    path = vocabulary("byte_bpe_50k.tiktoken")
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs(spark), path), path).collect()
    assert sorted(bytes(r.data).decode() for r in out) == sorted(r[1] or "" for r in AWKWARD)
    assert byte_bpe.encode_documents(docs(spark, []), path).count() == 0


def test_fold_as_a_column(spark, pieces, plain):
    rng = random.Random(3)
    words = [rng.choice(pieces) + rng.choice(pieces) for _ in range(60)] + [b"a", b"\xc3"]
    ranks = byte_bpe.RankTable(pieces)
    table = spark.createDataFrame([([bytearray(w) for w in words], ranks.table, ranks.bytes)], "w array<binary>, slots array<bigint>, own array<bigint>")
    row = table.select(F.transform("w", lambda w: byte_bpe.merge_fold(w, F.col("slots"), F.col("own"))).alias("ids")).first()
    assert row.ids == [plain._encode_single_piece(w) for w in words]


def test_documents_are_encoded_by_the_fold(spark, monkeypatch):
    """Without the fold there are no ids; each distinct word is folded once."""
    plan = byte_bpe.encode_documents(docs(spark), vocabulary("byte_bpe_50k.tiktoken"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(sequence(" in plan
    monkeypatch.setattr(byte_bpe, "merge_fold", lambda word, slots, own: F.array(F.lit(7)))
    out = byte_bpe.encode_documents(docs(spark, AWKWARD[:1]), vocabulary("byte_bpe_50k.tiktoken")).first()
    assert set(out.ids) == {7}


def test_rows_between_blocks_and_parts_grow_with_the_corpus(spark):
    """Twice the texts make twice the rows at most, and parts come from the distinct words, which grow slower."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(4000)]

    def corpus(n):
        return spark.createDataFrame([(k, " ".join(rng.choices(words, k=100))) for k in range(n)], "doc_id long, text string").coalesce(2)

    few, many = corpus(600), corpus(1200)
    rows = [df.mapInArrow(byte_bpe._blocks(8, 20_000), byte_bpe._BLOCK).count() for df in map(byte_bpe._rows, (few, many))]
    assert rows[1] <= 2.1 * rows[0]
    found = [byte_bpe.distinct_words(df) for df in (few, many, few.limit(0))]
    assert 1000 < found[0] < 30_000 and found[1] < 1.9 * max(found[0], 4000) and found[2] == 1 * byte_bpe.SAMPLED // 2
