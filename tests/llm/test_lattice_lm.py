import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyband.llm import lattice_lm
from tallyband.llm.byte_bpe import load_ranks
from tallyband.llm.common import vocabulary
from tests.llm.helpers import AWKWARD, docs

PATH = vocabulary("byte_bpe_50k.tiktoken")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_marginal(word, weight):
    """Probability of a word over all segmentations, by recursion on prefixes."""
    a = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        a[j] = sum(a[i] * weight.get(word[i:j], 0) for i in range(max(0, j - lattice_lm.LONGEST), j))
    return a[-1]


def test_marginals_and_expected_counts():
    pieces = load_ranks(PATH)
    lattice = lattice_lm.Lattice(pieces)
    weight = {p: math.exp(lattice.log_p[k]) for k, p in enumerate(pieces) if lattice.log_p[k] > -600}
    words = [b"the", b"internationalisation", "été".encode(), b"x", b"zzzzzzzzzzzz", b"\xff\xfe", b"ab" * 20]
    for word, got in zip(words, lattice.log_marginals(words)[0], strict=True):
        assert got == pytest.approx(math.log(plain_marginal(b" " + word, weight)), rel=1e-9)
    close = lattice.log_marginals(words, kind=np.float32)[0]
    assert close == pytest.approx(lattice.log_marginals(words)[0], rel=1e-5)
    used = lattice.expected(words, np.ones(len(words)))
    # pieces of a segmentation cover each byte once
    assert sum(n * len(pieces[k]) for k, n in enumerate(used)) == pytest.approx(sum(len(w) + 1 for w in words))


def check(rows, got):
    train = Counter()
    for i, text in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            train.update([*tokens(text), ""])
    total, distinct = sum(train.values()), len(train)
    want = []
    for i, text in rows:
        mine = [*tokens(text), ""]
        base = sum(math.log10((train[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in mine)
        want.append((str(i), len(mine), sum(train[t] > 0 for t in mine), total, base))
    key = lambda x: (x[0], x[1], x[4])
    for a, b in zip(sorted(want, key=key), sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


@pytest.mark.parametrize("head", [3, 200_000])
def test_scores(spark, data, head):
    table = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").unionByName(docs(spark).select("doc_id", "text", "lang"))
    got = lattice_lm.score_documents(table, PATH, lattice_lm.training_part(), head).collect()
    check([(r.doc_id, r.text) for r in table.collect()], got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_awkward_and_empty(spark):
    got = lattice_lm.score_documents(docs(spark), PATH, lattice_lm.training_part()).collect()
    check([(r[0], r[1]) for r in AWKWARD], got)
    assert lattice_lm.score_documents(docs(spark, []), PATH, lattice_lm.training_part()).count() == 0


def test_score_of_a_text_by_hand(spark):
    """One language: each word's own arc and its other segmentations, then the end."""
    texts = {1: "b a", 2: "a a the", 3: "the b", 4: "zq the", 7: "zq a"}
    table = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    got = {r.doc_id: r.score for r in lattice_lm.score_documents(table, PATH, lattice_lm.training_part(), rounds=0).collect()}
    pieces = load_ranks(PATH)
    log_p = lattice_lm.Lattice(pieces).log_p
    weight = {p: math.exp(log_p[k]) for k, p in enumerate(pieces) if log_p[k] > -600}
    count = Counter(w for i, t in texts.items() if i not in held for w in t.split())
    ends = len(texts) - len(held)
    total = sum(count.values()) + ends
    rest = (lattice_lm.DISCOUNT * len(count) + 0.01) / (total + 0.01)
    for i, t in texts.items():
        want = math.log10(ends / (total + 0.01))
        for w in t.split():
            arc = (count[w] - lattice_lm.DISCOUNT) / (total + 0.01) if count[w] else 0
            want += math.log10(arc + rest * plain_marginal(b" " + w.encode(), weight))
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    rows = lattice_lm.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), PATH, lattice_lm.training_part())
    held = rows.filter(~lattice_lm.training_part()).collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_long_pieces_are_in_the_lattice():
    pieces = load_ranks(PATH)
    lattice = lattice_lm.Lattice(pieces)
    weight = {p: math.exp(lattice.log_p[k]) for k, p in enumerate(pieces) if lattice.log_p[k] > -600}
    words = [b"international", b"administration", b"professional", b"-" * 16, b"-" * 70]
    used = lattice.expected(words, np.ones(len(words)))
    for word, got in zip(words, lattice.log_marginals(words)[0], strict=True):
        a = [1.0] + [0.0] * (len(word) + 1)
        for j in range(1, len(a)):
            a[j] = sum(a[i] * weight.get((b" " + word)[i:j], 0) for i in range(j))
        assert got == pytest.approx(math.log(a[-1]), rel=1e-9)
    for piece in (b" international", b" administration", b" professional", b"-" * 16):
        assert used[pieces.index(piece)] > 0
