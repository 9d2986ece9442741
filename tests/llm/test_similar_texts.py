import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyband.llm import similar_texts
from tests.llm.helpers import AWKWARD, docs


def stored(spark, path, texts):
    rows = [(k, " ".join(t), "en", "s", 0, None, None, None, None) for k, t in enumerate(texts)]
    docs(spark, rows).write.parquet(str(path))
    return spark.read.parquet(str(path))


def shingles(texts):
    return [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]


def close_pairs(sets):
    return [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def roots(n, pairs):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {k: find(k) for k in range(n)}


def prints(texts):
    return np.array([similar_texts.signature(" ".join(t).encode().split()) for t in texts], np.int64).view(np.uint64)


def candidate(prints, a, b):
    return np.bitwise_count(prints[a] ^ prints[b]).sum() <= similar_texts.RADIUS


def test_similar_texts_by_five_word_shingles(spark, tmp_path):
    """Texts with a few words changed fall together, unrelated ones stay; caught pairs are counted against all pairs."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["ba", "ke", "lo", "mi", "su", "ta"], k=rng.randint(1, 4)))
    texts = [[word() for _ in range(rng.randint(120, 400))] for _ in range(150)]
    for base in texts[:60]:
        for _ in range(2):
            copy = list(base)
            for _ in range(max(1, len(base) // 80)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    got = {r.doc_id: r.component_id for r in similar_texts.similar_rows(stored(spark, tmp_path / "d", texts)).collect()}
    close = close_pairs(shingles(texts))
    caught = sum(got[a] == got[b] for a, b in close)
    assert len(close) > 100 and caught / len(close) > 0.95
    linked = {x for pair in close for x in pair}
    assert all(got[k] == k for k in range(len(texts)) if k not in linked)


def test_awkward_tables(spark, tmp_path):
    for name, rows in (("all", AWKWARD), ("none", [])):
        docs(spark, rows).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        assert similar_texts.without_similar(table).columns == table.columns
        assert similar_texts.similar_rows(table).count() == len(rows)


@pytest.mark.parametrize("hot", [20_000, 40])
def test_dense_groups(spark, tmp_path, hot):
    """Hundreds of copies around one base, most of them not similar to each other: all true candidate links count, whatever fails before them, also under hot keys."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["ba", "ke", "lo", "mi", "su", "ta", "ri", "no"], k=3))
    base = [word() for _ in range(200)]
    texts = [base]
    for _ in range(200):
        copy = list(base)
        for place in rng.sample(range(200), 3):
            copy[place] = word()
        texts.append(copy)
    got = {r.doc_id: r.component_id for r in similar_texts.similar_rows(stored(spark, tmp_path / "d", texts), hot=hot).collect()}
    made = prints(texts)
    assert got == roots(len(texts), [(a, b) for a, b in close_pairs(shingles(texts)) if candidate(made, a, b)])


def test_hot_keys_do_not_decide(spark, tmp_path):
    """Families with failed links, in a corpus where their keys are hot and in one where they aren't: the same components."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices(["ba", "ke", "lo", "mi", "su", "ta", "ri", "no"], k=3))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(60, 160))]
        for _ in range(12):
            copy, start, size = list(base), rng.randrange(50), rng.randrange(2, 14)
            copy[start : start + size] = [word() for _ in range(size)]
            texts.append(copy)
    table = stored(spark, tmp_path / "d", texts)
    plain, hot = ({r.doc_id: r.component_id for r in similar_texts.similar_rows(table, hot=hot).collect()} for hot in (20_000, 6))
    assert plain == hot and 12 < len(set(plain.values())) < len(texts)


def test_every_two_texts_of_a_hot_key_meet(spark):
    nodes = spark.createDataFrame([(k, 5, 9) for k in range(90)], "node long, f0 long, f1 long")
    held = {}
    for r in similar_texts._first_cells(nodes, 10).collect():
        held.setdefault((r.key, r.cell), []).append(r.node)
    met = {}
    for (key, _), own in held.items():
        met.setdefault(key, set()).update((a, b) for a in own for b in own if a < b)
    assert len(met) == len(similar_texts.key_masks()) and all(len(x) == 90 * 89 // 2 for x in met.values())


def test_signature_by_hand():
    import xxhash

    words = b"a b c a b d".split()
    hashes = [int.from_bytes(xxhash.xxh3_128_digest(x), "big") for x in (b"a b", b"b c", b"c a", b"b d")]
    want = sum(1 << bit for bit in range(128) if sum(h >> bit & 1 for h in hashes) > 2)
    halves = np.array(similar_texts.signature(words), np.int64).tobytes()
    assert int.from_bytes(halves, "big") == want
    assert similar_texts.signature([]) == (0, 0)


def test_texts_of_one_signature_are_verified(spark, tmp_path, monkeypatch):
    """Equal signatures alone don't make texts similar."""
    texts = [[f"w{k}{j}" for j in range(50)] for k in range(4)] + [[f"w0{j}" for j in range(50)]]
    table = stored(spark, tmp_path / "d", texts)
    monkeypatch.setattr(similar_texts, "mapped", lambda df, run, schema: df.mapInArrow(run, schema).withColumns({"f0": F.lit(5).cast("long"), "f1": F.lit(9).cast("long")}) if "f0 long" in schema else df.mapInArrow(run, schema))
    got = {r.doc_id: r.component_id for r in similar_texts.similar_rows(table).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


def test_cells_of_families(spark):
    """Every two texts of a family with several components meet in a cell; no cell is larger than two chunks or so."""
    rows = [(7, k, 0 if k < 300 else k) for k in range(400)] + [(8, k, k) for k in range(1000, 1010)] + [(9, k, 2000) for k in range(2000, 2050)]
    cells = similar_texts._family_cells(spark.createDataFrame(rows, "family long, node long, root long"), 50).collect()
    held = {}
    for r in cells:
        held.setdefault((r.family, r.cell), []).append(r.node)
    assert max(map(len, held.values())) < 150 and {f for f, _ in held} == {7, 8}
    met = {(f, a, b) for (f, _), own in held.items() for a in own for b in own if a < b}
    assert met == {(7, a, b) for b in range(400) for a in range(b)} | {(8, a, b) for b in range(1000, 1010) for a in range(1000, b)}


def test_similarities_of_sets_by_a_product(monkeypatch):
    monkeypatch.setattr(similar_texts, "COLUMNS", 7)
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 50))), np.uint64) for _ in range(40)] + [np.empty(0, np.uint64)]
    sets += [sets[3], sets[3][:-1]]
    got = similar_texts.similar_pairs(sets, 0.8)
    plain = [set(x.tolist()) for x in sets]
    assert all(got[i, j] == (len(a & b) >= 0.8 * len(a | b)) for i, a in enumerate(plain) for j, b in enumerate(plain))
