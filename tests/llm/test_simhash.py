import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

from tallyband.llm import graph, simhash_pivots
from tests.llm.helpers import AWKWARD, docs


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """pairs: (id, print). Smallest id reachable by links of 3 bits."""
    ids = defaultdict(list)
    for i, p in pairs:
        ids[p].append(i)
    prints, root = list(ids), {}
    for p in prints:
        root[p] = p

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, p in enumerate(prints):
        for q in prints[:k]:
            if (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    groups = defaultdict(list)
    for p in prints:
        groups[find(p)] += [i for i in ids[p] if i is not None]
    return {p: min(groups[find(p)], default=None) for p in prints}


def check(spark, rows, table=None):
    want = [(r[0], plain_print(r[1])) for r in rows]
    label = plain_components(want)
    got = simhash_pivots.near_duplicates(table if table is not None else docs(spark, rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((i, f"{p:016x}", label[p]) for i, p in want), key=key)


def test_awkward_rows(spark):
    check(spark, AWKWARD)
    check(spark, [])


def test_real_documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in table.collect()], table)


def test_links_of_close_prints_against_all_pairs(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        for _ in range(20):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(signed, "fp long").repartition(7)
    found = graph.connected_components(simhash_pivots.links(table)).collect()
    root = {r.node % 2**64: r.root % 2**64 for r in found}
    label = plain_components([(p, p) for p in prints])
    groups, plain = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[root.get(p, p)].add(p)
        plain[label[p]].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_no_link_is_lost_under_hot_keys_and_no_task_holds_one(spark):
    """A family of near copies under the same keys, with a key of more than 20 fingerprints taken for hot."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    prints = {base}
    for p in range(400):
        q = base
        for b in rng.sample(range(64), rng.randint(1, 7)):
            q ^= 1 << b
        prints.add(q)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = graph.connected_components(simhash_pivots.links(table, hot=20)).collect()
    root = {r.node % 2**64: r.root % 2**64 for r in found}
    label = plain_components([(p, p) for p in prints])
    groups, plain = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[root.get(p, p)].add(p)
        plain[label[p]].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))
    cells = simhash_pivots._dealt(simhash_pivots._keyed(table, simhash_pivots.CLOSE), 20)
    rows = cells.collect()
    assert max(Counter((r.table, r.part, r.cell) for r in rows).values()) < 40
    met = defaultdict(set)
    for r in rows:
        met[r.table, r.part, r.cell].add(r.fp)
    together = {pair for group in met.values() for pair in combinations(sorted(group), 2)}
    keyed = defaultdict(set)
    for r in rows:
        keyed[r.table, r.part].add(r.fp)
    assert max(map(len, keyed.values())) > 60
    assert together == {pair for group in keyed.values() for pair in combinations(sorted(group), 2)}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200) if i % 50 != 49] + [(5, 5), (3, 2)]
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {i: i // 50 * 50 for i in range(201) if i != 200}


def test_one_of_each_component_stays(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    out = simhash_pivots.without_near_duplicates(stored)
    assert out.columns == stored.columns
    assert len(out.collect()) == len({plain_print(r[1]) for r in AWKWARD})
