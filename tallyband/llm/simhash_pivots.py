"""Near-duplicates by SimHash, with pivot distance tables.

A fingerprint has a bit for each of 64 places, set where over half of the text's shingle hashes have it. Equal
fingerprints collapse to one row before anything is compared, so a large group of copies is one row. Two fingerprints
within `radius` bits agree on at least two of five bit blocks; each of the ten pairs of blocks is one key, so linked
fingerprints meet under some key and no pair is lost. Under a key, each fingerprint has a row of Hamming distances to
REFERENCES fixed fingerprints. By the triangle inequality a pair whose rows differ by more than the radius anywhere
can't be linked: such pairs are discarded, first by sorting on one distance, then by the others; survivors are verified by
their own Hamming distance. A key gives a spanning forest of its links, not all pairs.

Defined results: a null text is the empty text, whose fingerprint is zero; fewer words than a shingle make one shingle;
null ids never become a component's id unless there is no other (then null); repeated rows share all;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyband.llm.common import drop_rows, mapped, stored_tag, tagged, text_or_empty, work_table
from tallyband.llm.graph import connected_components, spread_join

SHINGLE = 3
RADIUS = 3
REFERENCES = 16
#: Blocks of bits, and how many of them two fingerprints have in common where they meet.
CLOSE = (5, 2)
#: Fingerprints under one key beyond which the key is hot. Fingerprints of hot keys meet under FINE keys, so that links of
#: up to 3 bits share nine of twelve blocks; what is hot even then is dealt to cells.
HOT = 50_000
FINE = (12, 9)
NO_ID = 2**63 - 1
#: Links held before they are folded into the forest; a bound on memory, not on links.
FOLD = 2_000_000


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned, of a text in UTF-8."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    count = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:count]
    stops = ends[-count:] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for first in range(0, count, 65_536):
        part = hashes[first : first + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), size) for x in batch.column("data")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("tag"), batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["tag", "doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """tag, doc_id, fp (the fingerprint as a signed long) of every row."""
    rows = docs.select(stored_tag(docs), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    return mapped(rows, _fingerprints(size), "tag long, doc_id long, fp long")


def references(words: int = 1, count: int = REFERENCES) -> np.ndarray:
    """Reference fingerprints of `words` times 64 bits, a row each."""
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, (count, words), dtype=np.uint64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _keyed(prints: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    """table, part, fp: each fingerprint under its keys, one for each choice of blocks."""
    count, common = blocks
    cuts = [64 * k // count for k in range(count + 1)]
    masks = []
    for chosen in combinations(range(count), common):
        bits = sum(((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in chosen)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    keys = F.array(*(F.struct(F.lit(k).cast("short").alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks)))
    return prints.select("fp", F.explode(keys).alias("key")).select("key.table", "key.part", "fp")


class Forest:
    """Links that connect all that are linked, shorter ones first."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> None:
        self.held.append((i, j, bits))
        self.count += len(i)
        if self.count > FOLD:
            self.fold()

    def _union(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            before = label.copy()
            least = np.minimum(label[i], label[j])
            for place in (before[i], before[j], i, j):
                np.minimum.at(label, place, least)
            label = label[label]
            if np.array_equal(label, before):
                break
        self.label = label

    def fold(self) -> None:
        if not self.held:
            return
        i, j, bits = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.count = [], 0
        for level in np.unique(bits):
            a, b = i[bits == level], j[bits == level]
            one, two = self.label[a], self.label[b]
            apart = one != two
            if not apart.any():
                continue
            a, b, one, two = a[apart], b[apart], one[apart], two[apart]
            # one link between any two groups
            _, first = np.unique(np.minimum(one, two) * np.int64(len(self.label)) + np.maximum(one, two), return_index=True)
            self.kept.append((a[first], b[first]))
            self._union(a[first], b[first])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        if not self.kept:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.kept, strict=True))


def close_pairs(group: np.ndarray, prints: np.ndarray, radius: int, refs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j and the distance of all pairs of a group within the radius, in parts. group: numbers that rise; prints: rows of uint64."""
    table = _distance(prints[:, None, :], refs[None, :, :])
    order = np.lexsort((table[:, 0], group))
    ordered, table = prints[order], table[order]
    place = group[order].astype(np.int64) * 1024 + table[:, 0]
    stop = np.searchsorted(place, place + radius, side="right")  # beyond it the first distance rules a pair out
    i = np.flatnonzero(stop > np.arange(len(prints)) + 1)
    step = 1
    while len(i):
        j = i + step
        near = np.abs(table[i] - table[j]).max(axis=1) <= radius
        a, b = i[near], j[near]
        bits = _distance(ordered[a], ordered[b])
        same = bits <= radius
        if same.any():
            yield order[a[same]], order[b[same]], bits[same]
        step += 1
        i = i[stop[i] > i + step]


def links_under_keys(group: np.ndarray, nodes: np.ndarray, prints: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of nodes) that connect all linked ones in each group. group: numbers that rise; prints: rows of uint64."""
    forest = Forest(len(prints))
    for i, j, bits in close_pairs(group, prints, radius, refs):
        forest.add(i, j, bits)
    a, b = forest.links()
    return nodes[a], nodes[b]


def by_key(names: list[str], columns: int, done):
    """mapInArrow over rows sorted by their first columns, the key: done gets whole keys, as a number that rises and the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
            new = np.concatenate(([False], np.any([x[1:] != x[:-1] for x in rows[:columns]], axis=0)))
            return pa.RecordBatch.from_arrays(done(np.cumsum(new), *rows[columns:]), names=names)

        for batch in batches:  # the last key of a batch may go on in the next
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            rows = rows if left is None else [np.concatenate(x) for x in zip(left, rows, strict=True)]
            other = np.flatnonzero(np.any([x != x[-1] for x in rows[:columns]], axis=0))
            cut = other[-1] + 1 if len(other) else 0
            left = [x[cut:] for x in rows]
            if cut:
                yield whole([x[:cut] for x in rows])
        if left is not None:
            yield whole(left)

    return run


def _links(radius: int):
    refs = references()

    def done(group: np.ndarray, prints: np.ndarray) -> list[pa.Array]:
        return [pa.array(x) for x in links_under_keys(group, prints, prints.view(np.uint64)[:, None], radius, refs)]

    return by_key(["a", "b"], 3, done)


def _dealt(keyed: DataFrame, hot: int) -> DataFrame:
    """keyed with a cell after table and part, in tasks of whole cells, sorted. Every two fingerprints of a key meet in some cell.

    A key of up to `hot` fingerprints is one cell; a larger one is cut in chunks, with a cell for every two of them.
    """
    large = work_table(keyed.groupBy("table", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "hot-keys")
    if large.isEmpty():
        out = keyed.withColumn("cell", F.lit(0).cast("long"))
    else:
        chunks = F.ceil(2 * F.col("n") / hot).cast("long")
        own = F.pmod(F.xxhash64("fp"), chunks)
        cells = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda k: F.least(k, own) * chunks + F.greatest(k, own))
        # broadcast: each hot key has `hot` rows of the keyed table
        out = keyed.join(F.broadcast(large), ["table", "part"], "left").withColumn("cell", F.explode(F.coalesce(cells, F.array(F.lit(0).cast("long"))))).drop("n")
    rest = [c for c in keyed.columns if c not in ("table", "part")]
    return out.select("table", "part", "cell", *rest).repartition("table", "part", "cell").sortWithinPartitions("table", "part", "cell")


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """a, b: links between different fingerprints of prints(fp) within the radius; enough of them to connect all that are linked.

    Fingerprints of hot keys are linked where they share FINE keys, which for a radius of up to 3 loses none.
    """
    if radius > min(CLOSE[0] - CLOSE[1], FINE[0] - FINE[1]):
        raise ValueError("two of five blocks, or nine of twelve, find all links up to three bits only")
    keyed = _keyed(prints, CLOSE)
    large = work_table(keyed.groupBy("table", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).drop("n"), "hot-keys")
    run, schema = _links(radius), "a long, b long"
    cell = F.lit(0).cast("long")
    if large.isEmpty():
        cells = keyed.withColumn("cell", cell).select("table", "part", "cell", "fp")
        return mapped(cells.repartition("table", "part").sortWithinPartitions("table", "part"), run, schema)
    cold = keyed.join(F.broadcast(large), ["table", "part"], "left_anti")  # broadcast: each hot key has `hot` rows of the keyed table
    cold = cold.withColumn("cell", cell).select("table", "part", "cell", "fp").repartition("table", "part").sortWithinPartitions("table", "part")
    of_hot = work_table(keyed.join(F.broadcast(large), ["table", "part"], "left_semi").select("fp").distinct(), "hot-fingerprints")
    fine = _dealt(_keyed(of_hot, FINE), hot)
    return mapped(cold, run, schema).unionByName(mapped(fine, run, schema))


def best_of_component(found: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """node, best: the smallest best of the component of each linked node. found: node, root; nodes: node, best, `rows` of them."""
    linked = work_table(found.join(nodes, "node").select("node", "root", "best"), "component-rows", rows)
    roots = work_table(linked.groupBy("root").agg(F.min("best").alias("of_all"), F.count(F.lit(1)).alias("n")), "component-roots", rows)
    return spread_join(linked.drop("best"), roots, "root", rows).select("node", F.col("of_all").alias("best"))


def _labelled(rows: DataFrame, prints: DataFrame, found: DataFrame, many: int) -> DataFrame:
    """The rows with the best row of their component. found: node and root of linked fingerprints."""
    linked = best_of_component(found, prints.withColumnRenamed("fp", "node"), many).select(F.col("node").alias("fp"), F.col("best").alias("of_all"))
    labels = work_table(prints.join(linked, "fp", "left").select("fp", F.coalesce("of_all", "best").alias("best")), "fingerprint-labels", many)
    component = F.when(F.col("best.id") != NO_ID, F.col("best.id"))
    return rows.join(labels, "fp").select(
        "tag", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"), (F.col("tag") == F.col("best.t")).alias("kept")
    )


def _prints(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    rows = work_table(fingerprints(docs, size), "fingerprints")
    best = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("tag").alias("t")))
    many = rows.count()
    return rows, work_table(rows.groupBy("fp").agg(best.alias("best")), "distinct-fingerprints", many), many


def marked_rows(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """tag, doc_id, fingerprint, component_id, kept of every row; the row with the component's id is kept."""
    rows, prints, many = _prints(docs, size)
    return _labelled(rows, prints, connected_components(links(prints.select("fp"), radius)), many)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of docs."""
    return marked_rows(docs, size, radius).drop("tag", "kept")


def without_near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay when one of each component does; all columns as they were."""
    docs = tagged(docs)
    return drop_rows(docs, marked_rows(docs, size, radius).filter(~F.col("kept")).select("tag"))
