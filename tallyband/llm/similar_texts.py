"""Texts whose shingle sets are similar: wide SimHash candidates, discarded by pivot distance tables and verified by their shingles.

A signature is a SimHash of 128 bits over a text's distinct shingles of PAIR words; a few changed words change few of
them. Each of KEYS keys is BITS of its bits, drawn once; similar texts agree on all bits of some key with a probability that README
gives, whatever the size of the corpus. Under a key, pairs whose distances to the reference signatures differ by more than
`radius` anywhere are discarded, then those whose own distance is over it; the shortest candidate links that connect the others
are kept and verified by the sets of `words`-word shingles. A link that fails may have stood for a true one. So texts that candidate
links connect are a family, and families of several components are searched once more: their texts meet in cells of two
chunks, where all pairs within the radius are verified by one product of the cell's shingle matrix. Only links that
connect leave a cell, so no pairs of a family are ever rows.

A key of more than `hot` texts is hot: its texts meet in cells of two chunks, each two of them in one, so candidate links connect
the same texts whatever `hot` is.

Texts of equal words are one node and need no check. Defined results are those of simhash_pivots; texts without words are
similar to each other alone, and a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyband.llm.common import BROADCAST_TAGS, drop_rows, mapped, stored_tag, tagged, text_or_empty, work_table
from tallyband.llm.graph import connected_components
from tallyband.llm.simhash_pivots import NO_ID, Forest, best_of_component, by_key, close_pairs, links_under_keys, references

WORDS = 5
SIMILARITY = 0.8
PAIR = 2
RADIUS = 28
KEYS, BITS = 128, 22
HOT = 20_000
#: Of the texts, the part by which hot keys are found.
SAMPLED = 16
#: Texts of a chunk of a family; a cell holds two chunks. Shingles that are columns of a cell's matrix at a time.
CHUNK = 1_000
COLUMNS = 8_192


def signature(words: list[bytes]) -> tuple[int, int]:
    """The two halves, as signed 64-bit numbers."""
    if not words:
        return 0, 0
    digest = xxhash.xxh3_128_digest
    shingles = {b" ".join(words[k : k + PAIR]) for k in range(max(1, len(words) - PAIR + 1))} if len(words) > 1 else {words[0]}
    hashes = np.frombuffer(b"".join(map(digest, shingles)), np.uint8).reshape(-1, 16)
    ones = np.zeros(128, np.int64)
    for first in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[first : first + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(hashes)).view(np.int64).tolist())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, same = [], []
        for data in batch.column("data"):
            words = data.as_buffer().to_pybytes().lower().split()
            found.append(signature(words))
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
        halves = np.array(found, np.int64).reshape(-1, 2)
        columns = [batch.column("tag"), batch.column("doc_id"), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(same, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["tag", "doc_id", "f0", "f1", "same"])


def key_masks() -> list[tuple[int, int]]:
    """For each key its bits in both halves, as signed 64-bit numbers."""
    rng = np.random.Generator(np.random.PCG64(7))
    masks = np.zeros((KEYS, 128), np.uint8)
    for own in masks:
        own[rng.choice(128, BITS, replace=False)] = 1
    return [tuple(m) for m in np.packbits(masks, axis=1).view(np.int64).tolist()]


def _keyed(nodes: DataFrame, *carried: str) -> DataFrame:
    """key, node, f0, f1 and the carried columns: each text under its keys."""
    keys = [F.xxhash64(F.lit(k), F.col("f0").bitwiseAND(F.lit(a)), F.col("f1").bitwiseAND(F.lit(b))) for k, (a, b) in enumerate(key_masks())]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "f0", "f1", *carried)


def _prints(f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
    return np.stack([f0, f1], axis=1).view(np.uint64)


def _links(radius: int):
    refs = references(2)

    def done(group: np.ndarray, node: np.ndarray, f0: np.ndarray, f1: np.ndarray) -> list[pa.Array]:
        a, b = links_under_keys(group, node, _prints(f0, f1), radius, refs)
        return [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]

    return by_key(["a", "b"], 2, done)


def similar_pairs(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For every two sets (sorted, no repeats) whether their Jaccard similarity is at least `least`."""
    n, size = len(sets), np.array([len(x) for x in sets], np.float64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # only what two sets have counts
    kept = times[column] > 1
    row, column = np.repeat(np.arange(n), size.astype(np.int64))[kept], shared[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, (first, first + COLUMNS))
        matrix = np.zeros((n, COLUMNS), np.float32)
        matrix[row[low:high], column[low:high] - first] = 1
        common += matrix @ matrix.T
    common = common.astype(np.float64)
    return common >= least * (size[:, None] + size[None, :] - common)


def _family_links(radius: int, least: float):
    refs = references(2)

    def done(group: np.ndarray, node: np.ndarray, f0: np.ndarray, f1: np.ndarray, root: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        cuts = np.searchsorted(group, np.arange(group[-1] + 2)).tolist()
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            own, roots = node[low:high], root[low:high]
            if (roots == roots[0]).all():
                continue
            similar = similar_pairs([np.frombuffer(x, np.uint64) for x in data[low:high]], least)
            forest = Forest(high - low)
            for i, j, bits in close_pairs(np.zeros(high - low, np.int64), _prints(f0[low:high], f1[low:high]), radius, refs):
                good = similar[i, j] & (roots[i] != roots[j])
                forest.add(i[good], j[good], bits[good])
            i, j = forest.links()
            found.append((np.minimum(own[i], own[j]), np.maximum(own[i], own[j])))
        return [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]

    return by_key(["a", "b"], 2, done)


def _few(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if its size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_TAGS else df


def _grouped(cells: DataFrame, *carried: str) -> DataFrame:
    """In tasks of whole cells, sorted."""
    return cells.select("key", "cell", "node", "f0", "f1", *carried).repartition("key", "cell").sortWithinPartitions("key", "cell")


def _cells_of(own: Column, chunks: Column) -> Column:
    """The cells of a text in chunk `own`: one with each chunk, so that every two texts meet in one."""
    return F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda k: F.least(k, own) * chunks + F.greatest(k, own))


def _first_cells(nodes: DataFrame, hot: int) -> DataFrame:
    """The texts under their keys; those of hot keys in cells of two chunks. Which keys are hot is read off a part of the texts: it decides how the work is dealt, not which pairs meet."""
    keyed = _keyed(nodes)
    some = _keyed(nodes.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0)) if hot > SAMPLED else keyed
    scale = SAMPLED if hot > SAMPLED else 1
    large = some.groupBy("key").agg((scale * F.count(F.lit(1))).alias("n")).filter(F.col("n") > hot)
    large = work_table(large, "hot-keys")
    none = F.lit(0).cast("long")
    if large.isEmpty():
        return keyed.withColumn("cell", none)
    chunks = F.ceil(2 * F.col("n") / hot).cast("long")
    cells = _cells_of(F.pmod(F.xxhash64("node", "key"), chunks), chunks)
    return keyed.join(_few(large), "key", "left").withColumn("cell", F.explode(F.coalesce(cells, F.array(none)))).drop("n")


def _family_cells(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """members (family, node, root, stored) of families of several roots in cells: every two texts of a family meet in one."""
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    chunks = F.ceil(F.col("n") / chunk).cast("long")
    sizes = sizes.select("family", chunks.alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    return members.join(sizes, "family").withColumn("cell", F.explode(_cells_of(own, F.col("chunks")))).drop("chunks")


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            sets = []
            for data in batch.column("data"):
                own = data.as_buffer().to_pybytes().lower().split()
                hashes = {digest(b" ".join(own[k : k + words])) for k in range(max(1, len(own) - words + 1))} if own else set()
                sets.append(np.sort(np.fromiter(hashes, np.uint64, len(hashes))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_rows(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """tag, doc_id, signature (32 hexadecimal digits), component_id, kept of every row; the row with the component's id is kept."""
    docs = tagged(docs)
    data = docs.select(stored_tag(docs), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    rows = work_table(mapped(data, _signatures, "tag long, doc_id long, f0 long, f1 long, same binary"), "signatures")
    many = rows.count()
    best = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("tag").alias("t")))
    texts = rows.groupBy("same").agg(best.alias("best"), F.first("f0").alias("f0"), F.first("f1").alias("f1"))
    texts = work_table(texts.select(F.col("best.t").alias("node"), "best", "f0", "f1", "same"), "distinct-texts", many)
    nodes = texts.select("node", "f0", "f1")

    pairs = work_table(mapped(_grouped(_first_cells(nodes, hot)), _links(radius), "a long, b long").distinct(), "wide-links")
    n_pairs = pairs.count()
    met = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    met = work_table(met.distinct(), "wide-nodes")
    own = data.join(_few(met), F.col("tag") == F.col("node"))
    sets = work_table(mapped(own.select("node", "data"), _shingle_sets(words), "node long, shingles binary"), "wide-shingles")

    def verified(pairs: DataFrame, n_pairs: int) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
        return work_table(mapped(both.select("a", "b", "one", "two"), _similar(similarity), "a long, b long"), "verified-links", n_pairs)

    found = verified(pairs, n_pairs)
    if found.count() < n_pairs:
        families = connected_components(pairs).withColumnRenamed("root", "family")
        components = connected_components(found)
        members = families.join(components, "node", "left").select("family", "node", F.coalesce("root", "node").alias("root"))
        cells = _family_cells(work_table(members, "family-members"))
        cells = cells.join(nodes, "node").join(sets, "node").select("family", "cell", "node", "f0", "f1", "root", "shingles")
        cells = cells.repartition("family", "cell").sortWithinPartitions("family", "cell")
        more = work_table(mapped(cells, _family_links(radius, similarity), "a long, b long"), "family-links")
        found = found.unionByName(more)
    found = connected_components(found)
    linked = best_of_component(found, texts.select("node", "best"), many).withColumnRenamed("best", "of_all")
    labels = texts.join(linked, "node", "left").select("same", F.coalesce("of_all", "best").alias("best"))
    labels = work_table(labels, "signature-labels", many)
    component = F.when(F.col("best.id") != NO_ID, F.col("best.id"))
    digits = F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("f0", "f1"))))
    return rows.join(labels, "same").select("tag", "doc_id", digits.alias("signature"), component.alias("component_id"), (F.col("tag") == F.col("best.t")).alias("kept"))


def without_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay when one of each component of similar_rows() does; all columns as they were."""
    docs = tagged(docs)
    return drop_rows(docs, similar_rows(docs, words, similarity).filter(~F.col("kept")).select("tag"))
