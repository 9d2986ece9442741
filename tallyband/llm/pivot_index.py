"""Exact top-k by inner product through a pivot-distance index.

Vectors get one more coordinate that gives all of them the norm of the largest; then a larger inner product with a query is
a smaller distance to it. Each vector is keyed by its nearest pivot and its distance to it. A pivot's vectors, sorted by
distance, fall into RINGS annuli; by the triangle inequality a query at distance d of the pivot is at least
max(d - outer, inner - d) from all in an annulus, which bounds their inner products. Each query starts with the k-th best score among
the sample that the pivots were fitted on, visits its most promising annuli, which raises that score, and then expands
all others whose bound reaches it; the rest can't hold a result. Inside an annulus the same bound cuts its sorted rows.

The pivots are fitted on at most SAMPLE vectors, chosen by a hash of their ids; every vector is indexed. Pivots grow with the
cube root of the rows, up to an eighth of the sample. An annulus is dealt to slices of some SLICE chunks, each a key of its own
in the join, so one of any size is spread over tasks. Only pivots, annuli and the sample, all of bounded size, are sent to tasks
whole. Vectors are stored with a number for each row before anything else, so that all steps mean the same row by it.

Defined results: vectors that are null, hold null or non-finite components, or have a null id take no part; shorter ones are
padded with zeros; a repeated row is a candidate for its twin; ties go to the smaller vec_id; an empty table gives an
empty result; only vec_id and embedding are read. Sums stay exact: past 2**53 they are taken in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyband.llm.common import BROADCAST_TAGS, mapped, row_tag, work_table

SAMPLE = 4096
PIVOTS = 32
RINGS = 8
CHUNK = 2048
#: Chunks of a slice.
SLICE = 8
#: Annuli that each query visits before the others are bounded.
FIRST = 2
#: Queries taken together.
GROUP = 512


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """tag, vec_id, v: components as whole numbers (array of double)."""
    value = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(row_tag(), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select("tag", "vec_id", value.alias("v"))


@dataclass(frozen=True)
class Index:
    """What tasks need of the index besides its rows. norm2: the largest squared norm; pivots have the added coordinate."""

    dim: int
    norm2: float
    pivots: np.ndarray
    sample: np.ndarray
    sample_tags: np.ndarray
    bounds: np.ndarray | None = None
    inner: np.ndarray | None = None
    outer: np.ndarray | None = None
    slices: np.ndarray | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.norm2 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries, whose added coordinate is zero, to the pivots."""
        square = (q * q).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * q @ self.pivots[:, :-1].T
        return np.sqrt(np.maximum(0, square))

    def best_possible(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the inner products of each query with each annulus (pivot-major)."""
        d = np.repeat(self.query_distances(q), RINGS, axis=1)
        gap = np.maximum(0, np.maximum(d - self.outer[None, :], self.inner[None, :] - d))
        size = (q * q).sum(axis=1)[:, None] + self.norm2
        bound = (size - gap**2) / 2 + 1e-6 * size + 1e-3
        return np.where(np.isfinite(self.inner)[None, :], bound, -np.inf)  # annuli without rows


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), dim))
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def fit_pivots(x: np.ndarray, count: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Centres of at most `count` clusters of x."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    centres = x[: max(1, min(count, len(x)))].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def _fit(rows: DataFrame) -> Index | None:
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, dim, norm2 = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(size)).first()
    if not n:
        return None
    share = min(1.0, 0.9 * SAMPLE / n)
    picked = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000))).limit(SAMPLE).toArrow()
    sample = _matrix(picked.column("v").combine_chunks(), dim) if picked.num_rows else np.zeros((0, dim))
    order = np.argsort(picked.column("tag").to_numpy()) if picked.num_rows else np.empty(0, np.int64)
    found = Index(dim, norm2, np.zeros((1, dim + 1)), sample[order], picked.column("tag").to_numpy()[order] if picked.num_rows else order)
    if len(sample):
        found = Index(dim, norm2, fit_pivots(found.lifted(found.sample), min(SAMPLE // 8, max(PIVOTS, round(n ** (1 / 3))))), found.sample, found.sample_tags)
    return found


def _assign(shared: Broadcast):
    """Nearest pivot and distance of each vector, its components packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), index.dim)
            lifted = index.lifted(x)
            square = (lifted**2).sum(axis=1)[:, None] + (index.pivots**2).sum(axis=1)[None, :] - 2 * lifted @ index.pivots.T
            near = square.argmin(axis=1)
            far = np.sqrt(np.maximum(0, square[np.arange(len(x)), near]))
            columns = [batch.column("tag"), batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(far), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["tag", "vec_id", "pivot", "dist", "v"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one slice of an annulus together, sorted by distance, up to CHUNK in a chunk."""
    held: list[tuple] = []

    def chunk() -> pa.RecordBatch:
        key = held[0][:3]
        packed = [np.array([h[k] for h in held], t).tobytes() for k, t in ((3, np.float64), (4, np.int64), (5, np.int64))]
        values = [*key, *packed, b"".join(h[6] for h in held)]
        kinds = [*[pa.int32()] * 3, *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["pivot", "ring", "slice", "dists", "ids", "tags", "data"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("pivot", "ring", "slice", "dist", "vec_id", "tag", "v")), strict=True):
            if held and (held[0][:3] != row[:3] or len(held) == CHUNK):
                yield chunk()
                held = []
            held.append(row)
    if held:
        yield chunk()


def build(rows: DataFrame, index: Index) -> tuple[DataFrame, DataFrame, Index]:
    """The packed vectors, the chunks of all annuli, and the index with its annuli's bounds."""
    sc = rows.sparkSession.sparkContext
    packed = work_table(mapped(rows, _assign(sc.broadcast(index)), "tag long, vec_id long, pivot int, dist double, v binary"), "pivot-vectors")
    cuts = [k / RINGS for k in range(1, RINGS)]
    bounds = np.full((len(index.pivots), RINGS - 1), np.inf)
    for pivot, at in packed.groupBy("pivot").agg(F.percentile_approx("dist", cuts, 1000)).collect():  # a row a pivot
        bounds[pivot] = at
    table = F.array(*(F.array(*(F.lit(float(b)) for b in own)) for own in bounds))
    ring = F.size(F.filter(F.get(table, F.col("pivot")), lambda b: F.col("dist") > b))
    keyed = packed.withColumn("ring", ring)
    inner, outer = np.full(len(index.pivots) * RINGS, np.inf), np.full(len(index.pivots) * RINGS, -np.inf)
    slices = np.zeros(len(inner), np.int64)
    for pivot, k, low, high, n in keyed.groupBy("pivot", "ring").agg(F.min("dist"), F.max("dist"), F.count(F.lit(1))).collect():  # a row an annulus
        at = pivot * RINGS + k
        inner[at], outer[at], slices[at] = low, high, -(-n // (SLICE * CHUNK))
    of_annulus = F.get(F.array(*map(F.lit, slices.tolist())), F.col("pivot") * RINGS + F.col("ring"))
    keyed = keyed.withColumn("slice", F.pmod(F.xxhash64("tag"), of_annulus).cast("int"))
    order = ["pivot", "ring", "slice", "dist", "vec_id", "tag"]
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = work_table(mapped(sorted_rows, _chunks, "pivot int, ring int, slice int, dists binary, ids binary, tags binary, data binary"), "pivot-chunks")
    return packed, chunks, Index(index.dim, index.norm2, index.pivots, index.sample, index.sample_tags, bounds, inner, outer, slices)


def _visits(shared: Broadcast, k: int, first: bool):
    """Rows (pivot, ring, slice, queries that visit it with their least score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                q = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(-1, index.dim)
                tags, ids = batch.column("tag").to_numpy(), batch.column("vec_id").to_numpy()
                if first:
                    least = np.full(len(q), -(2**63), np.int64)
                    if len(index.sample) > k:
                        scores = products(q, index.sample)
                        scores[index.sample_tags[None, :] == tags[:, None]] = -(2**63)
                        least = np.partition(scores, -k, axis=1)[:, -k]
                else:
                    least = batch.column("least").to_numpy()
                bound = index.best_possible(q)
                top = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, top, True, axis=1)
                visit = (bound >= least[:, None]) & (early if first else ~early)
                out = []
                for a in np.flatnonzero(visit.any(axis=0)).tolist():
                    own = visit[:, a]
                    packed = [x[own].tobytes() for x in (tags, ids, least, q)]
                    out += [(a // RINGS, a % RINGS, k, *packed) for k in range(int(index.slices[a]))]
                if out:
                    kinds = [*[pa.int32()] * 3, *[pa.binary()] * 4]
                    names = ["pivot", "ring", "slice", "q_tags", "q_ids", "q_least", "q_data"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


VISIT = "pivot int, ring int, slice int, q_tags binary, q_ids binary, q_least binary, q_data binary"
HIT = "q_tag long, query_id long, vec_id long, score long"


def _expand(shared: Broadcast, k: int):
    """The best k of each (queries, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            given = {c: batch.column(c) for c in batch.schema.names}
            for k_row in range(batch.num_rows):
                # read in place: a batch holds many matrices
                row = {c: x[k_row].as_buffer() for c, x in given.items() if c not in ("pivot", "ring", "slice")}
                tags, ids, least = (np.frombuffer(row[c], np.int64) for c in ("q_tags", "q_ids", "q_least"))
                q = np.frombuffer(row["q_data"], np.float64).reshape(-1, index.dim)
                dists = np.frombuffer(row["dists"], np.float64)
                d = index.query_distances(q)[:, given["pivot"][k_row].as_py()]
                reach = (q * q).sum(axis=1) + index.norm2
                reach = np.sqrt(np.maximum(0, reach - 2 * least.astype(np.float64) + 1e-6 * reach + 1e-3))
                low, high = np.searchsorted(dists, (d - reach).min(), "left"), np.searchsorted(dists, (d + reach).max(), "right")
                if low >= high:
                    continue
                x = np.frombuffer(row["data"], np.float64).reshape(-1, index.dim)[low:high]
                own, own_tags = np.frombuffer(row["ids"], np.int64)[low:high], np.frombuffer(row["tags"], np.int64)[low:high]
                scores = products(q, x)
                good = (scores >= least[:, None]) & (own_tags[None, :] != tags[:, None])
                where, which = np.nonzero(good)
                order = np.lexsort((own[which], -scores[where, which], where))
                where, which = where[order], which[order]
                place = np.arange(len(where)) - np.searchsorted(where, where, "left")
                where, which = where[place < k], which[place < k]
                if len(where):
                    columns = [tags[where], ids[where], own[which], scores[where, which]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q_tag", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all other rows. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    rows = work_table(quantised(vectors, scale), "pivot-rows")
    index = _fit(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    packed, chunks, index = build(rows, index)
    shared = spark.sparkContext.broadcast(index)
    queries = packed.filter(is_query).select("tag", "vec_id", "v")
    # queries that are searched together share what they read of an annulus
    queries = queries.coalesce(max(1, queries.count() // GROUP))
    place = F.row_number().over(Window.partitionBy("q_tag").orderBy(F.desc("score"), "vec_id"))

    def search(asked: DataFrame, first: bool) -> DataFrame:
        visits = mapped(asked, _visits(shared, k, first), VISIT)
        hits = mapped(visits.join(chunks, ["pivot", "ring", "slice"]), _expand(shared, k), HIT)
        return hits.withColumn("rank", place).filter(F.col("rank") <= k)

    early = work_table(search(queries, True), "pivot-early")
    # with k hits, the last of them; else no bound yet
    least = early.groupBy(F.col("q_tag").alias("tag")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    later = queries.join(F.broadcast(least) if early.count() <= BROADCAST_TAGS else least, "tag", "left")
    later = later.withColumn("least", F.coalesce("least", F.lit(-(2**63))))
    both = early.drop("rank").unionByName(search(later, False).drop("rank"))
    return both.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
