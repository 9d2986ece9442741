"""The trie of conversations by their turns, with totals of every subtree by parallel tree contraction.

Conversations are rebuilt first: the first turns of a base conversation, then their own. A prefix is known by its depth and two
polynomial hashes modulo 2^61 - 1 of its turns' digests; hashes of that kind are running sums, so a conversation of any
length is split over tasks. Equal prefixes are a node, made by an aggregate.

Subtree totals (leaves, tokens saved) come from contraction. Rake: every leaf gives its total to its parent and goes, with its total
logged. Compress: nodes with one child are a chain; of those, every one whose throw is below both neighbours' is
taken out, its child tied to its parent, and what lay between is logged. Rounds alternate until the root is left; their number grows with
the logarithm of the nodes, also for a trie that is one long chain. Then the rounds are taken back, last one first: a node
that was taken out has its child's total and what lay between. Each round is a stored table.

No join meets a hot key: sums over children are aggregated first, and parents are joined to children by graph.spread_join.
The digest of a node's ends needs its ids in one sequence: they arrive as joined pieces of up to a bucket's ids each and are
hashed as a stream, so memory stays bounded.

Defined results: rows without conv_id belong to no conversation; equal turn numbers are ordered by role, then by the text's first
HEAD characters, then by a hash of the text; repeated rows are turns of their own; an empty table gives an empty result; only
conv_id, turn, role and text are read. The remainder of a negative id has its sign.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyband.llm.common import mapped, row_tag, text_or_empty, work_table
from tallyband.llm.graph import spread_join
from tallyband.operators.prefix import BUCKET, bucketed, running

#: A conversation's base is the one at the start of its block of so many; it takes fewer than MOST_SHARED turns of it.
BLOCK, MOST_SHARED = 5, 9
HEAD = 64
#: Fixed values of the hashes: the modulus and two factors.
MODULUS = 2**61 - 1
FACTORS = (1_237_940_039_285_380_274, 2_011_986_351_402_771_713)
WEIGHTS = ("n_leaves", "saved_tokens")


def shared_turns() -> Column:
    """How many turns of its base a conversation starts with."""
    return F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (from 1), x0, x1 (digests), n_bytes of every turn, stored."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    number = lambda first: F.conv(F.substring(digest, first, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.left(text, F.lit(HEAD)).alias("head"),
        number(1).alias("x0"), number(16).alias("x1"), F.octet_length(text).cast("long").alias("n_bytes"), row_tag(),
    ).filter("conv_id IS NOT NULL")
    rows = work_table(rows, "turns")
    order = ["conv_id", "turn", "role", "head", "x0", "tag"]
    return work_table(running(rows, order, {"k": ("count", F.lit(1))}, ["conv_id"]).select("conv_id", "k", "x0", "x1", "n_bytes"), "numbered-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, shared, length), and their turns (conv_id, pos, x0, x1, n_bytes) as rebuilt."""
    n_turns = turns.count()
    sizes = work_table(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversation-sizes")
    convs = sizes.select("conv_id", "n", shared_turns().alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "n", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = work_table(convs, "conversations")
    # a base has fewer than MOST_SHARED such turns and BLOCK conversations at most
    first = turns.filter(F.col("k") < MOST_SHARED).withColumnRenamed("conv_id", "base")
    borrowed = first.join(convs.select("base", "conv_id", "shared"), "base").filter("k <= shared").select("conv_id", F.col("k").alias("pos"), "x0", "x1", "n_bytes")
    own = spread_join(turns, convs.select("conv_id", "h", "shared", "n"), "conv_id", n_turns).filter("k > h")
    own = own.select("conv_id", (F.col("k") - F.col("h") + F.col("shared")).alias("pos"), "x0", "x1", "n_bytes")
    return convs, borrowed.unionByName(own)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's part of both hashes: digest times factor to the power of its place."""
    for batch in batches:
        place = batch.column("pos").to_pylist()
        terms = [pa.array([x * pow(b, p, MODULUS) % MODULUS for x, p in zip(batch.column(c).to_pylist(), place, strict=True)], pa.int64()) for c, b in zip(("x0", "x1"), FACTORS, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("pos"), *terms, batch.column("n_bytes")], names=["conv_id", "pos", "t0", "t1", "n_bytes"])


def _key(depth: Column, *hashes: Column) -> Column:
    return F.struct(depth.cast("long").alias("depth"), *(h.alias(f"h{k}") for k, h in enumerate(hashes)))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, n_bytes, key and up (the keys of the prefix that ends there and of the one before), stored."""
    terms = work_table(mapped(turns, _terms, "conv_id long, pos long, t0 long, t1 long, n_bytes long"), "turn-terms")
    sums = {f"s{k}": ("sum", F.col(f"t{k}").cast("decimal(20,0)")) for k in (0, 1)}
    rows = running(terms, ["conv_id", "pos"], sums, ["conv_id"])
    whole = [F.pmod(F.col(f"s{k}").cast("decimal(38,0)"), F.lit(MODULUS).cast("decimal(38,0)")).cast("long") for k in (0, 1)]
    rows = rows.select("conv_id", "pos", "n_bytes", "t0", "t1", *(h.alias(f"h{k}") for k, h in enumerate(whole)))
    before = [F.pmod(F.col(f"h{k}") - F.col(f"t{k}"), F.lit(MODULUS)) for k in (0, 1)]
    return work_table(rows.select("conv_id", "pos", "n_bytes", _key(F.col("pos"), F.col("h0"), F.col("h1")).alias("key"), _key(F.col("pos") - 1, *before).alias("up")), "prefixes")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a node: key, v (depth and smallest member), p (the parent's v), n_convs, n_bytes, n_children; stored."""
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(_key(zero, zero, zero).alias("key"), F.lit(None).cast(rows.schema["up"].dataType).alias("up"), "conv_id", "n_convs", zero.alias("n_bytes"))
    found = rows.groupBy("key").agg(F.first("up").alias("up"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("n_bytes").alias("n_bytes"))
    nodes = work_table(root.unionByName(found).select("key", "up", F.struct(F.col("key.depth").alias("depth"), F.col("conv_id").alias("conv_id")).alias("v"), "n_convs", "n_bytes"), "trie-nodes")
    children = nodes.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    children = work_table(nodes.select("key", F.col("v").alias("p")).join(children, "key"), "trie-parents")
    parents = spread_join(nodes.filter("up IS NOT NULL").select(F.col("key").alias("own"), F.col("up").alias("key")), children, "key", nodes.count())
    # keys are unique on both sides
    out = nodes.join(parents.select(F.col("own").alias("key"), "p"), "key", "left").join(children.select("key", F.col("n").alias("n_children")), "key", "left")
    return work_table(out.select("key", "v", "p", "n_convs", "n_bytes", F.coalesce("n_children", zero).alias("n_children")), "trie")


def subtree_sums(nodes: DataFrame, weights: tuple[str, ...], most_rounds: int = 200) -> DataFrame:
    """v and, for each column of weights (long), its sum over v's subtree. nodes: v, p (the parent's v, null at a root) and the weights."""
    zero = F.lit(0).cast("long")
    children = nodes.filter("p IS NOT NULL").groupBy(F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # n: how many children are left; <weight>_up: what lies between the node and its parent
    state = work_table(nodes.join(children, "v", "left").select("v", "p", F.coalesce("n", zero).alias("n"), *weights, *(zero.alias(f"{w}_up") for w in weights)), "contracted")
    left = state.count()
    raked: list[DataFrame] = []
    taken: list[DataFrame] = []
    while left:
        if len(raked) == most_rounds:
            raise RuntimeError(f"the tree was not contracted in {most_rounds} rounds")
        # rake: leaves give their totals, and what lies above them, to their parents
        leaves = state.filter("n = 0")
        raked.append(leaves.select("v", *weights))
        given = leaves.filter("p IS NOT NULL").groupBy(F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(F.col(w) + F.col(f"{w}_up")).alias(f"__{w}") for w in weights))
        inner = state.filter("n > 0").join(given, "v", "left")
        more = [(F.col(w) + F.coalesce(f"__{w}", zero)).alias(w) for w in weights]
        state = work_table(inner.select("v", "p", (F.col("n") - F.coalesce("__n", zero)).alias("n"), *more, *(f"{w}_up" for w in weights)), "contracted", left)
        left = state.count()
        if not left:
            break
        # compress: a node with one child goes if its throw is below its child's and its parent's, so no two neighbours go at once
        throw = lambda v, k=len(raked): F.xxhash64(F.lit(k), v)
        chain = state.filter("n = 1 AND p IS NOT NULL").filter(throw(F.col("v")) < throw(F.col("p")))
        child = state.filter("p IS NOT NULL").groupBy(F.col("p").alias("v")).agg(F.min("v").alias("c"), *(F.min(f"{w}_up").alias(f"__{w}") for w in weights))
        gone = chain.join(child, "v").filter(throw(F.col("v")) < throw(F.col("c")))
        gone = gone.select("v", "p", "c", *((F.col(w) + F.col(f"__{w}")).alias(w) for w in weights), *(f"{w}_up" for w in weights))
        gone = work_table(gone, "taken-out", left)
        if gone.isEmpty():
            continue
        taken.append(gone.select("v", "c", *weights))
        tied = gone.select(F.col("c").alias("v"), F.col("p").alias("__p"), *((F.col(w) + F.col(f"{w}_up")).alias(f"__{w}") for w in weights))
        rest = state.join(gone.select("v"), "v", "left_anti").join(tied, "v", "left")
        up = [F.when(F.col("__p").isNotNull(), F.col(f"__{w}")).otherwise(F.col(f"{w}_up")).alias(f"{w}_up") for w in weights]
        state = work_table(rest.select("v", F.coalesce("__p", "p").alias("p"), "n", *weights, *up), "contracted", left)
    # expand: the child of a node that was taken out lasted longer than the node
    known = nodes.limit(0).select("v", *weights)
    for more in raked:
        known = known.unionByName(more)
    for gone in reversed(taken):
        below = known.select(F.col("v").alias("c"), *(F.col(w).alias(f"__{w}") for w in weights))
        known = known.unionByName(work_table(gone.join(below, "c").select("v", *((F.col(w) + F.col(f"__{w}")).alias(w) for w in weights)), "expanded"))
    return known


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order, comma-joined."""
    at, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["depth", "conv_id", "ends_sha256"])

    for batch in batches:
        for depth, conv_id, piece in zip(batch.column("depth").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("piece"), strict=True):
            if at == (depth, conv_id):
                digest.update(b",")
            else:
                if at is not None:
                    yield row()
                at, digest = (depth, conv_id), hashlib.sha256()
            digest.update(piece.as_py().encode())
    if at is not None:
        yield row()


def ends(convs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """v and the digest of the conversations that end there."""
    zero = F.lit(0).cast("long")
    last = rows.join(convs.select("conv_id", F.col("length").alias("pos")), ["conv_id", "pos"]).select("conv_id", "key")
    last = last.unionByName(convs.filter("length = 0").select("conv_id", _key(zero, zero, zero).alias("key")))
    dealt = bucketed(work_table(last, "ends"), ["conv_id"])
    # a bucket has a bounded number of ids, so a node's piece of it is bounded too
    pieces = dealt.groupBy("key", BUCKET).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
    named = nodes.select("key", "v").join(pieces, "key").select("v.depth", "v.conv_id", BUCKET, "piece")
    named = named.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", BUCKET)
    out = mapped(named.select("depth", "conv_id", "piece"), _streamed, "depth long, conv_id long, ends_sha256 string")
    return out.select(F.struct("depth", "conv_id").alias("v"), "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    convs, turns = rebuilt(numbered_turns(conversations))
    rows = prefixes(turns)
    nodes = trie(convs, rows)
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    sums = subtree_sums(nodes.select("v", "p", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens")), WEIGHTS)
    out = nodes.join(sums, "v").join(ends(convs, rows, nodes), "v", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("v.conv_id", "v.depth", F.col("p.conv_id").alias("parent_conv_id"), "n_convs", "n_children", *WEIGHTS, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
