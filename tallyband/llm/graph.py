"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyband.llm.common import work_table

#: Keys with more rows are joined by a broadcast: at most MOST_HUBS keys, so that the bound grows with the table if need be.
HUB = 500
MOST_HUBS = 100_000


def spread_join(df: DataFrame, found: DataFrame, key: str, rows: int) -> DataFrame:
    """df joined to found, which has a row a key and in column n how many rows of df have it; n is dropped. rows: a bound of df's rows.

    Keys with so many rows that there can be no more than MOST_HUBS of them are broadcast, so no task gets all rows of one.
    """
    hub = F.col("n") > max(HUB, rows // MOST_HUBS)
    hubs, others = F.broadcast(found.filter(hub).drop("n")), found.filter(~hub).drop("n")
    keys = F.broadcast(found.filter(hub).select(key))
    return df.join(hubs, key).unionByName(df.join(keys, key, "left_anti").join(others, key))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges(a, b); root is the component's smallest node.

    Alternates two star steps: every larger neighbour of a node is tied to the smallest one, then every node and its
    smaller neighbours are. Each round is stored in the shared folder. Rounds grow with the logarithm of the nodes.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = work_table(edges, "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both.filter("b > a"), least, "a", state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = work_table(large, "edges-large", 2 * state[0])
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, low, "a", 2 * state[0]).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = work_table(after, "edges", 2 * state[0])  # in practice no more than before
        now = _state(after)
        edges = after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
