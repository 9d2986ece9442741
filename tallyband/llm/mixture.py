"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The tree is domain - language - source; weights are whole numbers for each node name of a level. The token budget goes
down the tree. Among siblings a node gets its share by weight but never more than its subtree can supply
(tokens x max_epochs); what it can't use goes to its siblings by weight, and only what all siblings together can't use
stays with the ancestors' siblings. A leaf with budget b and t tokens takes every document b div t times and then, of one more
epoch, the longest prefix that fits in b mod t tokens; each epoch's order is a seeded hash of the document's id.

No group is ordered in one task: prefixes are found over PREFIXES hash ranges of a leaf, and only the range in which the
budget ends is ordered row by row.

Defined results: null texts have no tokens; null or empty domain, language or source are nodes named ''; documents
without tokens come along in each whole epoch and in a prefix that reaches them; ties of the hash go by id;
a leaf without tokens gives none; an empty table gives an empty result; columns of docs that clash with working
columns are kept apart, since only id, text, lang and source are read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyband.llm.common import BROADCAST_TAGS, text_or_empty, work_table

#: Hash ranges of a leaf: three hexadecimal digits.
PREFIX_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """weights[level][name]: whole numbers; a name that isn't there has the weight 1. share: of all tokens, the budget in percent."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    share: int = 60
    max_epochs: int = 3
    seed: str = "mix-1"


#: Of production: English is to be half of each domain, and source 0 gets no more than others of its domain.
PRODUCTION = Mixture({"domain": {"d0": 3, "d1": 2, "d2": 2, "d3": 3}, "lang": {"en": 3, "de": 1, "fr": 1, "es": 1}})
LEVELS = ("domain", "lang", "source")


def domain_of(source: str) -> Column:
    """Sources are dealt to four domains by the number in their name; others are in domain ''."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.pmod(F.right(number, F.lit(9)).cast("int"), F.lit(4)).cast("string"))).otherwise("")


def _weight(spec: Mixture, level: str) -> Column:
    known = spec.weights.get(level)
    if not known:
        return F.lit(1).cast("long")
    out = F.lit(1)
    for name, weight in known.items():
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _share_out(nodes: DataFrame, parents: list[str], level: str, spec: Mixture) -> DataFrame:
    """Add `<level>_budget`: the parent's `budget` dealt out by weight, each within its `capacity`.

    Siblings are taken by capacity in proportion to weight. Those before the first whose share of the rest fits are
    filled; all later ones get their share of what is left.
    """
    nodes = nodes.withColumn("w", _weight(spec, level))
    order = [(F.col("capacity") / F.col("w")), F.col(level)]
    filled = Window.partitionBy(*parents, "budget").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents, "budget")
    nodes = nodes.withColumn("rest", F.col("budget") - F.coalesce(F.sum("capacity").over(filled), F.lit(0)))
    nodes = nodes.withColumn("rest_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(filled), F.lit(0)))
    # By the order above "fits" stays true once it is.
    fits = F.col("capacity") * F.col("rest_w") >= F.col("rest") * F.col("w")
    nodes = nodes.withColumn("fits", fits)
    level_rest = F.max(F.when(F.col("fits"), F.struct(F.col("rest"), F.col("rest_w")))).over(whole)
    nodes = nodes.withColumn("left", level_rest)
    share = F.expr("(left.rest * w) div left.rest_w")
    return nodes.withColumn("given", F.when(F.col("fits"), share).otherwise(F.col("capacity"))).drop("w", "rest", "rest_w", "fits", "left")


def leaf_budgets(leaves: DataFrame, spec: Mixture) -> DataFrame:
    """domain, lang, source, tokens, budget of each leaf, from its tokens. One row a leaf goes in."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    out = leaves.withColumn("capacity", F.col("tokens") * spec.max_epochs).withColumn("budget", F.lit(total * spec.share // 100).cast("long"))
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        path = [*parents, level]
        nodes = out.groupBy(*path, "budget").agg(F.sum("capacity").cast("long").alias("capacity"))
        nodes = _share_out(nodes, parents, level, spec).select(*path, "given")
        out = out.drop("budget").join(nodes, path).withColumnRenamed("given", "budget")
    return out.select(*LEVELS, "tokens", "budget")


def tree_columns() -> list[Column]:
    return [
        domain_of("source").alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
    ]


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the tree's columns and the number of words of each row."""
    return docs.select("doc_id", *tree_columns(), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("tokens"))


def _order(spec: Mixture) -> Column:
    """Place in the epoch that is cut short, the one after the whole ones; its number is part of the seed."""
    return F.md5(F.concat_ws(":", F.lit(spec.seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def plan_mixture(counted: DataFrame, spec: Mixture = PRODUCTION) -> DataFrame:
    """One row a leaf with tokens: domain, lang, source, tokens, budget, epochs, cutoff.

    The mixture takes each of its documents `epochs` times, and once more where the order is at most `cutoff`.
    """
    counted = work_table(counted, "mix-counted")
    leaves = work_table(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves", counted.count())
    many = leaves.count()
    budgets = leaf_budgets(leaves, spec).filter("tokens > 0")
    plan = work_table(budgets.select("*", F.expr("cast(budget div tokens as int)").alias("epochs"), F.expr("budget % tokens").alias("part")), "mix-budgets", many)
    ordered = counted.join(plan.select(*LEVELS, "epochs", "part"), list(LEVELS)).withColumn("order", _order(spec)).withColumn("range", F.substring("order", 1, PREFIX_DIGITS))
    sums = ordered.groupBy(*LEVELS, "part", "range").agg(F.sum("tokens").alias("range_tokens"))
    upto = F.sum("range_tokens").over(Window.partitionBy(*LEVELS).orderBy("range"))
    # The first range that the budget doesn't cover.
    ends = sums.withColumn("upto", upto).filter("upto > part").groupBy(*LEVELS, "part").agg(F.min(F.struct("range", (F.col("upto") - F.col("range_tokens")).alias("before"))).alias("at"))
    ends = work_table(ends.select(*LEVELS, F.col("at.range").alias("range"), F.col("at.before").alias("before")), "mix-ends", many)
    inside = ordered.join(ends, [*LEVELS, "range"]).withColumn("end", F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("order")))
    last = inside.filter("end <= part").groupBy(*LEVELS).agg(F.max("order").alias("last"))
    cut = ends.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "range").alias("cutoff"))
    return work_table(plan.join(cut, list(LEVELS)).drop("part"), "mix-plan", many)


def _beside(plan: DataFrame) -> DataFrame:
    """A stored plan as it is joined to rows: broadcast up to a checked number of leaves, so that rows aren't shuffled by leaf."""
    plan = plan.drop("tokens", "budget")
    return F.broadcast(plan) if plan.count() <= BROADCAST_TAGS else plan


def copies_in_mixture(docs: DataFrame, plan: DataFrame, spec: Mixture = PRODUCTION) -> DataFrame:
    """doc_id, domain, lang, source, epochs, copies of every row of docs; a leaf without a plan gives 0 copies."""
    rows = docs.select("doc_id", *tree_columns()).join(_beside(plan), list(LEVELS), "left")
    more = F.when(_order(spec) <= F.col("cutoff"), 1).otherwise(0)
    copies = F.coalesce(F.col("epochs") + more, F.lit(0)).cast("int")
    return rows.select("doc_id", *LEVELS, F.coalesce("epochs", F.lit(0)).cast("int").alias("epochs"), copies.alias("copies"))


def mixed(docs: DataFrame, spec: Mixture = PRODUCTION) -> DataFrame:
    """docs as the mixture has them: each row as often as its copies say; all columns as they were. Texts aren't shuffled, up to BROADCAST_TAGS leaves."""
    plan = plan_mixture(token_counts(docs), spec)
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select("doc_id", *tree_columns(), own).join(_beside(plan), list(LEVELS))
    more = F.when(_order(spec) <= F.col("cutoff"), 1).otherwise(0)
    rows = rows.withColumn("copies", (F.col("epochs") + more).cast("int")).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
