"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are taken in one Arrow pass (byte classes, repeated words, word shapes). Small trees are grown
on a bounded sample of labelled rows; every path from a root is a rule, a conjunction of bounds on statistics; a
logistic model with an L1 penalty gives most rules the weight zero, and those that stay are compiled into one Spark
column expression, which scores all rows in the JVM.

The sample has at most SAMPLE_ROWS labelled rows, chosen by a hash of their ids. If none is labelled, or all alike, the
score is the share of label 1 (0.5 without labels).

Defined results: null and empty texts have all statistics zero and get a score like others; rows with a null label aren't
learned from; of repeated ids in the labels each row counts; repeated documents get equal scores; an empty table
gives an empty result; only doc_id and text are read for scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyband.llm.common import give_back, mapped, remainder, text_or_empty

#: Bound of the labelled rows that the model is fitted on.
SAMPLE_ROWS = 4_000
KEEP_FROM = 0.7
STATISTICS = (
    "log_bytes",
    "letters",
    "upper",
    "digits",
    "symbols",
    "marks",
    "pipes",
    "commas_stops",
    "spaces",
    "log_lines",
    "mean_word",
    "distinct_words",
    "top_word",
    "shouted_words",
    "symbol_ends",
    "adjacent_repeats",
)


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[[ord(c) for c in characters]] = 1
    return out


#: Rows: classes of bytes; bytes from 128 on are parts of letters here.
_CLASSES = np.stack(
    [
        _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + (np.arange(256) >= 128),
        _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _class("0123456789"),
        _class("#$%&*@^~_=+<>{}[]\\/"),
        _class("!?"),
        _class("|"),
        _class(".,"),
        _class(" \t\r\n\v\f"),
    ]
)
_ENDS = tuple(bytes([c]) for c in b"#$%&*@^~_=+<>!|")


def statistics_of(data: bytes) -> list[float]:
    """The STATISTICS of one text in UTF-8; shares are of bytes or of words."""
    words = data.split()
    if not words:
        return [math.log1p(len(data)), *([0.0] * (len(STATISTICS) - 1))]
    shares = _CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    n = len(words)
    # distinct words fall with length in any text; Herdan's ratio doesn't
    distinct = math.log(len(counts) + 1) / math.log(n + 1)
    shouted = sum(map(bytes.isupper, words))
    ends = sum(word.endswith(_ENDS) for word in words)
    repeats = sum(map(bytes.__eq__, words[1:], words))
    return [
        math.log1p(len(data)),
        *shares.tolist(),
        math.log1p(data.count(b"\n")),
        sum(map(len, words)) / n,
        distinct,
        max(counts.values()) / n,
        shouted / n,
        ends / n,
        repeats / n,
    ]


#: Rows that go back to Spark in one batch with their texts.
ROWS_BACK = 1_000


def _rows_measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows, as a struct, beside their statistics."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_BACK):
            part = batch.slice(start, ROWS_BACK)
            data = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text"))
            values = np.array([statistics_of(x) for x in data]).reshape(-1, len(STATISTICS))
            row = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
            yield pa.RecordBatch.from_arrays([row, *(pa.array(values[:, k]) for k in range(len(STATISTICS)))], names=["row", *STATISTICS])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics_of(x.as_buffer().to_pybytes()) for x in batch.column("data")]).reshape(-1, len(STATISTICS))
        columns = [batch.column("doc_id"), *(pa.array(rows[:, k]) for k in range(len(STATISTICS)))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    return mapped(rows, _measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


# --- fitting ------------------------------------------------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]
"""Conditions (statistic, at most, bound); `at most` false means over the bound."""


def _paths(x: np.ndarray, residual: np.ndarray, depth: int, least: int, features: np.ndarray, path: Rule = ()) -> list[Rule]:
    """Rules of a regression tree: the paths to all its nodes but the root."""
    out = [path] if path else []
    if depth == 0 or len(x) < 2 * least:
        return out
    best = (0.0, -1, 0.0)
    total = residual.sum()
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        value = x[order, f]
        left = np.cumsum(residual[order])[:-1]
        n = np.arange(1, len(x))
        gain = left**2 / n + (total - left) ** 2 / (len(x) - n) - total**2 / len(x)
        gain[(n < least) | (len(x) - n < least) | (value[1:] == value[:-1])] = 0
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), int(f), float((value[k] + value[k + 1]) / 2))
    if best[1] < 0:
        return out
    _, f, bound = best
    low = x[:, f] <= bound
    out += _paths(x[low], residual[low], depth - 1, least, features, (*path, (f, True, bound)))
    return out + _paths(x[~low], residual[~low], depth - 1, least, features, (*path, (f, False, bound)))


def _applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_most, bound in rule:
        out &= (x[:, f] <= bound) == at_most
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.2, seed: int = 7) -> list[Rule]:
    """Rules of boosted trees, each on half of the rows and of the statistics."""
    rng = np.random.default_rng(seed)
    score = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        rows = rng.random(len(y)) < 0.5
        features = np.sort(rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)])
        residual = y - 1 / (1 + np.exp(-score))
        paths = _paths(x[rows], residual[rows], depth, max(5, len(y) // 400), features)
        prefixes = {p[:k] for p in paths for k in range(1, len(p))}
        for path in paths:
            rules[path] = None
            if path not in prefixes:
                own = _applies(path, x)
                if own.any():
                    p = 1 / (1 + np.exp(-score[own]))
                    score[own] += rate * (y[own] - p).sum() / ((p * (1 - p)).sum() + 1)
    return list(rules)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + penalty * sum |weight| (accelerated proximal gradient)."""
    n, k = x.shape
    weights, momentum, bias, bias_momentum, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    vector = np.ones(k)
    for _ in range(30):  # largest eigenvalue of x'x, for the step's length
        vector = x.T @ (x @ vector)
        vector /= np.linalg.norm(vector) or 1
    step = 1 / (0.25 * (np.linalg.norm(x @ vector) ** 2 / n + 1) * 1.05)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ momentum + bias_momentum))) - y
        new = momentum - step * (x.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = bias_momentum - step * error.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        momentum = new + (t - 1) / t_new * (new - weights)
        bias_momentum = new_bias + (t - 1) / t_new * (new_bias - bias)
        done = np.abs(new - weights).max(initial=0) < 1e-6 and abs(new_bias - bias) < 1e-6
        weights, bias, t = new, new_bias, t_new
        if done:
            break
    return weights, bias


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def logit(self) -> Column:
        """The model as a column expression over the STATISTICS."""
        out = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for f, at_most, bound in rule:
                column = F.col(STATISTICS[f])
                test &= (column <= F.lit(bound)) if at_most else (column > F.lit(bound))
            out += F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return out

    def described(self) -> list[str]:
        """The rules in words, heaviest first."""
        order = sorted(range(len(self.rules)), key=lambda k: -abs(self.weights[k]))
        return [f"{self.weights[k]:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'<=' if m else '>'} {b:.4g}" for f, m, b in self.rules[k]) for k in order]


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return RuleModel((), (), math.log(share / (1 - share)))
    rules = grow_rules(x, y)
    if not rules:
        return RuleModel((), (), math.log(y.mean() / (1 - y.mean())))
    columns: dict[bytes, Rule] = {}  # of rules that hold for the same rows the shortest is enough
    for rule in sorted(rules, key=len):
        columns.setdefault(np.packbits(_applies(rule, x)).tobytes(), rule)
    rules = list(columns.values())
    weights, bias = lasso_logistic(np.stack([_applies(r, x) for r in rules], axis=1).astype(np.float64), y)
    kept = np.flatnonzero(weights)
    return RuleModel(tuple(rules[k] for k in kept), tuple(float(weights[k]) for k in kept), float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, quality: labelled rows outside the held-out part, at most `most`.

    A hash of the id picks them: of n labelled rows a share of most / n, so that the sample is spread over all.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(4) != 2)).select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    n = known.count()
    share = min(1.0, 0.95 * most / max(n, 1))
    picked = known.filter(F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(1_000_000)) < F.lit(round(share * 1_000_000))).limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # at most `most` rows


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> RuleModel:
    """Learn from the statistics of at most `most` labelled rows, which come to the driver as numbers."""
    sample = training_rows(docs, labels, most)
    rows = sample.select(F.col("quality").cast("long").alias("doc_id"), "text")  # the label takes the id's place: statistics() hands it on
    table = statistics(rows).limit(2 * most).toArrow()
    y = table.column("doc_id").to_numpy().astype(np.float64)
    x = np.stack([table.column(s).to_numpy() for s in STATISTICS], axis=1) if len(y) else np.empty((0, len(STATISTICS)))
    order = np.lexsort((*x.T, y))  # the same model whichever order the rows came in
    model = fit_rules(x[order], y[order])
    give_back()
    return model


def score(docs: DataFrame, model: RuleModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, score, predicted of every row."""
    scored = statistics(docs).select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-model.logit()))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= keep_from, 1).otherwise(0))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned from docs and labels."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that the classifier doesn't reject; all columns as they were, text a string. One pass: rows carry their statistics to the filter, so nothing is stored, shuffled or joined."""
    model = fit(docs, labels)
    schema = StructType([StructField("row", docs.schema), *(StructField(s, DoubleType()) for s in STATISTICS)])
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.logit()))
    return mapped(docs, _rows_measured, schema).filter(score >= keep_from).select("row.*")
