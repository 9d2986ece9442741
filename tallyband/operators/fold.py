"""Folds: values that are made from their own last ones, row by row; and aggregates of the user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyband.operators.prefix import BUCKET, ROWS_PER_BUCKET, bucketed, join_same, running
from tallyband.shipping import ship
from tallyband.storage import stored

#: States that a task of user_aggregate() holds before it hands them on.
MOST_STATES = 100_000
NAN = float("nan")


def _with(fields: Sequence[T.StructField], name: str, kind: str) -> T.StructType:
    return T.StructType([*fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def _type(kind: str) -> pa.DataType:
    return to_arrow_type(T.StructType.fromDDL(f"x {kind}").fields[0].dataType)


def string_fold(df: DataFrame, piece: Column, order: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Add the pieces of the group's rows so far, joined. NULL pieces add nothing. The group's last row holds all of them, so they must fit one string."""
    rows = df.withColumn("__piece", F.coalesce(piece, F.lit("")))
    whole = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "__piece"))).alias("__all"))
    whole = whole.withColumn("__all", F.array_join(F.transform("__all", lambda x: x["__piece"]), ""))
    rows = running(rows, order, {"__length": ("sum", F.length("__piece"))}, by)
    return join_same(rows, whole, by, ["__all"]).withColumn(name, F.left("__all", F.col("__length").cast("int"))).drop("__piece", "__length", "__all")


@dataclass(frozen=True)
class Maps:
    """What makes a fold divisible: each value is a map of the last result, and maps compose.

    of(value): its map, as a list; then(a, b): first a, then b; apply(x, map): the result after it. kind: the SQL type of a map.
    """

    of: Callable[[object], list]
    then: Callable[[list, list], list]
    apply: Callable[[object, list], object]
    kind: str


def affine(times: int, modulus: int) -> Maps:
    """Of x -> (x * times + value) modulo modulus."""
    return Maps(
        lambda v: [times % modulus, v % modulus],
        lambda a, b: [a[0] * b[0] % modulus, (a[1] * b[0] + b[1]) % modulus],
        lambda x, m: (x * m[0] + m[1]) % modulus,
        "array<bigint>",
    )


def clamped(low: int, high: int) -> Maps:
    """Of x -> x + value, held between low and high: such a map is an addition held between two bounds, and so are two in a row."""

    def held(x: int, a: int, b: int) -> int:
        return max(a, min(b, x))

    return Maps(
        lambda v: [v or 0, low, high],
        lambda a, b: [a[0] + b[0], held(a[1] + b[0], b[1], b[2]), held(a[2] + b[0], b[1], b[2])],
        lambda x, m: held(x + m[0], m[1], m[2]),
        "array<bigint>",
    )


def best(better: Callable[[object, object], object], kind: str) -> Maps:
    """Of x -> better(x, value), where better picks one of the two: max or min."""
    return Maps(lambda v: [v], lambda a, b: [better(a[0], b[0])], lambda x, m: better(x, m[0]), f"array<{kind}>")


def machine(states: Sequence[object], step: Callable[[object, object], object]) -> Maps:
    """Of a step over few states, whatever it does: its map is a table of where each state goes."""
    number = {s: k for k, s in enumerate(states)}
    return Maps(lambda v: [number[step(s, v)] for s in states], lambda a, b: [b[k] for k in a], lambda x, m: states[m[number[x]]], "array<int>")


def _runs(batch: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple[int, int, tuple]]:
    """Stretches of rows with equal keys: from, to, keys. NULL and NaN equal themselves."""
    n = batch.num_rows
    cut = np.zeros(max(0, n - 1), bool)
    for k in by:
        numbers = pc.fill_null(pc.dictionary_encode(batch.column(k), null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
        cut |= numbers[1:] != numbers[:-1]
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    columns = [batch.column(k) for k in by]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if low < high:
            yield low, high, tuple(NAN if (x := c[low].as_py()) != x else x for c in columns)


def _keys_of(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple]:
    """The keys of each row; all NaN are one, and so are both zeros."""
    columns = []
    for k in keys:
        own = batch.column(k)
        columns.append([None if x is None else NAN if x != x else x + 0.0 for x in own.to_pylist()] if pa.types.is_floating(own.type) else own.to_pylist())
    return list(zip(*columns, strict=True)) if columns else [()] * batch.num_rows


def running_fold(
    df: DataFrame, step: Callable[[object, object], object], first: object, value: str, order: Sequence[str], by: Sequence[str], name: str, kind: str, maps: Maps | None = None, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add step(step(first, value 1), value 2).. for each row of its group; NULL values are given to step as None.

    Rows are dealt to buckets by ranges of (by, order), so a group may hold any share of them, and by may be empty. A task goes through
    its buckets once, row by row. A group that crosses buckets needs what it has come to at each edge: with maps every
    bucket makes one composed map, all at once; without them the result is handed on from bucket to bucket, in as many rounds
    as the longest group has buckets.
    """
    ship(df.sparkSession)
    schema = _with(df.schema.fields, name, kind)
    rows = bucketed(df, [*by, *order], rows_per_bucket)
    at = [BUCKET, *by]
    arrow = _type(kind)

    def folded(starts: dict) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, x = None, first
            for batch in batches:
                values, out = batch.column(value).to_pylist(), []
                for low, high, own in _runs(batch, at):
                    if own != key:
                        x = starts.get(own[0], first) if key is None or key[0] != own[0] else first
                        key = own
                    for v in values[low:high]:
                        x = step(x, v)
                        out.append(x)
                kept = batch.drop_columns([BUCKET])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, arrow)], names=[*kept.schema.names, name])

        return run

    narrow = rows.select(*dict.fromkeys([BUCKET, *by, *order, value]))
    starts = _starts_by_maps(narrow, maps, first, value, order, by) if maps else _starts_in_rounds(narrow, folded, first, name, kind, order, by)
    return rows.select(*df.columns, BUCKET).sortWithinPartitions(*at, *order).mapInArrow(folded(starts), schema)


def _starts_by_maps(rows: DataFrame, maps: Maps, first: object, value: str, order: Sequence[str], by: Sequence[str]) -> dict:
    """What the first group of each bucket has come to in the buckets before it, where it began in one of them."""
    kind = _type(maps.kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened, whole = None, None, None

        def edge(batch: pa.RecordBatch) -> pa.RecordBatch:
            types = [batch.schema.field(k).type for k in by]
            sides = [pa.array([x], t) for side in (opened[1:], key[1:]) for x, t in zip(side, types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), *sides, pa.array([whole], kind)], names=names)

        for batch in batches:
            values = batch.column(value).to_pylist()
            for low, high, own in _runs(batch, [BUCKET, *by]):
                if own != key:
                    if key is None or own[0] != key[0]:
                        if key is not None:
                            yield edge(batch)
                        opened = own
                    key, whole = own, None
                for v in values[low:high]:
                    m = maps.of(v)
                    whole = m if whole is None else maps.then(whole, m)
            last = batch
        if key is not None:
            yield edge(last)

    names = ["bucket", *(f"first_{k}" for k in range(len(by))), *(f"last_{k}" for k in range(len(by))), "whole"]
    fields = [rows.schema[k] for k in by] * 2
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(n, f.dataType) for n, f in zip(names[1:-1], fields, strict=True)), *T.StructType.fromDDL(f"whole {maps.kind}").fields])
    edges = sorted(rows.sortWithinPartitions(BUCKET, *by, *order).mapInArrow(run, schema).collect(), key=lambda r: r["bucket"])  # a row a bucket
    starts, last, reached = {}, None, first
    for row in edges:
        sides = [NAN if x != x else x for x in row[1:-1]]
        opened, closed = sides[: len(by)], sides[len(by) :]
        goes_on = last is not None and opened == last
        if goes_on:
            starts[row["bucket"]] = reached
        whole = list(row["whole"])
        reached = maps.apply(reached if goes_on and opened == closed else first, whole)
        last = closed
    return starts


def _starts_in_rounds(rows: DataFrame, folded: Callable, first: object, name: str, kind: str, order: Sequence[str], by: Sequence[str]) -> dict:
    """The same for steps that don't compose. The rows of groups that cross buckets are stored by bucket; each round reads those whose start is known."""
    key = F.struct(*by) if by else F.lit(1)
    sizes = rows.groupBy(BUCKET).agg(F.min(key).alias("opened"), F.max(key).alias("closed")).collect()  # a row a bucket
    sizes.sort(key=lambda r: r[BUCKET])
    same = lambda a, b: [NAN if x != x else x for x in (a if by else [a])] == [NAN if x != x else x for x in (b if by else [b])]
    goes_on = {b[BUCKET]: same(a["closed"], b["opened"]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)}
    if not any(goes_on.values()):
        return {}
    single = {r[BUCKET]: same(r["opened"], r["closed"]) for r in sizes}
    after = {a[BUCKET]: b[BUCKET] for a, b in zip(sizes[:-1], sizes[1:], strict=True)}
    needed = [a for a, b in after.items() if goes_on[b]]
    last_keys = F.broadcast(rows.sparkSession.createDataFrame([(r[BUCKET], r["closed"]) for r in sizes if r[BUCKET] in needed], T.StructType([T.StructField("__b", T.IntegerType()), T.StructField("__closed", rows.select(key.alias("k")).schema["k"].dataType)])))
    edge = rows.join(last_keys, (F.col(BUCKET) == F.col("__b")) & key.eqNullSafe(F.col("__closed"))).drop("__b", "__closed")
    table = stored(edge, "fold-edges", by=BUCKET)
    schema = _with(table.schema.fields, name, kind)
    plain = T.StructType([f for f in schema.fields if f.name != BUCKET])
    starts: dict = {}
    ready = [b for b in needed if not (goes_on.get(b) and single[b])]
    while ready:
        mine = table.filter(F.col(BUCKET).isin(ready)).repartition(len(ready), BUCKET).sortWithinPartitions(BUCKET, *by, *order)
        known = {b: starts[b] for b in ready if b in starts and single[b]}
        out = mine.withColumn("__of", F.col(BUCKET)).mapInArrow(folded(known), T.StructType([*plain.fields[:-1], T.StructField("__of", T.IntegerType()), plain.fields[-1]]))
        ends = out.groupBy("__of").agg(F.max_by(name, F.struct(*order)).alias("end")).collect()  # a row a bucket
        found = {after[r["__of"]]: r["end"] for r in ends}
        starts |= found
        ready = [b for b in found if b in needed and single[b]]
    return starts


def iterate(df: DataFrame, initial: Column, growth: Column, order: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Add initial * growth(1) * growth(2) .. of the group, growth over zero: a fold by multiplication is a running sum of logarithms."""
    return running(df.withColumn("__ln", F.ln(growth)), order, {"__sum": ("sum", F.col("__ln"))}, by).withColumn(name, initial * F.exp("__sum")).drop("__ln", "__sum")


def user_aggregate(df: DataFrame, keys: Sequence[str], value: str, start: Callable[[], list], step: Callable[[list, object], list], merge: Callable[[list, list], list], finish: Callable[[list], object], name: str, kind: str, state: str, most_states: int = MOST_STATES) -> DataFrame:
    """An aggregate of the user's own: keys and name, a row a group; NULL keys are a group, NULL values are given to step as None.

    start() makes a state (a list, of SQL type `state`), step(state, value) takes a value in, merge joins two states, finish gives the
    result. Rows are not shuffled: each task keeps a table of states by key, handed on when it is full or the task ends. Only states meet, so a
    group that holds most rows sends a row or so a task.
    """
    ship(df.sparkSession)
    own = [df.schema[k] for k in keys]
    state_type, result_type = _type(state), _type(kind)

    def rows_of(found: dict, types: list[pa.DataType], last: str, last_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)] if keys else []
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), last_type)], names=[*keys, last])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for key, v in zip(_keys_of(batch, keys), batch.column("__value").to_pylist(), strict=True):
                held = states.get(key)
                states[key] = step(start() if held is None else held, v)
            if len(states) >= most_states:
                yield rows_of(states, types, "__state", state_type)
                states = {}
        if states:
            yield rows_of(states, types, "__state", state_type)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, types = None, None, []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            done: dict = {}
            for key, s in zip(_keys_of(batch, keys), batch.column("__state").to_pylist(), strict=True):
                if key == at:
                    held = merge(held, s)
                    continue
                if at is not None:
                    done[at] = finish(held)
                at, held = key, s
            if done:
                yield rows_of(done, types, name, result_type)
        if at is not None:
            yield rows_of({at: finish(held)}, types, name, result_type)

    states = df.select(*keys, F.col(value).alias("__value")).mapInArrow(partial, _with(own, "__state", state))
    states = (states.repartition(*keys).sortWithinPartitions(*keys)) if keys else states.repartition(1)  # a row or so a task
    return states.mapInArrow(joined, _with(own, name, kind))
