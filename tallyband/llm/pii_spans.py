"""Personal data as scored spans, in DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for account numbers, number ranges for
addresses, digit counts for phones), and words near a span move its score. Spans of one kind are the leftmost
non-overlapping matches; a match that fails its check is dropped and not tried again. Positions count code points.

Every pattern takes each run of characters once: quantifiers are possessive where nothing after them could match
less, and a match starts at the start of a run or where the last match ended, so a long run costs linear time
and no recursion.

Defined results: a null text is empty and has no spans; repeated rows give repeated results; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyband.llm.common import text_or_empty

#: kind: pattern. The first four are fixed; iban is added.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # only the head is consumed; what may follow it is looked at: the groups, and a character that goes on with the last one
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})([A-Za-z0-9]?))",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must contain for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None}
#: Score without context, and words that raise it when they stand within NEAR characters before the span.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|credit|visa|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank",
}
AGAINST = "version|order|serial|isbn|sample|example"
NEAR = 40


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _mod97(text: Column) -> Column:
    """True where the account number's digits, letters as 10 to 35, leave 1 when divided by 97."""
    plain = F.regexp_replace(text, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    points = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.ascii(c))

    def step(rest: Column, point: Column) -> Column:
        return F.when(point >= 65, (rest * 100 + point - 55) % 97).otherwise((rest * 10 + point - 48) % 97)

    return F.aggregate(points, F.lit(0), step) == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(text)).between(16, 19) & F.call_function("luhn_check", _digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _has(kind: str, text: Column) -> Column:
    """Whether it is worth looking: a cheap test that every match passes."""
    if NEEDS[kind]:
        return F.contains(text, F.lit(NEEDS[kind]))
    return text.rlike(r"[A-Z]{2}[0-9]{2}" if kind == "iban" else r"[0-9][\x20-]?[0-9]")


def _account_numbers(text: Column) -> Column:
    """As spans_of. From each head the longest number that ends with a group and passes the check; none begins inside another."""
    pattern = PATTERNS["iban"]
    heads, runs, more = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(3))
    between = F.transform(F.split(text, pattern, -1), lambda part: F.length(part))

    def number(pair: Column) -> Column:
        groups = F.split(F.concat(pair["head"], pair["run"]), " ")
        whole = F.size(groups) - F.when(pair["more"] != "", 1).otherwise(0)
        ends = F.filter(F.sequence(F.lit(1), F.size(groups)), lambda k: k <= whole)
        numbers = F.transform(ends, lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
        return F.get(F.reverse(F.filter(numbers, lambda n: (F.length(F.replace(n, F.lit(" "), F.lit(""))) >= 15) & _mod97(n))), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        stop = start + F.length(pair["match"])
        taken = pair["match"].isNotNull() & (start >= state["free"])
        more = F.concat(state["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"), pair["match"].alias("match"))))
        return F.struct((start + 4).alias("at"), F.when(taken, stop).otherwise(state["free"]).alias("free"), F.when(taken, more).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    pairs = F.filter(F.arrays_zip(between.alias("gap"), heads.alias("head"), runs.alias("run"), more.alias("more")), lambda p: p["head"].isNotNull())
    pairs = F.transform(pairs, lambda p: F.struct(p["gap"].alias("gap"), number(p).alias("match")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), none.alias("spans")), step)["spans"]
    return F.when(_has("iban", text), spans).otherwise(none)


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<start, stop, match>>: the confirmed spans of a kind, in order.

    Splitting by the pattern gives what stands between the matches; their lengths give the places.
    """
    if kind == "iban":
        return _account_numbers(text)
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda part: F.length(part))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        stop = start + F.length(pair["match"])
        # only what is confirmed is taken in: a text may hold very many numbers
        more = F.concat(state["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"), pair["match"].alias("match"))))
        return F.struct(stop.alias("at"), F.when(_valid(kind, pair["match"]), more).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    pairs = F.filter(F.arrays_zip(between.alias("gap"), found.alias("match")), lambda p: p["match"].isNotNull())
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(_has(kind, text), spans).otherwise(none)


def _scored(kind: str, text: Column, spans: Column) -> Column:
    """array<struct<kind, start, stop, match, score>>"""

    def one(span: Column) -> Column:
        first = F.greatest(span["start"] - NEAR, F.lit(0))
        near = F.lower(F.substr(text, first + 1, span["start"] - first))
        shift = F.when(near.rlike(CONTEXT[kind]), 0.1).otherwise(0.0) - F.when(near.rlike(AGAINST), 0.3).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"), span["match"].alias("match"), F.round(F.lit(SCORES[kind]) + shift, 2).alias("score"))

    return F.transform(spans, one)


def find_spans(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """doc_id, text, and spans: array<struct<kind, start, stop, match, score>> by kind, then place."""
    text = F.col("text")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("*", *(spans_of(kind, text).alias(f"__{kind}") for kind in kinds))
    return rows.select("doc_id", "text", F.concat(*(_scored(kind, text, F.col(f"__{kind}")) for kind in kinds)).alias("spans"))


def masked(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and text with every span of at least that score replaced by its kind in angle brackets."""
    found = find_spans(docs)
    ordered = F.array_sort(F.transform(F.filter("spans", lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def step(state: Column, span: Column) -> Column:
        more = F.concat(state["out"], F.substr(F.col("text"), state["at"] + 1, span["start"] - state["at"]), F.lit("<"), span["kind"], F.lit(">"))
        return F.when(span["start"] >= state["at"], F.struct(span["stop"].alias("at"), more.alias("out"))).otherwise(state)

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)))
    return found.select("doc_id", done.alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans as text, and the scores in the same order."""

    def joined(kinds: tuple[str, ...]) -> Column:
        kept = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(BASE).cast("binary"), 256).alias("base_sha256"), joined(tuple(PATTERNS)).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores")
    )
