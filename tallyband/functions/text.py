"""String functions; lengths and places count characters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat(*xs: Column) -> Column:
    return F.concat(*xs)


def _count(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(n.cast("int"), F.lit(0))


def left(s: Column, n: Column | int) -> Column:
    return F.substr(s, F.lit(1), _count(n))


def right(s: Column, n: Column | int) -> Column:
    n = F.least(_count(n), F.length(s))
    return F.substr(s, F.length(s) - n + 1, n)


def mid(s: Column, start: Column | int, n: Column | int) -> Column:
    """From a place counted from 1 (0 is 1 too), or from the end if negative, but not before the start."""
    start = F.lit(start) if isinstance(start, int) else start
    size = F.length(s)
    first = F.when(start < 0, F.greatest(size + start + 1, F.lit(1))).otherwise(F.greatest(start, F.lit(1)))
    return F.substr(s, first.cast("int"), _count(n))


strlen = F.length

#: Letters that Spark's upper() makes several of; those that have one capital letter, and these capitals.
_SEVERAL = "".join(c for c in map(chr, range(0x80, 0xFB18)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1)
_SMALL = "ß" + "".join(c for c in _SEVERAL if c.title() != c and len(c.title()) == 1)
_CAPITAL = "ẞ" + "".join(c.title() for c in _SMALL[1:])


def lower(s: Column) -> Column:
    """Character by character, each gives one: unlike in Spark, a sigma is the same at the end of a word, and a dotted I is an i."""
    return F.lower(F.translate(s, "Σİ", "σi"))


def _capital(c: Column) -> Column:
    """Of one character."""
    return F.when(F.length(F.upper(c)) > 1, F.translate(c, _SMALL, _CAPITAL)).otherwise(F.upper(c))


def upper(s: Column) -> Column:
    """Character by character, each gives one: letters without a capital of their own stay, where Spark writes several."""
    each = F.array_join(F.transform(F.split(s, ""), _capital), "")
    return F.when(s.rlike(f"[{_SEVERAL}]"), each).otherwise(F.upper(s))


def proper(s: Column) -> Column:
    """First character in upper case, all others in lower case."""
    return F.concat(_capital(F.substr(s, F.lit(1), F.lit(1))), lower(F.substr(s, F.lit(2))))


def str_(x: Column, width: int, places: int) -> Column:
    return F.format_string(f"%{width}.{places}f", x.cast("double"))


def translate(df: DataFrame, name: str, catalog: DataFrame, out: str) -> DataFrame:
    """Add the catalog's msgstr for the text, or the text itself. catalog: msgid (unique), msgstr; a table of messages, which every task gets whole, since one text may be in all rows."""
    found = catalog.select(F.col("msgid").alias("__id"), F.col("msgstr").alias("__str"))
    return df.join(F.broadcast(found), df[name] == F.col("__id"), "left").withColumn(out, F.coalesce("__str", name)).drop("__id", "__str")


def translate2(df: DataFrame, singular: str, plural: str, n: str, catalog: DataFrame, out: str, rule: str | None = None) -> DataFrame:
    """As translate, by number, the catalog broadcast as well: it has msgid, form, msgstr. rule: the catalog's plural rule (see plural_form), which gives the form; else 0 for one and 1 for other numbers.

    A text that the catalog lacks is the singular for one, else the plural.
    """
    found = catalog.select(F.col("msgid").alias("__id"), F.col("form").alias("__form"), F.col("msgstr").alias("__str"))
    form = F.when(df[n] == 1, 0).otherwise(1) if rule is None else plural_form(rule, df[n])
    own = F.when(df[n] == 1, df[singular]).otherwise(df[plural])
    return df.join(F.broadcast(found), (df[singular] == F.col("__id")) & (form == F.col("__form")), "left").withColumn(out, F.coalesce("__str", own)).drop("__id", "__form", "__str")


#: Operators of a plural rule by how loosely they bind, loosest first; comparisons and logic give 1 or 0.
_OPERATORS = (
    {"||": lambda a, b: _flag((a != 0) | (b != 0))},
    {"&&": lambda a, b: _flag((a != 0) & (b != 0))},
    {"==": lambda a, b: _flag(a == b), "!=": lambda a, b: _flag(a != b)},
    {"<=": lambda a, b: _flag(a <= b), ">=": lambda a, b: _flag(a >= b), "<": lambda a, b: _flag(a < b), ">": lambda a, b: _flag(a > b)},
    {"+": lambda a, b: a + b, "-": lambda a, b: a - b},
    {"*": lambda a, b: a * b, "/": lambda a, b: F.floor(a / b), "%": lambda a, b: a % b},
)


def _flag(test: Column) -> Column:
    return F.when(test, 1).otherwise(0)


def plural_form(rule: str, n: Column) -> Column:
    """The number of the form for n by a rule such as 'nplurals=3; plural=n==1 ? 0 : n==2 ? 1 : 2;': arithmetic, comparisons and choices over n."""
    text = re.sub(r"\s+", "", re.sub(r"^.*\bplural\s*=(?!=)", "", rule).split(";")[0])
    tokens = re.findall(r"[0-9]+|n|\|\||&&|[=!<>]=|[-+*/%<>?:()!]", text)
    if text != "".join(tokens):
        raise ValueError(f"not a plural rule: {rule}")
    n = n.cast("long")

    def take(expected: str | None = None) -> str:
        if not tokens or (expected and tokens[0] != expected):
            raise ValueError(f"not a plural rule: {rule}")
        return tokens.pop(0)

    def choice() -> Column:
        test = binary(0)
        if tokens[:1] != ["?"]:
            return test
        take()
        yes = choice()
        take(":")
        return F.when(test != 0, yes).otherwise(choice())

    def binary(level: int) -> Column:
        if level == len(_OPERATORS):
            return single()
        left = binary(level + 1)
        while tokens and tokens[0] in _OPERATORS[level]:
            left = _OPERATORS[level][take()](left, binary(level + 1))
        return left

    def single() -> Column:
        token = take()
        if token == "!":
            return _flag(single() == 0)
        if token == "(":
            inner = choice()
            take(")")
            return inner
        if token != "n" and not token.isdigit():
            raise ValueError(f"not a plural rule: {rule}")
        return n if token == "n" else F.lit(int(token)).cast("long")

    form = choice()
    if tokens:
        raise ValueError(f"not a plural rule: {rule}")
    return form.cast("int")
