"""Numbers that stay exact: 36 digits before and 36 after the point, in sums, averages and running sums of any length.

A number is a struct of LIMBS, each a whole number of up to 18 digits with the number's sign. Sums add halves of limbs apart and carry
only in the end, so they merge in any order, and no double is passed through. Structs compare as the numbers do.

Halves are of nine digits, so that nine billion numbers of any size add up in 64 bits; where more of them don't, Spark stops with an
error. What is done for every row of a table is compiled: exact_columns() and summed_columns() take it in steps, with columns in between.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The limbs, most significant first: two before the point and two after it.
LIMBS = ("i1", "i0", "f0", "f1")
DIGITS = 18
BASE = 10**DIGITS
SIDE = 2 * DIGITS
#: Halves of limbs, as sums take them.
HALVES = tuple(n + part for n in LIMBS for part in "hl")
HALF = 10 ** (DIGITS // 2)
_PLAIN = rf"^-?[0-9]{{1,{SIDE}}}(?:\.[0-9]*)?\z"
_NUMBER = r"^\s*([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,9}))?\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact(x: Column) -> Column:
    """From text or a number: base ten, also with an exponent. NULL for all else and for numbers of more than 36 digits before the point; digits after the 36th behind it are cut off."""
    text = x.cast("string")
    return F.when(text.rlike(_PLAIN), let(_digits(text), lambda d: _plain(text, d))).otherwise(_read(text))


def exact_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with these columns as exact() makes them. The digits of plain numbers are a column before they are limbs; an exponent or blanks take the longer way."""
    text = {c: F.col(f"`{c}`").cast("string") for c in names}
    out = df.withColumns({f"__digits_{c}": F.when(t.rlike(_PLAIN), _digits(t)) for c, t in text.items()})
    digits = {c: F.col(f"`__digits_{c}`") for c in names}
    return out.withColumns({c: F.when(d.isNotNull(), _plain(text[c], d)).otherwise(_read(text[c])) for c, d in digits.items()}).drop(*(f"__digits_{c}" for c in names))


def _digits(text: Column) -> Column:
    """Of a plain number, without exponent: its digits stand where they belong."""
    body = F.ltrim(text, F.lit("-"))
    whole = F.substring_index(body, ".", 1)
    return F.concat(F.lpad(whole, SIDE, "0"), F.rpad(F.substr(body, F.length(whole) + 2), SIDE, "0"))


def _plain(text: Column, digits: Column) -> Column:
    sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    return F.struct(*((F.substring(digits, 1 + DIGITS * k, DIGITS).cast("long") * sign).alias(n) for k, n in enumerate(LIMBS)))


def _read(text: Column) -> Column:
    parts = F.split(F.when(text.rlike(_NUMBER), F.regexp_replace(text, F.lit(_NUMBER), F.lit("$1|$2|$3|$4"))), r"\|")

    def number(p: Column) -> Column:
        digits, size = F.concat(p[1], p[2]), F.length(p[1]) + F.length(p[2])
        point = F.length(p[1]) + F.when(p[3] == "", 0).otherwise(p[3].cast("int"))
        # zeros that fill up are never more than a side and the digits themselves
        whole = F.when(point <= 0, "").when(point >= size, F.concat(digits, F.repeat(F.lit("0"), F.least(point - size, F.lit(SIDE))))).otherwise(F.left(digits, point))
        below = F.when(point >= size, "").when(point < 0, F.concat(F.repeat(F.lit("0"), F.least(-point, F.lit(SIDE))), digits)).otherwise(F.substr(digits, point + 1))
        # a number that is zero has no digits before the point, whatever its exponent
        filled = F.struct(F.ltrim(whole, F.lit("0")).alias("whole"), F.rpad(F.left(below, F.lit(SIDE)), SIDE, "0").alias("below"), size.alias("size"), (point - size).alias("over"))

        def limbs(d: Column) -> Column:
            sound = (d["size"] > 0) & (F.length(d["whole"]) <= SIDE) & ((d["over"] <= SIDE) | (F.length(d["whole"]) == 0))
            padded = F.lpad(d["whole"], SIDE, "0")
            texts = [F.substring(padded, 1, DIGITS), F.substring(padded, 1 + DIGITS, DIGITS), F.substring(d["below"], 1, DIGITS), F.substring(d["below"], 1 + DIGITS, DIGITS)]
            return F.when(sound, F.struct(*(F.when(p[0] == "-", -t.cast("long")).otherwise(t.cast("long")).alias(n) for n, t in zip(LIMBS, texts, strict=True))))

        return let(filled, limbs)

    return let(parts, lambda p: F.when(p.isNotNull(), number(p)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _settled(limbs: Column) -> Column:
    """Carried up, so that all but the first limb are from zero to BASE - 1."""
    base = _whole(F.lit(BASE))

    def carried(places: Sequence[str], x: Column, done: dict[str, Column]) -> Column:
        name, *others = places
        if not others:
            return F.struct(*((done | {name: x})[n].alias(n) for n in LIMBS))
        return let(x, lambda x: let(F.pmod(x, base), lambda r: carried(others, _whole(limbs[others[0]] + _whole(_div(x - r, base))), done | {name: r})))

    return carried(LIMBS[::-1], limbs[LIMBS[-1]], {})


def _signed(limbs: Mapping[str, Column], body: Callable[[Column, Column], Column]) -> Column:
    """body(whether the number is below zero, the limbs of its size)."""
    start = F.struct(*(_whole(limbs[n]).alias(n) for n in LIMBS))
    turned = lambda s: _settled(F.struct(*((-s[n]).alias(n) for n in LIMBS)))
    first = LIMBS[0]
    # what is turned once is settled again, from zero to BASE - 1
    return let(let(start, _settled), lambda s: let(F.when(s[first] < 0, turned(s)).otherwise(s), lambda size: body(s[first] < 0, size)))


def _number(minus: Column, limbs: Mapping[str, Column]) -> Column:
    """NULL where the first limb has too many digits."""
    fits = F.abs(limbs[LIMBS[0]]) < BASE
    return F.when(fits, F.struct(*(F.when(minus, -limbs[n]).otherwise(limbs[n]).try_cast("long").alias(n) for n in LIMBS)))


def halves(x: Column) -> dict[str, Column]:
    """The parts of a number that sums add up, each apart."""
    both = [part for n in LIMBS for part in (_div(x[n], F.lit(HALF)), x[n] % F.lit(HALF))]
    return dict(zip(HALVES, both, strict=True))


def _limbs(added: Mapping[str, Column]) -> dict[str, Column]:
    return {n: _whole(_whole(added[n + "h"]) * F.lit(HALF) + added[n + "l"]) for n in LIMBS}


def summed(added: Mapping[str, Column]) -> Column:
    """The number of halves that have been added up."""
    return _signed(_limbs(added), lambda minus, size: _number(minus, {n: size[n] for n in LIMBS}))


def summed_columns(df: DataFrame, added: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """df with the numbers that summed() makes, by name: for tables of many rows."""
    place = lambda n, k: F.col(f"`__{k}_{n}`")
    base, half = F.lit(BASE), F.lit(HALF)
    last = len(HALVES) - 1
    out = df.withColumns({f"__{last}_{n}": halves[HALVES[last]] for n, halves in added.items()})
    for k in range(last - 1, -1, -1):
        out = out.withColumns({f"__{k}_{n}": halves[HALVES[k]] + _div(place(n, k + 1), half) for n, halves in added.items()})
    # limbs of less than BASE, the first apart, but not yet of one sign; a first half over HALF is that of a number with too many digits
    first = lambda n: F.when(F.abs(place(n, 0)) <= half, place(n, 0))
    limb = lambda n, j: (place(n, 2 * j) % half if j else first(n)) * half + place(n, 2 * j + 1) % half
    # the sign is that of the first limb that isn't zero
    signs = {f"__sign_{n}": F.coalesce(F.signum(F.get(F.filter(F.array(*(limb(n, j) for j in range(len(LIMBS)))), lambda x: x != 0), F.lit(0))).cast("long"), F.lit(1)) for n in added}
    out = out.withColumns({f"__limb{j}_{n}": limb(n, j) for n in added for j in range(len(LIMBS))} | signs)
    limbs = {n: [F.col(f"`__limb{j}_{n}`") for j in range(len(LIMBS))] for n in added}

    def number(n: str) -> Column:
        sign, low, found = F.col(f"`__sign_{n}`"), F.lit(0), {}
        for name, x in list(zip(LIMBS, limbs[n], strict=True))[:0:-1]:
            # low: -1 where the limb after this one has borrowed
            size = x * sign + low
            low = F.shiftright(size, 63)
            found[name] = sign * (size - low * base)
        top = limbs[n][0] * sign + low
        return F.when(top < base, F.struct(*((found | {LIMBS[0]: sign * top})[name].alias(name) for name in LIMBS)))

    out = out.withColumns({n: number(n) for n in added})
    taken = [*(str(k) for k in range(len(HALVES))), *(f"limb{j}" for j in range(len(LIMBS))), "sign"]
    return out.drop(*(f"__{k}_{n}" for k in taken for n in added))


def divided(added: Mapping[str, Column], n: Column) -> Column:
    """The number of added halves by n, a whole number over zero and under 10^18; cut off after 36 digits. NULL for n zero."""
    base = _whole(F.lit(BASE))

    def long_division(minus: Column, size: Column, n: Column, names: Sequence[str], rest: Column | None, out: dict) -> Column:
        if not names:
            return _number(minus, out)
        x = size[names[0]] if rest is None else _whole(rest * base + size[names[0]])
        return let(x, lambda x: long_division(minus, size, n, names[1:], x % n, out | {names[0]: _whole(_div(x, n))}))

    return F.when(n > 0, let(_whole(n), lambda n: _signed(_limbs(added), lambda minus, size: long_division(minus, size, n, LIMBS, None, {}))))


def exact_text(x: Column, places: int = SIDE) -> Column:
    """Digits without an exponent, cut after `places` behind the point, without zeros at the end."""
    digits = F.array_join(F.transform(F.array(*(x[n] for n in LIMBS)), lambda limb: F.lpad(F.abs(limb).cast("string"), DIGITS, "0")), "")
    # the last digit before the point stays
    whole = F.concat(F.ltrim(F.left(digits, F.lit(SIDE - 1)), F.lit("0")), F.substring(digits, SIDE, 1))
    shown = F.rtrim(F.rtrim(F.concat(whole, F.lit("."), F.substring(digits, SIDE + 1, places)), F.lit("0")), F.lit("."))
    text = F.concat(F.when(F.least(*(x[n] for n in LIMBS)) < 0, "-").otherwise(""), shown)
    text = F.when(x.isNotNull(), text)
    return text if places >= SIDE else F.when(text == "-0", "0").otherwise(text)


def exact_decimal(x: Column, places: int = 10) -> Column:
    """DECIMAL(38, places), cut; NULL where it doesn't fit."""
    return exact_text(x, places).try_cast(f"decimal(38,{places})")
