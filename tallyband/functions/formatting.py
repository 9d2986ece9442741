"""Format strings, compiled when the plan is made into column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strftime letters and the patterns of Spark that print the same.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "B": "MMMM", "b": "MMM", "h": "MMM",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "A": "EEEE", "a": "EEE",
}
DATE_DEFAULT = "%m/%d/%y"
_NUMBER = re.compile(r"%([-+ 0#,$']*)([0-9]*)(?:\.([0-9]+))?[dfgi]")
_STRING = re.compile(r"%([- ]*)([0-9]*)(?:\.[0-9]*)?s")
_PIECE = re.compile(r"!&\{([^}]*)\}|!#\{([^}]*)\}|!@\{([^}]*)\}|!\$\{([^}]*)\}|(%[-+ 0#,$']*[0-9]*(?:\.[0-9]+)?[dfgi])|(%[- ]*[0-9]*(?:\.[0-9]*)?s)|(%%)")
_BARE = re.compile(r"!([&#])(%[-+ 0#,$']*[0-9]*(?:\.[0-9]+)?[dfgis])")


def java_pattern(strftime: str) -> str:
    out, literal = [], ""
    parts = re.split(r"%(.)", strftime)
    for k, part in enumerate(parts):
        if k % 2 == 0:
            literal += part
        elif part == "%":
            literal += "%"
        elif part in STRFTIME:
            out.append("'" + literal.replace("'", "''") + "'" if literal else "")
            out.append(STRFTIME[part])
            literal = ""
        else:
            raise ValueError(f"%{part} has no pattern")
    out.append("'" + literal.replace("'", "''") + "'" if literal else "")
    return "".join(out)


def number(x: Column, fmt: str = "%d") -> Column:
    """%d prints no decimals, %.2d two of them; a width is that of the whole part. NULL and NaN print as nothing."""
    found = _NUMBER.fullmatch(fmt or "%d")
    if not found:
        raise ValueError(f"not a number's format: {fmt!r}")
    flags, width, places = found[1].replace("'", ",").replace("$", "").replace(" ", ""), found[2], found[3] or "0"
    if width and places != "0":
        width = str(int(width) + 1 + int(places))
    value = F.rint(x.cast("double")) if places == "0" else x.cast("double")
    return F.when(x.isNull() | F.isnan(x.cast("double")), "").otherwise(F.format_string(f"%{flags}{width}.{places}f", value))


def string(x: Column, fmt: str = "%s") -> Column:
    """%9s keeps nine characters; with a space before the width it fills up from the left, with a minus from the right."""
    found = _STRING.fullmatch(fmt or "%s")
    if not found:
        raise ValueError(f"not a string's format: {fmt!r}")
    if not found[2]:
        return F.coalesce(x, F.lit(""))
    width = int(found[2])
    kept = F.substr(x, F.lit(1), F.lit(width))
    if "-" in found[1]:
        kept = F.rpad(kept, width, " ")
    elif " " in found[1]:
        kept = F.lpad(kept, width, " ")
    return F.coalesce(kept, F.lit(""))


def datetime(x: Column, fmt: str = DATE_DEFAULT) -> Column:
    return F.coalesce(F.date_format(x, java_pattern(fmt or DATE_DEFAULT)), F.lit(""))


def money(x: Column, places: int = 2, symbol: str = "$") -> Column:
    """As in the United States."""
    text = F.concat(F.lit(symbol), F.format_number(F.abs(x.cast("double")), places))
    return F.when(x.isNull(), "").when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)


def _money_piece(x: Column, spec: str) -> Column:
    found = re.search(r"\.([0-9]+)", spec)
    return money(x, int(found[1]) if found else 2, "" if "!" in spec else "$")


def format_(x: Column, fmt: str | None, kind: str) -> Column:
    """kind: number, string or datetime. An empty format is the kind's own; others may have text around one piece."""
    if not fmt:
        return {"number": number, "string": string, "datetime": datetime}[kind](x)
    if kind == "datetime" and not re.search(r"!@\{", fmt):
        return datetime(x, fmt)
    return printf(fmt, x)


def printf(fmt: str, *xs: Column) -> Column:
    """%d, %s, and !#{number}, !&{string}, !@{date}, !${money} take the operands in turn; missing and NULL ones print as nothing."""
    pieces, rest, at = [], list(xs), 0
    fmt = _BARE.sub(r"!\1{\2}", fmt)
    for found in _PIECE.finditer(fmt):
        pieces.append(F.lit(fmt[at : found.start()]))
        at = found.end()
        if found[7]:
            pieces.append(F.lit("%"))
            continue
        x = rest.pop(0) if rest else F.lit(None).cast("string")
        if found[1] is not None:
            pieces.append(string(x, found[1]))
        elif found[2] is not None:
            pieces.append(number(x, found[2]))
        elif found[3] is not None:
            pieces.append(datetime(x, found[3]))
        elif found[4] is not None:
            pieces.append(_money_piece(x, found[4]))
        elif found[5]:
            pieces.append(number(x, found[5]))
        else:
            pieces.append(string(x, found[6]))
    return F.concat(*pieces, F.lit(fmt[at:]))


def dtos(d: Column) -> Column:
    return datetime(d)


def dtosf(d: Column, fmt: str) -> Column:
    return datetime(d, fmt)
