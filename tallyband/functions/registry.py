"""User functions by name: added ones come before built-in ones of the same name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from tallyband.functions import datetimes, formatting, logic, numeric, text

Function = Callable[..., Column]
_FIXED = {"abs": numeric.abs_, "pow": numeric.pow_, "round": numeric.round_away, "and": numeric.bit_and, "or": numeric.bit_or, "xor": numeric.bit_xor, "not": numeric.bit_not, "str": text.str_, "format": formatting.format_, "val": logic.cast_number}


class Functions:
    def __init__(self) -> None:
        self._own: dict[str, Function] = {}

    def add(self, name: str, function: Function, spark: SparkSession | None = None, returns: str | None = None) -> None:
        """Add or replace. With spark and returns, a Python (or pandas) function is registered for SQL as well."""
        self._own[name] = spark.udf.register(name, function, returns) if spark is not None and returns else function

    def __getitem__(self, name: str) -> Function:
        if name in self._own:
            return self._own[name]
        if name in _FIXED:
            return _FIXED[name]
        for module in (numeric, logic, text, datetimes, formatting):
            if callable(found := getattr(module, name, None)) and not name.startswith("_"):
                return found
        raise KeyError(name)
