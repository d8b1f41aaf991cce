"""Builders of audit entries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schema import CORRECTION, ERROR


def _text(value: Column | str | None) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def correction(field: Column | str, original: Column, corrected: Column, rule: Column | str, details: str | None = None) -> Column:
    return F.struct(_text(field).alias("field"), _text(original).alias("original_value"), _text(corrected).alias("corrected_value"), _text(rule).alias("rule_code"), _text(details).alias("details"))


def error(code: str, field: Column | str, value: Column | None, message: Column | str) -> Column:
    return F.struct(_text(code).alias("code"), _text(field).alias("field"), _text(value).alias("value"), _text(message).alias("message"))


def no_corrections() -> Column:
    return F.expr(f"cast(array() as array<{CORRECTION}>)")


def no_errors() -> Column:
    return F.expr(f"cast(array() as array<{ERROR}>)")


def correction_entries(*pairs: tuple[Column, Column]) -> Column:
    """The corrections whose condition holds, in order."""
    return _entries(pairs, no_corrections())


def error_entries(*pairs: tuple[Column, Column]) -> Column:
    """The errors whose condition holds, in order."""
    return _entries(pairs, no_errors())


def _entries(pairs: tuple[tuple[Column, Column], ...], none: Column) -> Column:
    """Most rows have none: their conditions are all that is evaluated, by generated code, which array_compact is not."""
    some = reduce(lambda a, b: a | b, (condition for condition, _ in pairs))
    return F.when(some, F.array_compact(F.array(*(F.when(condition, entry) for condition, entry in pairs)))).otherwise(none)


def computed_once(value: Column) -> Column:
    """`value`, which the optimizer will not push filters through: it would repeat the whole classification in the filter,
    once for each place that a stage's column is used."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


_T = TypeVar("_T")
_HELD: dict[tuple, object] = {}


def held(make: Callable[..., _T], *arguments: object) -> _T:
    """What `make` returns, made once for each Spark context: expressions that name columns only can be used again, and
    making some thousands of them takes seconds."""
    key = (make, arguments, SparkContext._active_spark_context)  # the context itself: its id may be used again
    if key not in _HELD:
        _HELD[key] = make(*arguments)
    return _HELD[key]
