"""Scalar helpers shared by the operators (all compile to built-in expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text of a finite decimal number.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def is_blank(col: Column) -> Column:
    """Null or whitespace only."""
    text = col.cast("string")
    return text.isNull() | (F.trim(text) == "")


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def to_number(col: Column) -> Column:
    """Finite number of a text or numeric column, else null."""
    text = col.cast("string")
    value = F.when(text.rlike(NUMBER_PATTERN), F.trim(text)).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(col: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def json_text(col: Column) -> Column:
    """JSON text of one value, null for null."""
    wrapped = F.to_json(F.struct(col.alias("v")))
    return F.when(col.isNotNull(), F.regexp_extract(wrapped, r'^\{"v":(.*)\}$', 1))


def slug(col: Column) -> Column:
    """Lower-case with every run of other characters as one underscore."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[^a-z0-9]+", "_")


def array_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def argmax_label(probabilities: Column, labels: Sequence[str]) -> Column:
    """Label of the first largest entry."""
    position = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), position)


def pick(columns: Sequence[Column], index: Column) -> Column:
    """1-based choice among columns."""
    return F.element_at(F.array(*columns), index.cast("int"))
