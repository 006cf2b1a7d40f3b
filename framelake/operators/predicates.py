"""Predicates on entities with the typing rules of the ``search`` command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("==", "!=", ">", "<", ">=", "<=")


def _number(text: str) -> float | None:
    """The number that a text starts with, as C's stod reads it; None where there is none."""
    import re

    m = re.match(r"\s*([+-]?(?:0[xX][0-9a-fA-F]+|inf(?:inity)?|nan|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))", text, re.I)
    if not m:
        return None
    token = m.group(1)
    return float(int(token, 16)) if "x" in token.lower() else float(token)


def compare(column: Column, op: str, value: Column) -> Column:
    """IEEE comparison of doubles: nothing equals NaN, and NaN is neither above nor below anything."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    odd = F.isnan(column) | F.isnan(value)
    if op == "!=":
        return odd | (column != value)
    made = {"==": column == value, ">": column > value, "<": column < value, ">=": column >= value, "<=": column <= value}[op]
    return ~odd & made


def matches(rows: DataFrame, prop: str, op: str, value: str) -> Column:
    """Whether a property satisfies ``op value``: booleans and texts know == and != only, numbers compare as doubles.

    A null (missing) property satisfies nothing, not even !=; other kinds never match.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    kind, column = rows.schema[prop].dataType, F.col(prop)
    if isinstance(kind, T.BooleanType):
        wanted = F.lit(value in ("true", "1"))
        made = column == wanted if op == "==" else column != wanted if op == "!=" else F.lit(False)
    elif isinstance(kind, T.StringType):
        made = column == value if op == "==" else column != value if op == "!=" else F.lit(False)
    elif isinstance(kind, T.NumericType):
        number = _number(value)
        made = F.lit(False) if number is None else compare(column.cast("double"), op, F.lit(number))
    else:
        made = F.lit(False)
    return F.coalesce(made, F.lit(False))


def search(rows: DataFrame, prop: str, op: str, value: str, frame_index: int | None = None, bucket_index: int | None = None) -> DataFrame:
    """Entities (of one frame, if given) whose property satisfies the predicate. The frame filter reaches the scan."""
    if prop not in rows.columns:
        from framelake.functions.text import closest

        hint = closest(prop, rows.columns)
        raise ValueError(f"no property {prop}" + (f"; did you mean {hint}?" if hint else ""))
    if frame_index is not None:
        rows = rows.where(F.col("frame_index") == frame_index)
    if bucket_index is not None and "bucket_index" in rows.columns:
        rows = rows.where(F.col("bucket_index") == bucket_index)
    return rows.where(matches(rows, prop, op, value))


def only_ids(rows: DataFrame, ids: str | None) -> DataFrame:
    """Rows of the comma-separated ids; an empty list passes all."""
    wanted = [i.strip() for i in (ids or "").split(",") if i.strip()]
    return rows.where(F.col("unique_id").isin(wanted)) if wanted else rows


def contains(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows where any of the columns' texts holds ``text``, whatever the case."""
    needle = text.lower()
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False))
    return rows.where(hit)
