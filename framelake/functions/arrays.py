"""Ragged arrays (arrays of sub-arrays). An index out of bounds leaves the array as it is, or gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _within(a: Column, i: Column | int, more: int = 0) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return (i >= 0) & (i < F.size(a) + more)


def sub_count(a: Column) -> Column:
    return F.size(a)


def total_count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda n, x: n + F.size(x))


def sub_array(a: Column, i: Column | int) -> Column:
    found = F.get(a, F.lit(i) if isinstance(i, int) else i)
    return F.coalesce(found, F.slice(F.flatten(a), 1, 0))


def append_sub(a: Column, x: Column) -> Column:
    return F.concat(a, F.array(x))


def insert_sub(a: Column, i: int, x: Column) -> Column:
    """At its place; at the end it is an append."""
    return F.when(_within(a, i, 1), F.concat(F.slice(a, 1, i), F.array(x), F.slice(a, i + 1, F.greatest(F.size(a) - i, F.lit(0))))).otherwise(a)


def erase_sub(a: Column, i: int) -> Column:
    return F.when(_within(a, i), F.concat(F.slice(a, 1, i), F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))))).otherwise(a)


def replace_sub(a: Column, i: int, x: Column) -> Column:
    return F.transform(a, lambda s, j: F.when(j == i, x).otherwise(s))


def push(a: Column, i: int, value: Column) -> Column:
    """Appends to sub-array i; beyond the end the array grows by empty sub-arrays up to i."""
    empty = F.slice(F.array(value), 1, 0)
    grown = F.concat(a, F.array_repeat(empty, F.greatest(F.lit(i + 1) - F.size(a), F.lit(0))))
    return F.transform(grown, lambda s, j: F.when(j == i, F.array_append(s, value)).otherwise(s))


def insert(a: Column, i: int, k: int, value: Column) -> Column:
    return F.transform(a, lambda s, j: F.when((j == i) & (F.lit(k) <= F.size(s)), F.concat(F.slice(s, 1, k), F.array(value), F.slice(s, k + 1, F.greatest(F.size(s) - k, F.lit(0))))).otherwise(s))


def replace(a: Column, i: int, k: int, value: Column) -> Column:
    return F.transform(a, lambda s, j: F.when(j == i, F.transform(s, lambda v, m: F.when(m == k, value).otherwise(v))).otherwise(s))


def erase(a: Column, i: int, k: int, count: int = 1) -> Column:
    """Removes ``count`` elements from k on, if all are there."""
    return F.transform(a, lambda s, j: F.when((j == i) & (F.lit(k + count) <= F.size(s)), F.concat(F.slice(s, 1, k), F.slice(s, k + count + 1, F.greatest(F.size(s) - k - count, F.lit(0))))).otherwise(s))
