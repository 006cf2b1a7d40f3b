"""Window results over sequences of any length, computed block by block.

A sequence is cut into blocks of its order column. Windows run inside (sequence, block); only
one summary row per block passes a window over the whole sequence and is joined back on the
partitioning that the rows have already. A sequence that holds a third of all rows is thus spread
over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 65_536

_COMBINE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}
_TOTAL = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_LOCAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
Running = dict[str, tuple[str, Column, bool]]


def _cut(rows: DataFrame, keys: Sequence[str], order: str, block: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with their block and their keys in forms without nulls, on which windows and joins share a partitioning."""
    flat = {}
    for i, k in enumerate(keys):
        flat |= {f"__k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")), f"__n{i}": F.col(k).isNull()}
    return rows.withColumns({"__block": F.floor(F.col(order) / block), **flat}), list(flat)


def windows(rows: DataFrame, keys: Sequence[str], order: str, previous: Sequence[str] = (), wanted: Running | None = None, block: int = BLOCK) -> DataFrame:
    """``rows`` with prev_<c> of the row before in its sequence (null for the first), and running aggregates.

    wanted: name -> (sum, count, max or min; expression; whether its own row counts). Order values must be distinct.
    """
    wanted = dict(wanted or {})
    rows, flat = _cut(rows, keys, order, block)
    rows = rows.withColumns({f"__x_{n}": x for n, (_, x, _) in wanted.items()})
    state = F.struct(*previous) if previous else F.lit(None)
    # one summary a block, combined before the shuffle, and carried over the blocks behind it
    tail = [F.max(F.struct(F.col(order).alias("o"), state.alias("s"))).alias("__t")] if previous else []
    summary = rows.groupBy(*flat, "__block").agg(*tail, *[_LOCAL[f](f"__x_{n}").alias(f"__t_{n}") for n, (f, _, _) in wanted.items()])
    over = W.partitionBy(*flat).orderBy("__block")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    carried = ({"__tail": F.lag("__t").over(over)["s"]} if previous else {}) | {f"__b_{n}": _TOTAL[f](f"__t_{n}").over(before) for n, (f, _, _) in wanted.items()}
    summary = summary.withColumns(carried).select(*flat, "__block", *carried)
    w = W.partitionBy(*flat, "__block").orderBy(order)
    local = {f"__l_{n}": _LOCAL[f](f"__x_{n}").over(w.rowsBetween(W.unboundedPreceding, 0 if own else -1)) for n, (f, _, own) in wanted.items()}
    if previous:
        local["__prev"] = F.lag(state).over(w)
    out = rows.withColumns(local).join(summary, [*flat, "__block"], "left")
    made = {n: _COMBINE[f](F.col(f"__b_{n}"), F.col(f"__l_{n}")) for n, (f, _, _) in wanted.items()} | {f"prev_{c}": F.coalesce("__prev", "__tail")[c] for c in previous}
    return out.withColumns(made).drop("__block", "__prev", "__tail", *flat, *[f"__{a}_{n}" for n in wanted for a in "xlb"])


def with_previous(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with prev_<c> of the row before in its sequence (null for the first). Order values must be distinct."""
    return windows(rows, keys, order, previous=columns, block=block)


def running(rows: DataFrame, keys: Sequence[str], order: str, wanted: Running, block: int = BLOCK) -> DataFrame:
    """``rows`` with running aggregates: name -> (sum, count, max or min; expression; whether its own row counts)."""
    return windows(rows, keys, order, wanted=wanted, block=block)


def accumulated(rows: DataFrame, keys: Sequence[str], order: str, name: str, value: str, start: Column, step: Callable[[Column, Column], Column], block: int = BLOCK) -> DataFrame:
    """``rows`` with the running sum of steps from the value before to the row's own; a sequence's first row has ``start``.

    A block's first step is taken where its summary meets the block before, so one pass does what a
    lag and a sum over it would. Steps must be no nulls and depend on constants of a sequence beside the two values.
    """
    rows, flat = _cut(rows, keys, order, block)
    w = W.partitionBy(*flat, "__block").orderBy(order)
    back = F.lag(value).over(w)
    local = rows.withColumn("__step", F.when(F.row_number().over(w) > 1, step(back, F.col(value))).otherwise(F.lit(0)))
    first = F.struct(F.col(order).alias("__o"), *rows.columns)
    heads = local.groupBy(*flat, "__block").agg(F.min(first).alias("__h"), F.max(F.struct(F.col(order), F.col(value).alias("v"))).alias("__e"), F.sum("__step").alias("__t"))
    over = W.partitionBy(*flat).orderBy("__block")
    heads = heads.withColumn("__before", F.lag("__e").over(over))
    opened = heads.select(*flat, "__block", "__t", "__before", *[F.col(f"__h.{c}").alias(c) for c in rows.columns if c not in (*flat, "__block")])
    opened = opened.withColumn("__first", F.when(F.col("__before").isNull(), start).otherwise(step(F.col("__before.v"), F.col(value))))
    carried = F.coalesce(F.sum(F.col("__first") + F.col("__t")).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("__first")
    opened = opened.select(*flat, "__block", carried.alias("__base"))
    out = local.withColumn("__sum", F.sum("__step").over(w.rowsBetween(W.unboundedPreceding, 0))).join(opened, [*flat, "__block"], "left")
    return out.withColumn(name, F.col("__base") + F.col("__sum")).drop("__block", "__step", "__sum", "__base", *flat)
