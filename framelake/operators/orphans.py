"""References to records that do not exist.

References are grouped by the null mask of their key columns, and each mask is anti-joined
with the parent on its own non-null columns, so a composite key with partial nulls is judged
by the match semantics that the caller declares. A validity period of the parent is part of
the join condition. Nothing is collected or broadcast by hand: the anti joins are equi-joins
on the key columns, so adaptive execution splits a hot key on the reference side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def _blank_to_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.when(F.trim(F.col(k)) != "", F.col(k)) for k in keys if kinds[k] == "string"})


def null_mask(keys: Sequence[str]) -> Column:
    """Bit i is set where key i is null."""
    return reduce(lambda a, b: a + b, (F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)))


def find_orphans(
    refs: DataFrame,
    parent: DataFrame,
    keys: Sequence[str],
    parent_keys: Sequence[str] | None = None,
    match: str = "simple",
    moment: str | None = None,
    valid_from: str | None = None,
    valid_to: str | None = None,
) -> DataFrame:
    """Rows of ``refs`` without a parent row, with a ``reason``.

    match: ``simple`` (a reference with any null key makes no claim), ``partial`` (the non-null
    keys must match; all null makes no claim) or ``full`` (all keys or none: a partly null
    reference is an orphan with reason ``partial_null``). Blank strings count as null.

    With ``moment``, a parent row counts only if valid_from <= moment < valid_to; a null bound
    is open on its side, and a null moment is satisfied by any row of the key. Reasons are
    ``missing`` (no parent row of the key), ``deleted`` (one began by the moment) and ``late``
    (all begin after it).

    Repeated rows of ``refs`` stay repeated; an empty parent makes every claim ``missing``;
    other columns pass through, also where the parent has columns of the same names, but for an
    own column ``reason``, which is replaced.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    keys, parent_keys = list(keys), list(parent_keys or keys)
    refs = _blank_to_null(refs.drop("reason"), keys)
    side = {p: f"__p{i}" for i, p in enumerate(parent_keys)}
    columns = [F.col(p).alias(a) for p, a in side.items()]
    if moment:
        columns += [F.col(valid_from).alias("__from"), (F.col(valid_to) if valid_to else F.lit(None)).alias("__to")]
    own = _blank_to_null(parent.select(columns), list(side.values())).distinct()
    names = [side[p] for p in parent_keys]

    def judged(part: DataFrame, used: list[int]) -> DataFrame:
        equal = reduce(lambda a, b: a & b, (F.col(keys[i]) == F.col(names[i]) for i in used))
        here = own.where(reduce(lambda a, b: a & b, (F.col(names[i]).isNotNull() for i in used)))
        if not moment:
            return part.join(here, equal, "left_anti").withColumn("reason", F.lit("missing"))
        at = F.col(moment)
        begun = at.isNull() | F.col("__from").isNull() | (F.col("__from") <= at)
        alive = begun & (at.isNull() | F.col("__to").isNull() | (at < F.col("__to")))
        first = here.groupBy(*[names[i] for i in used]).agg(
            F.max(F.col("__from").isNull()).alias("__open"), F.min("__from").alias("__first")
        )
        left = part.join(here, equal & alive, "left_anti").join(first, equal, "left")
        reason = (
            F.when(F.col("__open").isNull(), "missing").when(F.col("__open") | (F.col("__first") <= at), "deleted").otherwise("late")
        )
        return left.withColumn("reason", reason).drop("__open", "__first", *[names[i] for i in used])

    everything = (1 << len(keys)) - 1
    masked = refs.withColumn("__mask", null_mask(keys))
    parts = []
    for mask in range(everything):
        used = [i for i in range(len(keys)) if not mask >> i & 1]
        part = masked.where(F.col("__mask") == mask).drop("__mask")
        if mask == 0 or match == "partial":
            parts.append(judged(part, used))
        elif match == "full":
            parts.append(part.withColumn("reason", F.lit("partial_null")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def orphan_report(orphans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orphans counted per ``by`` columns and reason."""
    return orphans.groupBy(*by, "reason").agg(F.count("*").alias("n_orphans"))
