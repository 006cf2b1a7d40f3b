"""What changed between consecutive full snapshots.

Every entry is put out twice, as the new side of its own snapshot and as the old side of the
next one; a single aggregation by (snapshot, key) then classifies from the row hash of either
side. Only snapshot headers (not entries) pass through windows, in blocks, so a source with
any number of snapshots is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbours(points: DataFrame, keys: Sequence[str], order: str, block: int = 8192) -> DataFrame:
    """``points`` (distinct by keys and order) with ``before`` and ``after``, the neighbouring values of ``order``."""
    keys = list(keys)
    rows = points.withColumn("__block", F.floor(F.col(order) / block))
    w = W.partitionBy(*keys, "__block").orderBy(order)
    rows = rows.withColumns({"before": F.lag(order).over(w), "after": F.lead(order).over(w)})
    edges = rows.groupBy(*keys, "__block").agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    w = W.partitionBy(*keys).orderBy("__block")
    edges = edges.withColumns({"__back": F.lag("__hi").over(w), "__on": F.lead("__lo").over(w)}).drop("__lo", "__hi")
    named = edges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), "__back", "__on")
    same = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = rows.join(named, same, "left")
    rows = rows.withColumns({"before": F.coalesce("before", "__back"), "after": F.coalesce("after", "__on")})
    return rows.select(*points.columns, "before", "after")


def snapshot_changes(
    snapshots: DataFrame,
    source: Sequence[str],
    order: str,
    delivered: str,
    entries: str,
    key: Column,
    exact: Sequence[str],
    close: dict[str, float] | None = None,
    block: int = 8192,
) -> DataFrame:
    """Rows (source..., order, key, change) for each key added, removed or changed against the snapshot before.

    snapshots: one row a delivery; of several for one place the latest counts (ties: by content
    hash), those whose ``entries`` array is null never do, an empty array is a snapshot. key: an
    expression over an entry named ``e``; entries that are null or have a null or blank key are
    no entries; repeated entries count once (of differing ones, each field's greatest value).
    exact: entry fields that must be equal, null being a value of its own; close: fields that
    may differ by so much. NaN equals NaN. The first snapshot of a source gives no rows.
    """
    source, close = list(source), dict(close or {})
    given = snapshots.where(F.col(entries).isNotNull() & F.col(order).isNotNull()).select(
        *source, order, F.col(delivered).alias("__at"), F.col(entries).alias("__entries"), F.xxhash64(entries).alias("__hash")
    )
    heads = given.groupBy(*source, order).agg(F.max(F.struct("__at", "__hash")).alias("__v"))
    heads = neighbours(heads, source, order, block)
    chosen = heads.select(*[F.col(c).alias(f"__h{i}") for i, c in enumerate([*source, order])], F.col("__v.__at").alias("__v0"), F.col("__v.__hash").alias("__v1"), "before", "after")
    same = F.col("__at").eqNullSafe(F.col("__v0")) & (F.col("__hash") == F.col("__v1"))
    for i, c in enumerate([*source, order]):
        same &= F.col(c).eqNullSafe(F.col(f"__h{i}"))
    rows = given.join(chosen, same).select(*source, order, "before", "after", F.explode("__entries").alias("e"))
    rows = rows.where(F.col("e").isNotNull()).withColumn("__key", key).where(F.trim(F.col("__key")) != "")
    field = lambda c: F.col("e").getField(c)
    masks = [field(c).isNull() for c in close]
    hashed = F.xxhash64(*[v for c in exact for v in (field(c), field(c).isNull())], *masks)
    rows = rows.select(*source, order, "before", "after", "__key", hashed.alias("__row"), *[field(c).cast("double").alias(f"__c_{c}") for c in close])
    sides = F.array(
        F.when(F.col("before").isNotNull(), F.struct(F.col(order).alias("at"), F.lit(True).alias("new"))),
        F.when(F.col("after").isNotNull(), F.struct(F.col("after").alias("at"), F.lit(False).alias("new"))),
    )
    rows = rows.withColumn("__side", F.explode(F.array_compact(sides)))
    new = F.col("__side.new")
    pick = lambda c, side: F.max(F.when(side, F.col(c)))
    pairs = rows.groupBy(*source, F.col("__side.at").alias(order), "__key").agg(
        pick("__row", ~new).alias("__row0"),
        pick("__row", new).alias("__row1"),
        *[pick(f"__c_{c}", s).alias(f"__c{n}_{c}") for c in close for n, s in ((0, ~new), (1, new))],
    )
    differs = F.col("__row0") != F.col("__row1")
    for c, most in close.items():
        a, b = F.col(f"__c0_{c}"), F.col(f"__c1_{c}")
        differs |= F.coalesce((a != b) & (F.isnan(a) | F.isnan(b) | (F.abs(a - b) > most)), F.lit(False))
    change = F.when(F.col("__row0").isNull(), "added").when(F.col("__row1").isNull(), "removed").when(differs, "changed")
    return pairs.select(*source, order, F.col("__key").alias("key"), change.alias("change")).where(F.col("change").isNotNull())
