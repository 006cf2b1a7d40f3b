"""Whole-recording analyses: lifetimes, value spans, distinct property combinations, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.frames import frame_stride
from framelake.operators.runs import collapse_runs

#: Frames of a block; a recording's blocks are worked on apart.
BLOCK = 1024


def _placed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` lying by (recording, block of frames), the one shuffle that all later windows over frames share."""
    rows = rows.where(F.col("frame_index").isNotNull()).withColumns({"__rk": F.coalesce(F.col("replay_id").cast("string"), F.lit("\0")), "__fb": F.floor(F.col("frame_index") / block)})
    return rows.repartition("__rk", "__fb")


def _with_ordinal(placed: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``placed`` with ``__ord``: the number of a row's frame among the recording's frames that have the bucket.

    Inside a block by a window; where a block begins comes from one row a block, counted from the frames alone.
    """
    frames = rows.where(F.col("frame_index").isNotNull()).select(F.coalesce(F.col("replay_id").cast("string"), F.lit("\0")).alias("__rk"), F.floor(F.col("frame_index") / block).alias("__fb"), "frame_index")
    counts = frames.groupBy("__rk", "__fb").agg(F.size(F.collect_set("frame_index")).alias("__n"))
    before = W.partitionBy("__rk").orderBy("__fb").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("__rk", "__fb", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.dense_rank().over(W.partitionBy("__rk", "__fb").orderBy("frame_index"))
    return placed.withColumn("__within", within).join(bases, ["__rk", "__fb"]).withColumn("__ord", F.col("__base") + F.col("__within")).drop("__base", "__within")


def lifetimes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(replay_id, unique_id, entity_type_id, start_frame, end_frame, n_frames) of each stretch of presence.

    Presence is contiguous over the frames that have the bucket; repeated rows count once. The type is
    the one at first sight of the stretch (of several, the least). Rows without a frame are left out.
    """
    own = rows.select("replay_id", "frame_index", "unique_id", "entity_type_id")
    seen = _placed(own, block).groupBy("__rk", "__fb", "replay_id", "frame_index", "unique_id").agg(F.min("entity_type_id").alias("entity_type_id"))
    seen = _with_ordinal(seen, rows, block)
    follows = lambda prev, cur: prev("__ord") == cur("__ord") - 1
    runs = collapse_runs(seen, ["__rk", "replay_id", "unique_id"], "frame_index", ["__ord", "entity_type_id"], follows, combine=False, blocks="__fb")
    return runs.select("replay_id", "unique_id", F.col("state_entity_type_id").alias("entity_type_id"), F.col("first").alias("start_frame"), F.col("last").alias("end_frame"), F.col("n_events").alias("n_frames"))


def value_spans(rows: DataFrame, properties: Sequence[str], delivered: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(replay_id, unique_id, property, value, start_frame, end_frame) of each stretch of one value (as text).

    A span ends when the value changes or the entity is absent from a frame that has the bucket. Null
    is a value. Of several rows of an entity's frame the last ``delivered`` counts. Rows without a frame are left out.
    """
    cells = [F.col(p).cast("string").alias(f"__p{i}") for i, p in enumerate(properties)]
    own = _placed(rows.select("replay_id", "frame_index", "unique_id", *cells, (F.lit(None).cast("int") if delivered is None else delivered).alias("__d")), block)
    w = W.partitionBy("__rk", "__fb", "frame_index", "unique_id").orderBy(F.col("__d").desc_nulls_last())
    own = own.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n", "__d")
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(f"__p{i}").alias("value")) for i, p in enumerate(properties)]))
    long = _with_ordinal(own, rows, block).select("__rk", "__fb", "replay_id", "frame_index", "unique_id", "__ord", pairs.alias("x")).select("*", "x.property", "x.value").drop("x")
    same = lambda prev, cur: (prev("__ord") == cur("__ord") - 1) & prev("value").eqNullSafe(cur("value"))
    runs = collapse_runs(long, ["__rk", "replay_id", "unique_id", "property"], "frame_index", ["__ord", "value"], same, combine=False, blocks="__fb")
    return runs.select("replay_id", "unique_id", "property", F.col("state_value").alias("value"), F.col("first").alias("start_frame"), F.col("last").alias("end_frame"))


def unique_properties(rows: DataFrame, properties: Sequence[str]) -> DataFrame:
    """(properties..., n_entities, unique_ids) of each distinct combination of values; ids sorted.

    Entities and combinations are made distinct before they are grouped, so the group by
    combination sees each entity once. Entities without any of the properties' columns are those
    of other types and should be filtered before.
    """
    distinct = rows.select("unique_id", *properties).distinct()
    return distinct.groupBy(*properties).agg(F.count("*").alias("n_entities"), F.sort_array(F.collect_list("unique_id")).alias("unique_ids"))


def track(rows: DataFrame, unique_id: str | None, prop: str, start: int, end: int, step: int = 1) -> DataFrame:
    """A property of one entity (None: of all) at frames start, start + step, ... ; frames without it are skipped."""
    if unique_id is not None:
        rows = rows.where(F.col("unique_id") == unique_id)
    return frame_stride(rows, start, end, step).select("replay_id", "frame_index", "unique_id", F.col(prop).alias("value"))


def scan_report(rows: DataFrame, bucket: int, unique_ids: Sequence[str] = ()) -> DataFrame:
    """One row on what a scan of a bucket would see: n_frames, n_with_bucket, n_matched, and a message where that is nothing.

    rows: frame rows with bucket_index. An empty list of ids matches all.
    """
    here = F.col("bucket_index") == bucket
    named = here & F.col("unique_id").isin(list(unique_ids)) if unique_ids else here
    frame = F.struct("replay_id", "frame_index")
    counts = rows.agg(F.count_distinct(frame).alias("n_frames"), F.count_distinct(F.when(here, frame)).alias("n_with_bucket"), F.count_if(named).alias("n_matched"))
    message = F.when(F.col("n_frames") == 0, "no frames").when(F.col("n_with_bucket") == 0, "the bucket is not present").when(F.col("n_matched") == 0, "no entities matched").otherwise("")
    return counts.withColumn("message", message)
