"""Frame state as one long table: a row per entity and frame, a column per property.

Entities of several types share a bucket; a property that a type does not declare is null. The
order of entities in a bucket is derived (type, then id), so it needs no stored index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.tables import clean_id, table

#: Frame table columns that are not properties.
KEYS = ("replay_id", "frame_index", "unique_id")
#: type id -> (type name, source table, properties) of the arena recordings.
TYPES = {
    0: ("Player", "player_states", ("name", "team", "health", "armor", "position", "velocity", "is_alive", "score", "deaths")),
    1: ("Projectile", "projectiles", ("owner_id", "position", "velocity", "damage", "type")),
    2: ("MatchState", "match_states", ("score_team1", "score_team2", "round", "phase", "time_remaining")),
}
PROPERTIES = tuple(dict.fromkeys(p for _, _, ps in TYPES.values() for p in ps))


def latest(rows: DataFrame, keys: Sequence[str] = KEYS, delivered: str = "arrived_at") -> DataFrame:
    """The last delivered row of each key.

    Rows are placed by the keys but the frame, which later windows over an entity's frames need
    as well, while filters on any key (a frame, a recording) still go down to the scan.
    """
    source = [k for k in keys if k != "frame_index"]
    w = W.partitionBy(*source, "frame_index").orderBy(F.col(delivered).desc_nulls_last())
    return rows.repartition(*source).withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def entities(spark: SparkSession, d: str, type_id: int) -> DataFrame:
    """All entities of one type, ids normalised, the last delivery of each frame."""
    name, source, properties = TYPES[type_id]
    rows = table(spark, d, source).withColumn("unique_id", clean_id("unique_id"))
    rows = latest(rows).withColumns({"entity_type_id": F.lit(type_id), "type_name": F.lit(name)})
    clock = ["game_time"] if "game_time" in rows.columns else []
    return rows.select(*KEYS, "utc_ticks", *clock, "entity_type_id", "type_name", *properties)


def players(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d, 0)


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Every entity of every type in one sparse table (bucket 0, ``entity``)."""
    parts = [entities(spark, d, t) for t in TYPES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumns({"bucket_index": F.lit(0), "bucket_name": F.lit("entity")})


def deliveries(spark: SparkSession, d: str, type_id: int) -> DataFrame:
    """All rows of one type as delivered, ids normalised: for operators that choose among repeats themselves."""
    _, source, properties = TYPES[type_id]
    rows = table(spark, d, source).withColumns({"unique_id": clean_id("unique_id"), "entity_type_id": F.lit(type_id)})
    return rows.select(*KEYS, "entity_type_id", "arrived_at", *properties)


def presence(spark: SparkSession, d: str) -> DataFrame:
    """(replay_id, frame_index, unique_id, entity_type_id) of all entities, repeats included."""
    parts = [deliveries(spark, d, t).select(*KEYS, "entity_type_id") for t in TYPES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def frame_at(rows: DataFrame, index: int) -> DataFrame:
    """One frame; no rows where it does not exist."""
    return rows.where(F.col("frame_index") == index)


def frame_range(rows: DataFrame, start: int, count: int) -> DataFrame:
    """Frames start to start + count, both included."""
    return rows.where(F.col("frame_index").between(start, start + count))


def frame_context(rows: DataFrame, center: int, back: int, forward: int) -> DataFrame:
    return rows.where(F.col("frame_index").between(max(0, center - back), center + forward))


def frame_stride(rows: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Frames start, start + step, ... up to end."""
    if step < 1:
        raise ValueError("step must be at least 1")
    return rows.where(F.col("frame_index").between(start, end) & ((F.col("frame_index") - start) % step == 0))


def clamp_range(start: Column, end: Column, total: Column) -> tuple[Column, Column]:
    """A frame range brought inside [0, total - 1], the end not before the start."""
    low = F.greatest(F.lit(0), F.least(start, total - 1))
    return low, F.greatest(low, F.least(end, total - 1))


def nested(rows: DataFrame, properties: Sequence[str] = PROPERTIES) -> DataFrame:
    """One row a frame: ``data`` holds the buckets, each with its parallel unique_ids, entities and type_ranges."""
    entity = F.struct(F.col("entity_type_id").alias("type_id"), F.col("unique_id"), F.struct(*[p for p in properties if p in rows.columns]).alias("p"))
    buckets = rows.groupBy("replay_id", "frame_index", "bucket_index").agg(F.sort_array(F.collect_list(entity)).alias("e"))
    types = F.sequence(F.lit(0), F.array_max(F.transform("e", lambda e: e["type_id"])))
    count = lambda t: F.size(F.filter("e", lambda e: e["type_id"] == t))
    below = lambda t: F.size(F.filter("e", lambda e: e["type_id"] < t))
    bucket = F.struct(
        "bucket_index",
        F.transform("e", lambda e: e["unique_id"]).alias("unique_ids"),
        F.transform("e", lambda e: e["p"]).alias("entities"),
        F.transform("e", lambda e: e["type_id"]).alias("type_ids"),
        F.transform(types, lambda t: F.struct(below(t).alias("start"), count(t).alias("count"))).alias("type_ranges"),
    )
    return buckets.groupBy("replay_id", "frame_index").agg(F.sort_array(F.collect_list(bucket)).alias("data"))


def flattened(frames_nested: DataFrame) -> DataFrame:
    """The long form of ``nested``; a frame without buckets gives no rows."""
    b = frames_nested.select("replay_id", "frame_index", F.explode("data").alias("b"))
    e = b.select("replay_id", "frame_index", F.col("b.bucket_index").alias("bucket_index"), F.posexplode(F.arrays_zip("b.unique_ids", "b.entities", "b.type_ids")).alias("entity_index", "z"))
    return e.select("replay_id", "frame_index", "bucket_index", "entity_index", F.col("z.unique_ids").alias("unique_id"), F.col("z.type_ids").alias("entity_type_id"), "z.entities.*")
