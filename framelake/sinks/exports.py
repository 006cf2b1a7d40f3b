"""Exports of analyses as CSV, and answers as JSON."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.text import fixed, range_text


def _seconds(ticks: Column) -> Column:
    return F.concat(fixed(ticks / 1e7, 2), F.lit("s"))


def with_times(spans: DataFrame, clock: DataFrame) -> DataFrame:
    """Spans with start_ticks and end_ticks of their frames' game clock (0 where a frame has none)."""
    times = clock.select(F.col("replay_id").alias("__r"), F.col("frame_index").alias("__f"), F.col("game_ticks").alias("__g"))
    for side in ("start", "end"):
        spans = spans.join(times, (F.col("replay_id") == F.col("__r")) & (F.col(f"{side}_frame") == F.col("__f")), "left")
        spans = spans.withColumn(f"{side}_ticks", F.coalesce("__g", F.lit(0))).drop("__r", "__f", "__g")
    return spans


def lifetime_table(lives: DataFrame, names: dict[int, str]) -> DataFrame:
    """UniqueId, TypeName, TypeId, RangesFrame, RangesGameTime per entity, by its first frame."""
    one = F.struct("start_frame", range_text(F.col("start_frame"), F.col("end_frame")).alias("f"), F.concat(F.lit("["), _seconds(F.col("start_ticks")), F.lit("-"), _seconds(F.col("end_ticks")), F.lit("]")).alias("g"))
    out = lives.groupBy("replay_id", "unique_id").agg(F.min_by("entity_type_id", "start_frame").alias("TypeId"), F.sort_array(F.collect_list(one)).alias("r"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("TypeId")), F.lit(""))
    text = lambda k: F.array_join(F.transform("r", lambda r: r[k]), ", ")
    out = out.select("replay_id", F.col("unique_id").alias("UniqueId"), label.alias("TypeName"), "TypeId", text("f").alias("RangesFrame"), text("g").alias("RangesGameTime"), F.col("r")[0]["start_frame"].alias("__o"))
    return out.orderBy("replay_id", "__o", "UniqueId").drop("__o")


def unique_table(groups: DataFrame, properties: list[str]) -> DataFrame:
    """The properties, Count and UniqueIds (joined by semicolons), the largest groups first."""
    out = groups.select(*[F.col(p).cast("string").alias(p) for p in properties], F.col("n_entities").alias("Count"), F.array_join("unique_ids", ";").alias("UniqueIds"))
    return out.orderBy(F.desc("Count"), *properties)


def span_table(spans: DataFrame) -> DataFrame:
    """UniqueId, Property, Value, RangeFrame, RangeGameTime by entity, property and start."""
    time = F.concat(F.lit("["), _seconds(F.col("start_ticks")), F.lit("-"), _seconds(F.col("end_ticks")), F.lit("]"))
    out = spans.select("replay_id", F.col("unique_id").alias("UniqueId"), F.col("property").alias("Property"), F.coalesce("value", F.lit("")).alias("Value"), range_text(F.col("start_frame"), F.col("end_frame")).alias("RangeFrame"), time.alias("RangeGameTime"), "start_frame")
    return out.orderBy("replay_id", "UniqueId", "Property", "start_frame").drop("start_frame")


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; a field is quoted where it holds a comma, quote or line break, quotes are doubled."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def number_text(x: float, single: bool = False) -> str:
    """A number as answers give it: six or ten significant digits, null where it is not finite."""
    if not math.isfinite(x):
        return "null"
    return format(x, ".6g" if single else ".10g")


class Single(float):
    """A number of single precision, which answers give with six digits."""


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return None if not math.isfinite(value) else float(number_text(value, isinstance(value, Single)))
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return str(value)


def ok(command: str, data) -> str:
    return json.dumps({"status": "ok", "command": command, "data": _plain(data)}, ensure_ascii=False)


def error(command: str, message: str, hint: str | None = None) -> str:
    out = {"status": "error", "command": command, "error": message}
    return json.dumps(out | ({"hint": hint} if hint else {}), ensure_ascii=False)
