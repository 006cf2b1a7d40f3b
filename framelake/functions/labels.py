"""Labels of summaries and displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.text import fixed, numbers


def offset_label(offset: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(offset.cast("bigint")))


def location_label(v: Column) -> Column:
    return numbers("(", [v[c] for c in "xyz"], 0, ", ", ")")


def game_time_label(seconds: Column) -> Column:
    return F.concat(fixed(seconds, 2), F.lit("s"))


def vector_label(v: Column, digits: int = 3) -> Column:
    return numbers("(", [v[c] for c in "xyz"], digits, ", ", ")")


def quat_label(q: Column, digits: int = 4) -> Column:
    return numbers("(", [q[c] for c in "xyzw"], digits, ", ", ")")


def transform_label(t: Column) -> Column:
    return F.concat(F.lit("T"), vector_label(t["translation"]), F.lit(" R"), quat_label(t["rotation"]), F.lit(" S"), vector_label(t["scale"]))


def range_label(r: Column) -> Column:
    return F.concat(numbers("[", [r["min"], r["max"]], 3, " - ", "] "), fixed(r["value_normalized"], 3))


def clock_parts(frame: Column, fps: Column) -> dict[str, Column]:
    """Minutes, seconds and frame within the second of a frame number; a rate of zero or less counts as 30."""
    rate = F.when(fps > 0, fps).otherwise(30)
    total = F.floor(frame / rate)
    return {"minutes": F.floor(total / 60), "seconds": total % 60, "frames": F.floor(frame % rate)}


def visible_range(scroll: Column, width: Column, per_frame: Column, total: Column) -> tuple[Column, Column]:
    """First and last (excluded) frame that a timeline shows at a scroll position."""
    first = F.greatest(F.lit(0), F.least(total, F.floor(scroll / per_frame)))
    return first, F.greatest(first, F.least(total, F.ceil((scroll + width) / per_frame)))


def playback(position: float, seconds: float, speed: float, fps: float, total: int) -> float:
    """The frame position after some seconds of playing; speed stays within 0.1 and 10, the position within the recording."""
    return min(max(0.0, position + seconds * min(10.0, max(0.1, speed)) * fps), float(max(0, total - 1)))
