"""The clock of a recording: late frames, synthesised times, gaps, segments, chunks, summaries.

All functions take one row per (replay_id, frame_index) and go through ``blocked``, so that a
recording of any length spreads over tasks. Markers count frames from 1, as recorded files do;
``frame_index`` columns stay 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.blocked import Running, accumulated, running, windows

TICKS = 10_000_000
KEY = ["replay_id"]


def frame_step(fps: Column) -> Column:
    """Ticks of one frame, a whole number."""
    return F.floor(F.lit(TICKS) / fps).cast("bigint")


def accepted(clock: DataFrame, value: str, increasing: bool = True, arrival: str = "arrival") -> DataFrame:
    """Rows that one monotonic filter lets in, in order of arrival.

    A row passes if it is beyond every earlier one: a rejected row never moves the bound, so the
    bound is the running extreme of all rows before it. Rows with null pass. ``arrival`` must be distinct.
    """
    how = "max" if increasing else "min"
    out = running(clock, KEY, arrival, {"__bound": (how, F.col(value), False)})
    beyond = F.col(value) > F.col("__bound") if increasing else F.col(value) < F.col("__bound")
    return out.where(F.col(value).isNull() | F.col("__bound").isNull() | beyond).drop("__bound")


def numbered(clock: DataFrame, order: str = "frame_index") -> DataFrame:
    """``marker``: 1 for the first frame of a recording, counting accepted frames."""
    return running(clock, KEY, order, _marker())


def _marker() -> Running:
    return {"marker": ("count", F.lit(1), True)}


def gaps(clock: DataFrame, fps: Column, factor: float = 3) -> DataFrame:
    """Frames more than ``factor`` frame steps after the one before (in utc_ticks)."""
    rows = windows(clock, KEY, "frame_index", ["utc_ticks"], _marker())
    return rows.where(F.col("utc_ticks") - F.col("prev_utc_ticks") > factor * frame_step(fps)).select("replay_id", "frame_index", "marker", (F.col("utc_ticks") - F.col("prev_utc_ticks")).alias("step_ticks"))


def segments(clock: DataFrame, value: str, increasing: bool = True, marked: DataFrame | None = None) -> DataFrame:
    """Frames where the game clock runs against its direction, and those marked by hand (replay_id, marker), each once."""
    rows = windows(clock, KEY, "frame_index", [value], _marker())
    turn = F.col(value) < F.col(f"prev_{value}") if increasing else F.col(value) > F.col(f"prev_{value}")
    found = rows.where(turn).select("replay_id", "marker")
    return found if marked is None else found.unionByName(marked.select("replay_id", "marker")).distinct()


def times_from_fps(clock: DataFrame, fps: Column, start_utc: int = 0) -> DataFrame:
    """Both times from the frame count alone."""
    passed = (F.col("marker") - 1) * frame_step(fps)
    return numbered(clock).withColumns({"fake_game_ticks": passed, "fake_utc_ticks": F.lit(start_utc) + passed})


def game_time_from_utc(clock: DataFrame) -> DataFrame:
    """Game time as the time since the first frame."""
    rows = running(clock, KEY, "frame_index", {"__first": ("min", F.struct("frame_index", "utc_ticks"), True)})
    return rows.withColumn("fake_game_ticks", F.col("utc_ticks") - F.col("__first.utc_ticks")).drop("__first")


def utc_from_game_time(clock: DataFrame, fps: Column, start_utc: int = 0, increasing: bool = True) -> DataFrame:
    """UTC from the game clock; where that stands still or turns back, UTC goes on by one frame step."""
    def step(before: Column, now: Column) -> Column:
        d = now - before
        return F.when(d > 0, d).otherwise(frame_step(fps)) if increasing else F.when(d < 0, d).otherwise(-frame_step(fps))

    return accumulated(clock, KEY, "frame_index", "fake_utc_ticks", "game_ticks", F.lit(start_utc) + F.col("game_ticks"), step)


def chunk_of(marker: Column, max_frames: int = 1000) -> Column:
    """Chunk number of a frame's count; a chunk is flushed before it would exceed ``max_frames``."""
    return F.floor((marker - 1) / max_frames).cast("int")


def seek_table(clock: DataFrame, max_frames: int = 1000) -> DataFrame:
    """(replay_id, chunk_index, start_frame, end_frame, n_frames) over accepted frames' 0-based counts, ends included."""
    rows = numbered(clock).withColumn("chunk_index", chunk_of(F.col("marker"), max_frames))
    return rows.groupBy("replay_id", "chunk_index").agg((F.min("marker") - 1).alias("start_frame"), (F.max("marker") - 1).alias("end_frame"), F.count("*").alias("n_frames"))


def chunk_for(frames: DataFrame, chunks: DataFrame, position: str = "position") -> DataFrame:
    """Rows with the chunk that holds them: an equi-join on the chunk's fixed size, then the exact bounds."""
    size = chunks.groupBy("replay_id").agg(F.max("n_frames").alias("__size"))
    keyed = chunks.join(size, "replay_id").withColumn("__slot", F.floor(F.col("start_frame") / F.col("__size")))
    placed = frames.join(size, "replay_id").withColumn("__slot", F.floor(F.col(position) / F.col("__size")))
    both = placed.join(keyed.drop("__size", "n_frames"), ["replay_id", "__slot"])
    return both.where(F.col(position).between(F.col("start_frame"), F.col("end_frame"))).drop("__slot", "__size", "start_frame", "end_frame")


def footer_summary(clock: DataFrame) -> DataFrame:
    """(replay_id, total_frames, duration_ticks, avg_fps); avg_fps only where both are above zero."""
    out = clock.groupBy("replay_id").agg(F.count("*").alias("total_frames"), (F.max("utc_ticks") - F.min("utc_ticks")).alias("duration_ticks"))
    return out.withColumn("avg_fps", F.when((F.col("total_frames") > 0) & (F.col("duration_ticks") > 0), F.col("total_frames") * float(TICKS) / F.col("duration_ticks")))


def last_chunk(clock: DataFrame, max_frames: int = 1000) -> DataFrame:
    """The frames of each recording's last chunk."""
    rows = numbered(clock).withColumn("chunk_index", chunk_of(F.col("marker"), max_frames))
    top = rows.groupBy("replay_id").agg(F.max("chunk_index").alias("chunk_index"))
    return rows.join(top, ["replay_id", "chunk_index"], "left_semi")


def append_times(times: DataFrame, more: DataFrame) -> DataFrame:
    """Times of a growing recording: frames already there stay as they are."""
    new = more.join(times.select("replay_id", "frame_index"), ["replay_id", "frame_index"], "left_anti")
    return times.unionByName(new.select(times.columns))
