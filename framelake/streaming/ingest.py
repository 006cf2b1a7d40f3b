"""Ingest as a stream: late frames out, times filled in, markers set, frames numbered and chunked.

The clock of each recording is a small state that follows it: last times, frame count, offset.
One step function serves the stream (as state per recording) and batch checks alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.functions.time import TICKS_PER_SECOND
from framelake.operators.mutate import Processor

FILTERS = ("none", "increasing", "decreasing")
MODES = ("none", "utc", "game", "both")
NONE = -(1 << 62)


@dataclass
class Clock:
    """What a recording's clock remembers; NONE stands for nothing yet."""

    frames: int = 0
    last_utc: int = NONE
    first_utc: int = NONE
    last_game: int = NONE
    offset: int = 0
    mode: str = "none"


def to_ticks(seconds: float) -> int:
    """Single-precision seconds as ticks."""
    import numpy as np

    return int(np.float32(np.float32(seconds) * np.float32(TICKS_PER_SECOND)))


def step(clock: Clock, game_time: float | None, utc: int | None, fps: float = 60, time_filter: str = "none", increasing: bool = True, start_utc: int = 0) -> tuple[Clock, dict | None]:
    """The clock after a frame, and the frame's times and markers, or None where it is turned away.

    A frame is turned away if its UTC does not advance, if its game time goes against the filter,
    or if it lacks the times that earlier frames of the recording had. It then leaves no trace.
    """
    inverse = int(TICKS_PER_SECOND / fps)
    c = Clock(**asdict(clock))
    if utc is not None and c.last_utc != NONE and utc <= c.last_utc:
        return clock, None
    if game_time is not None and c.last_game != NONE:
        last = c.last_game / TICKS_PER_SECOND
        if time_filter == "increasing" and game_time <= last or time_filter == "decreasing" and game_time >= last:
            return clock, None
    if game_time is not None and utc is not None:
        c.mode = "both"
    elif utc is not None:
        c.mode = "utc"
    elif game_time is not None:
        c.mode = "game"
    elif c.mode != "none":
        return clock, None
    game = to_ticks(game_time) if game_time is not None else None
    if c.mode == "none":
        utc = start_utc if c.last_utc == NONE else c.last_utc + inverse
        game = 0 if c.last_game == NONE else c.last_game + inverse
    elif c.mode == "utc":
        game = utc - (c.first_utc if c.first_utc != NONE else utc)
    elif c.mode == "game":
        utc = start_utc + game + c.offset
        if c.last_utc != NONE:
            bump = 0
            if increasing and utc <= c.last_utc:
                bump = c.last_utc + inverse - utc
            elif not increasing and utc >= c.last_utc:
                bump = c.last_utc - inverse - utc
            c.offset += bump
            utc += bump
    c.frames += 1
    gap = c.last_utc != NONE and utc - c.last_utc > 3 * inverse
    turn = c.last_game != NONE and (game < c.last_game if increasing else game > c.last_game)
    out = {"frame_index": c.frames - 1, "marker": c.frames, "game_time_ticks": game, "created_utc_ticks": utc, "is_gap": bool(gap), "is_segment": bool(turn)}
    c.last_utc, c.last_game = utc, game
    if c.first_utc == NONE:
        c.first_utc = utc
    return c, out


_STATE = "frames long, last_utc long, first_utc long, last_game long, offset long, mode string"
_OUT = "replay_id string, source_frame long, frame_index long, marker long, game_time_ticks long, created_utc_ticks long, is_gap boolean, is_segment boolean, chunk_index long"


def _walk(clock: Clock, frame: pd.DataFrame, options: dict, max_frames: int) -> tuple[Clock, list[tuple]]:
    rows = []
    none = lambda v: None if v is None or pd.isna(v) else v
    for r in frame.sort_values("arrival", kind="stable").itertuples():
        utc = none(r.utc_ticks)
        clock, out = step(clock, none(r.game_time), None if utc is None else int(utc), **options)
        if out is not None:
            rows.append((r.replay_id, int(r.source_frame), *out.values(), out["frame_index"] // max_frames))
    return clock, rows


_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def accept_stream(clock: DataFrame, max_frames: int = 1000, **options) -> DataFrame:
    """The accepted frames of a stream of (replay_id, source_frame, game_time, utc_ticks, arrival), in order of arrival."""
    names = [f.name for f in fields(Clock)]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Clock(**dict(zip(names, state.get, strict=True))) if state.exists else Clock()
        frames = list(parts)  # one recording's rows of one micro-batch
        now, rows = _walk(now, pd.concat(frames), options, max_frames) if frames else (now, [])
        state.update(tuple(getattr(now, n) for n in names))
        yield pd.DataFrame(rows, columns=_NAMES)

    return clock.groupBy("replay_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def accept_batch(clock: DataFrame, max_frames: int = 1000, **options) -> DataFrame:
    """The same over a table, for filters that need the whole state; one filter alone is ``timeline.accepted``, which scales further.

    A recording's clock is sequential, so one task reads its rows in order; they stream through, and only the clock is held.
    """
    names = ["replay_id", "source_frame", "game_time", "utc_ticks", "arrival"]
    rows = clock.select(*names).repartition("replay_id").sortWithinPartitions("replay_id", "arrival")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Clock()
        for batch in batches:
            made = []
            for replay, frame, game, utc in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != (replay,):
                    now, state = (replay,), Clock()
                state, out = step(state, game, utc, **options)
                if out is not None:
                    made.append((replay, frame, *out.values(), out["frame_index"] // max_frames))
            cells = zip(*made, strict=True) if made else [[] for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, _ARROW, strict=True)], names=_NAMES)

    return rows.mapInArrow(walk, _OUT)


_ARROW = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in _OUT.split(", ")]


class RecordPipeline:
    """A stream of frames through processors into a table; each micro-batch is written once by its number."""

    def __init__(self, source: DataFrame, target: str, checkpoint: str, processor: Processor | None = None, partition_by: tuple[str, ...] = ()):
        self.source, self.target, self.checkpoint, self.processor, self.partition_by = source, target, checkpoint, processor, partition_by

    def run(self, on_progress: Callable[[int, int], None] | None = None, timeout: float | None = None) -> bool:
        """Whether any frame was written. Reads what is there, then stops."""
        if self.processor is not None:
            self.processor.init(self.source.columns)
        seen = {"rows": 0}

        def write(batch: DataFrame, number: int) -> None:
            out = self.processor.process(batch) if self.processor is not None else batch
            writer = out.write.mode("overwrite")
            if self.partition_by:
                writer = writer.partitionBy(*self.partition_by)
            at = f"{self.target}/batch={number}"
            writer.parquet(at)  # the batch's own folder: written again after a failure, it is the same
            n = batch.sparkSession.read.parquet(at).count()
            seen["rows"] += n
            if on_progress is not None:
                on_progress(number, seen["rows"])

        query = self.source.writeStream.foreachBatch(write).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        if not query.awaitTermination(timeout) if timeout else query.awaitTermination() is False:
            query.stop()
        return seen["rows"] > 0
