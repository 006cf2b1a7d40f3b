"""Implausible readings: spikes, stuck values and impossible values, per source.

Each source's course is taken apart by an undecimated lifting wavelet. At level j (steps of 2^(j-1)
readings) a reading's detail is its distance from the line between its two neighbours (prediction),
and half of the neighbours' details is given back to what stays (update), which the next level takes
apart in turn. Details count in robust spreads (median absolute detail) of their level in that source's
whole course. Spikes are spans of up to three readings that stand off from both their sides, which
agree (an exact check), with a detail far beyond the spread; runs of zero detail while the source
moves are stuck readings; bounds find impossible ones.

Copies are combined first, then rows are shuffled by (source, block of frames); long courses are cut
into blocks that overlap by ``HALO`` frames, so no source is gathered in one task. A block gives its
candidates, which depend on their neighbours only, and counts of its details' sizes; these counts are
summed up per source before its candidates are judged, so results do not depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALO = 32
MAX_SPAN = 3
MIN_STUCK = 6
LEVELS = 2
FIELDS = ("position", "velocity", "health")
#: Sizes of details are counted in buckets of half an octave; bucket 0 is for those next to zero.
BUCKETS = 64


@dataclass(frozen=True)
class Limits:
    """Bounds, and for each field (position, velocity, health) when a detail is a spike's."""

    arena: float = 60.0
    health: tuple[float, float] = (0.0, 100.0)
    #: by so many robust spreads of its source a spike's detail is out
    spreads: tuple[float, float, float] = (40.0, 140.0, 34.0)
    #: a spread is at least the resolution of a reading, for courses that mostly stand still
    resolution: tuple[float, float, float] = (0.01, 0.1, 0.25)
    #: the sides of a spike agree to within this share of its height
    back: tuple[float, float, float] = (0.5, 0.5, 0.25)
    #: a velocity is borne out if the way covered agrees with it to within this share of its departure
    borne_out: float = 0.5

    def least(self, field: int) -> float:
        """No detail up to this is a spike's, whatever the source."""
        return self.spreads[field] * 1.4826 * self.resolution[field]


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _lifted(x: np.ndarray, t: np.ndarray, seg: np.ndarray) -> list[np.ndarray]:
    """Sizes of the details of each level, nan where a reading has no neighbours on both sides in its segment."""
    out = []
    n = len(x)
    for level in range(LEVELS):
        step = 1 << level
        sizes = np.full(n, np.nan)
        detail = np.zeros_like(x)
        if n > 2 * step:
            i = np.arange(step, n - step)
            i = i[seg[i - step] == seg[i + step]]
            before, after = x[i - step], x[i + step]
            share = (t[i] - t[i - step]) / np.maximum(t[i + step] - t[i - step], 1e-12)
            detail[i] = x[i] - before - (after - before) * share[:, None]
            sizes[i] = _norm(detail[i])
        out.append(sizes)
        given = np.zeros_like(x)  # the update: what is left keeps the course's mean
        given[step:] += np.where((seg[step:] == seg[:-step])[:, None], detail[:-step], 0) if n > step else 0
        given[:-step] += np.where((seg[step:] == seg[:-step])[:, None], detail[step:], 0) if n > step else 0
        x = x + given / 4
    return out


def bucket_of(sizes: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(sizes > 2.0**-16, np.clip(np.floor(2 * np.log2(np.maximum(sizes, 2.0**-16))) + 32, 1, BUCKETS - 1), 0).astype(np.int64)


def spread_of(counts: np.ndarray) -> float:
    """Robust spread of details from the counts of their sizes: 1.4826 times the median's bucket (0 for none)."""
    total = counts.sum()
    if not total:
        return 0.0
    middle = int(np.searchsorted(np.cumsum(counts), (total + 1) // 2))
    return 0.0 if middle == 0 else 1.4826 * 2.0 ** ((middle - 32 + 0.5) / 2)


def _spans(x: np.ndarray, t: np.ndarray, seg: np.ndarray, levels: list[np.ndarray], least: float, back: float) -> tuple[np.ndarray, np.ndarray]:
    """Readings on spans that stand off from both their sides, which agree: mask, and (height, detail of each level) of each.

    A span's height is the least distance of its readings from the line between its sides, its
    details are the greatest of its readings. Of several spans of a reading the higher one counts.
    """
    n = len(x)
    told = np.zeros((n, 1 + LEVELS))
    for w in range(1, MAX_SPAN + 1):
        if n < w + 2:
            break
        i = np.arange(1, n - w)
        i = i[seg[i - 1] == seg[i + w]]
        before, after, t0, t1 = x[i - 1], x[i + w], t[i - 1], t[i + w]
        height = np.full(len(i), np.inf)
        for k in range(w):
            share = (t[i + k] - t0) / np.maximum(t1 - t0, 1e-12)
            height = np.minimum(height, _norm(x[i + k] - before - (after - before) * share[:, None]))
        hit = (height > least) & (_norm(after - before) < back * height)
        i, height = i[hit], height[hit]
        own = np.stack([np.nanmax(np.stack([np.nan_to_num(sizes[i + k]) for k in range(w)]), axis=0) if len(i) else np.zeros(0) for sizes in levels], axis=1)
        for k in range(w):
            higher = height > told[i + k, 0]
            told[(i + k)[higher]] = np.column_stack([height, own])[higher]
    return told[:, 0] > 0, told


def _stuck(x: np.ndarray, sizes: np.ndarray, moving: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Mask of the second and later readings of runs of at least MIN_STUCK equal ones while moving: runs of zero detail."""
    n = len(x)
    flagged = np.zeros(n, bool)
    if n < MIN_STUCK:
        return flagged
    zero = sizes == 0
    zero[1:-1] &= moving[:-2] & moving[1:-1] & moving[2:]
    fresh = np.ones(n, bool)
    fresh[1:] = (zero[1:] != zero[:-1]) | (seg[1:] != seg[:-1])
    start = np.flatnonzero(fresh)
    length = np.diff(np.append(start, n))
    for a, m in zip(start[zero[start]], length[zero[start]], strict=True):
        if m >= MIN_STUCK - 2 and (x[a] == x[a - 1]).all():  # an even course has zero detail too
            flagged[a : a + m + 1] = True
    return flagged


@dataclass
class Judged:
    """Of one field: reason codes (0 none, 1 impossible, 2 spike candidate, 3 stuck), what the spikes are judged by, and sizes of details."""

    code: np.ndarray
    told: np.ndarray  #: height and detail of each level
    at: np.ndarray  #: the readings that have details
    sizes: list[np.ndarray]


def judge(source, frame, time, alive, position, velocity, health, limits: Limits) -> list[Judged]:
    """Position, velocity and health of courses.

    source: number of each row's source, ascending; rows of a source ascend in frame. Values come
    as (values, present); an unknown time is nan.
    """
    n = len(source)
    (p, has_p), (v, has_v), (h, has_h) = position, velocity, health
    bad_p = has_p & ~(np.isfinite(p) & (np.abs(p) <= limits.arena)).all(axis=1)
    bad_v = has_v & ~np.isfinite(v).all(axis=1)
    bad_h = has_h & ~(np.isfinite(h) & (h >= limits.health[0]) & (h <= limits.health[1]))
    # a life of a source: rows between deaths
    starts = np.ones(n, bool)
    starts[1:] = (source[1:] != source[:-1]) | (alive[1:] != alive[:-1])
    life = np.cumsum(starts)
    ok_p = has_p & ~bad_p & alive
    out = []
    for field, (x, has, bad) in enumerate(((p, has_p, bad_p), (v, has_v, bad_v), (h[:, None], has_h, bad_h))):
        at = np.flatnonzero(has & ~bad & alive)
        sizes = _lifted(x[at], frame[at], life[at])
        hit, own = _spans(x[at], frame[at], life[at], sizes, limits.least(field), limits.back[field])
        code, told = np.zeros(n, np.int8), np.zeros((n, 1 + LEVELS))
        code[at[hit]] = 2
        told[at] = own
        if FIELDS[field] == "velocity":  # unless the way covered bears it out
            i = np.flatnonzero(code == 2)
            i = i[i > 0]
            dt = time[i] - time[i - 1]
            known = ok_p[i] & ok_p[i - 1] & (life[i] == life[i - 1]) & (dt > 0)
            covered = (p[i] - p[i - 1]) / np.where(dt > 0, dt, 1)[:, None]
            code[i[known & (_norm(v[i] - covered) < limits.borne_out * _norm(v[i]))]] = 0
        code[bad] = 1
        out.append(Judged(code, told, at, sizes))

    # stuck: zero detail while the other reading moves; a null reading leaves the movement as it was
    def filled(present: np.ndarray, value: np.ndarray) -> np.ndarray:
        last = np.maximum.accumulate(np.where(present, np.arange(n), -1))
        return np.where((last >= 0) & (life[np.maximum(last, 0)] == life), value[np.maximum(last, 0)], False)

    here = np.flatnonzero(has_p)
    step = np.zeros(n, bool)
    if len(here) > 1:
        near = (source[here][1:] == source[here][:-1]) & (p[here][1:] != p[here][:-1]).any(axis=1)
        step[here[1:][near]] = True
        step[here[:-1][near]] = True
    runs = filled(has_v, (v != 0).any(axis=1)), filled(has_p, step) & (v != 0).any(axis=1)
    for judged, x, moving in zip(out, (p, v), runs, strict=False):
        at = judged.at
        judged.code[at[_stuck(x[at], judged.sizes[0], moving[at], life[at])]] = 3
    return out


REASONS = np.array(["", "impossible", "spike", "stuck"])
_FOUND = "replay_id string, unique_id string, frame_index int, field string, reason string, told array<double>, counts binary"


def _vector(batch: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    columns = [batch[f"{name}{a}"] for a in "xyz"]
    present = np.ones(len(batch), bool)
    for c in columns:
        present &= c.is_valid().to_numpy(zero_copy_only=False)
    return np.stack([c.fill_null(np.nan).to_numpy() for c in columns], axis=1), present


def _comparable(column: pa.ChunkedArray) -> pa.Array:
    """A key column in which null is a value of its own."""
    array = column.combine_chunks()
    return array.fill_null("\0") if pa.types.is_string(array.type) else array


def _judged(batch: pa.Table, limits: Limits) -> pa.RecordBatch | None:
    """Flagged rows and counts of whole groups; repeats of a frame (they lie side by side) count once."""
    first = np.ones(len(batch), bool)
    edge = np.ones(len(batch), bool)
    for name in ("replay_id", "unique_id", "block"):
        column = _comparable(batch[name])
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        edge[1:] = differs if name == "replay_id" else edge[1:] | differs
    frame = batch["frame_index"].to_numpy()
    first[1:] = edge[1:] | (frame[1:] != frame[:-1])
    keep = np.flatnonzero(first)
    batch, frame = batch.take(keep), frame[keep]
    source = np.cumsum(edge)[keep] - 1
    n_sources = int(source[-1]) + 1 if len(source) else 0
    health = batch["health"]
    judged = judge(
        source, frame.astype(float), batch["game_time"].fill_null(np.nan).to_numpy().astype(float), batch["is_alive"].fill_null(False).to_numpy(zero_copy_only=False),
        _vector(batch, "p"), _vector(batch, "v"),
        (health.fill_null(np.nan).to_numpy().astype(float), health.is_valid().to_numpy(zero_copy_only=False)), limits,
    )
    owned = batch["owned"].to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(np.diff(source, prepend=-1))  # a row of each group
    rows, fields, reasons, told, counts = [], [], [], [], []
    for name, of in zip(FIELDS, judged, strict=True):
        at = np.flatnonzero((of.code > 0) & owned)
        rows.append(at)
        fields += [name] * len(at)
        reasons += REASONS[of.code[at]].tolist()
        told += [row if c == 2 else None for row, c in zip(of.told[at].tolist(), of.code[at].tolist(), strict=True)]
        counts += [None] * len(at)
        made = np.zeros((n_sources, LEVELS, BUCKETS), np.int64)
        for level, sizes in enumerate(of.sizes):
            use = ~np.isnan(sizes) & owned[of.at]
            np.add.at(made, (source[of.at[use]], level, bucket_of(sizes[use])), 1)
        some = np.flatnonzero(made.any(axis=(1, 2)))
        rows.append(heads[some])
        fields += [name] * len(some)
        reasons += [None] * len(some)
        told += [None] * len(some)
        counts += [made[i].astype("<i8").tobytes() for i in some]
    at = np.concatenate(rows)
    if not len(at):
        return None
    out = batch.select(["replay_id", "unique_id", "frame_index"]).take(at)
    for name, values, kind in (("field", fields, pa.string()), ("reason", reasons, pa.string()), ("told", told, pa.list_(pa.float64())), ("counts", counts, pa.binary())):
        out = out.append_column(name, pa.array(values, kind))
    return out.combine_chunks().to_batches()[0]


def _settled(limits: Limits):
    """Judges the candidates of sources by the summed counts, which come first."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        sums: dict[str, np.ndarray] = {}
        bounds: dict[str, list[float]] = {}
        for batch in batches:
            keep: list[int] = []
            keys = zip(*[batch.column(c).to_pylist() for c in ("replay_id", "unique_id", "field", "told", "counts", "reason")], strict=True)
            for i, (replay, unique, field, told, counts, reason) in enumerate(keys):
                if now is None or (replay, unique) != now:
                    now, sums, bounds = (replay, unique), {}, {}
                if counts is not None:
                    own = np.frombuffer(counts, "<i8").reshape(LEVELS, BUCKETS)
                    sums[field] = sums[field] + own if field in sums else own
                elif reason != "spike":
                    keep.append(i)
                else:
                    if field not in bounds:
                        f = FIELDS.index(field)
                        own = sums.get(field, np.zeros((LEVELS, BUCKETS), np.int64))
                        bounds[field] = [limits.spreads[f] * max(spread_of(c), 1.4826 * limits.resolution[f]) for c in own]
                    out = bounds[field]
                    if told[0] > out[0] and any(d > b for d, b in zip(told[1:], out, strict=True)):
                        keep.append(i)
            yield batch.select(["replay_id", "unique_id", "frame_index", "field", "reason"]).take(pa.array(keep, pa.int32()))

    return walk


def implausible(states: DataFrame, limits: Limits = Limits(), block: int = 4096, batch_rows: int = 65_536) -> DataFrame:
    """(replay_id, unique_id, frame_index, field, reason) of each reading that cannot be right.

    states: replay_id, unique_id (compared trimmed and in lower case), frame_index, game_time,
    is_alive, position, velocity (structs of x, y, z), health, arrived_at; other columns are not
    read. A null reading is no case and does not break a course; a vector with a null component
    is null; a null is_alive counts as not alive; rows without a frame are left out; of several
    rows of a frame the last delivered counts; a velocity beside an unknown time is not borne out.
    Only the bounds apply while not alive. An empty table gives no rows. ``block`` only sets how
    work is cut up.
    """
    cast = lambda c: F.col(c).cast("double")
    number = F.greatest(F.floor(F.col("frame_index") / block), F.lit(0))  # the first block has what lies before frame 0 too
    within = F.col("frame_index") - number * block
    reach = -(-HALO // block)  # blocks that the halo touches on either side
    near = [F.when(F.lit(k) * block - within <= HALO, number + k) if k > 0 else F.when(within - (F.lit(k + 1) * block - 1) <= HALO, number + k) for k in range(-reach, reach + 1) if k]
    blocks = F.filter(F.array(number, *near), lambda b: b >= 0)
    rows = states.where(F.col("frame_index").isNotNull()).select(
        "replay_id", F.lower(F.trim("unique_id")).alias("unique_id"), "frame_index", F.col("game_time").alias("game_time"), "is_alive",
        *[cast(f"{n}.{a}").alias(f"{n[0]}{a}") for n in ("position", "velocity") for a in "xyz"],
        cast("health").alias("health"), "arrived_at", number.alias("__own"), F.explode(blocks).alias("block"),
    )
    # copies of a reading are combined before they meet, however many there are
    rows = rows.groupBy(*[c for c in rows.columns if c != "arrived_at"]).agg(F.max("arrived_at").alias("arrived_at"))
    rows = rows.withColumn("owned", F.col("block") == F.col("__own")).drop("__own")
    keys = ["replay_id", "unique_id", "block"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "frame_index", F.col("arrived_at").desc_nulls_last()).drop("arrived_at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def tail_start(table: pa.Table) -> int:
            """Where the last group begins."""
            start = 0
            for name in keys:
                column = _comparable(table[name])
                same = pc.equal(column, column[len(column) - 1]).to_numpy(zero_copy_only=False)
                other = np.flatnonzero(~same)
                start = max(start, int(other[-1]) + 1 if len(other) else 0)
            return start

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= batch_rows:
                table = pa.Table.from_batches(held)
                cut = tail_start(table)
                if cut:
                    out = _judged(table.slice(0, cut).combine_chunks(), limits)
                    if out is not None:
                        yield out
                    held = table.slice(cut).combine_chunks().to_batches()
                    count = table.num_rows - cut
        if count:
            out = _judged(pa.Table.from_batches(held).combine_chunks(), limits)
            if out is not None:
                yield out

    found = rows.mapInArrow(walk, _FOUND)
    # flagged rows and counts are few beside the readings; a source's counts lie before its candidates
    found = found.repartition("replay_id", "unique_id").sortWithinPartitions("replay_id", "unique_id", F.col("counts").isNull())
    return found.mapInArrow(_settled(limits), "replay_id string, unique_id string, frame_index int, field string, reason string")
