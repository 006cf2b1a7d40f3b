import math
import random

import pytest
from pyspark.sql import types as T

from framelake.operators.spikes import implausible

VEC = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
SHAPE = T.StructType(
    [T.StructField("replay_id", T.StringType()), T.StructField("unique_id", T.StringType()), T.StructField("frame_index", T.IntegerType()), T.StructField("game_time", T.FloatType()), T.StructField("is_alive", T.BooleanType()), T.StructField("position", VEC), T.StructField("velocity", VEC), T.StructField("health", T.FloatType()), T.StructField("arrived_at", T.IntegerType()), T.StructField("field", T.StringType())]
)


def course(uid="p", n=120, fps=10, seed=0):
    """A circling player with a noisy velocity."""
    rng = random.Random(seed)
    out = []
    for f in range(n):
        t, w = f / fps, 0.7
        p = [30 * math.cos(w * t), 0.0, 30 * math.sin(w * t)]
        v = [-30 * w * math.sin(w * t) + rng.gauss(0, 0.2), 0.0, 30 * w * math.cos(w * t) + rng.gauss(0, 0.2)]
        out.append(["r", uid, f, t, True, p, v, 80.0, 0, "own"])
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([tuple(tuple(c) if isinstance(c, list) else c for c in r) for r in rows], SHAPE)
    return {(r.unique_id, r.frame_index, r.field, r.reason) for r in implausible(df, **more).collect()}


def planted():
    rows = course(" P ") + course("q", seed=1)
    by = {(r[1].strip().lower(), r[2]): r for r in rows}
    want = set()

    def mark(u, f, field, reason):
        want.add((u, f, field, reason))

    by["p", 20][5][0] += 9
    mark("p", 20, "position", "spike")
    for f in (40, 41, 42):
        by["p", f][6][2] = 700.0 + f
        mark("p", f, "velocity", "spike")
    by["p", 60][7] = 12.0
    mark("p", 60, "health", "spike")
    by["p", 70][5][1] = 61.0
    mark("p", 70, "position", "impossible")
    by["p", 71][6][0] = float("nan")
    mark("p", 71, "velocity", "impossible")
    by["p", 72][7] = 101.0
    mark("p", 72, "health", "impossible")
    for f in range(31, 37):
        by["q", f][5] = list(by["q", 30][5])
        mark("q", f, "position", "stuck")
    for f in range(81, 86):
        by["q", f][6] = list(by["q", 80][6])
        mark("q", f, "velocity", "stuck")
    for f in range(100, 120):  # damage that stays, then death
        by["q", f][7] = 30.0
    for f in range(110, 120):
        by["q", f][4], by["q", f][7], by["q", f][6] = False, 0.0, [0.0, 0.0, 0.0]
        by["q", f][5] = list(by["q", 110][5])
    for f in (50, 51):
        by["q", f][5] = None
        by["q", f][6] = None
        by["q", f][7] = None
    return rows + [list(by["p", 20]), list(by["q", 33])], want


@pytest.mark.parametrize("more", [{}, {"block": 32}, {"batch_rows": 50}])
def test_planted_readings(spark, more):
    rows, want = planted()
    random.Random(3).shuffle(rows)
    assert found(spark, rows, **more) == want


@pytest.mark.parametrize("block", [7, 40, 333])
def test_blocks_change_nothing(spark, block):
    """Courses of uneven noise, whose spread differs from part to part."""
    rng = random.Random(8)
    rows = course("p", 900) + course("q", 700, seed=2)
    for r in rows:
        calm = r[2] % 400 < 200
        r[6] = [c + rng.gauss(0, 0.05 if calm else 3.0) for c in r[6]]
        if rng.random() < 0.02:
            r[6][1] += rng.choice([9.0, 25.0, 60.0, 300.0])
        if rng.random() < 0.02:
            r[5][1] += rng.choice([0.3, 0.8, 4.0])
        if rng.random() < 0.02:
            r[7] -= rng.choice([3.0, 14.0, 40.0])
        if rng.random() < 0.1:
            r[rng.choice([5, 6, 7])] = None
    rows = [r for r in rows if rng.random() > 0.05]
    want = found(spark, rows)
    assert len(want) > 20 and found(spark, rows, block=block, batch_rows=100) == want


def test_the_lifting_keeps_even_courses_and_tells_levels():
    import numpy as np

    from framelake.operators import spikes

    n = 64
    t, seg = np.arange(n, dtype=float), np.zeros(n, int)
    line = np.stack([3 * t, -t, 0 * t], axis=1)
    assert all(np.nanmax(s) < 1e-9 for s in spikes._lifted(line, t, seg))
    wide = line.copy()
    wide[30:33, 2] += 10
    one, two = spikes._lifted(wide, t, seg)
    assert one[31] < 1e-9 and two[31] > 7  # the middle of a span of three shows at the second level
    uneven = np.sort(np.random.default_rng(0).choice(400, n, replace=False)).astype(float)
    assert np.nanmax(spikes._lifted(uneven[:, None] * 2.0, uneven, seg)[0]) < 1e-9
    counts = np.bincount(spikes.bucket_of(np.full(9, 3.0)), minlength=spikes.BUCKETS)
    assert 1.4826 * 3 / 1.2 < spikes.spread_of(counts) < 1.4826 * 3 * 1.2 and spikes.spread_of(counts * 0) == 0


def test_five_equal_readings_and_standing_still_are_fine(spark):
    rows = course()
    for f in range(31, 35):
        rows[f][5] = list(rows[30][5])
    for f in range(60, 90):
        rows[f][5], rows[f][6] = list(rows[60][5]), [0.0, 0.0, 0.0]
    assert not {x for x in found(spark, rows[:90]) if x[3] == "stuck"}


def test_nulls_and_empty(spark):
    assert found(spark, []) == set()
    rows = [["r", None, 0, None, None, None, None, None, None, None], [None, "x", None, 0.0, True, [0.0, 0.0, 0.0], None, 500.0, 0, None], [None, "x", 1, 0.0, None, [0.0, None, 99.0], None, 500.0, 0, None]]
    assert found(spark, rows) == {("x", 1, "health", "impossible")}
