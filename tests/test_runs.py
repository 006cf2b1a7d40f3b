import random

import pytest
from pyspark.sql import functions as F

from framelake.operators.blocked import accumulated, running, windows, with_previous
from framelake.operators.runs import collapse_runs
from framelake.operators.snapshots import neighbours


def brute(rows, near):
    out = []
    for key in sorted({r[0] for r in rows}, key=str):
        last, run = None, None
        for _, f, v in sorted({(k, f, v) for k, f, v in rows if k == key and f is not None}, key=lambda r: r[1]):
            if run is not None and last is not None and v is not None and abs(last - v) <= near:
                run[2], run[3] = f, run[3] + 1
            else:
                run = [key, f, f, 1]
                out.append(run)
            last = v
    return sorted(tuple(r) for r in out)


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_runs_do_not_depend_on_blocks(spark, block):
    rng = random.Random(4)
    rows = [(f"s{s}", f, round(rng.choice([1.0, 1.3, 1.6, 5.0]), 2)) for s in range(4) for f in range(60) if rng.random() < 0.8]
    rows += rng.sample(rows, 20)
    df = spark.createDataFrame(rows, "k string, f int, v double")
    near = lambda p, c: F.abs(p("v") - c("v")) <= 0.4
    got = collapse_runs(df, ["k"], "f", ["v"], near, block=block).select("k", "first", "last", "n_events").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 0.4)


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "a", 1), (None, 1, "b", 2), (None, 2, "b", 1), ("k", None, "x", 1), ("k", 5, None, 1), ("k", 6, None, 1)], "k string, f int, v string, t int")
    same = lambda p, c: p("v") == c("v")
    got = {(r.k, r.first, r["last"], r.n_events) for r in collapse_runs(df, ["k"], "f", ["v"], same, [F.col("t")]).collect()}
    assert got == {(None, 1, 2, 2), ("k", 5, 5, 1), ("k", 6, 6, 1)}
    assert collapse_runs(df.limit(0), ["k"], "f", ["v"], same).count() == 0


def test_negative_places_keep_their_lanes(spark):
    df = spark.createDataFrame([("k", f, 1 if f < 2 else 2) for f in range(-12, 6)], "k string, f int, v int")
    got = collapse_runs(df, ["k"], "f", ["v"], lambda p, c: p("v") == c("v"), block=4).collect()
    assert sorted((r.first, r["last"], r.n_events) for r in got) == [(-12, 1, 14), (2, 5, 4)]


@pytest.mark.parametrize("block", [2, 7, 100])
def test_blocked_windows(spark, block):
    rng = random.Random(1)
    values = {f: rng.randrange(100) for f in rng.sample(range(50), 30)}
    df = spark.createDataFrame([("a", f, v) for f, v in values.items()], "k string, f int, v int")
    order = sorted(values)
    prev = {r.f: r.prev_v for r in with_previous(df, ["k"], "f", ["v"], block).collect()}
    assert prev == {f: values[order[i - 1]] if i else None for i, f in enumerate(order)}
    run = {r.f: (r.s, r.m, r.n) for r in running(df, ["k"], "f", {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False), "n": ("count", F.lit(1), True)}, block).collect()}
    for i, f in enumerate(order):
        before = [values[g] for g in order[:i]]
        assert run[f] == (sum(before) + values[f], max(before) if before else None, i + 1)
    sums = {r.f: r.s for r in accumulated(df, ["k"], "f", "s", "v", F.col("v") + 1000, lambda a, b: F.when(b > a, b - a).otherwise(1), block).collect()}
    want, at = {}, 0
    for i, f in enumerate(order):
        step = values[f] - values[order[i - 1]] if i else 0
        at = at + (step if step > 0 else 1) if i else values[f] + 1000
        want[f] = at
    assert sums == want
    both = windows(df.withColumn("k", F.when(F.col("f") % 2 == 0, F.col("k"))), ["k"], "f", ["v"], {"n": ("count", F.lit(1), True)}, block).collect()
    for odd in (0, 1):  # null keys are a sequence of their own
        own = [f for f in order if f % 2 == odd]
        assert {r.f: (r.prev_v, r.n) for r in both if r.f % 2 == odd} == {f: (values[own[i - 1]] if i else None, i + 1) for i, f in enumerate(own)}
    near = {r.f: (r.before, r.after) for r in neighbours(df.select("k", "f"), ["k"], "f", block).collect()}
    assert near == {f: (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, f in enumerate(order)}


def test_p4_runs_keeps_stretches_of_one_frame(spark, data):
    from framelake.plans import training
    from framelake.tables import clean_id, table

    runs, keys = training.p4_runs(spark, data).cache(), ["replay_id", "sequence_id"]
    states = table(spark, data, "player_states").where("health is not null").select("replay_id", clean_id("unique_id").alias("sequence_id"), "frame_index")
    phases = table(spark, data, "match_states").where("phase is not null").select("replay_id", F.lit("match_state").alias("sequence_id"), "frame_index")
    frames = states.unionByName(phases).distinct()
    assert runs.agg(F.sum("n_frames")).first()[0] == frames.count()
    assert runs.where("n_frames = 1").count() > 0
    found = training.p4_found(spark, data)
    assert found.exceptAll(runs.where("n_frames > 1").select(found.columns)).count() == 0
    assert found.count() == runs.where("n_frames > 1").count()


@pytest.mark.parametrize("block", [1, 3, 50])
def test_lifetimes_and_spans_do_not_depend_on_blocks(spark, block):
    from framelake.operators.analysis import lifetimes, value_spans

    rng = random.Random(9)
    frames = sorted(rng.sample(range(60), 40))
    rows = [(r, f, u, 0, rng.choice("xy")) for r in ("r", None) for f in frames for u in ("a", "b", "c") if rng.random() < 0.8 and (u != "c" or 20 < f < 40)]
    df = spark.createDataFrame([*rows, *rng.sample(rows, 20)], "replay_id string, frame_index int, unique_id string, entity_type_id int, v string")
    want_lives, want_spans = set(), set()
    for replay in ("r", None):
        present = sorted({f for r, f, *_ in rows if r == replay})
        for u in "abc":
            values = {f: v for r, f, w, _, v in rows if r == replay and w == u}
            for changes, out in ((lambda a, b: False, want_lives), (lambda a, b: a != b, want_spans)):
                start = last = None
                for f in [*present, None]:
                    here = f in values
                    if start is not None and (not here or changes(values[last], values[f])):
                        out.add((replay, u, start, last, values[start] if out is want_spans else None))
                        start = None
                    if here:
                        start, last = f if start is None else start, f
    assert {(r.replay_id, r.unique_id, r.start_frame, r.end_frame, None) for r in lifetimes(df, block).collect()} == want_lives
    assert {(r.replay_id, r.unique_id, r.start_frame, r.end_frame, r.value) for r in value_spans(df, ["v"], block=block).collect()} == want_spans
