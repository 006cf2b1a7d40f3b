"""Runs of identical or near-identical consecutive events.

Each event is compared with its predecessor by a lag window, changes are flagged, the flags'
running sum names the run, and runs are aggregated. A sequence is cut into blocks of its order
column first, so a sequence that holds a third of all rows spreads over many tasks; only the
first and last run of each block meet again, in a lane of their own, to be joined across blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Same = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def collapse_runs(
    events: DataFrame,
    keys: Sequence[str],
    order: str,
    state: Sequence[str],
    same: Same,
    tie: Sequence[Column] = (),
    clock: str | None = None,
    block: int = 8192,
    min_length: int = 1,
    combine: bool = True,
    blocks: str | None = None,
) -> DataFrame:
    """One row a run: keys, first, last (of ``order``), n_events, state_<c> of its first event, duration.

    same(prev, cur): whether neighbours belong together, given functions from a state column's
    name to its value in either event; a null result counts as a change. ``tie`` chooses among
    several events of one place: the greatest counts (then the greatest state), the others are
    repeats and are not counted. duration is the difference of ``clock`` (else of ``order``) between the first
    and last event; null clocks are passed over. ``combine`` is for inputs that may hold many
    copies of an event; without it results are the same. Events with a null order are left out, null
    keys form sequences like other values; an empty input gives no runs. ``blocks`` names a column
    of block numbers that the input already lies by (in place of ``block``); places must then be distinct.
    """
    keys, state = list(keys), list(state)
    at = F.col(order)
    clock_column = F.col(clock) if clock else at
    rows = events.where(at.isNotNull()).select(
        *keys, at.alias("__at"), clock_column.alias("__clock"), *[F.col(c).alias(f"__s_{c}") for c in state], *[t.alias(f"__t{i}") for i, t in enumerate(tie)],
        (F.col(blocks) if blocks else F.floor(at / block)).alias("__block"),
    )
    if combine:  # copies of an event, before the shuffle, however many there are
        latest = [F.max(f"__t{i}").alias(f"__t{i}") for i in range(len(tie))]
        rows = rows.groupBy(*keys, "__at", *[f"__s_{c}" for c in state], "__block").agg(F.min("__clock").alias("__clock"), *latest)
    ties = [F.col(c).desc_nulls_last() for c in (*[f"__t{i}" for i in range(len(tie))], *[f"__s_{c}" for c in state])]
    w = W.partitionBy(*keys, "__block").orderBy("__at", *ties)
    rows = rows.withColumn("__before", F.lag("__at").over(w))
    if not blocks:
        rows = rows.where(~F.col("__before").eqNullSafe(F.col("__at"))).drop(*[f"__t{i}" for i in range(len(tie))])
        w = W.partitionBy(*keys, "__block").orderBy("__at")
    back = {c: F.lag(f"__s_{c}").over(w) for c in state}
    together = F.col("__before").isNotNull() & F.coalesce(same(lambda c: back[c], lambda c: F.col(f"__s_{c}")), F.lit(False))
    rows = rows.withColumn("__new", F.when(together, 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(w))
    # of a run's rows only its ends carry state on, so plain maxima (hash aggregation) pick them
    rows = rows.withColumn("__end", F.coalesce(F.lead("__new").over(w), F.lit(1)))
    runs = rows.groupBy(*keys, "__block", "__run").agg(
        F.min("__at").alias("__first"),
        F.max("__at").alias("__last"),
        F.count("*").alias("__n"),
        F.min("__clock").alias("__c0"),
        F.max("__clock").alias("__c1"),
        *[F.max(F.when(F.col("__new") == 1, F.col(f"__s_{c}"))).alias(f"__f_{c}") for c in state],
        *[F.max(F.when(F.col("__end") == 1, F.col(f"__s_{c}"))).alias(f"__l_{c}") for c in state],
    )
    ends = W.partitionBy(*keys, "__block")
    runs = runs.withColumn("__opens", F.col("__run") == 1).withColumn("__closes", F.col("__run") == F.max("__run").over(ends))
    lane = F.when(F.col("__opens") | F.col("__closes"), F.lit(-1)).otherwise(F.when(F.col("__block") >= 0, F.col("__block")).otherwise(F.col("__block") - 1))
    runs = runs.withColumn("__lane", lane)
    w = W.partitionBy(*keys, "__lane").orderBy("__first")
    back = {c: F.lag(f"__l_{c}").over(w) for c in state}
    joined = F.col("__opens") & F.lag(F.lit(1)).over(w).isNotNull() & F.coalesce(same(lambda c: back[c], lambda c: F.col(f"__f_{c}")), F.lit(False))
    runs = runs.withColumn("__join", F.when(joined, 0).otherwise(1))
    runs = runs.withColumn("__id", F.sum("__join").over(w))
    out = runs.groupBy(*keys, "__lane", "__id").agg(
        F.min("__first").alias("first"),
        F.max("__last").alias("last"),
        F.sum("__n").alias("n_events"),
        *[F.max(F.when(F.col("__join") == 1, F.col(f"__f_{c}"))).alias(f"state_{c}") for c in state],
        (F.max("__c1") - F.min("__c0")).alias("duration"),
    )
    return out.where(F.col("n_events") >= min_length).drop("__lane", "__id")
