"""Filling fixed-capacity containers with items by the sum-of-squares rule.

Each packer keeps, for every fill level, the number of its open containers at that level, and
puts an item where the sum of squared counts over partial levels becomes least. Items are placed
online, each as it comes and for good, so a packer holds its open containers only and its rows
leave as its items arrive. Packers are independent: items are dealt to them by hash, about
``per_packer`` each, so any number of items spreads evenly; they come in the order of that hash.
What stays partly filled is a few containers per packer, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Packer:
    """Open containers of one capacity by fill level."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.next = 0
        self.held: dict[int, int] = {}

    def place(self, size: int) -> tuple[int, int, int]:
        """(container, place, offset) for an item of at most the capacity."""
        cap, count = self.capacity, self.count
        levels = np.flatnonzero(count[: cap - size + 1])
        level = 0
        best = 2 * count[size] + 1 if size < cap else 0
        if len(levels):
            after = levels + size
            change = 1 - 2 * count[levels] + np.where(after < cap, 2 * count[after] + 1, 0)
            i = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals, the fullest
            if change[i] <= best:
                level = int(levels[i])
        if level:
            box = self.open[level].pop()
            count[level] -= 1
        else:
            box = self.next
            self.next += 1
            self.held[box] = 0
        place = self.held[box]
        full = level + size
        if full < cap:
            self.held[box] = place + 1
            self.open[full].append(box)
            count[full] += 1
        else:
            del self.held[box]
        return box, place, level


class Online:
    """Places items of one group as they come: rows (item, container, place, offset, token_start, token_end)."""

    def __init__(self, capacity: int):
        self.capacity, self.packer = capacity, Packer(capacity)

    def add(self, item, size: int) -> Iterator[tuple]:
        start = 0
        while size - start >= self.capacity:  # alone at least a container: whole containers, then what is left
            yield item, self.packer.next, 0, 0, start, start + self.capacity
            self.packer.next += 1
            start += self.capacity
        if start < size:
            box, place, offset = self.packer.place(size - start)
            yield item, box, place, offset, start, size


def pack_group(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Rows (item, container, place, offset, token_start, token_end) for items (item, size), in their order."""
    online = Online(capacity)
    rows = [r for item, size in zip(items["item"].tolist(), items["size"].tolist(), strict=True) for r in online.add(item, size)]
    return pd.DataFrame(rows, columns=["item", "container", "place", "offset", "token_start", "token_end"])


def pack(sizes: DataFrame, targets: DataFrame, n_items: int, key: str = "doc_id", size: str = "n_tokens", per_packer: int = 50_000) -> DataFrame:
    """(target_id, container_id, place, offset, key, token_start, token_end) of every item for every target.

    sizes: one row an item; null and non-positive sizes are left out, repeated keys are items of
    their own. targets: (target_id, capacity), rows without a positive capacity are left out.
    n_items only sets the number of packers. An item is whole unless it exceeds the capacity;
    then it fills containers of its own and its end is packed like an item. No items, no rows.
    """
    packers = max(1, math.ceil(n_items / per_packer))
    items = sizes.where(F.col(size) > 0).select(F.col(key).alias("item"), F.col(size).cast("int").alias("size"), F.xxhash64(key).alias("turn"))
    goals = targets.where(F.col("capacity") > 0).select(F.col("target_id").cast("int"), F.col("capacity").cast("int")).distinct()
    # every item goes to every target: targets are a handful of settings, collected to keep the plan free of joins
    wanted = sorted((r.target_id, r.capacity) for r in goals.collect())
    if not wanted:
        wanted, items = [(0, 1)], items.limit(0)
    kind = dict(items.dtypes)["item"]
    groups = F.transform(F.array(*[F.lit(i * packers) for i in range(len(wanted))]), lambda g: g + F.pmod(F.shiftrightunsigned("turn", 16), F.lit(packers)).cast("int"))
    dealt = items.withColumn("group", F.explode(groups))
    # a partition a group; a definite order, so that a task that runs again gives the same rows
    placed = dealt.repartitionById(len(wanted) * packers, "group").sortWithinPartitions("group", "turn", "item", "size").select("group", "item", "size")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, online = -1, None
        for batch in batches:
            made: list[tuple] = []
            at: list[int] = []
            for i, (group, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if group != now:
                    now, online = group, Online(wanted[group // packers][1])
                for row in online.add(group, n):
                    made.append(row)
                    at.append(i)
            group, box, place, offset, start, end = (np.array([r[j] for r in made], np.int64) for j in range(6))
            target = np.array([t for t, _ in wanted], np.int64)[group // packers]
            cells = [target, ((group % packers) << 32) + box, place, offset, start, end]
            columns = [pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            columns.insert(4, batch.column(1).take(pa.array(at, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["target_id", "container_id", "place", "offset", "item", "token_start", "token_end"])

    shape = f"target_id int, container_id long, place int, offset int, item {kind}, token_start int, token_end int"
    return placed.mapInArrow(walk, shape).withColumnRenamed("item", key)


def faults(packed: DataFrame, sizes: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Per target: items placed, and how many containers or items break a rule (all 0 where packing is right).

    n_overfull: containers beyond the capacity; n_misplaced: parts that do not begin where the part
    before them in the container ends; n_broken: items whose parts do not cover them whole, or that are
    split though they fit. Keys of ``sizes`` must be distinct.
    """
    rows = packed.join(targets.where(F.col("capacity") > 0).distinct(), "target_id").withColumn("n", F.col("token_end") - F.col("token_start"))
    box = W.partitionBy("target_id", "container_id").orderBy("place")
    told = rows.withColumn("__off", F.coalesce(F.sum("n").over(box.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) != F.col("offset"))
    boxes = told.groupBy("target_id", "container_id").agg((F.sum("n") > F.max("capacity")).alias("full"), F.count_if("__off").alias("off"))
    boxes = boxes.groupBy("target_id").agg(F.count_if("full").alias("n_overfull"), F.sum("off").alias("n_misplaced"))
    parts = rows.groupBy("target_id", key).agg(F.count("*").alias("parts"), F.min("token_start").alias("low"), F.max("token_end").alias("high"), F.sum("n").alias("sum"), F.max("capacity").alias("capacity"))
    whole = parts.join(sizes.select(key, F.col(size).alias("__size")), key, "left")
    broken = (F.col("low") != 0) | ~F.col("high").eqNullSafe(F.col("__size")) | (F.col("sum") != F.col("__size")) | (F.col("parts") > 1) & (F.col("__size") <= F.col("capacity"))
    items = whole.groupBy("target_id").agg(F.count("*").alias("n_items"), F.count_if(broken).alias("n_broken"))
    return items.join(boxes, "target_id").select("target_id", "n_items", "n_overfull", "n_misplaced", "n_broken")
