"""Mutation of frames before they are written: processors, chains, and the helpers they use."""

from __future__ import annotations

import copy
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


class Processor:
    """A step on the frame table. ``init`` may raise to refuse installation; ``clear`` undoes it."""

    def init(self, columns: Sequence[str]) -> None:
        pass

    def process(self, rows: DataFrame) -> DataFrame:
        return rows

    def clear(self) -> None:
        pass

    def print_info(self) -> str:
        return type(self).__name__


class Chain(Processor):
    """Processors in order of registration; the last writer of a column wins; cleared in reverse."""

    def __init__(self, *steps: Processor, on_error: str = "raise"):
        if on_error not in ("raise", "ignore"):
            raise ValueError("on_error must be raise or ignore")
        self.steps = list(steps)
        self.on_error = on_error

    def init(self, columns: Sequence[str]) -> None:
        for step in self.steps:
            step.init(columns)

    def process(self, rows: DataFrame) -> DataFrame:
        for step in self.steps:
            try:
                rows = step.process(rows)
            except Exception:
                if self.on_error == "raise":
                    raise
                log.warning("%s failed and is passed over", step.print_info(), exc_info=True)
        return rows

    def clear(self) -> None:
        for step in reversed(self.steps):
            step.clear()

    def print_info(self) -> str:
        return " > ".join(s.print_info() for s in self.steps)


class Function(Processor):
    def __init__(self, function: Callable[[DataFrame], DataFrame], name: str = "function"):
        self.function, self.name = function, name

    def process(self, rows: DataFrame) -> DataFrame:
        return self.function(rows)

    def print_info(self) -> str:
        return self.name


class RowFunction(Processor):
    """A Python function on each row (a dict, changed in place or returned), in Arrow batches.

    ``on_error="ignore"`` keeps a row on which the function fails as it was and goes on; ``raise`` ends the job. For
    what column expressions can't say: rows pass through Python.
    """

    def __init__(self, function: Callable[[dict], dict | None], on_error: str = "raise", name: str = "row function"):
        if on_error not in ("raise", "ignore"):
            raise ValueError("on_error must be raise or ignore")
        self.function, self.on_error, self.name = function, on_error, name

    def process(self, rows: DataFrame) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        function, ignore, shape = self.function, self.on_error == "ignore", to_arrow_schema(rows.schema)

        def walk(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    changed = copy.deepcopy(row)
                    try:
                        changed = function(changed) or changed
                        pa.RecordBatch.from_pylist([changed], shape)  # a value of another type fails here, with its row
                    except Exception:
                        if not ignore:
                            raise
                        changed = row
                    out.append(changed)
                yield pa.RecordBatch.from_pylist(out, shape)

        return rows.mapInArrow(walk, rows.schema)

    def print_info(self) -> str:
        return self.name


class Clamp(Processor):
    """Brings numbers into [low, high] and marks the rows that it changed in ``clamped_<column>``, if asked."""

    def __init__(self, column: str, low: float = 0.0, high: float = 100.0, count: bool = False):
        self.column, self.low, self.high, self.count = column, low, high, count

    def init(self, columns: Sequence[str]) -> None:
        if self.column not in columns:
            raise ValueError(f"no column {self.column}")

    def process(self, rows: DataFrame) -> DataFrame:
        kind = dict(rows.dtypes)[self.column]
        old = F.col(self.column)
        new = F.when(old.isNotNull(), F.greatest(F.lit(self.low), F.least(F.lit(self.high), old))).cast(kind)
        if self.count:
            rows = rows.withColumn(f"clamped_{self.column}", F.coalesce(old != new, F.lit(False)))
        return rows.withColumn(self.column, new)


class Alive(Processor):
    """is_alive follows from health: false at or below zero; a null health leaves it."""

    def process(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("is_alive", F.when(F.col("health") <= 0, False).otherwise(F.col("is_alive")))


def set_value(rows: DataFrame, column: str, value: Column, where: Column | None = None) -> DataFrame:
    """Sets a column on the rows where the condition holds; an unknown column is left alone."""
    if column not in rows.columns:
        return rows
    kind = dict(rows.dtypes)[column]
    value = value.cast(kind)
    return rows.withColumn(column, value if where is None else F.when(where, value).otherwise(F.col(column)))


def set_nested(rows: DataFrame, path: str, value: Callable[[Column], Column], where: Column | None = None) -> DataFrame:
    """Sets a value inside a structured property: ``a.b`` is a field, ``a[].b`` a field of every element of an array.

    value is given the old value. Null structs and arrays stay null, an unknown path leaves the rows alone, array sizes stay.
    """
    steps = path.replace("[]", ".[]").split(".")
    kind = {f.name: f.dataType for f in rows.schema.fields}.get(steps[0])
    for step in steps[1:]:
        kind = kind.elementType if step == "[]" and isinstance(kind, T.ArrayType) else kind[step].dataType if isinstance(kind, T.StructType) and step in kind.names else None
        if kind is None:
            return rows
    if kind is None:
        return rows

    def edited(old: Column, rest: list[str]) -> Column:
        if not rest:
            return value(old).cast(kind)
        if rest[0] == "[]":
            return F.when(old.isNotNull(), F.transform(old, lambda x: edited(x, rest[1:])))
        return F.when(old.isNotNull(), old.withField(rest[0], edited(old[rest[0]], rest[1:])))

    new = edited(F.col(steps[0]), steps[1:])
    return rows.withColumn(steps[0], new if where is None else F.when(where, new).otherwise(F.col(steps[0])))


def with_context(rows: DataFrame, max_frames: int = 1000) -> DataFrame:
    """What a processor is told of a frame: ``frame_number`` (0-based, counting frames), ``chunk_index`` and ``chunk_frame`` inside the chunk."""
    from framelake.operators.timeline import chunk_of, numbered

    frames = numbered(rows.select("replay_id", "frame_index").distinct())
    frames = frames.select("replay_id", "frame_index", (F.col("marker") - 1).alias("frame_number"), chunk_of(F.col("marker"), max_frames).alias("chunk_index"), F.pmod(F.col("marker") - 1, F.lit(max_frames)).alias("chunk_frame"))
    return rows.join(frames, ["replay_id", "frame_index"])


def add_entities(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Appends entities; properties they lack are null."""
    return rows.unionByName(extra, allowMissingColumns=True)


def remove_if(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition is not true (null keeps)."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def type_ranges(rows: DataFrame, n_types: int) -> DataFrame:
    """(replay_id, frame_index, entity_type_id, start_index, n_entities) for types 0 to n_types - 1, also absent ones up to the largest present.

    One aggregation per frame; the ranges are unfolded from its counts without another shuffle.
    """
    counts = rows.where(F.col("entity_type_id") >= 0).groupBy("replay_id", "frame_index").agg(*[F.count(F.when(F.col("entity_type_id") == t, 1)).alias(f"n{t}") for t in range(n_types)])
    made, before = [], F.lit(0).cast("bigint")
    for t in range(n_types):
        later = sum((F.col(f"n{u}") for u in range(t, n_types)), F.lit(0))
        made.append(F.when(later > 0, F.struct(F.lit(t).alias("entity_type_id"), before.alias("start_index"), F.col(f"n{t}").alias("n_entities"))))
        before = before + F.col(f"n{t}")
    return counts.select("replay_id", "frame_index", F.explode(F.array_compact(F.array(*made))).alias("x")).select("replay_id", "frame_index", "x.*")


def bucket_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("replay_id", "frame_index").agg(F.count_distinct("bucket_index").alias("n_buckets"), F.count("*").alias("n_entities"))


def missing_fields(rows: DataFrame, declared: dict[int, Sequence[str]]) -> DataFrame:
    """Entities with declared properties that have no value: (keys, missing) with the names in declared order."""
    names = None
    for type_id, properties in declared.items():
        found = F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in properties]))
        names = F.when(F.col("entity_type_id") == type_id, found) if names is None else names.when(F.col("entity_type_id") == type_id, found)
    out = rows.withColumn("missing", names).where(F.size("missing") > 0)
    return out.select("replay_id", "frame_index", "unique_id", "entity_type_id", F.array_join("missing", ",").alias("missing"))


class Sanitizers(Processor):
    """A function per entity type; rows of other types pass as they are. Types are told apart by one narrow expression each."""

    def __init__(self):
        self.by_type: dict[int, dict[str, Callable[[Column], Column]]] = {}

    def add(self, type_id: int, column: str, function: Callable[[Column], Column]) -> Sanitizers:
        self.by_type.setdefault(type_id, {})[column] = function
        return self

    def process(self, rows: DataFrame) -> DataFrame:
        for type_id, columns in self.by_type.items():
            for column, function in columns.items():
                rows = set_value(rows, column, function(F.col(column)) if column in rows.columns else F.lit(None), F.col("entity_type_id") == type_id)
        return rows

    def clear(self) -> None:
        self.by_type.clear()
