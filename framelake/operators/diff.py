"""Structural diff of frames: which entities, slots and map keys were added, removed or replaced.

Two frames meet in one full outer equi-join on the entity; consecutive frames meet without a
join, by a window over each entity. Values compare by their type: floats within an epsilon,
everything else exactly; null is a missing slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-5


def differs(a: Column, b: Column, kind: T.DataType, epsilon: float = EPSILON) -> Column:
    """Whether two values of one type differ; NaN differs from nothing but numbers."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x, y = a.cast("double"), b.cast("double")
        both = a.isNotNull() & b.isNotNull()
        return F.when(both, ~(F.isnan(x) & F.isnan(y)) & (F.isnan(x) | F.isnan(y) | (F.abs(x - y) > epsilon))).otherwise(a.isNull() != b.isNull())
    if isinstance(kind, T.StructType):
        inner = F.lit(False)
        for f in kind.fields:
            inner |= differs(a[f.name], b[f.name], f.dataType, epsilon)
        return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(inner)
    if isinstance(kind, T.ArrayType):
        pair = F.zip_with(a, b, lambda x, y: differs(x, y, kind.elementType, epsilon))
        return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise((F.size(a) != F.size(b)) | F.exists(pair, lambda v: v))
    return ~a.eqNullSafe(b)


_NAMES = {T.BooleanType: "Bool", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float", T.DoubleType: "Double", T.StringType: "String"}


def container_of(kind: T.DataType) -> str:
    """The kind of slot that holds a value of a type, such as ``Int32``, ``Vector``, ``StringArray`` or ``Map``."""
    if isinstance(kind, T.MapType):
        return "Map"
    if isinstance(kind, T.ArrayType):
        return container_of(kind.elementType) + "Array"
    if isinstance(kind, T.StructType):
        names = kind.names
        return "Vector" if names == ["x", "y", "z"] else "Quat" if names == ["x", "y", "z", "w"] else "Transform" if names[:1] == ["translation"] else "Range" if names[:2] == ["min", "max"] else "Struct"
    return _NAMES.get(type(kind), "String")


_OPERATIONS = "array<struct<path:string,op:string,container:string,old_value:string,new_value:string>>"


def nested_ops(a: Column, b: Column, kind: T.DataType, path: Column, epsilon: float = EPSILON) -> Column:
    """Operations (path, op, container, old_value, new_value) that turn one value into another, down to the slots that differ.

    A struct is taken apart field by field and a map key by key; an array of structs element by element where
    both have as many, else it is one Replace; other arrays, vectors and scalars are one slot. What is null on
    one side is one Add or Remove. Paths read ``field``, ``[index]`` and ``{key}``.
    """
    none = F.array().cast(_OPERATIONS)
    text = lambda c: c.cast("string")
    one = lambda op: F.array(F.struct(path.alias("path"), op.alias("op"), F.lit(container_of(kind)).alias("container"), text(a).alias("old_value"), text(b).alias("new_value"))).cast(_OPERATIONS)
    edge = F.when(a.isNull() & b.isNull(), none).when(a.isNull(), one(F.lit("Add"))).when(b.isNull(), one(F.lit("Remove")))
    if isinstance(kind, T.StructType) and container_of(kind) == "Struct":
        return edge.otherwise(F.concat(none, *[nested_ops(a[f.name], b[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), epsilon) for f in kind.fields]))
    if isinstance(kind, T.ArrayType) and container_of(kind.elementType) == "Struct":
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        slots = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
        inner = F.flatten(F.transform(slots, lambda i: nested_ops(F.get(a, i), F.get(b, i), kind.elementType, at(i), epsilon)))
        return edge.when(F.size(a) != F.size(b), one(F.lit("Replace"))).otherwise(inner)
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
        at = lambda k: F.concat(path, F.lit("{"), k.cast("string"), F.lit("}"))
        return edge.otherwise(F.flatten(F.transform(keys, lambda k: nested_ops(F.try_element_at(a, k), F.try_element_at(b, k), kind.valueType, at(k), epsilon))))
    return edge.otherwise(F.when(differs(a, b, kind, epsilon), one(F.lit("Replace"))).otherwise(none))


def patch(a: DataFrame, b: DataFrame, properties: Sequence[str], keys: Sequence[str] = ("unique_id",), epsilon: float = EPSILON) -> DataFrame:
    """``diff_frames`` with nested operations: (keys..., op, property, path, container, old_value, new_value)."""
    keys = list(keys)
    kinds = {f.name: f.dataType for f in a.schema.fields}
    side = lambda df, n: df.where(F.col(keys[-1]) != "").select(*keys, F.struct(*properties).alias(n))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    whole = F.when(F.col("a").isNull(), "Add").when(F.col("b").isNull(), "Remove")
    entity = F.array(F.struct(F.lit(None).cast("string").alias("property"), F.struct(F.lit(None).cast("string").alias("path"), whole.alias("op"), F.lit("Entity").alias("container"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value")).alias("o")))
    each = [F.transform(nested_ops(F.col("a")[p], F.col("b")[p], kinds[p], F.lit(p), epsilon), lambda o, p=p: F.struct(F.lit(p).alias("property"), o.alias("o"))) for p in properties]
    ops = F.when(whole.isNotNull(), entity).otherwise(F.concat(*each))
    return both.select(*keys, F.explode(ops).alias("x")).select(*keys, "x.o.op", "x.property", "x.o.path", "x.o.container", "x.o.old_value", "x.o.new_value")


def _operation(old: Column, new: Column, changed: Column) -> Column:
    return F.when(changed, F.when(old.isNull(), "Add").when(new.isNull(), "Remove").otherwise("Replace"))


def _slots(rows: DataFrame, properties: Sequence[str], old, new, epsilon: float) -> Column:
    """One struct (property, op, old_value, new_value) for each changed slot."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    made = []
    for p in properties:
        a, b = old(p), new(p)
        op = _operation(a, b, differs(a, b, kinds[p], epsilon))
        made.append(F.when(op.isNotNull(), F.struct(F.lit(p).alias("property"), op.alias("op"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"))))
    return F.array_compact(F.array(*made))


def diff_frames(a: DataFrame, b: DataFrame, properties: Sequence[str], keys: Sequence[str] = ("unique_id",), epsilon: float = EPSILON) -> DataFrame:
    """Patch rows (keys..., op, property, old_value, new_value) that turn frame ``a`` into ``b``.

    An entity only in one frame gives one Add or Remove with a null property. Empty ids are no entities.
    """
    keys = list(keys)
    side = lambda df, n: df.where(F.col(keys[-1]) != "").select(*keys, F.struct(*properties).alias(n))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    whole = F.when(F.col("a").isNull(), "Add").when(F.col("b").isNull(), "Remove")
    entity = F.array(F.struct(F.lit(None).cast("string").alias("property"), whole.alias("op"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value")))
    ops = F.when(whole.isNotNull(), entity).otherwise(_slots(a, properties, lambda p: F.col("a")[p], lambda p: F.col("b")[p], epsilon))
    return both.select(*keys, F.explode(ops).alias("x")).select(*keys, "x.op", "x.property", "x.old_value", "x.new_value")


def diff_consecutive(rows: DataFrame, properties: Sequence[str], epsilon: float = EPSILON) -> DataFrame:
    """Changed slots of each entity against its own frame before: (replay_id, unique_id, frame_a, frame_b, op, property, values)."""
    w = W.partitionBy("replay_id", "unique_id").orderBy("frame_index")
    state = F.struct(*properties)
    held = rows.withColumns({"__a": F.lag(state).over(w), "frame_a": F.lag("frame_index").over(w)}).where(F.col("frame_a").isNotNull())
    ops = _slots(rows, properties, lambda p: F.col("__a")[p], F.col, epsilon)
    out = held.select("replay_id", "unique_id", "frame_a", F.col("frame_index").alias("frame_b"), F.explode(ops).alias("x"))
    return out.select("replay_id", "unique_id", "frame_a", "frame_b", "x.op", "x.property", "x.old_value", "x.new_value")


def summary(patch: DataFrame, keys: Sequence[str] = ("unique_id",)) -> DataFrame:
    """Per entity: its sorted changed properties and its number of operations."""
    return patch.groupBy(*keys).agg(F.sort_array(F.collect_set("property")).alias("properties"), F.count("*").alias("n_ops"))


def preview(patch: DataFrame, order: Sequence[str], most: int = 50) -> DataFrame:
    """The first operations, as a patch is printed."""
    return patch.orderBy(*order).limit(most)


def with_type_names(summaries: DataFrame, frame: DataFrame, keys: Sequence[str] = ("unique_id",)) -> DataFrame:
    """Summaries with the type name that an entity has in the later frame; removed entities have none."""
    names = frame.groupBy(*keys).agg(F.max("type_name").alias("type_name"))
    return summaries.join(names, list(keys), "left")


def histogram(patch: DataFrame) -> DataFrame:
    return patch.groupBy("op", "property").agg(F.count("*").alias("n_ops"))


def changed_hashes(rows: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Entities whose content hash differs from their frame before (the test that spares the slot-wise diff)."""
    w = W.partitionBy("replay_id", "unique_id").orderBy("frame_index")
    hashed = rows.withColumn("content_hash", F.xxhash64(*[x for p in properties for x in (F.col(p).isNull(), p)]))
    return hashed.withColumn("__before", F.lag("content_hash").over(w)).where(F.col("__before") != F.col("content_hash")).drop("__before")


def array_ops(a: Column, b: Column, kind: T.DataType, epsilon: float = EPSILON) -> Column:
    """Operations (op, slot_start, range_count) between two slot vectors: neighbours that changed make one range.

    One slot gives Replace, several ReplaceRange; slots beyond the other's end give one Add or Remove each.
    """
    common = F.least(F.size(a), F.size(b))
    slots = F.when(common > 0, F.sequence(F.lit(0), common - 1)).otherwise(F.array().cast("array<int>"))
    hit = lambda i: F.coalesce(differs(F.get(a, i), F.get(b, i), kind, epsilon), F.lit(False))
    starts = F.filter(slots, lambda i: hit(i) & ((i == 0) | ~hit(i - 1)))
    ends = F.filter(slots, lambda i: hit(i) & ((i == common - 1) | ~hit(i + 1)))
    ranges = F.zip_with(starts, ends, lambda s, e: F.struct(F.when(s == e, "Replace").otherwise("ReplaceRange").alias("op"), s.alias("slot_start"), (e - s + 1).alias("range_count")))
    beyond = lambda n, op: F.when(n > common, F.transform(F.sequence(common, n - 1), lambda i: F.struct(F.lit(op).alias("op"), i.alias("slot_start"), F.lit(1).alias("range_count")))).otherwise(F.array().cast("array<struct<op:string,slot_start:int,range_count:int>>"))
    return F.concat(ranges, beyond(F.size(a), "Remove"), beyond(F.size(b), "Add"))


def map_ops(a: Column, b: Column) -> Column:
    """Operations (op, key, old_value, new_value) between two maps, by key."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    row = lambda k: F.struct(
        F.when(~F.map_contains_key(a, k), "Add").when(~F.map_contains_key(b, k), "Remove").when(~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)), "Replace").alias("op"),
        k.alias("key"), F.try_element_at(a, k).cast("string").alias("old_value"), F.try_element_at(b, k).cast("string").alias("new_value"),
    )
    return F.filter(F.transform(keys, row), lambda r: r["op"].isNotNull())


def validate(patch: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str] = ("unique_id",)) -> DataFrame:
    """``patch`` with ``valid``: Replace needs the entity in both frames, Add in the later one, Remove in the earlier one, and values that differ."""
    keys = list(keys)
    there = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(True))
    both = patch.join(there(a, "in_a"), keys, "left").join(there(b, "in_b"), keys, "left")
    in_a, in_b = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    slot = F.col("property").isNotNull()
    valid = F.when(slot, in_a & in_b & ~F.col("old_value").eqNullSafe(F.col("new_value"))).when(F.col("op") == "Add", ~in_a & in_b).otherwise(in_a & ~in_b)
    return both.withColumn("valid", valid).drop("in_a", "in_b")


def path_text(unique_id: Column, prop: Column, slot: Column | None = None, key: Column | None = None) -> Column:
    """A readable path such as ``id.property[0]{key}``."""
    text = F.concat_ws(".", unique_id, prop)
    if slot is not None:
        text = F.concat(text, F.when(slot.isNotNull(), F.concat(F.lit("["), slot.cast("string"), F.lit("]"))).otherwise(""))
    if key is not None:
        text = F.concat(text, F.when(key.isNotNull(), F.concat(F.lit("{"), key, F.lit("}"))).otherwise(""))
    return text


def resolve(patch: DataFrame, frame: DataFrame, properties: Sequence[str], keys: Sequence[str] = ("unique_id",)) -> DataFrame:
    """``patch`` with ``found`` (the entity is in the frame) and ``value`` (its property's text): the data an operation points to."""
    keys = list(keys)
    value = F.coalesce(*[F.when(F.col("property") == p, F.col(f"__v.{p}").cast("string")) for p in properties])
    held = frame.select(*keys, F.struct(*properties).alias("__v"))
    return patch.join(held, keys, "left").withColumns({"found": F.col("__v").isNotNull(), "value": value}).drop("__v")


def is_ancestor(path: Column, other: Column) -> Column:
    """Whether a path (an array of steps) leads to another one below it."""
    return (F.size(path) < F.size(other)) & (F.slice(other, 1, F.size(path)) == path)
