"""Frame rows from JSON, tagged messages and native records, by a schema or a mapping.

Error policies: ``strict`` fails on a missing key or an unreadable text, ``lenient`` keeps the
row with nulls and says which keys were missing, ``silent`` keeps it with nulls. Naming
policies: ``exact``, or ``lowercase`` for keys that match whatever their case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.text import fixed
from framelake.schema import SchemaRegistry

ERRORS = ("strict", "lenient", "silent")
NAMING = ("exact", "lowercase")


def from_json_text(
    rows: DataFrame, column: str, struct: T.StructType, errors: str = "lenient", naming: str = "exact", sanitize: Callable[[DataFrame], DataFrame] | None = None, hash_column: str | None = None
) -> DataFrame:
    """``rows`` with the struct's fields read from a JSON column (and ``missing_keys`` if lenient).

    ``sanitize`` is applied to the rows read; ``hash_column`` then gets a hash of the fields, in which null is a value of its own.
    """
    if errors not in ERRORS or naming not in NAMING:
        raise ValueError(f"errors must be of {ERRORS}, naming of {NAMING}")
    read = F.from_json(column, struct, {"mode": "FAILFAST" if errors == "strict" else "PERMISSIVE"})
    raw = F.from_json(column, "map<string,string>")
    if naming == "lowercase":
        raw = F.transform_keys(raw, lambda k, _: F.lower(k))
    names = {f.name: f.name.lower() if naming == "lowercase" else f.name for f in struct.fields}
    out = rows.withColumns({"__raw": raw, "__read": read})
    missing = F.array_compact(F.array(*[F.when(F.col("__raw").isNull() | ~F.map_contains_key("__raw", F.lit(k)), F.lit(n)) for n, k in names.items()]))
    made = {}
    for f in struct.fields:
        text = F.try_element_at("__raw", F.lit(names[f.name]))
        simple = not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        made[f.name] = text.try_cast(f.dataType) if simple else F.col("__read")[f.name] if naming == "exact" else F.from_json(text, f.dataType)
    if errors == "strict":
        torn = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))).cast("int"))
        first = struct.fields[0].name
        made[first] = F.when(torn.isNull(), made[first])
    elif errors == "lenient":
        made["missing_keys"] = missing
    out = out.withColumns(made).drop("__raw", "__read")
    out = sanitize(out) if sanitize is not None else out
    return out if hash_column is None else out.withColumn(hash_column, F.xxhash64(*[x for f in struct.fields for x in (F.col(f.name).isNull(), F.col(f.name))]))


def json_files(spark: SparkSession, path: str, struct: T.StructType, errors: str = "lenient") -> DataFrame:
    mode = {"strict": "FAILFAST", "lenient": "PERMISSIVE", "silent": "PERMISSIVE"}[errors]
    return spark.read.schema(struct).option("mode", mode).option("multiLine", True).json(path)


def json_recording(spark: SparkSession, path: str, registry: SchemaRegistry, lists: dict[str, str]) -> DataFrame:
    """Entities of recordings in JSON files: ``lists`` maps a frame's key to the struct of its entries, e.g. players -> Player."""
    frame = T.StructType([T.StructField("frame_index", T.IntegerType()), T.StructField("game_time", T.DoubleType()), T.StructField("utc_ticks", T.LongType()), *[T.StructField(k, T.ArrayType(registry.struct_type(s))) for k, s in lists.items()]])
    schema = T.StructType([T.StructField("replay_name", T.StringType()), T.StructField("fps", T.IntegerType()), T.StructField("frames", T.ArrayType(frame))])
    frames = json_files(spark, path, schema).select(F.col("replay_name").alias("replay_id"), F.explode("frames").alias("f"))
    out = None
    for key, struct in lists.items():
        part = frames.select("replay_id", "f.frame_index", "f.game_time", "f.utc_ticks", F.explode(f"f.{key}").alias("e")).select("replay_id", "frame_index", "game_time", "utc_ticks", F.lit(registry.type_id(struct)).alias("entity_type_id"), F.lit(struct).alias("type_name"), "e.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def from_tagged(rows: DataFrame, column: str, message: str, descriptor: bytes, binding: dict[str, Column | str]) -> DataFrame:
    """Rows of a column of tagged messages: ``binding`` names the output columns and their place in the message."""
    from pyspark.sql.protobuf.functions import from_protobuf

    read = rows.withColumn("m", from_protobuf(column, message, binaryDescriptorSet=descriptor))
    return read.select(*[c for c in rows.columns if c != column], *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in binding.items()])


def from_records(spark: SparkSession, records: Iterable, mapping: dict[str, Callable], schema: str) -> DataFrame:
    """Rows of native records: one getter per column."""
    return spark.createDataFrame([tuple(get(r) for get in mapping.values()) for r in records], schema)


def map_key(first_text: Column, first_int: Column, position: Column) -> Column:
    """The key of a map entry: its first non-empty text, else its first whole number, else ``Key_<n>``."""
    return F.coalesce(F.when(first_text != "", first_text), first_int.cast("string"), F.concat(F.lit("Key_"), position.cast("string")))


def stored(value: Column, kind: T.DataType, given: T.DataType | None = None) -> Column:
    """A value of a ``given`` type as a slot of another stores it.

    Numbers become texts where a text is declared, fractions with six decimals; what can't be read is null.
    """
    if isinstance(kind, T.StringType) and isinstance(given, (T.FloatType, T.DoubleType)):
        return fixed(value, 6)
    if isinstance(kind, T.StringType) and isinstance(given, T.BooleanType):
        return value.cast("int").cast("string")
    return value.try_cast(kind)
