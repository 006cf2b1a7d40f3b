"""An entity's properties as rows of (path, value), however deep they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.text import value_text

_PAIR = "array<struct<path:string,value:string>>"


def _leaves(column: Column, kind: T.DataType, path: Column, depth: int) -> Column:
    """All leaves below a value; a null value is one leaf without text."""
    leaf = lambda text: F.array(F.struct(path.alias("path"), text.alias("value")))
    names = [f.name for f in kind.fields] if isinstance(kind, T.StructType) else []
    plain = names in (["x", "y", "z"], ["x", "y", "z", "w"]) or names[:1] == ["min"]
    if depth <= 0 or not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) or plain:
        text = value_text(column, kind) if not isinstance(kind, (T.ArrayType, T.MapType)) else F.to_json(column)
        return leaf(F.when(column.isNotNull(), text))
    if isinstance(kind, T.StructType):
        parts = [_leaves(column[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), depth - 1) for f in kind.fields]
        below = F.concat(*parts) if parts else F.array().cast(_PAIR)
    elif isinstance(kind, T.ArrayType):
        below = F.flatten(F.transform(column, lambda v, i: _leaves(v, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth - 1)))
    else:
        below = F.flatten(F.transform(F.map_entries(column), lambda e: _leaves(e["value"], kind.valueType, F.concat(path, F.lit("{"), e["key"].cast("string"), F.lit("}")), depth - 1)))
    return F.when(column.isNull(), leaf(F.lit(None).cast("string"))).otherwise(below)


def property_tree(rows: DataFrame, keys: list[str], properties: list[str], depth: int = 8) -> DataFrame:
    """(keys..., path, value) of every leaf: ``a.b[0]{key}``; missing values have a null value."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    parts = [_leaves(F.col(p), kinds[p], F.lit(p), depth) for p in properties]
    return rows.select(*keys, F.explode(F.concat(*parts)).alias("x")).select(*keys, "x.path", "x.value")
