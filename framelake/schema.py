"""Schemas of recordings: parsing, slots, validation, evolution, and typed access."""

from __future__ import annotations

import json
import keyword
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type tokens (in lower case) and what they are read as; aliases of the schema editor come last.
TYPE_TOKENS = {
    "int8": "Int8", "uint8": "Int8", "byte": "Int8",
    "int32": "Int32", "uint32": "Int32", "int": "Int32",
    "int64": "Int64", "uint64": "Int64", "long": "Int64",
    "float": "Float", "double": "Double", "bool": "Bool",
    "string": "String", "fname": "String", "fstring": "String",
    "vector": "Vector", "quat": "Quat", "transform": "Transform",
    "floatrange": "FloatRange", "range": "FloatRange", "struct": "Struct", "enum": "Enum",
}
CONTAINER_TOKENS = {"none": "None", "array": "Array", "map": "Map"}

VECTOR = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
QUAT = T.StructType([T.StructField(c, T.FloatType()) for c in "xyzw"])
TRANSFORM = T.StructType([T.StructField("translation", VECTOR), T.StructField("rotation", QUAT), T.StructField("scale", VECTOR)])
FLOAT_RANGE = T.StructType([T.StructField(c, T.FloatType()) for c in ("min", "max", "value_normalized")])
SCALARS: dict[str, T.DataType] = {
    "Int8": T.IntegerType(), "Int32": T.IntegerType(), "Enum": T.IntegerType(), "Int64": T.LongType(), "Float": T.FloatType(), "Double": T.DoubleType(),
    "Bool": T.BooleanType(), "String": T.StringType(), "Vector": VECTOR, "Quat": QUAT, "Transform": TRANSFORM, "FloatRange": FLOAT_RANGE,
}
MAX_DEPTH = 16


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    container: str = "None"
    struct_type: str = ""
    key: str = "None"
    slot: int = 0
    ordinal: int = 0
    meta: dict = field(default_factory=dict, compare=False)
    raw_type: str = ""
    raw_container: str = ""

    def signature(self) -> tuple:
        return self.type, self.key, self.container, self.slot, self.struct_type


@dataclass(frozen=True)
class Struct:
    name: str
    type_id: int
    fields: tuple[Field, ...]

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


def canonical_type(token: str | None) -> str:
    return TYPE_TOKENS.get((token or "").strip().lower(), "None")


def canonical_container(token: str | None, strict: bool = False) -> str:
    """``strict`` knows only the lower-case spellings, as old readers do; others read as None."""
    token = token or "none"
    if strict and token != token.lower():
        return "None"
    return CONTAINER_TOKENS.get(token.strip().lower(), "None")


class SchemaRegistry:
    """Structs of a schema in order. Type ids count the named structs; slots count per struct, type and container."""

    def __init__(self, structs: list[Struct], buckets: list[str], version: str = "", text: str = ""):
        self.structs, self.buckets, self.version, self.text = structs, buckets, version, text
        self.by_name = {s.name: s for s in structs}
        self.by_id = {s.type_id: s for s in structs}

    @classmethod
    def from_json(cls, text: str, strict: bool = False) -> SchemaRegistry:
        """Raises ValueError where the text is no JSON or has no list ``property_mapping``."""
        try:
            data = json.loads(text)
        except ValueError as e:
            raise ValueError(f"the schema is no JSON: {e}") from e
        if not isinstance(data, dict) or not isinstance(data.get("property_mapping"), list):
            raise ValueError("the schema has no list property_mapping")
        structs: dict[str, list[Field]] = {}
        ids: dict[str, int] = {}
        for entry in data["property_mapping"]:
            name = (entry or {}).get("struct") or ""
            if not name:
                continue
            ids[name] = len(ids) if name not in ids else ids[name]
            fields = structs.setdefault(name, [])
            slots: Counter = Counter()
            for value in entry.get("values") or []:
                kind, container = canonical_type(value.get("typeId")), canonical_container(value.get("containerType"), strict)
                made = Field(value.get("name") or "", kind, container, value.get("structType") or "", canonical_type(value.get("keyId")), slots[kind, container], len(fields), value.get("meta") or {}, value.get("typeId") or "", value.get("containerType") or "None")
                slots[kind, container] += 1
                fields.append(made)
        return cls([Struct(n, ids[n], tuple(f)) for n, f in structs.items()], [str(b) for b in data.get("buckets") or []], str(data.get("version") or ""), text)

    @classmethod
    def load(cls, path: str, strict: bool = False) -> SchemaRegistry:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read(), strict)

    # --- lookups

    def struct_names(self) -> list[str]:
        return [s.name for s in self.structs]

    def properties(self, struct: str) -> list[str]:
        """In declared order; none for an unknown struct."""
        found = self.by_name.get(struct)
        return [f.name for f in found.fields] if found else []

    def has_property(self, struct: str, name: str) -> bool:
        return self.field(struct, name) is not None

    def field(self, struct: str, name: str) -> Field | None:
        found = self.by_name.get(struct)
        return found.get(name) if found else None

    def slot(self, struct: str, name: str) -> int:
        """-1 where unknown."""
        found = self.field(struct, name)
        return found.slot if found else -1

    def type_id(self, struct: str) -> int:
        found = self.by_name.get(struct)
        return found.type_id if found else -1

    def name_at(self, type_id: int, kind: str, container: str, slot: int) -> str | None:
        """The property behind a slot; 32-bit slots are looked up among Int32, Enum and Int8 in turn."""
        found = self.by_id.get(type_id)
        for wanted in ("Int32", "Enum", "Int8") if kind == "Int32" else (kind,):
            for f in found.fields if found else ():
                if (f.type, f.container, f.slot) == (wanted, container, slot):
                    return f.name
        return None

    # --- Spark forms

    def data_type(self, f: Field, depth: int = 0) -> T.DataType:
        if f.type == "Struct":
            if depth > MAX_DEPTH:
                raise ValueError(f"struct {f.struct_type} contains itself")
            inner: T.DataType = self.struct_type(f.struct_type, depth + 1)
        else:
            inner = SCALARS.get(f.type, T.StringType())
        if f.container == "Array":
            return T.ArrayType(inner)
        if f.container == "Map":
            return T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", inner)]))
        return inner

    def struct_type(self, struct: str, depth: int = 0) -> T.StructType:
        found = self.by_name.get(struct)
        return T.StructType([T.StructField(f.name, self.data_type(f, depth)) for f in found.fields]) if found else T.StructType([])

    def columns(self) -> dict[str, tuple[T.DataType, dict[int, Field]]]:
        """Column -> (type, field per type id) over all structs; a name used with another type gets the struct's name behind it."""
        out: dict[str, tuple[T.DataType, dict[int, Field]]] = {}
        taken: dict[str, str] = {}
        for s in self.structs:
            for f in s.fields:
                if f.type == "None" or not f.name:
                    continue
                kind = self.data_type(f)
                name = f.name
                key = taken.get(name.lower(), name)
                if key in out and (out[key][0] != kind or key != name or s.type_id in out[key][1]):
                    name = f"{name}_{s.name}"
                    key = name
                taken.setdefault(key.lower(), key)
                out.setdefault(key, (kind, {}))[1][s.type_id] = f
        return out

    def fields_frame(self, spark: SparkSession) -> DataFrame:
        """One row a field: the small table that names and slots are looked up in."""
        rows = [(s.type_id, s.name, f.name, f.type, f.container, f.slot, f.struct_type or None, f.ordinal) for s in self.structs for f in s.fields]
        return spark.createDataFrame(rows, "type_id int, struct string, property string, type string, container string, slot int, child_struct string, ordinal int")


# --- typed access with defaults

_DEFAULTS = {T.IntegerType: 0, T.LongType: 0, T.FloatType: 0.0, T.DoubleType: 0.0, T.BooleanType: False, T.StringType: ""}


def value(rows: DataFrame, prop: str) -> Column:
    """A property or its type's default where it is missing, as accessors give it."""
    kind = rows.schema[prop].dataType if prop in rows.columns else None
    if kind is None:
        return F.lit(None)
    if kind == QUAT:
        return F.coalesce(F.col(prop), F.struct(*[F.lit(v).cast("float").alias(c) for c, v in zip("xyzw", (0, 0, 0, 1), strict=True)]))
    if kind == VECTOR:
        return F.coalesce(F.col(prop), F.struct(*[F.lit(0.0).alias(c) for c in "xyz"]))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.col(prop), F.array().cast(kind))
    default = _DEFAULTS.get(type(kind))
    return F.col(prop) if default is None else F.coalesce(F.col(prop), F.lit(default).cast(kind))


# --- validation and evolution


@dataclass(frozen=True)
class Issue:
    severity: str
    kind: str
    message: str
    struct: str = ""
    field: str = ""


def validate(text: str) -> list[Issue]:
    """Errors and warnings of a schema text; valid if there is no error."""
    out: list[Issue] = []
    try:
        data = json.loads(text)
        mapping = data["property_mapping"]
        if not isinstance(mapping, list):
            raise TypeError("property_mapping is no list")
    except (ValueError, KeyError, TypeError) as e:
        return [Issue("error", "unreadable", f"the schema can't be read: {e}")]
    if not mapping:
        out.append(Issue("warning", "empty", "the schema has no struct"))
    structs: set[str] = set()
    for entry in mapping:
        name = entry.get("struct") or ""
        if not name:
            out.append(Issue("error", "struct_name", "a struct has no name"))
            continue
        if name in structs:
            out.append(Issue("error", "duplicate_struct", "the struct is there twice", name))
        structs.add(name)
        fields: set[str] = set()
        for f in entry.get("values") or []:
            fname, token = f.get("name") or "", f.get("typeId") or ""
            if not fname:
                out.append(Issue("error", "field_name", "a field has no name", name))
                continue
            if fname in fields:
                out.append(Issue("error", "duplicate_field", "the field is there twice", name, fname))
            fields.add(fname)
            container = (f.get("containerType") or "None").strip().lower()
            if container not in CONTAINER_TOKENS:
                out.append(Issue("warning", "container", f"unknown container {f.get('containerType')}", name, fname))
            if canonical_type(token) == "Struct" and not f.get("structType"):
                out.append(Issue("error", "struct_type", "a Struct field needs structType", name, fname))
            if container == "map" and canonical_type(f.get("keyId")) == "None":
                out.append(Issue("warning", "key", "a Map field should have keyId", name, fname))
            if token.strip().lower() in ("", "none"):
                out.append(Issue("error", "type", "a field has no typeId", name, fname))
            elif canonical_type(token) == "None":
                out.append(Issue("warning", "type_token", f"unknown typeId {token}", name, fname))
    return out


def is_valid(text: str) -> bool:
    return all(i.severity != "error" for i in validate(text))


def evolution(baseline: SchemaRegistry, candidate: SchemaRegistry) -> list[Issue]:
    """What a candidate adds (info), removes or changes (errors: breaking), and whose metadata it changes (warnings)."""
    out = [Issue("info", "struct_added", "struct added", s.name) for s in candidate.structs if s.name not in baseline.by_name]
    for old in baseline.structs:
        new = candidate.by_name.get(old.name)
        if new is None:
            out.append(Issue("error", "struct_removed", "struct removed", old.name))
            continue
        before = {f.name: f for f in old.fields}
        after = {f.name: f for f in new.fields}
        for name, f in after.items():
            if name not in before:
                out.append(Issue("info", "field_added", "field added", old.name, name))
            elif f.signature() != before[name].signature():
                out.append(Issue("error", "field_changed", "type, key, container, slot or struct changed", old.name, name))
            elif f.meta != before[name].meta:
                out.append(Issue("warning", "field_meta_changed", "metadata changed", old.name, name))
        out += [Issue("error", "field_removed", "field removed", old.name, n) for n in before if n not in after]
    return out


def next_generation(baseline: str, candidate: str) -> str:
    """The candidate with the next version number on fields that are new or changed against the baseline."""
    old, new = SchemaRegistry.from_json(baseline), SchemaRegistry.from_json(candidate)
    version = lambda f: int(f.meta.get("version", 1) or 1)
    stamp = max([1, *(version(f) for r in (old, new) for s in r.structs for f in s.fields)]) + 1
    data = json.loads(candidate)
    for entry in data["property_mapping"]:
        for f in entry.get("values") or []:
            before, after = old.field(entry.get("struct", ""), f.get("name", "")), new.field(entry.get("struct", ""), f.get("name", ""))
            if before is None or after is None or before.signature() != after.signature() or before.meta != after.meta:
                f.setdefault("meta", {})["version"] = stamp
    return json.dumps(data, indent=1)


def clean_name(name: str, taken: set[str] | None = None) -> str:
    """A name as an identifier: other signs become underscores, keywords and leading digits get one, repeats a number."""
    out = "".join(c if c.isalnum() and c.isascii() or c == "_" else "_" for c in name) or "_"
    out = f"_{out}" if out[0].isdigit() else f"{out}_" if keyword.iskeyword(out) else out
    base, n = out, 2
    while taken is not None and out in taken:
        out, n = f"{base}_{n}", n + 1
    if taken is not None:
        taken.add(out)
    return out


def accessor_source(registry: SchemaRegistry) -> str:
    """Python source of one typed accessor class per struct: a getter and a setter per property, names cleaned."""
    out = ["from pyspark.sql import functions as F", "", "from framelake.operators.mutate import set_value", ""]
    classes: set[str] = set()
    for s in registry.structs:
        out += ["", f"class {clean_name(s.name, classes)}:", f"    TYPE_ID = {s.type_id}", f"    PROPERTIES = {[f.name for f in s.fields]!r}", ""]
        out += ["    @staticmethod", "    def rows(frames):", f"        return frames.where(F.col('entity_type_id') == {s.type_id})"]
        own = {"rows", "TYPE_ID", "PROPERTIES"}
        for f in s.fields:
            name = clean_name(f.name, own)
            column = "`" + f.name.replace("`", "``") + "`"
            out += ["", "    @staticmethod", f"    def {name}():", f"        return F.col({column!r})"]
            out += ["", "    @staticmethod", f"    def {clean_name(f'set_{name}', own)}(frames, value):", f"        return set_value(frames, {f.name!r}, value, F.col('entity_type_id') == {s.type_id})"]
    return "\n".join(out) + "\n"


def schema_text(registry: SchemaRegistry) -> str:
    """The schema as it is exported: indented JSON with types and containers in their canonical spelling."""
    mapping = []
    for s in registry.structs:
        values = []
        for f in s.fields:
            value = {"name": f.name, "typeId": f.type, "containerType": f.container}
            value |= {"structType": f.struct_type} if f.struct_type else {}
            value |= {"keyId": f.key} if f.key != "None" else {}
            values.append(value | ({"meta": f.meta} if f.meta else {}))
        mapping.append({"struct": s.name, "values": values})
    return json.dumps({"version": registry.version, "buckets": registry.buckets, "property_mapping": mapping}, indent=4, ensure_ascii=False)


def renamed_slot(f: Field, slot: int) -> Field:
    return replace(f, slot=slot)
