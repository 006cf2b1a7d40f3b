"""Schemas that drift between files.

Tagged-union inference: the schemas of all versions are fused into one graph per (studio, struct,
field path), in which every type and container that a path ever had stays as an alternative with
the versions over which it held. Changes are read off that graph: an alternative that begins or
ends where its path has another is a change of type or container, one that begins or ends without
is a field that comes or goes, and two of those at one place are a rename. Records are read
through the schema of their own version into one table, where a field that has several
alternatives has a typed branch for each and one canonical column that holds all of them.
"""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Spellings of types that are read as one type, and of containers.
TYPES = {
    "int8": "Int8", "uint8": "Int8",
    "int32": "Int32", "uint32": "Int32", "int": "Int32",
    "int64": "Int64", "uint64": "Int64", "long": "Int64",
    "float": "Float", "double": "Double", "bool": "Bool", "string": "String",
    "vector": "Vector", "quat": "Quat", "transform": "Transform", "struct": "Struct",
}
CONTAINERS = {"array": "Array", "map": "Map"}

_BODY = "version string, property_mapping array<struct<struct: string, values: array<struct<name: string, typeId: string, containerType: string>>>>"

def _lookup(values: dict[str, str], column: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(column))), F.lit("None"))


def version_parts(column: Column | str) -> Column:
    """A version as an array of three numbers, missing ones 0; null where it has no number."""
    text = F.regexp_replace(F.trim(F.col(column) if isinstance(column, str) else column), "^[vV]", "")
    parts = F.transform(F.split(text, r"\."), lambda p: F.trim(p).try_cast("int"))
    number = lambda i: F.coalesce(F.get(parts, i), F.lit(0))
    return F.when(F.get(parts, 0).isNotNull(), F.array(number(0), number(1), number(2)))


def version_text(parts: Column) -> Column:
    return F.concat_ws(".", F.transform(parts, lambda p: p.cast("string")))


def schema_versions(files: DataFrame) -> DataFrame:
    """(studio_id, version, ordinal, next, since, mapping): each version of a studio in number order, with the one after it.

    files: file_id, studio_id, delivered_at, body. Bodies that are null, cut or no JSON (a key given
    twice included), and those without a version or a mapping, are passed over. Of several whole
    files of one version the last delivered counts; since is the version's first delivery.
    """
    whole = F.try_parse_json("body").isNotNull()
    read = files.select("studio_id", "file_id", "delivered_at", F.when(whole, F.from_json("body", _BODY)).alias("b"))
    read = read.withColumn("version", version_parts("b.version")).where(F.col("version").isNotNull() & F.col("b.property_mapping").isNotNull())
    last = read.groupBy("studio_id", "version").agg(F.max_by("b.property_mapping", F.struct("delivered_at", "file_id")).alias("mapping"), F.min("delivered_at").alias("since"))
    # only the versions' numbers pass the window
    w = W.partitionBy("studio_id").orderBy("version")
    order = last.select("studio_id", "version").withColumns({"ordinal": F.row_number().over(w), "next": F.lead("version").over(w)})
    order = order.select(F.col("studio_id").alias("__s"), F.col("version").alias("__v"), "ordinal", "next")
    return last.join(order, F.col("studio_id").eqNullSafe(F.col("__s")) & (F.col("version") == F.col("__v"))).drop("__s", "__v")


def schema_fields(files: DataFrame) -> DataFrame:
    """(studio_id, version, ordinal, next, since, struct_name, field_name, place, type, container) of each version's fields.

    Structs and fields without a name are left out; of a name given twice the first place counts.
    """
    own = ["studio_id", "version", "ordinal", "next", "since"]
    fields = schema_versions(files).select(*own, F.explode("mapping").alias("s")).where(F.trim("s.struct") != "")
    fields = fields.select(*own, F.col("s.struct").alias("struct_name"), F.posexplode("s.values").alias("place", "v")).where(F.col("v.name") != "")
    kinds = F.struct("place", _lookup(TYPES, F.col("v.typeId")).alias("type"), _lookup(CONTAINERS, F.col("v.containerType")).alias("container")).alias("k")
    first = fields.select(*own, "struct_name", F.col("v.name").alias("field_name"), kinds)
    keys = ["studio_id", "struct_name", "field_name", "ordinal"]
    first = first.groupBy(*keys).agg(F.min("k").alias("k"), *[F.first(c).alias(c) for c in ("version", "next", "since")])
    return first.select(*keys, "version", "next", "since", "k.place", "k.type", "k.container")


PATH = ["studio_id", "struct_name", "field_name"]


def fused(fields: DataFrame) -> DataFrame:
    """The graph: one row an alternative of a path and stretch of versions over which it held.

    (path, type, container, from_ordinal, to_ordinal, from_version, next, from_place, to_place, since);
    next is the version after the stretch, null where it lasts. A path may have an alternative in several stretches.
    """
    w = W.partitionBy(*PATH).orderBy("ordinal")
    goes_on = (F.lag("ordinal").over(w) == F.col("ordinal") - 1) & (F.lag("type").over(w) == F.col("type")) & (F.lag("container").over(w) == F.col("container"))
    rows = fields.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    return rows.groupBy(*PATH, "__run").agg(
        F.first("type").alias("type"), F.first("container").alias("container"), F.min("ordinal").alias("from_ordinal"), F.max("ordinal").alias("to_ordinal"),
        F.min("version").alias("from_version"), F.max_by("next", "ordinal").alias("next"), F.min_by("place", "ordinal").alias("from_place"), F.max_by("place", "ordinal").alias("to_place"), F.min("since").alias("since"),
    ).drop("__run")


def schema_changes(fields: DataFrame) -> DataFrame:
    """(studio_id, version, struct_name, field_name, change) of every field against the version before it, read off the fused graph."""
    w = W.partitionBy(*PATH).orderBy("from_ordinal")
    rows = fused(fields).withColumns({"__end": F.lag("to_ordinal").over(w), "__type": F.lag("type").over(w), "__container": F.lag("container").over(w), "__start": F.lead("from_ordinal").over(w)})
    takes_over = F.col("__end").eqNullSafe(F.col("from_ordinal") - 1)
    event = lambda at, what, place: F.struct(F.col(at).alias("version"), F.lit(what).alias("what"), F.col(place).alias("place"))
    events = F.array_compact(
        F.array(
            F.when(takes_over & (F.col("type") != F.col("__type")), event("from_version", "type_changed", "from_place")),
            F.when(takes_over & (F.col("container") != F.col("__container")), event("from_version", "container_changed", "from_place")),
            F.when(~takes_over & (F.col("from_ordinal") > 1), event("from_version", "came", "from_place")),
            F.when(F.col("next").isNotNull() & ~F.col("__start").eqNullSafe(F.col("to_ordinal") + 1), event("next", "went", "to_place")),
        )
    )
    # a name that goes and one that comes at one place, with one type and container, share a group
    told = rows.select("studio_id", "struct_name", "field_name", "type", "container", F.explode(events).alias("e"))
    moves = F.col("e.what").isin("came", "went")
    name = lambda what: F.max(F.when(F.col("e.what") == what, F.col("field_name")))
    pairs = told.where(moves).groupBy("studio_id", F.col("e.version").alias("version"), "struct_name", F.col("e.place").alias("place"), "type", "container").agg(name("came").alias("came"), name("went").alias("went"))
    change = F.when(F.col("went").isNull(), "added").when(F.col("came").isNull(), "removed").otherwise("renamed")
    moved = pairs.select("studio_id", "version", "struct_name", F.coalesce("came", "went").alias("field_name"), change.alias("change"))
    altered = told.where(~moves).select("studio_id", "e.version", "struct_name", "field_name", F.col("e.what").alias("change"))
    return moved.unionByName(altered).withColumn("version", version_text(F.col("version")))


def _roots(frame: pd.DataFrame) -> list[str]:
    """The root of each alternative of one struct (rows in order of from_ordinal)."""
    rows = list(frame.itertuples())
    starts = {(r.field_name, r.from_ordinal) for r in rows}
    field_of: dict[str, int] = {}  # name -> the field that it stands or last stood for
    until: dict[str, int] = {}  # name -> the last ordinal at which it was there
    went: dict[tuple, int] = {}  # (ordinal, place, type, container) -> the field whose name went there
    labels: list[str] = []
    renamed: list[bool] = []
    taken: set[str] = set()
    out: list[str] = []
    for r in rows:
        name = r.field_name
        if until.get(name) != r.from_ordinal - 1:  # not just another alternative of a name that is there
            gone = went.get((r.from_ordinal, r.from_place, r.type, r.container))
            old = field_of.get(name)
            if gone is not None:
                field_of[name] = gone
                renamed[gone] = True
            elif old is None or renamed[old] or labels[old] != name:
                label = name
                while label.lower() in taken:
                    label = f"{name}@{r.v}" if label == name else label + "~"
                taken.add(label.lower())
                field_of[name] = len(labels)
                labels.append(label)
                renamed.append(False)
        until[name] = r.to_ordinal
        if (name, r.to_ordinal + 1) not in starts:
            went[r.to_ordinal + 1, r.to_place, r.type, r.container] = field_of[name]
        out.append(labels[field_of[name]])
    return out


def lineage(fields: DataFrame) -> DataFrame:
    """``fused`` with ``root``: the name under which a field first appeared, followed through its renames.

    A name that is free again and taken up by another field is that field's own root, ``name@version``;
    a name that only was away is the same field. Renames chain from version to version, so the
    alternatives of one struct of one studio, one row for each time a field changed, are walked by one task.
    """
    rows = fused(fields).withColumn("v", version_text(F.col("from_version")))
    picked = rows.select(*PATH, "type", "container", "from_ordinal", "to_ordinal", "from_place", "to_place", "v")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["from_ordinal", "from_place"])
        return own.assign(root=_roots(own))[[*PATH, "type", "container", "from_ordinal", "to_ordinal", "v", "root"]]

    return picked.groupBy("studio_id", "struct_name").applyInPandas(walk, "studio_id string, struct_name string, field_name string, type string, container string, from_ordinal int, to_ordinal int, v string, root string")


def alternatives(fields: DataFrame) -> DataFrame:
    """Each (studio, struct, root field) with each type and container it has had and the version where that first appeared."""
    rows = lineage(fields).groupBy("studio_id", "struct_name", F.col("root").alias("field_name"), "type", "container").agg(
        F.min_by("v", "from_ordinal").alias("first_version"), F.min("from_ordinal").alias("__rank"), F.sum(F.col("to_ordinal") - F.col("from_ordinal") + 1).alias("n_versions")
    )
    w = W.partitionBy("studio_id", "struct_name", "field_name").orderBy("__rank", "type", "container")
    return rows.withColumn("alternative", F.row_number().over(w)).drop("__rank")


_SQL_TYPE = {"Int8": "bigint", "Int32": "bigint", "Int64": "bigint", "Float": "double", "Double": "double", "Bool": "boolean", "String": "string"}


def _canonical(kinds: set[str]) -> str:
    """The narrowest column type that holds all alternatives; text holds anything."""
    if kinds <= {"bigint"}:
        return "bigint"
    if kinds <= {"bigint", "double"}:
        return "double"
    return kinds.pop() if len(kinds) == 1 else "string"


def consistent_table(records: DataFrame, files: DataFrame, max_columns: int = 1000) -> DataFrame:
    """All records in one wide table under root field names.

    A root field is one column, of the narrowest type that holds all its alternatives; where
    they conflict, each also has a typed branch ``<field>__<type>`` that is filled by the records
    of versions that declared it. Structured types and containers are kept as JSON text. Studios
    name fields as they like, so only the ``max_columns`` fields that most studios have are
    columns; all others are in ``more``, a map from root to text. A key that the version does not
    declare goes to ``undeclared`` (a map), as does every key of a null studio. A null version is read as the last one that the studio
    had delivered by then (else its first); payloads that are no JSON (a key given twice
    included) give null fields and ``readable`` false; repeated rows count once.
    """
    versions = schema_versions(files)
    known = lineage(schema_fields(files)).withColumn("kind", F.concat_ws("", "type", F.when(F.col("container") != "None", F.col("container"))))
    wide = known.groupBy(F.lower("root").alias("key")).agg(F.min("root").alias("name"), F.collect_set("kind").alias("kinds"), F.count_distinct("studio_id").alias("n"))
    wide = sorted(wide.orderBy(F.desc("n"), "key").limit(max_columns).collect(), key=lambda r: r.key)
    at = versions.select("studio_id", "ordinal", version_text(F.col("version")).alias("version"), "since")
    index = known.withColumn("ordinal", F.explode(F.sequence("from_ordinal", "to_ordinal"))).groupBy("studio_id", "struct_name", "ordinal").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("root", "kind")))).alias("__known")
    )
    index = index.join(at.drop("since"), ["studio_id", "ordinal"]).drop("ordinal")
    order = at.groupBy("studio_id").agg(F.sort_array(F.collect_list(F.struct("since", "ordinal", F.col("version").alias("v")))).alias("__order"))
    rows = records.select("record_id", "studio_id", "schema_version", "struct_name", "recorded_at", "payload").distinct()
    by_then = F.filter("__order", lambda o: o["since"] <= F.col("recorded_at"))
    fallback = F.coalesce(F.get(F.reverse(by_then), 0)["v"], F.get(F.col("__order"), 0)["v"])
    given = version_text(version_parts("schema_version"))
    given = F.when(given != "", given)
    dated = rows.where(given.isNull()).join(order, "studio_id", "left").withColumn("version", fallback).drop("__order")
    rows = rows.where(given.isNotNull()).withColumn("version", given).unionByName(dated)
    rows = rows.join(index, ["studio_id", "struct_name", "version"], "left")
    rows = rows.withColumn("__raw", F.when(F.try_parse_json("payload").isNotNull(), F.from_json("payload", "map<string,string>")))
    entry = lambda k: F.try_element_at(F.col("__known"), k)
    read = F.map_entries("__raw")
    declared = F.filter(read, lambda e: entry(e["key"]).isNotNull())
    tagged = F.transform(declared, lambda e: F.struct(F.lower(entry(e["key"])["root"]).alias("key"), F.struct(entry(e["key"])["kind"].alias("kind"), e["value"].alias("value")).alias("value")))
    rows = rows.withColumn("__read", F.map_from_entries(tagged)).withColumn("undeclared", F.map_from_entries(F.filter(read, lambda e: entry(e["key"]).isNull())))
    taken = {"record_id", "studio_id", "version", "struct_name", "recorded_at", "readable", "undeclared", "more"}
    columns = []
    for r in wide:
        cell = F.try_element_at("__read", F.lit(r.key))
        sql = {k: _SQL_TYPE.get(k, "string") for k in r.kinds}
        own = f"{r.name}_" if r.key in taken else r.name
        columns.append(cell["value"].try_cast(_canonical(set(sql.values()))).alias(own))
        if len(r.kinds) > 1:
            columns += [F.when(cell["kind"] == k, cell["value"].try_cast(sql[k])).alias(f"{own}__{k.lower()}") for k in sorted(r.kinds)]
    held = F.array(*[F.lit(r.key) for r in wide]) if wide else F.array().cast("array<string>")
    more = F.transform_values(F.map_filter("__read", lambda k, v: ~F.array_contains(held, k)), lambda k, v: v["value"])
    return rows.select("record_id", "studio_id", "version", "struct_name", "recorded_at", F.col("__raw").isNotNull().alias("readable"), *columns, more.alias("more"), "undeclared")


_VERSIONS_SQL = """f AS (
  SELECT studio_id, string_split(regexp_replace(trim(body::json->>'version'), '^[vV]', ''), '.')::int[] AS v, body::json AS b, delivered_at
  FROM schema_files WHERE json_valid(body)),
g AS (SELECT studio_id, [v[1], coalesce(v[2], 0), coalesce(v[3], 0)] AS v, any_value(b) AS b, min(delivered_at) AS since FROM f GROUP BY studio_id, [v[1], coalesce(v[2], 0), coalesce(v[3], 0)]),
o AS (SELECT studio_id, v, row_number() OVER (PARTITION BY studio_id ORDER BY v) AS n, b, since FROM g),
s AS (SELECT studio_id, v, n, unnest(from_json(b->'property_mapping', '["json"]')) AS m FROM o),
t AS (SELECT studio_id, v, n, m->>'struct' AS st, from_json(m->'values', '["json"]') AS fs FROM s),
u AS (SELECT studio_id, v, n, st, fs, unnest(range(len(fs))) AS place FROM t),
x AS (
  SELECT studio_id, v, n, st, place, fs[place + 1]->>'name' AS nm,
    coalesce(map {TYPES}[lower(fs[place + 1]->>'typeId')], 'None') AS ty,
    CASE lower(fs[place + 1]->>'containerType') WHEN 'array' THEN 'Array' WHEN 'map' THEN 'Map' ELSE 'None' END AS co FROM u),
i AS (SELECT *, n - row_number() OVER (PARTITION BY studio_id, st, nm ORDER BY n) AS island FROM x),
h AS (SELECT studio_id, st, nm, island, min(n) AS a, max(n) AS z, arg_min({'p': place, 't': ty, 'c': co}, n) AS first, arg_max({'p': place, 't': ty, 'c': co}, n) AS last FROM i GROUP BY ALL),
r AS (
  SELECT h.*, nm AS root FROM h WHERE NOT EXISTS (SELECT 1 FROM h q WHERE q.studio_id = h.studio_id AND q.st = h.st AND q.z = h.a - 1 AND q.last = h.first)
  UNION ALL
  SELECT h.*, r.root FROM r JOIN h ON r.studio_id = h.studio_id AND r.st = h.st AND r.z = h.a - 1 AND r.last = h.first),
w AS (SELECT i.studio_id, i.st, i.v, i.n, i.nm, i.ty, i.co, r.root FROM i JOIN r USING (studio_id, st, nm, island))""".replace("{TYPES}", str(TYPES))

_FIXED = ("record_id", "studio_id", "version", "struct_name", "recorded_at", "readable", "more", "undeclared")


def filled(wide: DataFrame) -> DataFrame:
    """(studio_id, struct_name, field_name, n_filled): how many records have a value of each root field."""
    own = [c for c in wide.columns if c not in _FIXED and "__" not in c]
    held = F.array_compact(F.concat(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in own]), F.map_keys(F.map_filter("more", lambda k, v: v.isNotNull()))))
    return wide.select("studio_id", "struct_name", F.explode(held).alias("field_name")).groupBy("studio_id", "struct_name", "field_name").agg(F.count("*").alias("n_filled"))


ORACLE = {
    "p2_alternatives": f"""
WITH RECURSIVE {_VERSIONS_SQL},
k AS (SELECT studio_id, st AS struct_name, root AS field_name, ty AS type, co AS container, array_to_string(arg_min(v, n), '.') AS first_version, count(*) AS n_versions, min(n) AS n FROM w GROUP BY ALL)
SELECT * EXCLUDE n, row_number() OVER (PARTITION BY studio_id, struct_name, field_name ORDER BY n, type, container)::INT AS alternative FROM k
""",
    "p2_filled": f"""
WITH RECURSIVE {_VERSIONS_SQL},
d AS (SELECT DISTINCT record_id, studio_id, schema_version, struct_name, recorded_at, payload FROM raw_records),
e AS (SELECT *, string_split(regexp_replace(trim(schema_version), '^[vV]', ''), '.')::int[] AS p FROM d),
j AS (
  SELECT e.* EXCLUDE p, CASE WHEN schema_version IS NOT NULL THEN [p[1], coalesce(p[2], 0), coalesce(p[3], 0)] ELSE coalesce(
    (SELECT arg_max(o.v, (o.since, o.n)) FROM o WHERE o.studio_id = e.studio_id AND o.since <= e.recorded_at),
    (SELECT arg_min(o.v, (o.since, o.n)) FROM o WHERE o.studio_id = e.studio_id)) END AS v FROM e),
y AS (SELECT j.studio_id, j.struct_name, w.root, (j.payload::json->>w.nm) IS NOT NULL AS filled FROM j JOIN w ON w.studio_id = j.studio_id AND w.st = j.struct_name AND w.v = j.v)
SELECT studio_id, struct_name, root AS field_name, count_if(filled)::BIGINT AS n_filled FROM y GROUP BY ALL HAVING count_if(filled) > 0
""",
    "p2_found": """
WITH f AS (
  SELECT studio_id, string_split(regexp_replace(trim(body::json->>'version'), '^[vV]', ''), '.')::int[] AS v, body::json AS b
  FROM schema_files WHERE json_valid(body)),
g AS (SELECT studio_id, [v[1], coalesce(v[2], 0), coalesce(v[3], 0)] AS v, any_value(b) AS b FROM f GROUP BY ALL),
o AS (SELECT studio_id, v, lag(v) OVER w AS v0, lead(v) OVER w AS v1, b FROM g WINDOW w AS (PARTITION BY studio_id ORDER BY v)),
s AS (SELECT studio_id, v, v0, v1, unnest(from_json(b->'property_mapping', '["json"]')) AS m FROM o),
t AS (SELECT studio_id, v, v0, v1, m->>'struct' AS st, from_json(m->'values', '["json"]') AS fs FROM s),
u AS (SELECT studio_id, v, v0, v1, st, fs, unnest(range(len(fs))) AS place FROM t),
x AS (
  SELECT studio_id, v, v0, v1, st, place, fs[place + 1]->>'name' AS nm,
    CASE lower(fs[place + 1]->>'typeId') WHEN 'uint8' THEN 'int8' WHEN 'uint32' THEN 'int32' WHEN 'int' THEN 'int32' WHEN 'uint64' THEN 'int64' WHEN 'long' THEN 'int64'
      ELSE lower(fs[place + 1]->>'typeId') END AS ty,
    CASE WHEN lower(fs[place + 1]->>'containerType') IN ('array', 'map') THEN lower(fs[place + 1]->>'containerType') ELSE 'none' END AS co FROM u),
n AS (SELECT * FROM x WHERE v0 IS NOT NULL),
p AS (SELECT * FROM x WHERE v1 IS NOT NULL),
j AS (
  SELECT coalesce(n.studio_id, p.studio_id) AS studio_id, coalesce(n.v, p.v1) AS v, coalesce(n.st, p.st) AS st, n.nm AS nn, p.nm AS pn,
    coalesce(n.place, p.place) AS place, n.ty AS nt, p.ty AS pt, n.co AS nc, p.co AS pc
  FROM n FULL JOIN p ON n.studio_id = p.studio_id AND n.v = p.v1 AND n.st = p.st AND n.nm = p.nm),
a AS (SELECT * FROM j WHERE pn IS NULL),
r AS (SELECT * FROM j WHERE nn IS NULL),
m AS (
  SELECT coalesce(a.studio_id, r.studio_id) AS studio_id, coalesce(a.v, r.v) AS v, coalesce(a.st, r.st) AS st, coalesce(a.nn, r.pn) AS nm,
    CASE WHEN r.pn IS NULL THEN 'added' WHEN a.nn IS NULL THEN 'removed' ELSE 'renamed' END AS change
  FROM a FULL JOIN r ON a.studio_id = r.studio_id AND a.v = r.v AND a.st = r.st AND a.place = r.place AND a.nt = r.pt AND a.nc = r.pc),
z AS (
  SELECT * FROM m
  UNION ALL SELECT studio_id, v, st, nn, 'type_changed' FROM j WHERE nt <> pt
  UNION ALL SELECT studio_id, v, st, nn, 'container_changed' FROM j WHERE nc <> pc)
SELECT studio_id, array_to_string(v, '.') AS version, st AS struct_name, nm AS field_name, change FROM z
"""
}
