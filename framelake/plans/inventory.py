"""Queries of schema access, labels, clocks, exports and other small operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.frames import TYPES, clamp_range, deliveries, players, presence
from framelake.functions import labels, text
from framelake.functions import time as ticks
from framelake.operators import analysis, diff, timeline
from framelake.operators.predicates import only_ids
from framelake.plans.reference import _C, _E, _P, _bodies, clock
from framelake.schema import SchemaRegistry, evolution, validate
from framelake.sinks import exports
from framelake.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        SQL[name] = sql
        return function

    return add


# --- schemas

_TYPES = {
    "int8": "Int8", "uint8": "Int8", "byte": "Int8", "int32": "Int32", "uint32": "Int32", "int": "Int32", "int64": "Int64", "uint64": "Int64", "long": "Int64", "float": "Float", "double": "Double", "bool": "Bool",
    "string": "String", "fname": "String", "fstring": "String", "vector": "Vector", "quat": "Quat", "transform": "Transform", "floatrange": "FloatRange", "range": "FloatRange", "struct": "Struct", "enum": "Enum",
}
_SCHEMAS = f"""f AS (
  SELECT studio_id, string_split(regexp_replace(trim(body::json->>'version'), '^[vV]', ''), '.')::int[] AS v, body::json AS b, body, delivered_at, file_id FROM schema_files WHERE json_valid(body)),
g AS (SELECT studio_id, [v[1], coalesce(v[2], 0), coalesce(v[3], 0)] AS v, arg_max(b, (delivered_at, file_id)) AS b FROM f GROUP BY studio_id, [v[1], coalesce(v[2], 0), coalesce(v[3], 0)]),
o AS (SELECT studio_id, array_to_string(v, '.') AS version, row_number() OVER (PARTITION BY studio_id ORDER BY v) AS n, from_json(b->'property_mapping', '["json"]') AS ms FROM g),
s AS (SELECT studio_id, version, n, unnest(range(len(ms))) AS type_id, ms FROM o),
t AS (SELECT studio_id, version, n, type_id::INT AS type_id, ms[type_id + 1]->>'struct' AS struct, from_json(ms[type_id + 1]->'values', '["json"]') AS fs FROM s),
u AS (SELECT *, unnest(range(len(fs))) AS ordinal FROM t),
x AS (
  SELECT studio_id, version, n, type_id, struct, ordinal::INT AS ordinal, fs[ordinal + 1]->>'name' AS property, coalesce(map {_TYPES}[lower(trim(fs[ordinal + 1]->>'typeId'))], 'None') AS type,
    CASE lower(trim(fs[ordinal + 1]->>'containerType')) WHEN 'array' THEN 'Array' WHEN 'map' THEN 'Map' ELSE 'None' END AS container,
    coalesce(map {_TYPES}[lower(trim(fs[ordinal + 1]->>'keyId'))], 'None') AS key, coalesce(fs[ordinal + 1]->>'structType', '') AS child, coalesce((fs[ordinal + 1]->'meta')::VARCHAR, '{{}}') AS meta FROM u),
y AS (SELECT *, (row_number() OVER (PARTITION BY studio_id, version, struct, type, container ORDER BY ordinal) - 1)::INT AS slot FROM x)"""


def _over_schemas(spark: SparkSession, d: str, rows_of, shape: str) -> DataFrame:
    """Rows of each studio's each schema version, read by ``SchemaRegistry`` in Arrow batches."""
    arrow = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in T._parse_datatype_string(shape).fields])

    def walk(batches):
        for batch in batches:
            rows = [(s, ".".join(map(str, v)), *r) for s, v, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for r in rows_of(b)]
            cells = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

    return _bodies(spark, d).select("studio_id", "version", "body").mapInArrow(walk, shape)


@query("schema_slots", f"WITH {_SCHEMAS} SELECT studio_id, version, type_id, struct, property, type, container, slot, ordinal FROM y")
def schema_slots(spark, d):
    """The address (type, container, slot) of every property of every schema version."""
    rows_of = lambda b: [(s.type_id, s.name, f.name, f.type, f.container, f.slot, f.ordinal) for s in SchemaRegistry.from_json(b).structs for f in s.fields]
    return _over_schemas(spark, d, rows_of, "studio_id string, version string, type_id int, struct string, property string, type string, container string, slot int, ordinal int")


@query("schema_lookup", f"""
WITH {_SCHEMAS} SELECT studio_id, version, struct, property, CASE WHEN type = 'Int8' AND EXISTS (SELECT 1 FROM y q WHERE q.studio_id = y.studio_id AND q.version = y.version AND q.struct = y.struct AND q.container = y.container AND q.slot = y.slot AND q.type IN ('Int32', 'Enum'))
  THEN NULL ELSE property END AS found FROM y WHERE type IN ('Int8', 'Int32', 'Float', 'String')
""")
def schema_lookup(spark, d):
    """Each slot looked up backwards; where 8-bit and 32-bit integers share slot numbers, a 32-bit look finds the latter first."""

    def rows_of(b):
        r = SchemaRegistry.from_json(b)
        for s in r.structs:
            for f in s.fields:
                if f.type in ("Int8", "Int32", "Float", "String"):
                    found = r.name_at(s.type_id, "Int32" if f.type == "Int8" else f.type, f.container, f.slot)
                    yield s.name, f.name, found if found == f.name else None

    return _over_schemas(spark, d, rows_of, "studio_id string, version string, struct string, property string, found string")


@query("schema_counts", f"WITH {_SCHEMAS} SELECT studio_id, version, type, container, count(*) AS n_fields FROM y GROUP BY ALL")
def schema_counts(spark, d):
    """How many fields of each type and container a schema has."""
    return schema_slots(spark, d).groupBy("studio_id", "version", "type", "container").agg(F.count("*").alias("n_fields"))


@query("schema_evolution", f"""
WITH {_SCHEMAS}, p AS (SELECT y.* REPLACE (y.n + 1 AS n, o.version AS version) FROM y JOIN o ON o.studio_id = y.studio_id AND o.n = y.n + 1), c AS (SELECT * FROM y WHERE n > 1),
cs AS (SELECT DISTINCT studio_id, version, struct FROM c), ps AS (SELECT DISTINCT studio_id, version, struct FROM p),
j AS (
  SELECT coalesce(c.studio_id, p.studio_id) AS studio_id, coalesce(c.version, p.version) AS version, coalesce(c.struct, p.struct) AS struct, coalesce(c.property, p.property) AS field, c.property AS a, p.property AS b,
    (c.type, c.key, c.container, c.slot, c.child) IS DISTINCT FROM (p.type, p.key, p.container, p.slot, p.child) AS changed, c.meta IS DISTINCT FROM p.meta AS meta
  FROM c FULL JOIN p ON c.studio_id = p.studio_id AND c.version = p.version AND c.struct = p.struct AND c.property = p.property)
SELECT studio_id, version, 'info' AS severity, 'struct_added' AS kind, struct, '' AS field FROM (SELECT * FROM cs EXCEPT SELECT * FROM ps)
UNION ALL SELECT studio_id, version, 'error', 'struct_removed', struct, '' FROM (SELECT * FROM ps EXCEPT SELECT * FROM cs)
UNION ALL SELECT j.studio_id, j.version, CASE WHEN b IS NULL THEN 'info' WHEN a IS NULL OR changed THEN 'error' ELSE 'warning' END,
  CASE WHEN b IS NULL THEN 'field_added' WHEN a IS NULL THEN 'field_removed' WHEN changed THEN 'field_changed' ELSE 'field_meta_changed' END, j.struct, j.field
FROM j JOIN cs ON cs.studio_id = j.studio_id AND cs.version = j.version AND cs.struct = j.struct JOIN ps ON ps.studio_id = j.studio_id AND ps.version = j.version AND ps.struct = j.struct
WHERE a IS NULL OR b IS NULL OR changed OR meta
""")
def schema_evolution(spark, d):
    """What each version of a studio adds, changes or breaks against the one before.

    Each body meets the one before it in one row, so versions are compared wherever they lie.
    """
    from pyspark.sql import Window as W

    shape = pa.schema([(c, pa.string()) for c in ("studio_id", "version", "severity", "kind", "struct", "field")])
    pairs = _bodies(spark, d).withColumn("before", F.lag("body").over(W.partitionBy("studio_id").orderBy("version"))).where(F.col("before").isNotNull())

    def walk(batches):
        for batch in batches:
            rows = [
                (s, ".".join(map(str, v)), i.severity, i.kind, i.struct, i.field)
                for s, v, b, a in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
                for i in evolution(SchemaRegistry.from_json(a), SchemaRegistry.from_json(b))
            ]
            cells = zip(*rows, strict=True) if rows else [[] for _ in shape]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cells], schema=shape)

    return pairs.select("studio_id", "version", "body", "before").mapInArrow(walk, ", ".join(f"{f.name} string" for f in shape))


@query("schema_validation", f"""
WITH i AS (SELECT file_id, CASE WHEN json_valid(body) THEN body::json END AS b FROM schema_files),
m AS (SELECT file_id, unnest(from_json(b->'property_mapping', '["json"]')) AS m FROM i WHERE b IS NOT NULL),
v AS (SELECT file_id, m->>'struct' AS struct, unnest(from_json(m->'values', '["json"]')) AS f FROM m),
w AS (SELECT file_id, struct, coalesce(f->>'name', '') AS field, lower(trim(coalesce(f->>'typeId', ''))) AS t, lower(trim(coalesce(f->>'containerType', 'None'))) AS c, lower(trim(coalesce(f->>'keyId', ''))) AS k, coalesce(f->>'structType', '') AS st FROM v),
z AS (
  SELECT file_id, 'error' AS severity, 'unreadable' AS kind, '' AS struct, '' AS field FROM i WHERE b IS NULL OR json_type(b->'property_mapping') IS DISTINCT FROM 'ARRAY'
  UNION ALL SELECT file_id, 'warning', 'container', struct, field FROM w WHERE c NOT IN ('none', 'array', 'map')
  UNION ALL SELECT file_id, 'error', 'struct_type', struct, field FROM w WHERE t = 'struct' AND st = ''
  UNION ALL SELECT file_id, 'warning', 'key', struct, field FROM w WHERE c = 'map' AND (map {_TYPES}[k]) IS NULL
  UNION ALL SELECT file_id, 'error', 'type', struct, field FROM w WHERE t IN ('', 'none')
  UNION ALL SELECT file_id, 'warning', 'type_token', struct, field FROM w WHERE t NOT IN ('', 'none') AND (map {_TYPES}[t]) IS NULL
  UNION ALL SELECT file_id, 'error', 'duplicate_field', struct, field FROM w GROUP BY ALL HAVING count(*) > 1)
SELECT * FROM z
""")
def schema_validation(spark, d):
    """Issues of every schema file, torn ones included."""
    names = ("file_id", "severity", "kind", "struct", "field")

    def walk(batches):
        for batch in batches:
            rows = [(f, i.severity, i.kind, i.struct, i.field) for f, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i in validate(b or "")]
            cells = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cells], names=list(names))

    return table(spark, d, "schema_files").select("file_id", "body").mapInArrow(walk, ", ".join(f"{n} string" for n in names))


# --- texts, labels, clocks


@query("time_texts", f"""
WITH {_C} SELECT replay_id, frame_index, printf('%.6f', game_ticks / 1e7) || 's' AS seconds,
  strftime(make_timestamp(utc_ticks // 10), '%d %b %Y %H:%M:%S') || '.' || lpad((utc_ticks % 10000000 // 10000)::VARCHAR, 3, '0') || ' UTC' AS utc, game_ticks / 1e7 AS plain,
  (game_ticks // 10000000) // 3600 AS hours FROM k
""")
def time_texts(spark, d):
    epoch = F.col("utc_ticks") + ticks.UNIX_EPOCH_TICKS
    return clock(spark, d).select(
        "replay_id", "frame_index", ticks.ticks_text(F.col("game_ticks")).alias("seconds"), ticks.format_utc(epoch).alias("utc"), ticks.ticks_to_seconds(F.col("game_ticks")).alias("plain"),
        ticks.whole(F.col("game_ticks"), 36_000_000_000).alias("hours"),
    )


@query("epoch_forms", f"""
WITH {_C} SELECT replay_id, frame_index, utc_ticks AS of_ticks, utc_ticks // 10000000 * 10000000 + 621355968000000000 AS of_unix, utc_ticks // 10000 * 10000 + 621355968000000000 AS of_millis,
  utc_ticks // 10000000 * 10000000 + 621355968000000000 AS of_iso, game_ticks AS of_seconds, 0::BIGINT AS of_other FROM k
""")
def epoch_forms(spark, d):
    rows = clock(spark, d)
    seconds, millis = ticks.whole(F.col("utc_ticks"), 10_000_000), ticks.whole(F.col("utc_ticks"), 10_000)
    iso = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    first = table(spark, d, "player_states").groupBy("replay_id", "frame_index").agg(F.min("game_time").alias("game_time"))
    rows = rows.join(first, ["replay_id", "frame_index"])
    form = lambda c, f: ticks.to_epoch_ticks(c, f)
    return rows.select(
        "replay_id", "frame_index", form(F.col("utc_ticks"), "ticks").alias("of_ticks"), form(seconds, "unix").alias("of_unix"), form(millis, "unix_ms").alias("of_millis"), form(iso, "iso8601").alias("of_iso"),
        form(F.col("game_time"), "seconds").alias("of_seconds"), form(iso, "other").cast("bigint").alias("of_other"),
    )


@query("duration_labels", """
WITH r AS (SELECT DISTINCT replay_id, duration_seconds AS s FROM replays), m AS (SELECT replay_id, s, floor(greatest(s, 0) * 1000 + 0.5)::BIGINT AS ms FROM r)
SELECT replay_id, concat(ms // 3600000, 'h ', ms % 3600000 // 60000, 'm ', ms % 60000 // 1000, 's ', ms % 1000, 'ms (', printf('%.1f', greatest(s, 0)), ' sec)') AS label FROM m
""")
def duration_labels(spark, d):
    return table(spark, d, "replays").select("replay_id", "duration_seconds").distinct().select("replay_id", ticks.duration_label(F.col("duration_seconds")).alias("label"))


@query("size_labels", """
SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN printf('%.2f', n_chars / 1048576.0) || ' MB' WHEN n_chars >= 1024 THEN printf('%.2f', n_chars / 1024.0) || ' KB' ELSE n_chars || ' B' END AS size, '0x' || upper(to_hex(doc_id)) AS at
FROM documents
""")
def size_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", text.size_label(F.col("n_chars")).alias("size"), labels.offset_label(F.col("doc_id")).alias("at"))


@query("state_labels", f"""
WITH {_P} SELECT replay_id, frame_index, unique_id, printf('(%.3f, %.3f, %.3f)', position.x, position.y, position.z) AS place, printf('%.2f', game_time::DOUBLE) || 's' AS at, coalesce(name, 'Type_' || team) AS label FROM p WHERE position IS NOT NULL AND isfinite(position.x) AND isfinite(position.y) AND isfinite(position.z)
""")
def state_labels(spark, d):
    finite = [~(F.isnan(f"position.{a}") | F.abs(F.col(f"position.{a}")).isin(float("inf"))) for a in "xyz"]
    rows = players(spark, d).where(F.col("position").isNotNull() & finite[0] & finite[1] & finite[2])
    return rows.select("replay_id", "frame_index", "unique_id", labels.vector_label(F.col("position")).alias("place"), labels.game_time_label(F.col("game_time")).alias("at"), text.type_label(F.col("team"), F.col("name")).alias("label"))


@query("clock_parts", f"WITH {_C} SELECT replay_id, frame_index, frame_index // fps // 60 AS minutes, frame_index // fps % 60 AS seconds, frame_index % fps AS frames FROM k")
def clock_parts(spark, d):
    parts = labels.clock_parts(F.col("frame_index"), F.col("fps"))
    return clock(spark, d).select("replay_id", "frame_index", *[v.cast("int").alias(k) for k, v in parts.items()])


@query("visible_frames", """
WITH r AS (SELECT DISTINCT replay_id, total_frames AS n FROM replays), f AS (SELECT *, greatest(0, least(n, floor(n * 2 / 4)))::INT AS first_frame FROM r)
SELECT replay_id, first_frame, greatest(first_frame, least(n, ceil((n * 2 + 130) / 4)))::INT AS end_frame FROM f
""")
def visible_frames(spark, d):
    rows = table(spark, d, "replays").select("replay_id", F.col("total_frames").alias("n")).distinct()
    first, end = labels.visible_range(F.col("n") * 2, F.lit(130), F.lit(4), F.col("n"))
    return rows.select("replay_id", first.cast("int").alias("first_frame"), end.cast("int").alias("end_frame"))


@query("time_display", f"""
WITH {_C}, t AS (SELECT replay_id, frame_index, utc_ticks + 621355968000000000 AS e, utc_ticks, game_ticks AS g, (game_ticks + 5000) // 10000 AS ms FROM k)
SELECT replay_id, frame_index, e::VARCHAR AS raw, strftime(make_timestamp(utc_ticks // 10), '%d %b %Y %H:%M:%S') || '.' || lpad((utc_ticks % 10000000 // 10000)::VARCHAR, 3, '0') || ' UTC' AS shown,
  CASE WHEN ms >= 60000 THEN concat(ms // 60000, 'm ') ELSE '' END || concat(ms % 60000 // 1000, 's ', ms % 1000, 'ms (', g, ')') AS game FROM t
""")
def time_display(spark, d):
    epoch = F.col("utc_ticks") + ticks.UNIX_EPOCH_TICKS
    return clock(spark, d).select("replay_id", "frame_index", ticks.display(epoch, "raw").alias("raw"), ticks.display(epoch).alias("shown"), ticks.display(F.col("game_ticks"), "both").alias("game"))


_KNOWN = ("rocket", "grenade", "bullet", "plasma", "arrow")


@query("closest_names", f"""
WITH w AS (SELECT DISTINCT lower(trim(type)) AS word FROM projectiles WHERE type IS NOT NULL), n AS (SELECT unnest({list(_KNOWN)}) AS name, unnest(range({len(_KNOWN)})) AS i),
d AS (SELECT word, name, i, levenshtein(word, name) AS e FROM w, n)
SELECT word, CASE WHEN min(e) <= 3 THEN arg_min(name, (e, i)) END AS nearest FROM d GROUP BY word
""")
def closest_names(spark, d):
    """Types of projectiles as written, and the known name within three edits."""

    def walk(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text.closest(w, _KNOWN) for w in words], pa.string())], names=["word", "nearest"])

    words = table(spark, d, "projectiles").where(F.col("type").isNotNull()).select(F.lower(F.trim("type")).alias("word")).distinct()
    return words.mapInArrow(walk, "word string, nearest string")


# --- filters, spans, exports


@query("only_ids", f"WITH {_P}, i AS (SELECT DISTINCT unique_id FROM p ORDER BY unique_id LIMIT 3) SELECT replay_id, frame_index, unique_id FROM p JOIN i USING (unique_id)")
def only_ids_query(spark, d):
    """The rows of a list of ids as a user writes it: the first three in order."""
    rows = players(spark, d)
    names = [r.unique_id for r in rows.select("unique_id").distinct().orderBy("unique_id").limit(3).collect()]
    return only_ids(rows, " , ".join(names) + ",").select("replay_id", "frame_index", "unique_id")


@query("scan_reports", f"""
WITH {_E}, n AS (SELECT count(DISTINCT (replay_id, frame_index)) AS n, count(*) AS m FROM e)
SELECT 'all' AS scan, n AS n_frames, n AS n_with_bucket, m AS n_matched, '' AS message FROM n
UNION ALL SELECT 'other bucket', n, 0, 0, 'the bucket is not present' FROM n
UNION ALL SELECT 'unknown id', n, n, 0, 'no entities matched' FROM n
""")
def scan_reports(spark, d):
    """What scans of all entities, of a bucket that is not there and of an unknown id report."""
    from framelake.frames import frames

    rows = frames(spark, d).select("replay_id", "frame_index", "unique_id", "bucket_index")
    asked = [("all", 0, []), ("other bucket", 5, []), ("unknown id", 0, ["no such id"])]
    parts = [analysis.scan_report(rows, b, ids).select(F.lit(n).alias("scan"), "*") for n, b, ids in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("clamped_ranges", f"""
WITH {_C}, t AS (SELECT DISTINCT replay_id, total_frames AS n FROM replays), a AS (SELECT k.replay_id, frame_index, greatest(0, least(frame_index - 20, n - 1)) AS low, n FROM k JOIN t USING (replay_id))
SELECT replay_id, frame_index, low, greatest(low, least(frame_index + 30, n - 1)) AS high FROM a
""")
def clamped_ranges(spark, d):
    total = table(spark, d, "replays").select("replay_id", F.col("total_frames").alias("n")).distinct()
    low, high = clamp_range(F.col("frame_index") - 20, F.col("frame_index") + 30, F.col("n"))
    return clock(spark, d).join(total, "replay_id").select("replay_id", "frame_index", low.alias("low"), high.alias("high"))


@query("appended_times", f"""
WITH {_C}, m AS (SELECT replay_id, frame_index, min(utc_ticks) AS utc_ticks FROM match_states GROUP BY ALL), t AS (SELECT replay_id, frame_index, utc_ticks FROM k WHERE frame_index < 50)
SELECT * FROM t UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.replay_id = m.replay_id AND t.frame_index = m.frame_index)
""")
def appended_times(spark, d):
    times = clock(spark, d).where(F.col("frame_index") < 50).select("replay_id", "frame_index", "utc_ticks")
    more = table(spark, d, "match_states").groupBy("replay_id", "frame_index").agg(F.min("utc_ticks").alias("utc_ticks"))
    return timeline.append_times(times, more)


_LIVES = f"""{_E},
f AS (SELECT replay_id, frame_index, row_number() OVER (PARTITION BY replay_id ORDER BY frame_index) AS o FROM (SELECT DISTINCT replay_id, frame_index FROM e)),
x AS (SELECT e.*, o, o - row_number() OVER (PARTITION BY e.replay_id, unique_id ORDER BY o) AS g FROM e JOIN f USING (replay_id, frame_index)),
l AS (SELECT replay_id, unique_id, min(entity_type_id) AS type_id, min(frame_index) AS a, max(frame_index) AS b FROM x GROUP BY replay_id, unique_id, g)"""
_TIMED = """(SELECT {t}.*, coalesce(p.game_ticks, 0) AS ga, coalesce(q.game_ticks, 0) AS gb FROM {t} LEFT JOIN k p ON p.replay_id = {t}.replay_id AND p.frame_index = {t}.a LEFT JOIN k q ON q.replay_id = {t}.replay_id AND q.frame_index = {t}.b)"""
_RANGE, _GAME = "'[' || a || '-' || b || ']'", "'[' || printf('%.2f', ga / 1e7) || 's-' || printf('%.2f', gb / 1e7) || 's]'"


@query("export_lifetimes", f"""
WITH {_LIVES}, {_C}, w AS {_TIMED.format(t="l")}
SELECT replay_id, unique_id AS UniqueId, CASE arg_min(type_id, a) WHEN 0 THEN 'Player' WHEN 1 THEN 'Projectile' ELSE 'MatchState' END AS TypeName, arg_min(type_id, a) AS TypeId,
  string_agg({_RANGE}, ', ' ORDER BY a) AS RangesFrame, string_agg({_GAME}, ', ' ORDER BY a) AS RangesGameTime FROM w GROUP BY replay_id, unique_id
""")
def export_lifetimes(spark, d):
    lives = analysis.lifetimes(presence(spark, d))
    return exports.lifetime_table(exports.with_times(lives, clock(spark, d)), {t: name for t, (name, _, _) in TYPES.items()})


@query("export_spans", f"""
WITH {_P}, {_C},
f AS (SELECT replay_id, frame_index, row_number() OVER (PARTITION BY replay_id ORDER BY frame_index) AS o FROM (SELECT DISTINCT replay_id, frame_index FROM player_states)),
v AS (SELECT replay_id, frame_index, unique_id, unnest([{{'k': 'team', 'v': team::varchar}}, {{'k': 'is_alive', 'v': is_alive::varchar}}]) AS kv FROM p),
x AS (SELECT v.replay_id, v.frame_index, unique_id, kv.k AS property, kv.v AS value, o FROM v JOIN f USING (replay_id, frame_index)),
y AS (SELECT *, CASE WHEN lag(o) OVER w = o - 1 AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS c FROM x WINDOW w AS (PARTITION BY replay_id, unique_id, property ORDER BY o)),
z AS (SELECT *, sum(c) OVER (PARTITION BY replay_id, unique_id, property ORDER BY o) AS g FROM y),
l AS (SELECT replay_id, unique_id, property, any_value(value) AS value, min(frame_index) AS a, max(frame_index) AS b FROM z GROUP BY replay_id, unique_id, property, g), w AS {_TIMED.format(t="l")}
SELECT replay_id, unique_id AS UniqueId, property AS Property, coalesce(value, '') AS Value, {_RANGE} AS RangeFrame, {_GAME} AS RangeGameTime FROM w
""")
def export_spans(spark, d):
    return exports.span_table(exports.with_times(analysis.value_spans(deliveries(spark, d, 0), ["team", "is_alive"], F.col("arrived_at")), clock(spark, d)))


@query("export_unique", f"""
WITH {_P} SELECT team::VARCHAR AS team, is_alive::VARCHAR AS is_alive, count(DISTINCT unique_id) AS Count, string_agg(DISTINCT unique_id, ';' ORDER BY unique_id) AS UniqueIds FROM p GROUP BY team, is_alive
""")
def export_unique(spark, d):
    return exports.unique_table(analysis.unique_properties(players(spark, d), ["team", "is_alive"]), ["team", "is_alive"])


# --- loaders


@query("json_loaded", """
WITH r AS (SELECT record_id, payload::json AS p FROM raw_records WHERE struct_name = 'Projectile')
SELECT record_id, upper(p->>'UniqueID') AS UniqueID, try_cast(p->>'Damage' AS DOUBLE) AS Damage, p->>'Type' AS Type, (p->'Position'->>'x')::DOUBLE AS x,
  concat_ws(',', CASE WHEN NOT list_contains(json_keys(p), 'UniqueID') THEN 'UniqueID' END, CASE WHEN NOT list_contains(json_keys(p), 'Damage') THEN 'Damage' END, CASE WHEN NOT list_contains(json_keys(p), 'Type') THEN 'Type' END, CASE WHEN NOT list_contains(json_keys(p), 'Position') THEN 'Position' END) AS missing
FROM r
""")
def json_loaded(spark, d):
    """Projectiles of raw records read by a schema, leniently, through a sanitizer."""
    from framelake.sources.loaders import from_json_text

    struct = T._parse_datatype_string("UniqueID string, Damage double, Type string, Position struct<x:double,y:double,z:double>")
    rows = table(spark, d, "raw_records").where(F.col("struct_name") == "Projectile").select("record_id", "payload")
    read = from_json_text(rows, "payload", struct, sanitize=lambda r: r.withColumn("UniqueID", F.upper("UniqueID")), hash_column="content")
    return read.select("record_id", "UniqueID", "Damage", "Type", F.col("Position.x").alias("x"), F.array_join("missing_keys", ",").alias("missing"))


@query("typed_store", f"WITH {_P} SELECT replay_id, frame_index, unique_id, CASE WHEN health IS NOT NULL THEN printf('%.6f', health::DOUBLE) END AS health, deaths::VARCHAR AS deaths, is_alive::INT::VARCHAR AS is_alive, score::DOUBLE AS score, try_cast(name AS INT)::DOUBLE AS name FROM p WHERE health IS NULL OR isfinite(health)")
def typed_store(spark, d):
    """Values as slots of other types hold them."""
    from framelake.sources.loaders import stored

    rows = players(spark, d).where(F.col("health").isNull() | ~(F.isnan("health") | F.abs("health").isin(float("inf"))))
    text_, number = T.StringType(), T.DoubleType()
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    cells = {"health": text_, "deaths": text_, "is_alive": text_, "score": number}
    return rows.select("replay_id", "frame_index", "unique_id", *[stored(F.col(c), k, kinds[c]).alias(c) for c, k in cells.items()], stored(F.col("name"), T.IntegerType(), text_).cast("double").alias("name"))


# --- hashes and diffs


@query("content_hash_tokens", f"""
WITH {_P}, c AS (SELECT replay_id, (coalesce(name, ''), coalesce(team, 0), coalesce(score, 0), coalesce(deaths, 0), coalesce(health, 0), coalesce(position.x, 0), coalesce(position.y, 0), coalesce(position.z, 0)) AS c FROM p)
SELECT replay_id, count(*) AS n_rows, count(DISTINCT c) AS n_tokens FROM c GROUP BY ALL
""")
def content_hash_tokens(spark, d):
    """Per recording: states and distinct content tokens, which are as many as distinct contents of the six properties of the schema."""
    from framelake.plans.reference import _PLAYER_SCHEMA
    from framelake.sources.replay import content_hashes

    return content_hashes(players(spark, d), _PLAYER_SCHEMA).groupBy("replay_id").agg(F.count("*").alias("n_rows"), F.count_distinct("content_hash").alias("n_tokens"))


@query("diff_unequal_arrays", """
WITH o AS (SELECT l_orderkey, list(l_quantity::INT ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
j AS (SELECT a.l_orderkey, a.q AS a, b.q AS b, least(len(a.q), len(b.q)) AS n FROM o a JOIN o b ON b.l_orderkey = a.l_orderkey + 1),
s AS (SELECT l_orderkey, unnest(range(n)) AS i, a, b FROM j), h AS (SELECT l_orderkey, i FROM s WHERE a[i + 1] <> b[i + 1]),
g AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS g FROM h)
SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 'Replace' ELSE 'ReplaceRange' END AS op, min(i)::INT AS slot_start, count(*)::INT AS range_count FROM g GROUP BY l_orderkey, g
UNION ALL SELECT l_orderkey, 'Remove', unnest(range(n, len(a)))::INT, 1 FROM j
UNION ALL SELECT l_orderkey, 'Add', unnest(range(n, len(b)))::INT, 1 FROM j
""")
def diff_unequal_arrays(spark, d):
    """Operations between slot vectors of different lengths, tails included."""
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("x")).select("l_orderkey", F.transform("x", lambda i: i["l_quantity"].cast("int")).alias("q"))
    both = rows.join(rows.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("q").alias("after")), "l_orderkey")
    ops = both.select("l_orderkey", F.explode(diff.array_ops(F.col("q"), F.col("after"), T.IntegerType())).alias("x"))
    return ops.select("l_orderkey", "x.op", "x.slot_start", "x.range_count")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
