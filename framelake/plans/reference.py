"""Queries of the frame-state operators, each over its whole tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.frames import TYPES, deliveries, entities, flattened, frame_at, frame_context, frame_range, frame_stride, frames, nested, players, presence
from framelake.functions import arrays, text
from framelake.functions import time as ticks
from framelake.operators import analysis, diff, mutate, timeline
from framelake.operators.predicates import contains, search
from framelake.operators.tree import property_tree
from framelake.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# fragments of SQL: deduplicated players, all entities, the frame clock
_P = """p AS (SELECT DISTINCT replay_id, frame_index, lower(trim(unique_id)) AS unique_id, game_time, utc_ticks, name, team, health, armor, position, velocity, is_alive, score, deaths FROM player_states)"""
_E = """e AS (
  SELECT DISTINCT replay_id, frame_index, lower(trim(unique_id)) AS unique_id, 0 AS entity_type_id FROM player_states
  UNION ALL SELECT DISTINCT replay_id, frame_index, lower(trim(unique_id)), 1 FROM projectiles
  UNION ALL SELECT DISTINCT replay_id, frame_index, lower(trim(unique_id)), 2 FROM match_states)"""
_C = """c AS (
  SELECT s.replay_id, s.frame_index, s.utc_ticks, (s.game_time * 10000000::FLOAT)::DOUBLE AS gt, r.fps,
    row_number() OVER (PARTITION BY s.replay_id ORDER BY s.frame_index) AS marker
  FROM (SELECT replay_id, frame_index, min(utc_ticks) AS utc_ticks, min(game_time) AS game_time FROM player_states GROUP BY ALL) s
  JOIN (SELECT replay_id, min(fps) AS fps FROM replays GROUP BY ALL) r ON s.replay_id = r.replay_id),
k AS (SELECT replay_id, frame_index, utc_ticks, trunc(gt)::BIGINT AS game_ticks, fps, marker FROM c)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def clock(spark: SparkSession, d: str) -> DataFrame:
    """One row a frame with its ticks and the recording's rate."""
    rows = table(spark, d, "player_states").groupBy("replay_id", "frame_index").agg(F.min("utc_ticks").alias("utc_ticks"), F.min("game_time").alias("game_time"))
    rate = table(spark, d, "replays").groupBy("replay_id").agg(F.min("fps").alias("fps"))
    rows = rows.join(rate, "replay_id").withColumn("game_ticks", ticks.seconds_to_ticks(F.col("game_time")))
    return rows.select("replay_id", "frame_index", "utc_ticks", "game_ticks", "fps")


# --- windows: lifetimes, spans, samples


@query("entity_lifetime", f"""
WITH {_E},
f AS (SELECT replay_id, frame_index, row_number() OVER (PARTITION BY replay_id ORDER BY frame_index) AS o FROM (SELECT DISTINCT replay_id, frame_index FROM e)),
x AS (SELECT e.*, o, o - row_number() OVER (PARTITION BY e.replay_id, unique_id ORDER BY o) AS g FROM e JOIN f USING (replay_id, frame_index))
SELECT replay_id, unique_id, min(entity_type_id) AS entity_type_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS n_frames FROM x GROUP BY replay_id, unique_id, g
""")
def entity_lifetime(spark, d):
    return analysis.lifetimes(presence(spark, d))


@query("track_spans", f"""
WITH {_P},
f AS (SELECT replay_id, frame_index, row_number() OVER (PARTITION BY replay_id ORDER BY frame_index) AS o FROM (SELECT DISTINCT replay_id, frame_index FROM player_states)),
v AS (SELECT replay_id, frame_index, unique_id, unnest([{{'k': 'team', 'v': team::varchar}}, {{'k': 'is_alive', 'v': is_alive::varchar}}, {{'k': 'score', 'v': score::varchar}}]) AS kv FROM p),
x AS (SELECT v.replay_id, v.frame_index, unique_id, kv.k AS property, kv.v AS value, o FROM v JOIN f USING (replay_id, frame_index)),
y AS (SELECT *, CASE WHEN lag(o) OVER w = o - 1 AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS c FROM x WINDOW w AS (PARTITION BY replay_id, unique_id, property ORDER BY o)),
z AS (SELECT *, sum(c) OVER (PARTITION BY replay_id, unique_id, property ORDER BY o) AS g FROM y)
SELECT replay_id, unique_id, property, any_value(value) AS value, min(frame_index) AS start_frame, max(frame_index) AS end_frame FROM z GROUP BY replay_id, unique_id, property, g
""")
def track_spans(spark, d):
    return analysis.value_spans(deliveries(spark, d, 0), ["team", "is_alive", "score"], F.col("arrived_at"))


@query("unique_properties", f"""
WITH {_P} SELECT team, deaths, count(DISTINCT unique_id) AS n_entities, string_agg(DISTINCT unique_id, ';' ORDER BY unique_id) AS unique_ids FROM p GROUP BY team, deaths
""")
def unique_properties(spark, d):
    return analysis.unique_properties(players(spark, d), ["team", "deaths"]).withColumn("unique_ids", F.array_join("unique_ids", ";"))


@query("track_sample_step", f"""
WITH {_P} SELECT replay_id, frame_index, unique_id, health::DOUBLE AS value FROM p WHERE frame_index BETWEEN 10 AND 90 AND (frame_index - 10) % 7 = 0
""")
def track_sample_step(spark, d):
    return analysis.track(players(spark, d), None, "health", 10, 90, 7).withColumn("value", F.col("value").cast("double"))


# --- predicates


@query("search_numeric", f"WITH {_P} SELECT replay_id, frame_index, unique_id FROM p WHERE health::DOUBLE < 20.5 AND NOT isnan(health)")
def search_numeric(spark, d):
    return search(players(spark, d), "health", "<", "20.5").select("replay_id", "frame_index", "unique_id")


@query("search_string_ne", "WITH m AS (SELECT DISTINCT replay_id, frame_index, phase FROM match_states) SELECT replay_id, frame_index, phase FROM m WHERE phase <> 'playing'")
def search_string_ne(spark, d):
    return search(entities(spark, d, 2), "phase", "!=", "playing").select("replay_id", "frame_index", "phase")


@query("search_bool", f"WITH {_P} SELECT replay_id, frame_index, unique_id FROM p WHERE is_alive = false")
def search_bool(spark, d):
    return search(players(spark, d), "is_alive", "==", "0").select("replay_id", "frame_index", "unique_id")


@query("search_contains", f"WITH {_P} SELECT replay_id, frame_index, unique_id, name FROM p WHERE contains(lower(name), 'zu')")
def search_contains(spark, d):
    return contains(players(spark, d), ["name"], "ZU").select("replay_id", "frame_index", "unique_id", "name")


# --- scans


def _slim(rows: DataFrame) -> DataFrame:
    return rows.select("replay_id", "frame_index", "unique_id", "team", "score")


@query("frame_at", f"WITH {_P} SELECT replay_id, frame_index, unique_id, team, score FROM p WHERE frame_index = 50")
def frame_at_query(spark, d):
    return _slim(frame_at(players(spark, d), 50))


@query("frame_range", f"WITH {_P} SELECT replay_id, frame_index, unique_id, team, score FROM p WHERE frame_index BETWEEN 20 AND 30")
def frame_range_query(spark, d):
    return _slim(frame_range(players(spark, d), 20, 10))


@query("frame_context", f"WITH {_P} SELECT replay_id, frame_index, unique_id, team, score FROM p WHERE frame_index BETWEEN 0 AND 6")
def frame_context_query(spark, d):
    return _slim(frame_context(players(spark, d), 4, 10, 2))


@query("frame_stride", f"WITH {_P} SELECT replay_id, frame_index, unique_id, team, score FROM p WHERE frame_index % 25 = 0")
def frame_stride_query(spark, d):
    return _slim(frame_stride(players(spark, d), 0, 1 << 30, 25))


@query("entities_of_type", f"WITH {_E} SELECT replay_id, frame_index, unique_id FROM e WHERE entity_type_id = 1")
def entities_of_type(spark, d):
    return entities(spark, d, 1).select("replay_id", "frame_index", "unique_id")


@query("nest_and_flatten", f"WITH {_E} SELECT replay_id, frame_index, row_number() OVER (PARTITION BY replay_id, frame_index ORDER BY entity_type_id, unique_id) - 1 AS entity_index, unique_id, entity_type_id FROM e")
def nest_and_flatten(spark, d):
    return flattened(nested(frames(spark, d))).select("replay_id", "frame_index", "entity_index", "unique_id", "entity_type_id")


# --- the clock


@query("timeline_gaps", """
WITH k AS (SELECT s.replay_id, s.frame_index, s.utc_ticks, r.fps FROM (SELECT replay_id, frame_index, min(utc_ticks) AS utc_ticks FROM match_states GROUP BY ALL) s
  JOIN (SELECT replay_id, min(fps) AS fps FROM replays GROUP BY ALL) r ON s.replay_id = r.replay_id),
l AS (SELECT *, row_number() OVER w AS marker, utc_ticks - lag(utc_ticks) OVER w AS step_ticks FROM k WINDOW w AS (PARTITION BY replay_id ORDER BY frame_index))
SELECT replay_id, frame_index, marker, step_ticks FROM l WHERE step_ticks > 1.5 * (10000000 // fps)
""")
def timeline_gaps(spark, d):
    rows = table(spark, d, "match_states").groupBy("replay_id", "frame_index").agg(F.min("utc_ticks").alias("utc_ticks"))
    rate = table(spark, d, "replays").groupBy("replay_id").agg(F.min("fps").alias("fps"))
    return timeline.gaps(rows.join(rate, "replay_id"), F.col("fps"), factor=1.5)


def _late(spark: SparkSession, d: str) -> DataFrame:
    """Match states in order of arrival, which is not that of frames; the order is the arrival's rank, made distinct."""
    rows = table(spark, d, "match_states").groupBy("replay_id", "frame_index").agg(F.min("arrived_at").alias("arrived_at"), F.min("time_remaining").cast("double").alias("remaining"))
    micros = F.unix_micros(F.col("arrived_at").cast("timestamp"))
    return rows.select("replay_id", F.col("frame_index").cast("bigint").alias("position"), "remaining", (micros * 1024 + F.col("frame_index") % 1024).alias("arrival"))


_L = """m AS (
  SELECT replay_id, frame_index::BIGINT AS position, min(time_remaining)::DOUBLE AS remaining, epoch_us(min(arrived_at)) * 1024 + frame_index % 1024 AS arrival FROM match_states GROUP BY replay_id, frame_index)"""


@query("time_filter_increasing", f"""
WITH {_L}, b AS (SELECT *, max(position) OVER (PARTITION BY replay_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound FROM m)
SELECT replay_id, position FROM b WHERE bound IS NULL OR position > bound
""")
def time_filter_increasing(spark, d):
    return timeline.accepted(_late(spark, d), "position").select("replay_id", "position")


@query("time_filter_decreasing", f"""
WITH {_L}, b AS (SELECT *, min(remaining) OVER (PARTITION BY replay_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound FROM m)
SELECT replay_id, position FROM b WHERE remaining IS NULL OR bound IS NULL OR remaining < bound
""")
def time_filter_decreasing(spark, d):
    return timeline.accepted(_late(spark, d), "remaining", increasing=False).select("replay_id", "position")


@query("game_segments", """
WITH m AS (SELECT replay_id, frame_index, min(time_remaining)::DOUBLE AS remaining FROM match_states GROUP BY ALL),
l AS (SELECT *, lag(remaining) OVER w AS before, row_number() OVER w AS marker FROM m WINDOW w AS (PARTITION BY replay_id ORDER BY frame_index))
SELECT replay_id, marker FROM l WHERE remaining > before UNION SELECT replay_id, 1 FROM replays
""")
def game_segments(spark, d):
    rows = table(spark, d, "match_states").groupBy("replay_id", "frame_index").agg(F.min("time_remaining").cast("double").alias("remaining"))
    marked = table(spark, d, "replays").select("replay_id", F.lit(1).cast("bigint").alias("marker"))
    return timeline.segments(rows, "remaining", increasing=False, marked=marked)


@query("fake_times_fps", f"WITH {_C} SELECT replay_id, frame_index, (marker - 1) * (10000000 // fps) AS fake_game_ticks, 1000 + (marker - 1) * (10000000 // fps) AS fake_utc_ticks FROM k")
def fake_times_fps(spark, d):
    return timeline.times_from_fps(clock(spark, d), F.col("fps"), 1000).select("replay_id", "frame_index", "fake_game_ticks", "fake_utc_ticks")


@query("fake_game_time_from_utc", f"WITH {_C} SELECT replay_id, frame_index, utc_ticks - first_value(utc_ticks) OVER (PARTITION BY replay_id ORDER BY frame_index) AS fake_game_ticks FROM k")
def fake_game_time_from_utc(spark, d):
    return timeline.game_time_from_utc(clock(spark, d)).select("replay_id", "frame_index", "fake_game_ticks")


@query("fake_utc_from_game_time", f"""
WITH {_C}, l AS (SELECT *, game_ticks - lag(game_ticks) OVER (PARTITION BY replay_id ORDER BY frame_index) AS dt FROM k),
s AS (SELECT *, CASE WHEN dt IS NULL THEN 5000 + game_ticks WHEN dt > 0 THEN dt ELSE 10000000 // fps END AS step FROM l)
SELECT replay_id, frame_index, (sum(step) OVER (PARTITION BY replay_id ORDER BY frame_index))::BIGINT AS fake_utc_ticks FROM s
""")
def fake_utc_from_game_time(spark, d):
    return timeline.utc_from_game_time(clock(spark, d), F.col("fps"), 5000).select("replay_id", "frame_index", "fake_utc_ticks")


@query("sorted_game_time_index", """
WITH m AS (SELECT replay_id, frame_index, min(time_remaining)::DOUBLE AS remaining FROM match_states WHERE time_remaining IS NOT NULL GROUP BY ALL)
SELECT replay_id, frame_index, row_number() OVER (PARTITION BY replay_id ORDER BY remaining, frame_index DESC) - 1 AS sorted_index FROM m
""")
def sorted_game_time_index(spark, d):
    from pyspark.sql import Window as W

    rows = table(spark, d, "match_states").where(F.col("time_remaining").isNotNull()).groupBy("replay_id", "frame_index").agg(F.min("time_remaining").cast("double").alias("remaining"))
    w = W.partitionBy("replay_id").orderBy("remaining", F.desc("frame_index"))  # equal times: the newest first
    return rows.select("replay_id", "frame_index", (F.row_number().over(w) - 1).cast("bigint").alias("sorted_index"))


@query("chunk_seek_table", f"WITH {_C} SELECT replay_id, ((marker - 1) // 40)::INT AS chunk_index, min(marker) - 1 AS start_frame, max(marker) - 1 AS end_frame, count(*) AS n_frames FROM k GROUP BY ALL")
def chunk_seek_table(spark, d):
    return timeline.seek_table(clock(spark, d), 40)


@query("frame_to_chunk", f"""
WITH {_C}, s AS (SELECT replay_id, ((marker - 1) // 40)::INT AS chunk_index, min(marker) - 1 AS a, max(marker) - 1 AS b FROM k GROUP BY ALL)
SELECT k.replay_id, k.frame_index, s.chunk_index FROM k JOIN s ON k.replay_id = s.replay_id AND k.marker - 1 BETWEEN s.a AND s.b
""")
def frame_to_chunk(spark, d):
    rows = timeline.numbered(clock(spark, d)).withColumn("position", F.col("marker") - 1)
    return timeline.chunk_for(rows, timeline.seek_table(clock(spark, d), 40)).select("replay_id", "frame_index", "chunk_index")


@query("footer_summary", f"""
WITH {_C} SELECT replay_id, count(*) AS total_frames, max(utc_ticks) - min(utc_ticks) AS duration_ticks,
  CASE WHEN max(utc_ticks) > min(utc_ticks) THEN floor(count(*) * 1e7 / (max(utc_ticks) - min(utc_ticks)) * 1000)::BIGINT END AS avg_fps_milli FROM k GROUP BY replay_id
""")
def footer_summary(spark, d):
    return timeline.footer_summary(clock(spark, d)).select("replay_id", "total_frames", "duration_ticks", F.floor(F.col("avg_fps") * 1000).alias("avg_fps_milli"))


# --- counts


@query("type_ranges", f"""
WITH {_E}, n AS (SELECT replay_id, frame_index, entity_type_id, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT replay_id, frame_index, max(entity_type_id) AS top FROM n GROUP BY ALL),
t AS (SELECT replay_id, frame_index, unnest(range(top + 1))::INT AS entity_type_id FROM m)
SELECT t.replay_id, t.frame_index, t.entity_type_id, coalesce(n, 0) AS n_entities,
  coalesce(sum(n) OVER (PARTITION BY t.replay_id, t.frame_index ORDER BY t.entity_type_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_index
FROM t LEFT JOIN n ON t.replay_id = n.replay_id AND t.frame_index = n.frame_index AND t.entity_type_id = n.entity_type_id
""")
def type_ranges(spark, d):
    return mutate.type_ranges(frames(spark, d), 3)


@query("frame_stats", f"WITH {_E} SELECT replay_id, frame_index, 1::BIGINT AS n_buckets, count(*) AS n_entities FROM e GROUP BY ALL")
def frame_stats(spark, d):
    return mutate.bucket_counts(frames(spark, d))


@query("bucket_entity_counts", f"WITH {_E} SELECT replay_id, 'entity' AS bucket_name, entity_type_id, count(*) AS n_entities FROM e GROUP BY ALL")
def bucket_entity_counts(spark, d):
    return frames(spark, d).groupBy("replay_id", "bucket_name", "entity_type_id").agg(F.count("*").alias("n_entities"))


# --- diff

_SLOTS = ("team", "health", "is_alive", "score", "deaths")


def _slot_sql(a: str, b: str) -> str:
    """(property, op) of changed slots of two row aliases."""
    made = []
    for p in _SLOTS:
        x, y = f"{a}.{p}", f"{b}.{p}"
        change = f"({x} IS NULL) <> ({y} IS NULL) OR abs({x}::DOUBLE - {y}::DOUBLE) > 1e-5" if p == "health" else f"{x} IS DISTINCT FROM {y}"
        made.append(f"CASE WHEN {change} THEN {{'property': '{p}', 'op': CASE WHEN {x} IS NULL THEN 'Add' WHEN {y} IS NULL THEN 'Remove' ELSE 'Replace' END}} END")
    return f"list_filter([{', '.join(made)}], lambda s: s IS NOT NULL)"


_DIFF = f"""{_P}, a AS (SELECT * FROM p WHERE frame_index = 10), b AS (SELECT * FROM p WHERE frame_index = 60),
j AS (
  SELECT coalesce(a.replay_id, b.replay_id) AS replay_id, coalesce(a.unique_id, b.unique_id) AS unique_id,
    unnest(CASE WHEN a.unique_id IS NULL THEN [{{'property': NULL::VARCHAR, 'op': 'Add'}}] WHEN b.unique_id IS NULL THEN [{{'property': NULL::VARCHAR, 'op': 'Remove'}}] ELSE {_slot_sql("a", "b")} END) AS x
  FROM a FULL JOIN b ON a.replay_id = b.replay_id AND a.unique_id = b.unique_id)"""


def _patch(spark: SparkSession, d: str) -> DataFrame:
    rows = players(spark, d)
    return diff.diff_frames(frame_at(rows, 10), frame_at(rows, 60), _SLOTS, ["replay_id", "unique_id"])


@query("diff_frames", f"WITH {_DIFF} SELECT replay_id, unique_id, x.op AS op, x.property AS property FROM j")
def diff_frames(spark, d):
    return _patch(spark, d).select("replay_id", "unique_id", "op", "property")


@query("patch_validate", f"""
WITH {_DIFF}, v AS (SELECT x.op AS op, true AS valid FROM j UNION ALL SELECT x.op, x.property IS NOT NULL FROM j)
SELECT op, valid, count(*) AS n_ops FROM v GROUP BY ALL
""")
def patch_validate(spark, d):
    """A patch against its own frames, and against them the wrong way round, where whole entities come and go the other way."""
    rows = players(spark, d)
    made, a, b, keys = _patch(spark, d), frame_at(rows, 10), frame_at(rows, 60), ["replay_id", "unique_id"]
    checked = diff.validate(made, a, b, keys).unionByName(diff.validate(made, b, a, keys))
    return checked.groupBy("op", "valid").agg(F.count("*").alias("n_ops"))


@query("patch_preview", f"WITH {_DIFF} SELECT replay_id, unique_id, x.op AS op, x.property AS property FROM j ORDER BY replay_id, unique_id, x.property NULLS FIRST LIMIT 50")
def patch_preview(spark, d):
    """The first fifty operations of a patch."""
    return diff.preview(_patch(spark, d), ["replay_id", "unique_id", "property"]).select("replay_id", "unique_id", "op", "property")


@query("diff_type_names", f"""
WITH {_DIFF}, b2 AS (SELECT DISTINCT replay_id, unique_id FROM p WHERE frame_index = 60)
SELECT j.replay_id, j.unique_id, count(*) AS n_ops, CASE WHEN any_value(b2.unique_id) IS NOT NULL THEN 'Player' END AS type_name FROM j LEFT JOIN b2 ON j.replay_id = b2.replay_id AND j.unique_id = b2.unique_id GROUP BY ALL
""")
def diff_type_names(spark, d):
    keys = ["replay_id", "unique_id"]
    named = diff.with_type_names(diff.summary(_patch(spark, d), keys), frame_at(players(spark, d), 60), keys)
    return named.select("replay_id", "unique_id", "n_ops", "type_name")


_CONSEC = f"""{_P}, l AS (SELECT *, lag(frame_index) OVER w AS frame_a, lag(struct_pack(team := team, health := health, is_alive := is_alive, score := score, deaths := deaths)) OVER w AS b FROM p WINDOW w AS (PARTITION BY replay_id, unique_id ORDER BY frame_index)),
j AS (SELECT replay_id, unique_id, frame_a, frame_index AS frame_b, unnest({_slot_sql("l.b", "l")}) AS x FROM l WHERE frame_a IS NOT NULL)"""


@query("diff_consecutive", f"WITH {_CONSEC} SELECT replay_id, unique_id, frame_a, frame_b, x.op AS op, x.property AS property FROM j")
def diff_consecutive(spark, d):
    return diff.diff_consecutive(players(spark, d), _SLOTS).select("replay_id", "unique_id", "frame_a", "frame_b", "op", "property")


@query("diff_summary", f"WITH {_CONSEC} SELECT replay_id, unique_id, string_agg(DISTINCT x.property, ',' ORDER BY x.property) AS properties, count(*) AS n_ops FROM j GROUP BY replay_id, unique_id")
def diff_summary(spark, d):
    patch = diff.diff_consecutive(players(spark, d), _SLOTS)
    return diff.summary(patch, ["replay_id", "unique_id"]).withColumn("properties", F.array_join("properties", ","))


@query("diff_op_histogram", f"WITH {_CONSEC} SELECT x.op AS op, x.property AS property, count(*) AS n_ops FROM j GROUP BY ALL")
def diff_op_histogram(spark, d):
    return diff.histogram(diff.diff_consecutive(players(spark, d), _SLOTS))


@query("content_hash_changes", f"""
WITH {_P}, l AS (SELECT *, row_number() OVER w AS n, lag(struct_pack(t := team, s := score, d := deaths, a := is_alive)) OVER w AS b FROM p WINDOW w AS (PARTITION BY replay_id, unique_id ORDER BY frame_index))
SELECT replay_id, unique_id, frame_index FROM l WHERE n > 1 AND b IS DISTINCT FROM struct_pack(t := team, s := score, d := deaths, a := is_alive)
""")
def content_hash_changes(spark, d):
    return diff.changed_hashes(players(spark, d), ["team", "score", "deaths", "is_alive"]).select("replay_id", "unique_id", "frame_index")


@query("diff_range_coalesce", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 2)::INT) AS a FROM embeddings),
j AS (SELECT x.vec_id, x.a AS a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1),
s AS (SELECT vec_id, unnest(range(64)) AS i, a, b FROM j),
d AS (SELECT vec_id, i FROM s WHERE a[i + 1] <> b[i + 1]),
g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM d)
SELECT vec_id, min(i)::INT AS slot_start, count(*)::INT AS range_count, CASE WHEN count(*) = 1 THEN 'Replace' ELSE 'ReplaceRange' END AS op FROM g GROUP BY vec_id, g
""")
def diff_range_coalesce(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 2).cast("int")).alias("a"))
    both = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    ops = both.select("vec_id", F.explode(diff.array_ops(F.col("a"), F.col("b"), T.IntegerType())).alias("x"))
    return ops.select("vec_id", "x.slot_start", "x.range_count", "x.op")


_ORDERS = """o AS (SELECT l_orderkey, list(struct_pack(p := l_partkey, q := l_quantity) ORDER BY l_linenumber, l_partkey, l_quantity) AS items, map_from_entries(list(DISTINCT struct_pack(k := l_returnflag, v := l_linestatus))) AS m FROM lineitem GROUP BY l_orderkey)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q")))).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda i: F.struct(i["p"].alias("p"), i["q"].alias("q"))).alias("items"))


@query("diff_nested_arrays", """
WITH o AS (SELECT l_orderkey, list(struct_pack(p := l_partkey, q := l_quantity) ORDER BY l_linenumber, l_partkey, l_quantity) AS items FROM lineitem GROUP BY l_orderkey),
j AS (SELECT a.l_orderkey, a.items AS a, b.items AS b FROM o a JOIN o b ON b.l_orderkey = a.l_orderkey + 1),
e AS (SELECT l_orderkey, unnest(range(len(a))) AS i, a, b FROM j WHERE len(a) = len(b)),
x AS (SELECT l_orderkey, i, a[i + 1] AS m, b[i + 1] AS n FROM e)
SELECT l_orderkey, 'items' AS path, 'Replace' AS op, 'StructArray' AS container FROM j WHERE len(a) <> len(b)
UNION ALL SELECT l_orderkey, 'items[' || i || '].p', 'Replace', 'Int64' FROM x WHERE m.p <> n.p
UNION ALL SELECT l_orderkey, 'items[' || i || '].q', 'Replace', 'Double' FROM x WHERE abs(m.q - n.q) > 1e-5
""")
def diff_nested_arrays(spark, d):
    """The operations between the items of each order and those of the next one."""
    rows = _items(spark, d)
    kind = rows.schema["items"].dataType
    both = rows.join(rows.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("items").alias("after")), "l_orderkey")
    return both.select("l_orderkey", F.explode(diff.nested_ops(F.col("items"), F.col("after"), kind, F.lit("items"))).alias("x")).select("l_orderkey", "x.path", "x.op", "x.container")


@query("diff_containers", f"""
WITH {_P}, a AS (SELECT * FROM p WHERE frame_index = 10), b AS (SELECT * FROM p WHERE frame_index = 60),
j AS (SELECT a.unique_id AS ua, b.unique_id AS ub, a.team AS t0, b.team AS t1, a.health::DOUBLE AS h0, b.health::DOUBLE AS h1, a.is_alive AS l0, b.is_alive AS l1, a.position AS p0, b.position AS p1 FROM a FULL JOIN b ON a.replay_id = b.replay_id AND a.unique_id = b.unique_id),
s AS (
  SELECT 'Entity' AS container, CASE WHEN ua IS NULL THEN 'Add' ELSE 'Remove' END AS op FROM j WHERE ua IS NULL OR ub IS NULL
  UNION ALL SELECT 'Int32', CASE WHEN t0 IS NULL THEN 'Add' WHEN t1 IS NULL THEN 'Remove' ELSE 'Replace' END FROM j WHERE ua IS NOT NULL AND ub IS NOT NULL AND t0 IS DISTINCT FROM t1
  UNION ALL SELECT 'Float', CASE WHEN h0 IS NULL THEN 'Add' WHEN h1 IS NULL THEN 'Remove' ELSE 'Replace' END FROM j WHERE ua IS NOT NULL AND ub IS NOT NULL AND ((h0 IS NULL) <> (h1 IS NULL) OR abs(h0 - h1) > 1e-5)
  UNION ALL SELECT 'Bool', CASE WHEN l0 IS NULL THEN 'Add' WHEN l1 IS NULL THEN 'Remove' ELSE 'Replace' END FROM j WHERE ua IS NOT NULL AND ub IS NOT NULL AND l0 IS DISTINCT FROM l1
  UNION ALL SELECT 'Vector', CASE WHEN p0 IS NULL THEN 'Add' WHEN p1 IS NULL THEN 'Remove' ELSE 'Replace' END FROM j WHERE ua IS NOT NULL AND ub IS NOT NULL AND ((p0 IS NULL) <> (p1 IS NULL) OR abs(p0.x - p1.x) > 1e-5 OR abs(p0.y - p1.y) > 1e-5 OR abs(p0.z - p1.z) > 1e-5))
SELECT container, op, count(*) AS n_ops FROM s GROUP BY ALL
""")
def diff_containers(spark, d):
    """Operations between two frames, counted by the kind of slot."""
    rows = players(spark, d)
    made = diff.patch(frame_at(rows, 10), frame_at(rows, 60), ["team", "health", "is_alive", "position"], ["replay_id", "unique_id"])
    return made.groupBy("container", "op").agg(F.count("*").alias("n_ops"))


@query("diff_map", """
WITH m AS (SELECT l_orderkey, l_returnflag AS k, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY ALL),
o AS (SELECT DISTINCT l_orderkey FROM m),
pairs AS (SELECT a.l_orderkey FROM o a JOIN o b ON b.l_orderkey = a.l_orderkey + 1),
x AS (SELECT m.* FROM m JOIN pairs USING (l_orderkey)),
y AS (SELECT m.l_orderkey - 1 AS l_orderkey, k, v FROM m JOIN pairs ON pairs.l_orderkey = m.l_orderkey - 1)
SELECT coalesce(x.l_orderkey, y.l_orderkey) AS l_orderkey, coalesce(x.k, y.k) AS key, CASE WHEN x.k IS NULL THEN 'Add' WHEN y.k IS NULL THEN 'Remove' ELSE 'Replace' END AS op
FROM x FULL JOIN y ON x.l_orderkey = y.l_orderkey AND x.k = y.k WHERE x.v IS DISTINCT FROM y.v
""")
def diff_map(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").cast("bigint").alias("v"))
    rows = sums.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "v"))).alias("m"))
    both = rows.join(rows.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("m").alias("after")), "l_orderkey")
    return both.select("l_orderkey", F.explode(diff.map_ops(F.col("m"), F.col("after"))).alias("x")).select("l_orderkey", "x.key", "x.op")


# --- mutation


@query("post_process_clamp", f"""
WITH {_P}, h AS (SELECT *, CASE WHEN health IS NULL OR isnan(health) THEN health::DOUBLE ELSE greatest(0, least(100, health))::DOUBLE END AS h FROM p)
SELECT replay_id, unique_id, count_if(h IS DISTINCT FROM health::DOUBLE)::BIGINT AS n_clamped, count_if(h < 50)::BIGINT AS n_low, count_if(CASE WHEN h <= 0 THEN false ELSE is_alive END)::BIGINT AS n_alive FROM h GROUP BY ALL
""")
def post_process_clamp(spark, d):
    chain = mutate.Chain(mutate.Clamp("health", count=True), mutate.Alive())
    rows = players(spark, d)
    chain.init(rows.columns)
    out = chain.process(rows)
    return out.groupBy("replay_id", "unique_id").agg(F.count_if("clamped_health").alias("n_clamped"), F.count_if((F.col("health") < 50) & ~F.isnan("health")).alias("n_low"), F.count_if("is_alive").alias("n_alive"))


@query("post_process_chain", f"WITH {_P} SELECT replay_id, frame_index, unique_id, 7 AS score, (deaths * 2 + 1) AS deaths FROM p WHERE team IS DISTINCT FROM 2")
def post_process_chain(spark, d):
    chain = mutate.Chain(
        mutate.Function(lambda r: mutate.remove_if(r, F.col("team") == 2), "drop team 2"),
        mutate.Function(lambda r: mutate.set_value(r, "deaths", F.col("deaths") * 2), "double"),
        mutate.Function(lambda r: mutate.set_value(r, "deaths", F.col("deaths") + 1), "add one"),
        mutate.Function(lambda r: mutate.set_value(r, "score", F.lit(7)), "tag"),
    )
    return chain.process(players(spark, d)).select("replay_id", "frame_index", "unique_id", "score", "deaths")


@query("inject_entities", f"WITH {_P} SELECT replay_id, frame_index, unique_id, team FROM p UNION ALL SELECT DISTINCT replay_id, frame_index, 'ghost', 99 FROM p")
def inject_entities(spark, d):
    rows = players(spark, d)
    ghosts = table(spark, d, "player_states").select("replay_id", "frame_index").distinct().withColumns({"unique_id": F.lit("ghost"), "team": F.lit(99)})
    return mutate.add_entities(rows, ghosts).select("replay_id", "frame_index", "unique_id", "team")


@query("remove_if", f"WITH {_P} SELECT replay_id, frame_index, unique_id FROM p WHERE NOT coalesce(is_alive = false AND armor = 0, false)")
def remove_if(spark, d):
    return mutate.remove_if(players(spark, d), ~F.col("is_alive") & (F.col("armor") == 0)).select("replay_id", "frame_index", "unique_id")


@query("nested_edit", f"""
WITH {_P} SELECT replay_id, frame_index, unique_id, CASE WHEN team = 1 THEN position.x + 1 ELSE position.x END AS x, position.y AS y FROM p
""")
def nested_edit(spark, d):
    edited = mutate.set_nested(players(spark, d), "position.x", lambda x: x + 1, F.col("team") == 1)
    return edited.select("replay_id", "frame_index", "unique_id", F.col("position.x").alias("x"), F.col("position.y").alias("y"))


@query("process_context", f"WITH {_C} SELECT replay_id, frame_index, marker - 1 AS frame_number, ((marker - 1) // 40)::INT AS chunk_index, (marker - 1) % 40 AS chunk_frame FROM k")
def process_context(spark, d):
    """What processors are told of each frame."""
    return mutate.with_context(clock(spark, d), 40).select("replay_id", "frame_index", "frame_number", "chunk_index", "chunk_frame")


@query("missing_fields", f"""
WITH {_P} SELECT replay_id, frame_index, unique_id, 0 AS entity_type_id,
  concat_ws(',', CASE WHEN name IS NULL THEN 'name' END, CASE WHEN team IS NULL THEN 'team' END, CASE WHEN health IS NULL THEN 'health' END, CASE WHEN armor IS NULL THEN 'armor' END,
    CASE WHEN position IS NULL THEN 'position' END, CASE WHEN velocity IS NULL THEN 'velocity' END) AS missing
FROM p WHERE name IS NULL OR team IS NULL OR health IS NULL OR armor IS NULL OR position IS NULL OR velocity IS NULL
""")
def missing_fields(spark, d):
    return mutate.missing_fields(players(spark, d), {0: TYPES[0][2]})


@query("property_tree", f"""
WITH {_P}, v AS (SELECT replay_id, frame_index, unique_id, unnest([{{'path': 'team', 'value': team::VARCHAR}}, {{'path': 'score', 'value': score::VARCHAR}}, {{'path': 'is_alive', 'value': is_alive::VARCHAR}}, {{'path': 'name', 'value': name}}]) AS x FROM p)
SELECT replay_id, frame_index, unique_id, x.path AS path, x.value AS value FROM v
""")
def property_tree_query(spark, d):
    return property_tree(players(spark, d), ["replay_id", "frame_index", "unique_id"], ["team", "score", "is_alive", "name"])


@query("patch_resolve", f"""
WITH {_DIFF}, b2 AS (SELECT * FROM p WHERE frame_index = 60)
SELECT j.replay_id, j.unique_id, j.x.property AS property, b2.unique_id IS NOT NULL AS found,
  CASE j.x.property WHEN 'team' THEN b2.team::VARCHAR WHEN 'score' THEN b2.score::VARCHAR WHEN 'deaths' THEN b2.deaths::VARCHAR WHEN 'is_alive' THEN b2.is_alive::VARCHAR END AS value
FROM j LEFT JOIN b2 ON j.replay_id = b2.replay_id AND j.unique_id = b2.unique_id WHERE j.x.property IS DISTINCT FROM 'health'
""")
def patch_resolve(spark, d):
    patch = _patch(spark, d).where(~F.col("property").eqNullSafe("health"))
    found = diff.resolve(patch, frame_at(players(spark, d), 60), _SLOTS, ["replay_id", "unique_id"])
    return found.select("replay_id", "unique_id", "property", "found", "value")


@query("last_chunk", f"WITH {_C}, m AS (SELECT *, (marker - 1) // 40 AS ch, max((marker - 1) // 40) OVER (PARTITION BY replay_id) AS top FROM k) SELECT replay_id, frame_index, marker FROM m WHERE ch = top")
def last_chunk(spark, d):
    return timeline.last_chunk(clock(spark, d), 40).select("replay_id", "frame_index", "marker")


@query("sanitize_by_type", f"""
WITH {_P} SELECT replay_id, frame_index, unique_id, 'Player' AS type_name, greatest(team, 0) + 10 AS team FROM p
UNION ALL SELECT DISTINCT replay_id, frame_index, lower(trim(unique_id)), 'Projectile', -1 FROM projectiles UNION ALL SELECT DISTINCT replay_id, frame_index, lower(trim(unique_id)), 'MatchState', -1 FROM match_states
""")
def sanitize_by_type(spark, d):
    clean = mutate.Sanitizers().add(0, "team", lambda c: F.greatest(c, F.lit(0)) + 10)
    return clean.process(frames(spark, d)).select("replay_id", "frame_index", "unique_id", "type_name", F.coalesce("team", F.lit(-1)).alias("team"))


#: Types of the container for the properties of all entities.
_STORED = {"name": "String", "team": "Int32", "health": "Float", "armor": "Float", "position": "Vector", "velocity": "Vector", "is_alive": "Bool", "score": "Int32", "deaths": "Int32",
           "owner_id": "String", "damage": "Float", "type": "String", "score_team1": "Int32", "score_team2": "Int32", "round": "Int32", "phase": "String", "time_remaining": "Float"}


def _stored_schema() -> str:
    import json

    mapping = [{"struct": name, "values": [{"name": p, "typeId": _STORED[p]} for p in properties]} for name, _, properties in (TYPES[t] for t in sorted(TYPES))]
    return json.dumps({"version": "1.0.0", "buckets": ["entity"], "property_mapping": mapping})


def _recorded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_utc_ticks", F.col("utc_ticks"))


def container_differences(rows: DataFrame, at: str) -> DataFrame:
    """Rows of ``frames`` that are given back other than they were written, with how often they are ``missing`` (less than 0: too many).

    All entities and properties are written to container files in the folder ``at`` and read again. The
    container has no null scalars, so a null counts as its type's empty value. Its frames are
    numbered without gaps; they are told by their time.
    """
    from framelake.sources import replay

    rows, schema = _recorded(rows), _stored_schema()
    replay.write_replays(rows, at, schema, max_frames=40)
    want = replay.as_stored(rows, schema)
    back = replay.read_replays(rows.sparkSession, at).select(want.columns)
    both = want.withColumn("__n", F.lit(1)).unionByName(back.withColumn("__n", F.lit(-1)))
    return both.groupBy(want.columns).agg(F.sum("__n").alias("missing")).where(F.col("missing") != 0)


def _stored_sql() -> str:
    """All entities as the container gives them back: frames numbered without gaps, nulls of own properties as empty values."""
    empty = {"String": "''", "Int32": "0", "Float": "0::FLOAT", "Bool": "false"}
    parts = []
    for type_id, (name, source, properties) in TYPES.items():
        cells = []
        for p, kind in _STORED.items():
            if kind == "Vector":
                cells += [f"coalesce({p}.{a}, 0) AS {p}_{a}" if p in properties else f"NULL::DOUBLE AS {p}_{a}" for a in "xyz"]
            else:
                value = f"coalesce({p}, {empty[kind]})" if p in properties else "NULL"
                cells.append(f"{value} AS {p}" if kind == "String" else f"{value}::INT::DOUBLE AS {p}" if kind == "Bool" else f"{value}::DOUBLE AS {p}")
        parts.append(f"SELECT DISTINCT replay_id, frame_index, utc_ticks, lower(trim(unique_id)) AS unique_id, {type_id} AS entity_type_id, '{name}' AS type_name, {', '.join(cells)} FROM {source}")
    return f"WITH s AS ({' UNION ALL '.join(parts)})"


def _recordings(spark: SparkSession, d: str, backend: str) -> str:
    """A folder of the shared one for the recordings of a data folder."""
    import zlib

    from framelake.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/replays_{backend}_{zlib.crc32(d.encode()):08x}"


def _given_back(spark: SparkSession, d: str, backend: str) -> DataFrame:
    from framelake.sources import replay

    at = _recordings(spark, d, backend)
    replay.write_replays(_recorded(frames(spark, d)), at, _stored_schema(), backend, max_frames=40)
    return replay.read_replays(spark, at)


def _flat_cells(rows: DataFrame) -> DataFrame:
    cells = []
    for p, kind in _STORED.items():
        if kind == "Vector":
            cells += [F.col(f"{p}.{a}").alias(f"{p}_{a}") for a in "xyz"]
        else:
            cells.append(F.col(p) if kind == "String" else F.col(p).cast("double").alias(p))
    return rows.select("replay_id", "frame_index", F.col("created_utc_ticks").alias("utc_ticks"), "unique_id", "entity_type_id", "type_name", *cells)


_ROUNDTRIP = _stored_sql() + " SELECT * REPLACE ((dense_rank() OVER (PARTITION BY replay_id ORDER BY frame_index) - 1)::INT AS frame_index) FROM s"


@query("replay_roundtrip", _ROUNDTRIP)
def replay_roundtrip(spark, d):
    """Every entity of every type and all its properties, written to container files in the shared folder and read back."""
    return _flat_cells(_given_back(spark, d, "flatbuffers"))


@query("replay_roundtrip_tagged", _ROUNDTRIP)
def replay_roundtrip_tagged(spark, d):
    """The same in the tagged encoding."""
    return _flat_cells(_given_back(spark, d, "protobuf"))


_ORDERED = "f AS (SELECT replay_id, frame_index, dense_rank() OVER (PARTITION BY replay_id ORDER BY frame_index) - 1 AS n FROM (SELECT DISTINCT replay_id, frame_index FROM s))"


@query("replay_chunks", f"{_stored_sql()}, {_ORDERED} SELECT replay_id, (n // 40)::INT AS chunk_index, min(n)::INT AS start_frame, max(n)::INT AS end_frame FROM f GROUP BY ALL")
def replay_chunks(spark, d):
    """Seek tables as the files hold them."""
    from framelake.sources import replay

    _given_back(spark, d, "flatbuffers")
    return replay.metadata(spark, _recordings(spark, d, "flatbuffers"))["chunks"].select("replay_id", "chunk_index", "start_frame", "end_frame")


@query("replay_range", f"{_stored_sql()}, {_ORDERED} SELECT s.replay_id, f.n::INT AS frame_index, unique_id FROM s JOIN f USING (replay_id, frame_index) WHERE f.n BETWEEN 45 AND 50")
def replay_range(spark, d):
    """A frame range of every recording; chunks outside it are not opened."""
    from framelake.sources import replay

    _given_back(spark, d, "flatbuffers")
    return replay.read_replays(spark, _recordings(spark, d, "flatbuffers"), frames=(45, 50)).select("replay_id", "frame_index", "unique_id")


# --- functions


@query("ticks_roundtrip", f"WITH {_C} SELECT replay_id, frame_index, game_ticks, utc_ticks + 621355968000000000 AS epoch_ticks, utc_ticks AS back FROM k")
def ticks_roundtrip(spark, d):
    epoch = F.col("utc_ticks") + ticks.UNIX_EPOCH_TICKS
    return clock(spark, d).select("replay_id", "frame_index", "game_ticks", epoch.alias("epoch_ticks"), ticks.unix_ticks(epoch).alias("back"))


@query("duration_parts", f"""
WITH {_C}, m AS (SELECT replay_id, frame_index, (utc_ticks + 5000) // 10000 AS ms FROM k)
SELECT replay_id, frame_index, ms // 3600000 AS hours, ms % 3600000 // 60000 AS minutes, ms % 60000 // 1000 AS seconds, ms % 1000 AS milliseconds,
  concat(ms // 3600000, 'h ', ms % 3600000 // 60000, 'm ', ms % 60000 // 1000, 's ', ms % 1000, 'ms') AS label FROM m
""")
def duration_parts(spark, d):
    parts = ticks.duration_parts(F.col("utc_ticks"))
    return clock(spark, d).select("replay_id", "frame_index", *[v.alias(k) for k, v in parts.items()], ticks.format_duration(F.col("utc_ticks")).alias("label"))


@query("array_ops", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 10)::INT) AS a FROM embeddings),
s AS (SELECT vec_id, [a[1:4], a[5:6], a[7:9]] AS r FROM e)
SELECT vec_id, len(r) AS n_sub, (len(r[1]) + len(r[2]) + len(r[3]))::INT AS n_total, array_to_string(r[2], ',') AS sub_1,
  array_to_string(flatten([r[1], [1, 2], r[2], r[3]]), ',') AS inserted, array_to_string(flatten([r[1], r[3]]), ',') AS erased,
  array_to_string(flatten([r[1], [7], r[3]]), ',') AS replaced, array_to_string(flatten([r[1], r[2], r[3], [9]]), ',') AS pushed, 5 AS pushed_subs
FROM s
""")
def array_ops(spark, d):
    ints = F.transform("embedding", lambda x: F.floor(x * 10).cast("int"))
    rows = table(spark, d, "embeddings").select("vec_id", ints.alias("a")).select("vec_id", F.array(F.slice("a", 1, 4), F.slice("a", 5, 2), F.slice("a", 7, 3)).alias("r"))
    r = F.col("r")
    joined = lambda c: F.array_join(F.flatten(c), ",")
    return rows.select(
        "vec_id", arrays.sub_count(r).cast("bigint").alias("n_sub"), arrays.total_count(r).alias("n_total"), F.array_join(arrays.sub_array(r, 1), ",").alias("sub_1"),
        joined(arrays.insert_sub(r, 1, F.array(F.lit(1), F.lit(2)))).alias("inserted"), joined(arrays.erase_sub(r, 1)).alias("erased"),
        joined(arrays.replace_sub(r, 1, F.array(F.lit(7)))).alias("replaced"), joined(arrays.push(r, 4, F.lit(9))).alias("pushed"), F.size(arrays.push(r, 4, F.lit(9))).alias("pushed_subs"),
    )


@query("levenshtein_hint", """
WITH w AS (SELECT DISTINCT lower(trim(type)) AS word FROM projectiles WHERE type IS NOT NULL)
SELECT word, CASE WHEN levenshtein(word, 'rocket') <= 3 THEN 'rocket' END AS hint, levenshtein(word, 'rocket') AS distance FROM w
""")
def levenshtein_hint(spark, d):
    words = table(spark, d, "projectiles").where(F.col("type").isNotNull()).select(F.lower(F.trim("type")).alias("word")).distinct()
    distance = text.edit_distance(F.col("word"), F.lit("ROCKET"))
    return words.select("word", F.when(distance <= 3, "rocket").alias("hint"), distance.cast("bigint").alias("distance"))


@query("schema_name_lookup", f"""
WITH {_E}, n AS (SELECT unnest([0, 1, 2]) AS entity_type_id, unnest(['Player', 'Projectile', 'MatchState']) AS type_name, unnest([9, 5, 5]) AS n_properties)
SELECT DISTINCT replay_id, unique_id, type_name, n_properties FROM e JOIN n USING (entity_type_id)
""")
def schema_name_lookup(spark, d):
    """Entities with the name of their type and how many properties it declares, both looked up in the schema."""
    from framelake.schema import SchemaRegistry

    declared = SchemaRegistry.from_json(_stored_schema()).fields_frame(spark).groupBy(F.col("type_id").alias("entity_type_id"), F.col("struct").alias("type_name")).agg(F.count("*").cast("int").alias("n_properties"))
    return presence(spark, d).select("replay_id", "unique_id", "entity_type_id").distinct().join(declared, "entity_type_id").select("replay_id", "unique_id", "type_name", "n_properties")


@query("timeline_events", "SELECT event_id, epoch_us(ts) * 10 AS game_ticks, event_type, 'user ' || user_id AS entity_unique_id, (props::json->>'k')::INT AS k FROM events")
def timeline_events(spark, d):
    from framelake.tables import ticks_of

    return table(spark, d, "events").select("event_id", ticks_of("ts").alias("game_ticks"), "event_type", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity_unique_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))


# --- without SQL: stateful, binary or many-shaped results


@query("ingest_accepted")
def ingest_accepted(spark, d):
    """Frames that both the UTC rule and a decreasing clock let in, in order of arrival, with their times, markers and chunks."""
    from framelake.streaming.ingest import accept_batch

    rows = table(spark, d, "match_states").groupBy("replay_id", "frame_index").agg(F.min("arrived_at").alias("at"), F.min("time_remaining").cast("double").alias("game_time"), F.min("utc_ticks").alias("utc_ticks"))
    arrival = F.unix_micros(F.col("at").cast("timestamp")) * 1024 + F.col("frame_index") % 1024
    clocked = rows.select("replay_id", F.col("frame_index").cast("bigint").alias("source_frame"), "game_time", "utc_ticks", arrival.alias("arrival"))
    return accept_batch(clocked, 40, time_filter="decreasing", increasing=False)


@query("bone_pack_roundtrip", f"""
WITH {_P}, q AS (SELECT replay_id, coalesce(abs(position.x) <= 100 AND abs(position.y) <= 100 AND abs(position.z) <= 100, false) AS inside FROM p WHERE position IS NOT NULL),
n AS (SELECT replay_id, count_if(inside)::BIGINT AS n, count_if(NOT inside)::BIGINT AS n_outside FROM q GROUP BY ALL)
SELECT replay_id, n AS n_inside, n_outside, n AS n_fine, n AS n_coarse, n AS n_turned, n AS n_scaled FROM n
""")
def bone_pack_roundtrip(spark, d):
    """Per recording, transforms that went through 16 bytes in either layout and came back within a code's width.

    Positions inside the settings' range (n_outside are the others), turned where the velocity points, scaled by health.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from framelake.functions import bones

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine, coarse = bones.BoneSettings(-100.0, 200.0, fine_position=True), bones.BoneSettings(-100.0, 200.0, 0.0, 10.0)
        for batch in batches:
            number = lambda c: batch[c].to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            x = np.stack([number(c) for c in "xyz"], axis=1)
            inside = (np.abs(x) <= 100).all(axis=1)
            here = np.where(inside[:, None], x, 0.0)
            half = np.nan_to_num(np.arctan2(number("vx"), number("vz"))) / 2
            q = np.stack([np.sin(half) * 0.6, np.sin(half) * 0.8, np.zeros(len(x)), np.cos(half)], axis=1)
            scale = np.clip(1 + np.nan_to_num(number("health")) / 20, 0.5, 9.5)[:, None] * np.array([1.0, 0.5, 1.0])
            one, two = (bones.unpack(bones.pack(here, q, scale, s), s) for s in (fine, coarse))
            near = lambda a, b, most: (np.abs(a - b) <= most).all(axis=1)
            told = [inside, ~inside, near(one[0], here, 2e-4), near(two[0], here, 2e-3), np.abs((one[1] * q).sum(axis=1)) > 1 - 1e-6, near(two[2], scale, 0.02)]
            cells = [told[0], told[1], *[t & inside for t in told[2:]]]
            yield pa.RecordBatch.from_arrays([batch["replay_id"], *[pa.array(c) for c in cells]], names=["replay_id", *names])

    names = ["n_inside", "n_outside", "n_fine", "n_coarse", "n_turned", "n_scaled"]
    rows = players(spark, d).where(F.col("position").isNotNull()).select("replay_id", "position.*", F.col("velocity.x").alias("vx"), F.col("velocity.z").alias("vz"), F.col("health").cast("double").alias("health"))
    told = rows.mapInArrow(walk, "replay_id string, " + ", ".join(f"{n} boolean" for n in names))
    return told.groupBy("replay_id").agg(*[F.count_if(n).alias(n) for n in names])


_PLAYER_SCHEMA = '{"version": "1.0.0", "buckets": ["entity"], "property_mapping": [{"struct": "Player", "values": [{"name": "name", "typeId": "String"}, {"name": "team", "typeId": "Int32"}, {"name": "score", "typeId": "Int32"}, {"name": "deaths", "typeId": "Int32"}, {"name": "health", "typeId": "Float"}, {"name": "position", "typeId": "Vector"}]}]}'


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """The last delivered whole body of each studio's version."""
    from framelake.operators.drift import version_parts

    files = table(spark, d, "schema_files").where(F.try_parse_json("body").isNotNull())
    files = files.withColumn("version", version_parts(F.get_json_object("body", "$.version"))).where(F.col("version").isNotNull())
    return files.groupBy("studio_id", "version").agg(F.max_by("body", F.struct("delivered_at", "file_id")).alias("body"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
