"""Queries of the general data-preparation operators (p1 to p6), with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import drift, shred
from framelake.operators.orphans import find_orphans, orphan_report
from framelake.operators.runs import collapse_runs
from framelake.operators.snapshots import snapshot_changes
from framelake.operators.spikes import implausible
from framelake.tables import clean_id, month_of_ticks, table, ticks_of

Query = Callable[[SparkSession, str], DataFrame]


# --- p1: references to players who are not registered at that moment


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references with their earliest moment; combined before the shuffle, so repeats cost nothing."""
    states = table(spark, d, "player_states").groupBy("replay_id", clean_id("unique_id").alias("ref_id")).agg(F.min("utc_ticks").alias("moment"))
    shots = table(spark, d, "projectiles").groupBy("replay_id", clean_id("unique_id").alias("record_id"), clean_id("owner_id").alias("ref_id")).agg(F.min("utc_ticks").alias("moment"))
    shape = ["table_name", "replay_id", "record_id", "ref_id", "moment"]
    states = states.withColumns({"table_name": F.lit("player_states"), "record_id": F.col("ref_id")}).select(shape)
    return states.unionByName(shots.withColumn("table_name", F.lit("projectiles")).select(shape))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    register = table(spark, d, "roster").select(clean_id("unique_id").alias("ref_id"), ticks_of("registered_at").alias("valid_from"), ticks_of("deleted_at").alias("valid_to"))
    return find_orphans(_references(spark, d), register, ["ref_id"], match="simple", moment="moment", valid_from="valid_from", valid_to="valid_to")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "replay_id", "record_id", "ref_id", "reason")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d).withColumn("month", month_of_ticks("moment")), ["table_name", "month"])


def p1_composite(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, team) under which players appear and which no row of the roster has, on those of the three that are given."""
    own = [clean_id("unique_id").alias("unique_id"), F.nullif(F.trim("name"), F.lit("")).alias("name"), "team"]
    refs = table(spark, d, "player_states").select(own).distinct()
    keys = ["unique_id", "name", "team"]
    return find_orphans(refs, table(spark, d, "roster").select(own), keys, match="partial").select(*keys, "reason")


_P1 = """
WITH refs AS (
  SELECT 'player_states' AS table_name, replay_id, lower(trim(unique_id)) AS record_id, lower(trim(unique_id)) AS ref_id, min(utc_ticks) AS moment
  FROM player_states GROUP BY ALL
  UNION ALL
  SELECT 'projectiles', replay_id, lower(trim(unique_id)), lower(trim(owner_id)), min(utc_ticks) FROM projectiles GROUP BY ALL),
reg AS (SELECT lower(trim(unique_id)) AS id, epoch_us(registered_at) * 10 AS a, epoch_us(deleted_at) * 10 AS b FROM roster),
judged AS (
  SELECT r.*, count(g.id) AS n, coalesce(bool_or(g.a <= r.moment AND (g.b IS NULL OR r.moment < g.b)), false) AS ok, min(g.a) AS a
  FROM refs r LEFT JOIN reg g ON r.ref_id = g.id WHERE r.ref_id <> '' GROUP BY ALL),
found AS (
  SELECT table_name, replay_id, record_id, ref_id, moment, CASE WHEN n = 0 THEN 'missing' WHEN a <= moment THEN 'deleted' ELSE 'late' END AS reason
  FROM judged WHERE NOT ok)
"""
P1_SQL = {
    "p1_composite": """
WITH r AS (SELECT DISTINCT nullif(lower(trim(unique_id)), '') AS unique_id, nullif(trim(name), '') AS name, team FROM player_states), g AS (SELECT nullif(lower(trim(unique_id)), '') AS u, nullif(trim(name), '') AS n, team AS t FROM roster)
SELECT unique_id, name, team, 'missing' AS reason FROM r WHERE coalesce(unique_id, name, team::VARCHAR) IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM g WHERE (unique_id IS NULL OR u = unique_id) AND (name IS NULL OR n = name) AND (team IS NULL OR t = team))
""",
    "p1_found": _P1 + "SELECT table_name, replay_id, record_id, ref_id, reason FROM found",
    "p1_report": _P1 + "SELECT table_name, strftime(make_timestamp(moment // 10), '%Y-%m') AS month, reason, count(*) AS n_orphans FROM found GROUP BY ALL",
}


# --- p2: schemas that drift


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(drift.schema_fields(table(spark, d, "schema_files")))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "raw_records"), table(spark, d, "schema_files"))


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    return drift.filled(p2_table(spark, d))


def p2_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(drift.schema_fields(table(spark, d, "schema_files")))


# --- p3: nested frames as flat tables

FRAME_MARKS = ("players", "projectiles", "match_state", "frame_index")


def _graph(docs: DataFrame) -> shred.Graph:
    return shred.infer_graph(docs, "body", FRAME_MARKS, own_tables=["match_state"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "frame_docs")
    graph = _graph(docs)
    kinds = ["players", "players.loadout", "players.loadout.mods", "projectiles", "projectiles.hits", "match_state"]
    return shred.shred(docs, "frame_id", "body", graph, FRAME_MARKS, with_fields=False, nodes=kinds).select("frame_id", "node", "path")


def _p3_table(node: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "frame_docs")
        graph = _graph(docs)
        return shred.flat_table(shred.shred(docs, "frame_id", "body", graph, FRAME_MARKS), "frame_id", graph, node)

    return query


def _entries_sql(j: str) -> str:
    """The entries of a list, which may be one object or JSON text."""
    inner = f"({j}->>'$')::json"
    return f"""CASE json_type({j}) WHEN 'ARRAY' THEN from_json({j}, '["json"]') WHEN 'OBJECT' THEN [{j}] WHEN 'VARCHAR' THEN CASE WHEN json_valid({j}->>'$') THEN CASE json_type({inner}) WHEN 'ARRAY' THEN from_json({inner}, '["json"]') WHEN 'OBJECT' THEN [{inner}] END END END"""


def _level_sql(name: str, of: str, keys: tuple[str, str], root: bool = False) -> str:
    """A level of entries ``e`` with their path and their parent's."""
    at = "i::VARCHAR" if root else "path || '/' || i"
    path = "NULL::VARCHAR" if root else "path"
    return f"""{name}_l AS (SELECT frame_id, {path} AS path, coalesce(e->'{keys[0]}', e->'{keys[1]}') AS j FROM {of}), {name}_m AS (SELECT frame_id, path, {_entries_sql("j")} AS l FROM {name}_l),
{name}_n AS (SELECT frame_id, path, l, unnest(range(len(l))) AS i FROM {name}_m), {name} AS (SELECT frame_id, coalesce(path, '') AS parent_path, {at} AS path, l[i + 1] AS e FROM {name}_n WHERE json_type(l[i + 1]) <> 'NULL')"""


_P3 = f"""
WITH b AS (SELECT frame_id, CASE WHEN json_valid(body) THEN body::json END AS b FROM frame_docs),
r AS (SELECT frame_id, coalesce(b->'data'->'frame', b->'frame', b->'data', b) AS e FROM b WHERE b IS NOT NULL),
{_level_sql("players", "r", ("players", "Players"), True)},
{_level_sql("loadout", "players", ("loadout", "Loadout"))},
{_level_sql("mods", "loadout", ("mods", "Mods"))},
{_level_sql("projectiles", "r", ("projectiles", "Projectiles"), True)},
{_level_sql("hits", "projectiles", ("hits", "Hits"))},
{_level_sql("match_state", "r", ("match_state", "MatchState"), True)}
"""
_NODES = {"players": "players", "loadout": "players.loadout", "mods": "players.loadout.mods", "projectiles": "projectiles", "hits": "projectiles.hits", "match_state": "match_state"}


def _cells_sql(columns: str) -> str:
    return ", ".join(f"(e->>'{c}')::{kind} AS {c}" for c, kind in (c.split() for c in columns.split(", ")))


def _point_sql(name: str) -> str:
    parts = []
    for level in ("players", "projectiles"):
        point = f"(e->'{name}')"
        cells = ", ".join(f"(CASE json_type{point} WHEN 'ARRAY' THEN {point}->>{i} ELSE {point}->>'{a}' END)::DOUBLE AS {a}" for i, a in enumerate("xyz"))
        parts.append(f"SELECT frame_id, '{level}.{name}' AS node, path || '/0' AS path, '{level}' AS parent_node, path AS parent_path, {cells} FROM {level} WHERE json_type{point} IN ('ARRAY', 'OBJECT')")
    return _P3 + " UNION ALL ".join(parts)


P3_SQL = {
    "p3_found": _P3 + " UNION ALL ".join(f"SELECT frame_id, '{node}' AS node, path FROM {level}" for level, node in _NODES.items()),
    "p3_frames": _P3 + f"SELECT frame_id, '' AS path, NULL::VARCHAR AS parent_path, {_cells_sql('frame_index BIGINT, game_time DOUBLE, utc_ticks BIGINT')} FROM r",
    "p3_players_loadout_mods": _P3 + f"SELECT frame_id, path, parent_path, {_cells_sql('mod VARCHAR, level BIGINT')} FROM mods",
    "p3_projectiles": _P3 + f"SELECT frame_id, path, parent_path, {_cells_sql('unique_id VARCHAR, owner_id VARCHAR, damage DOUBLE, type VARCHAR')} FROM projectiles",
    "p3_projectiles_hits": _P3 + f"SELECT frame_id, path, parent_path, {_cells_sql('target_id VARCHAR, damage BIGINT')} FROM hits",
    "p3_match_state": _P3 + f"SELECT frame_id, path, parent_path, {_cells_sql('score_team1 BIGINT, score_team2 BIGINT, round BIGINT, phase VARCHAR, time_remaining DOUBLE')} FROM match_state",
    "p3_position": _point_sql("position"),
    "p3_velocity": _point_sql("velocity"),
}


# --- p4: stretches of one state


def _player_runs(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "player_states").where(F.col("health").isNotNull())
    states = states.select("replay_id", clean_id("unique_id").alias("sequence_id"), "frame_index", "is_alive", F.col("health").cast("double").alias("health"), "utc_ticks", "arrived_at")
    near = lambda prev, cur: prev("is_alive").eqNullSafe(cur("is_alive")) & (F.round(F.abs(prev("health") - cur("health")), 5) <= 0.5)
    runs = collapse_runs(states, ["replay_id", "sequence_id"], "frame_index", ["is_alive", "health"], near, [F.col("arrived_at")], "utc_ticks")
    return runs.withColumn("state", F.concat_ws(" ", F.when(F.col("state_is_alive"), "alive").otherwise("dead"), F.round("state_health", 2).cast("string")))


def _phase_runs(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "match_states").where(F.col("phase").isNotNull())
    phase = F.regexp_replace(F.lower("phase"), r"[\s_\-]+", "")
    states = states.select("replay_id", F.lit("match_state").alias("sequence_id"), "frame_index", phase.alias("phase"), "utc_ticks", "arrived_at")
    same = lambda prev, cur: prev("phase") == cur("phase")
    runs = collapse_runs(states, ["replay_id", "sequence_id"], "frame_index", ["phase"], same, [F.col("arrived_at")], "utc_ticks")
    return runs.withColumn("state", F.col("state_phase"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    shape = ["replay_id", "sequence_id", F.col("first").alias("first_frame"), F.col("last").alias("last_frame"), F.col("n_events").alias("n_frames"), (F.col("duration") / 1e7).alias("duration_s"), "state"]
    return _player_runs(spark, d).select(shape).unionByName(_phase_runs(spark, d).select(shape))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_runs(spark, d).where(F.col("n_frames") >= 2).select("replay_id", "sequence_id", "first_frame", "last_frame")


_P4 = """
WITH a AS (
  SELECT replay_id, lower(trim(unique_id)) AS sequence_id, frame_index AS f, any_value(is_alive) AS s, any_value(health::double) AS h, any_value(NULL::VARCHAR) AS p, any_value(utc_ticks) AS t
  FROM player_states WHERE health IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT replay_id, 'match_state', frame_index, any_value(NULL::boolean), any_value(NULL::double), any_value(regexp_replace(lower(phase), '[\\s_\\-]+', '', 'g')), any_value(utc_ticks)
  FROM match_states WHERE phase IS NOT NULL GROUP BY ALL),
b AS (
  SELECT *, CASE WHEN lag(f) OVER w IS NULL OR lag(s) OVER w IS DISTINCT FROM s OR lag(p) OVER w IS DISTINCT FROM p OR round(abs(lag(h) OVER w - h), 5) > 0.5 THEN 1 ELSE 0 END AS c
  FROM a WINDOW w AS (PARTITION BY replay_id, sequence_id ORDER BY f)),
c AS (SELECT *, sum(c) OVER (PARTITION BY replay_id, sequence_id ORDER BY f) AS r FROM b),
d AS (SELECT replay_id, sequence_id, min(f) AS first_frame, max(f) AS last_frame, count(*) AS n_frames, (max(t) - min(t)) / 1e7 AS duration_s, arg_min((s, h, p), f) AS x FROM c GROUP BY replay_id, sequence_id, r)
"""
P4_SQL = {
    "p4_found": _P4 + "SELECT replay_id, sequence_id, first_frame, last_frame FROM d WHERE n_frames >= 2",
    "p4_runs": _P4 + "SELECT replay_id, sequence_id, first_frame, last_frame, n_frames, duration_s, coalesce(x[3], CASE WHEN x[1] THEN 'alive ' ELSE 'dead ' END || round(x[2], 2)) AS state FROM d",
}


# --- p5: changes between snapshots


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshot_changes(
        table(spark, d, "keyframes"), ["replay_id"], "frame_index", "delivered_at", "players",
        key=F.lower(F.trim(F.col("e.unique_id"))), exact=["name", "team", "is_alive", "score", "deaths"], close={"health": 0.001, "armor": 0.001},
    )
    return changes.select("replay_id", "frame_index", F.col("key").alias("unique_id"), "change")


P5_SQL = {
    "p5_found": """
WITH k AS (SELECT * FROM keyframes WHERE players IS NOT NULL QUALIFY row_number() OVER (PARTITION BY replay_id, frame_index ORDER BY delivered_at DESC) = 1),
o AS (SELECT replay_id, frame_index, players, lag(frame_index) OVER w AS f0, lead(frame_index) OVER w AS f1 FROM k WINDOW w AS (PARTITION BY replay_id ORDER BY frame_index)),
e AS (SELECT replay_id, frame_index, f0, f1, unnest(players) AS p FROM o),
r AS (SELECT DISTINCT replay_id, frame_index, f0, f1, lower(trim(p.unique_id)) AS u, p.name AS name, p.team AS team, p.health::double AS h, p.armor::double AS a, p.is_alive AS al, p.score AS sc, p.deaths AS de FROM e WHERE trim(p.unique_id) <> ''),
n AS (SELECT * FROM r WHERE f0 IS NOT NULL),
p AS (SELECT * FROM r WHERE f1 IS NOT NULL)
SELECT coalesce(n.replay_id, p.replay_id) AS replay_id, coalesce(n.frame_index, p.f1) AS frame_index, coalesce(n.u, p.u) AS unique_id,
  CASE WHEN p.u IS NULL THEN 'added' WHEN n.u IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN p ON n.replay_id = p.replay_id AND n.frame_index = p.f1 AND n.u = p.u
WHERE p.u IS NULL OR n.u IS NULL OR n.name IS DISTINCT FROM p.name OR n.team IS DISTINCT FROM p.team OR n.al IS DISTINCT FROM p.al OR n.sc IS DISTINCT FROM p.sc
  OR n.de IS DISTINCT FROM p.de OR (n.h IS NULL) <> (p.h IS NULL) OR abs(n.h - p.h) > 0.001 OR (n.a IS NULL) <> (p.a IS NULL) OR abs(n.a - p.a) > 0.001
"""
}


# --- p6: implausible readings


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "player_states"))


def p6_impossible(spark: SparkSession, d: str) -> DataFrame:
    """The readings that the bounds alone find."""
    return p6_reasons(spark, d).where(F.col("reason") == "impossible").select("replay_id", "unique_id", "frame_index", "field")


P6_SQL = {
    "p6_impossible": """
WITH p AS (SELECT DISTINCT replay_id, lower(trim(unique_id)) AS unique_id, frame_index, position, velocity, health::DOUBLE AS health FROM player_states)
SELECT replay_id, unique_id, frame_index, 'position' AS field FROM p WHERE NOT (isfinite(position.x) AND isfinite(position.y) AND isfinite(position.z) AND greatest(abs(position.x), abs(position.y), abs(position.z)) <= 60)
UNION ALL SELECT replay_id, unique_id, frame_index, 'velocity' FROM p WHERE NOT (isfinite(velocity.x) AND isfinite(velocity.y) AND isfinite(velocity.z))
UNION ALL SELECT replay_id, unique_id, frame_index, 'health' FROM p WHERE NOT (isfinite(health) AND health BETWEEN 0 AND 100)
"""
}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_reasons(spark, d).select("replay_id", "unique_id", "frame_index", "field")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "p1_found": p1_found, "p1_report": p1_report, "p1_composite": p1_composite,
        "p2_found": p2_found, "p2_table": p2_table, "p2_filled": p2_filled, "p2_alternatives": p2_alternatives,
        "p3_found": p3_found,
        "p4_found": p4_found, "p4_runs": p4_runs,
        "p5_found": p5_found,
        "p6_found": p6_found, "p6_reasons": p6_reasons, "p6_impossible": p6_impossible,
    }
    for node in ("", "players", "players.loadout", "players.loadout.mods", "projectiles", "projectiles.hits", "match_state", "position", "velocity"):
        out[f"p3_{(node or 'frames').replace('.', '_')}"] = _p3_table(node)
    return out


def oracle_sql() -> dict[str, str]:
    return {**P1_SQL, **drift.ORACLE, **P3_SQL, **P4_SQL, **P5_SQL, **P6_SQL}
