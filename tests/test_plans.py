"""Every registered query with SQL agrees with DuckDB on the smallest tables; all others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import canonical

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = canonical(got).astype(str), canonical(want).astype(str)
    for c in a.columns:
        assert (a[c].replace({"<NA>": "None", "nan": "None"}) == b[c].replace({"<NA>": "None", "nan": "None"})).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_shapes_of_found(spark, data):
    shapes = {
        "p1_found": "table_name string, replay_id string, record_id string, ref_id string, reason string",
        "p2_found": "studio_id string, version string, struct_name string, field_name string, change string",
        "p3_found": "frame_id bigint, node string, path string",
        "p4_found": "replay_id string, sequence_id string, first_frame int, last_frame int",
        "p5_found": "replay_id string, frame_index int, unique_id string, change string",
        "p6_found": "replay_id string, unique_id string, frame_index int, field string",
    }
    for name, shape in shapes.items():
        assert ", ".join(f"{c} {t}" for c, t in QUERIES[name](spark, data).dtypes) == shape, name


def test_nested_paths_against_brute_force(spark, data):
    import json

    want = set()

    def walk(frame_id, node, value, place):
        for key, v in value.items():
            name = key[0].lower() + key[1:] if key != "MatchState" else "match_state"
            if name not in ("players", "loadout", "mods", "projectiles", "hits", "match_state"):
                continue
            if isinstance(v, str):
                try:
                    v = json.loads(v)
                except ValueError:
                    continue
            at = f"{node}.{name}" if node else name
            for i, e in enumerate(v if isinstance(v, list) else [] if v is None else [v]):
                if e is not None:
                    own = f"{place}/{i}" if place else str(i)
                    want.add((frame_id, at, own))
                    walk(frame_id, at, e, own)

    for r in spark.read.parquet(f"{data}/frame_docs.parquet").collect():
        try:
            body = json.loads(r.body)
        except (TypeError, ValueError):
            continue
        while "frame" in body or "data" in body:
            body = body.get("frame") or body.get("data")
        walk(r.frame_id, "", body, "")
    got = [tuple(r) for r in QUERIES["p3_found"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
