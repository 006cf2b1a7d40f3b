import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake import schema as S
from framelake.commands import Session, tokens
from framelake.frames import frame_context, frame_range
from framelake.functions import arrays, bones, text
from framelake.functions import time as ticks
from framelake.operators import diff, mutate, timeline
from framelake.operators.analysis import lifetimes, value_spans
from framelake.operators.predicates import matches, search
from framelake.sinks.exports import lifetime_table, number_text, span_table, unique_table, write_csv
from framelake.sources import codec
from framelake.sources.binary import BinaryCursor, scan_binary
from framelake.sources.loaders import from_json_text, from_records, json_recording, map_key
from framelake.sources.replay import RecordingWriter, ReplayError, ReplayFile, ReplayReader, content_hashes, deflate, inflate, metadata, pack, read_replays, unpack, write_replays
from framelake.streaming.ingest import Clock, RecordPipeline, accept_batch, accept_stream, step

SCHEMA = json.dumps(
    {
        "version": "1.0.0", "buckets": ["entity", "bones"],
        "property_mapping": [
            {"struct": "Player", "values": [{"name": n, "typeId": t} for n, t in (("UniqueID", "String"), ("Name", "String"), ("Team", "Int32"), ("Health", "Float"), ("Armor", "Float"), ("Position", "Vector"), ("Rotation", "Quat"), ("IsAlive", "Bool"), ("Score", "Int32"))]},
            {"struct": "", "values": []},
            {"struct": "Item", "values": [{"name": "Tags", "typeId": "String", "containerType": "array"}, {"name": "Sizes", "typeId": "Int64", "containerType": "Array"}, {"name": "Owner", "typeId": "Struct", "structType": "Player"}, {"name": "Parts", "typeId": "Struct", "structType": "Part", "containerType": "array"}, {"name": "Bag", "typeId": "Struct", "structType": "Part", "containerType": "map", "keyId": "String"}, {"name": "Range", "typeId": "FloatRange"}, {"name": "Mode", "typeId": "Enum"}]},
            {"struct": "Part", "values": [{"name": "Weight", "typeId": "Double"}, {"name": "Flag", "typeId": "Int8"}]},
        ],
    }
)


# --- schema


def test_registry():
    r = S.SchemaRegistry.from_json(SCHEMA)
    assert r.struct_names() == ["Player", "Item", "Part"] and r.type_id("Item") == 1 and r.type_id("none") == -1
    assert (r.slot("Player", "Name"), r.slot("Player", "Score"), r.slot("Player", "none")) == (1, 1, -1)
    assert r.name_at(0, "Float", "None", 1) == "Armor" and r.name_at(1, "Int32", "None", 0) == "Mode"
    assert r.properties("Part") == ["Weight", "Flag"] and r.has_property("Part", "Flag")
    assert r.field("Item", "Bag").container == "Map" and S.SchemaRegistry.from_json(SCHEMA, strict=True).field("Item", "Sizes").container == "None"
    compile(S.accessor_source(r), "made", "exec")
    for bad in ("", "[]", "{}", '{"property_mapping": 1}'):
        with pytest.raises(ValueError):
            S.SchemaRegistry.from_json(bad)


def test_recursive_struct_is_refused():
    r = S.SchemaRegistry.from_json('{"property_mapping": [{"struct": "A", "values": [{"name": "a", "typeId": "Struct", "structType": "A"}]}]}')
    with pytest.raises(ValueError):
        r.columns()


def test_validation_and_evolution():
    bad = {"property_mapping": [{"struct": "A", "values": [{"name": "", "typeId": "int"}, {"name": "x", "typeId": "what"}, {"name": "x", "typeId": ""}, {"name": "m", "typeId": "int", "containerType": "map"}, {"name": "s", "typeId": "struct"}, {"name": "c", "typeId": "int", "containerType": "odd"}]}, {"struct": "A"}, {"struct": ""}]}
    kinds = {i.kind for i in S.validate(json.dumps(bad))}
    assert kinds == {"field_name", "type_token", "duplicate_field", "type", "key", "struct_type", "container", "duplicate_struct", "struct_name"}
    assert S.is_valid(SCHEMA.replace('{"struct": "", "values": []}, ', "")) and not S.is_valid("{")
    old = '{"property_mapping": [{"struct": "A", "values": [{"name": "a", "typeId": "int"}, {"name": "b", "typeId": "int"}, {"name": "m", "typeId": "float", "meta": {"version": 3}}]}, {"struct": "B"}]}'
    new = '{"property_mapping": [{"struct": "A", "values": [{"name": "b", "typeId": "int"}, {"name": "n", "typeId": "bool"}, {"name": "m", "typeId": "float", "meta": {"version": 4}}]}, {"struct": "C"}]}'
    got = {(i.kind, i.struct, i.field) for i in S.evolution(S.SchemaRegistry.from_json(old), S.SchemaRegistry.from_json(new))}
    assert got == {("struct_added", "C", ""), ("struct_removed", "B", ""), ("field_added", "A", "n"), ("field_removed", "A", "a"), ("field_changed", "A", "b"), ("field_meta_changed", "A", "m")}
    stamped = json.loads(S.next_generation(old, new))["property_mapping"][0]["values"]
    assert {f["name"]: f["meta"]["version"] for f in stamped} == {"b": 5, "n": 5, "m": 5}


# --- the container


def rows(n=120, replay="r1"):
    return [
        {"replay_id": replay, "frame_index": i, "bucket_index": 0, "unique_id": "player_0", "entity_type_id": 0, "game_time_ticks": i * 166_666, "created_utc_ticks": 1000 + i * 166_666, "Team": 1, "Score": i, "Health": 100.0 - i, "Position": {"x": float(i), "y": 0.0, "z": 0.0}}
        for i in range(n)
    ]


@pytest.mark.parametrize("backend", ["flatbuffers", "protobuf"])
def test_round_trip(spark, tmp_path, backend):
    shape = "replay_id string, frame_index int, bucket_index int, unique_id string, entity_type_id int, game_time_ticks long, created_utc_ticks long, Team int, Score int, Health float, Position struct<x:double,y:double,z:double>"
    df = spark.createDataFrame([Row(**r) for r in rows()] + [Row(**r) for r in rows(3, "r2")], T._parse_datatype_string(shape))
    write_replays(df, str(tmp_path / "out"), SCHEMA, backend, max_frames=40)
    back = read_replays(spark, str(tmp_path / "out"))
    got = {r.frame_index: r for r in back.where("replay_id = 'r1'").collect()}
    assert len(got) == 120 and back.count() == 123
    for i in (0, 60, 119):
        assert (got[i].Score, got[i].Health, got[i].Position.x, got[i].type_name, got[i].created_utc_ticks, got[i].bucket_name) == (i, 100.0 - i, float(i), "Player", 1000 + i * 166_666, "entity")
    m = metadata(spark, str(tmp_path / "out"))
    assert [tuple(r)[1:4] for r in m["chunks"].where("replay_id = 'r1'").orderBy("chunk_index").collect()] == [(0, 0, 39), (1, 40, 79), (2, 80, 119)]
    assert m["header"].first().backend == backend
    assert back.where("frame_index = 50 and replay_id = 'r1'").count() == 1
    registry = S.SchemaRegistry.from_json(SCHEMA)
    reader = ReplayReader({"path": str(tmp_path / "out"), "frames": "50,50"}, registry.columns(), registry.text)
    opened = [b for part in reader.partitions() for b in reader.read(part)]
    assert [set(b["chunk_index"].to_pylist()) for b in opened] == [{1}]  # one chunk of four is opened
    hashes = content_hashes(back.where("frame_index < 3 and replay_id = 'r1'"), SCHEMA)
    assert {r.content_hash for r in hashes.collect()} == {got[i].content_hash for i in range(3)}


@pytest.mark.parametrize("encode", [(codec.encode_tables, codec.decode_tables), (codec.encode_tagged, codec.decode_tagged)])
def test_nested_values_survive(encode):
    r = S.SchemaRegistry.from_json(SCHEMA)
    values = {"Tags": ["a", "", "ü"], "Sizes": [1, -2], "Owner": {"Name": "N", "Team": 3}, "Parts": [{"Weight": 1.5, "Flag": 7}, {"Weight": 2.5, "Flag": -1}], "Bag": [{"key": "k", "value": {"Weight": 9.0, "Flag": 1}}], "Range": {"min": 0.5, "max": 1.5, "value_normalized": 0.25}, "Mode": 4}
    entity = pack(values, r, 1)
    back = unpack(encode[1]("PropertyContainer", encode[0]("PropertyContainer", entity)), r, "Item")
    assert back["Owner"]["Name"] == "N" and back["Owner"]["Team"] == 3
    assert {k: back[k] for k in values if k != "Owner"} == {k: v for k, v in values.items() if k != "Owner"}


def test_hash_tells_what_it_should():
    h = codec.content_hash
    assert h({"type_id": 1, "int32_arrays": {"data": [1, 2, 3], "offsets": [0, 2]}}) != h({"type_id": 1, "int32_arrays": {"data": [1, 2, 3], "offsets": [0, 1]}})
    assert h({"float_properties": [0.0]}) != h({"float_properties": [-0.0]}) and h({"float_properties": [math.nan]}) == h({"float_properties": [math.nan]})


def test_type_sort_and_ranges(tmp_path):
    w = RecordingWriter(str(tmp_path / "a.replay"), SCHEMA, max_frames=1)
    for f in range(3):
        for t, u in ((1, "id_b"), (0, "id_a"), (1, "id_c"), (-1, "odd")):
            w.add_row({"frame_index": f, "unique_id": u, "entity_type_id": t})
    w.close()
    w.close()
    r = ReplayFile.open(str(tmp_path / "a.replay"))
    assert [(c["chunk_index"], c["start_frame"], c["end_frame"]) for c in r.seek_table()] == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
    bucket = r.chunk(r.seek_table()[1])[0]["data"][0]
    assert bucket["unique_ids"] == ["odd", "id_a", "id_b", "id_c"] and bucket["type_ranges"] == [{"start_index": 1, "count": 1}, {"start_index": 2, "count": 2}]
    assert r.header["replay_uuid"] == "uuid_placeholder"


def test_torn_files(spark, tmp_path):
    path = tmp_path / "good.replay"
    w = RecordingWriter(str(path), SCHEMA, replay_id="x", max_frames=10)
    for r in rows(30):
        w.add_row(r)
    w.close()
    good = path.read_bytes()
    for i, bad in enumerate((b"", b"XXXX1234", good[:20], good[: len(good) // 2], good[:-3], good[:8] + b"\xff" * 50 + good[58:])):
        torn = tmp_path / f"torn{i}.replay"
        torn.write_bytes(bad)
        with pytest.raises((ReplayError, ValueError)):
            r = ReplayFile.open(str(torn))
            r.registry()
            r.chunk(r.seek_table()[0])
    assert read_replays(spark, str(tmp_path), "PERMISSIVE").count() == 30
    with pytest.raises(Exception, match="replay"):
        read_replays(spark, str(tmp_path)).count()
    assert inflate(deflate(b"x" * 2000)) == b"x" * 2000 and deflate(b"x" * 100) == b"x" * 100


def test_any_session_reads_recordings(spark, tmp_path):
    """Also one that keeps filters from Python sources."""
    w = RecordingWriter(str(tmp_path / "a.replay"), SCHEMA, replay_id="a", max_frames=10)
    for r in rows(30):
        w.add_row(r)
    w.close()
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    try:
        for on in ("false", "true"):
            spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
            back = read_replays(spark, f"file:{tmp_path}")
            assert back.where("frame_index = 25").count() == 1 and back.count() == 30
            assert sorted(r.frame_index for r in read_replays(spark, str(tmp_path), frames=(8, 11)).collect()) == [8, 9, 10, 11]
            assert read_replays(spark, str(tmp_path), chunks=(1, 1)).count() == 10
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_splits_cover_every_chunk_once(tmp_path):
    for n in (1, 40, 400):
        w = RecordingWriter(str(tmp_path / f"{n}.replay"), SCHEMA, replay_id=str(n), max_frames=3)
        for r in rows(n):
            w.add_row(r)
        w.close()
    want = sorted((p.name, c["chunk_index"]) for p in tmp_path.glob("*.replay") for c in ReplayFile.open(str(p)).seek_table())
    import framelake.sources.replay as R

    before = R.OPEN_BYTES
    try:
        for least, parallelism in ((1 << 16, 1), (100, 3), (100, 64)):
            R.OPEN_BYTES = least
            made = R.splits(str(tmp_path), parallelism)
            assert sorted((os.path.basename(f.path), c["chunk_index"]) for s in made for f, c in R.chunks_in(s)) == want
            assert parallelism == 1 or len(made) > 1
    finally:
        R.OPEN_BYTES = before


def test_ids_that_look_alike_keep_their_files(spark, tmp_path):
    """Also null, blank, hidden and very long ids, twice over."""
    ids = ["a/b", "a_b", "a b", ".a", "_a", "", None, "x" * 500, "x" * 501, "%"]
    shape = "replay_id string, frame_index int, unique_id string, entity_type_id int, created_utc_ticks long, Score int"
    df = spark.createDataFrame([(i, f, "p", 0, f, n) for n, i in enumerate(ids) for f in range(2)], shape)
    for _ in range(2):
        write_replays(df, str(tmp_path / "o"), SCHEMA)
        assert sorted((r.Score, r.frame_index) for r in read_replays(spark, str(tmp_path / "o")).collect()) == [(n, f) for n in range(len(ids)) for f in range(2)]
        assert len(list((tmp_path / "o").iterdir())) == len(ids)
    write_replays(df.where("replay_id = 'a/b'"), str(tmp_path / "o"), SCHEMA)
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["a%2Fb.replay"]


def test_a_failed_overwrite_keeps_the_old_files(spark, tmp_path):
    shape = "replay_id string, frame_index int, unique_id string, entity_type_id int, created_utc_ticks long, Score int"
    write_replays(spark.createDataFrame([("a", 0, "p", 0, 0, 1)], shape), str(tmp_path / "o"), SCHEMA)
    bad = spark.createDataFrame([("a", 0, "p", 0, 0, 2), ("b", 0, "p", 0, 0, 3)], shape).withColumn("Score", F.when(F.col("replay_id") == "b", F.raise_error(F.lit("no"))).otherwise(F.col("Score")).cast("int"))
    with pytest.raises(Exception, match="no"):
        write_replays(bad, str(tmp_path / "o"), SCHEMA)
    assert [r.Score for r in read_replays(spark, str(tmp_path / "o")).collect()] == [1]


def test_chunks_are_bounded_by_bytes(tmp_path):
    w = RecordingWriter(str(tmp_path / "a.replay"), SCHEMA, replay_id="a", max_bytes=700)
    for r in rows(20):
        w.add_row(r)
    w.close()
    r = ReplayFile.open(str(tmp_path / "a.replay"))
    sizes = [c["end_frame"] - c["start_frame"] + 1 for c in r.seek_table()]
    assert sum(sizes) == 20 and len(sizes) > 3 and all(len(codec.encode_tables("Chunk", {"frames": r.chunk(c)})) <= 900 for c in r.seek_table())


def test_empty_recording(spark, tmp_path):
    RecordingWriter(str(tmp_path / "e.replay"), SCHEMA).close()
    assert read_replays(spark, str(tmp_path)).count() == 0
    assert metadata(spark, str(tmp_path))["footer"].first().total_frames == 0


# --- commands


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rec") / "a.replay"
    w = RecordingWriter(str(path), SCHEMA, replay_id="a")
    for r in rows(10):
        w.add_row(r)
        if r["frame_index"] > 4:
            w.add_row({**r, "unique_id": "player_1", "Team": 2})
    w.close()
    s = Session(spark)
    assert json.loads(s.run("info"))["status"] == "error"
    assert json.loads(s.run(f'open "{path}"'))["data"]["total_frames"] == 10
    return s


def test_commands(session):
    ask = lambda line: json.loads(session.run(line))
    assert ask("frame 7")["data"] == {"frame": 7, "buckets": 1, "entities": 2}
    assert ask("frame 70")["status"] == "error"
    assert [e["unique_id"] for e in ask("entities ENTITY")["data"]] == ["player_0", "player_1"]
    assert ask("buckets")["data"][0] == {"index": 0, "name": "entity", "entities": 2}
    assert ask("property entity player_1 Team")["data"]["value"] == 2 and ask("entity 0 1")["data"]["properties"]["Team"] == 2
    assert "Team" in ask("property entity player_1 Taem")["hint"]
    assert [r["unique_id"] for r in ask("search Team == 2")["data"]] == ["player_1"] and "Team" in ask("search Tean == 2")["hint"]
    assert [r["value"] for r in ask("track entity player_0 Score 1 9 4")["data"]] == [1, 5, 9]
    d = ask("diff 4 6")["data"]
    assert (d["added"], d["removed"], d["changed"]) == (1, 0, [{"unique_id": "player_0", "properties": ["Health", "Position", "Score"], "n_ops": 3, "type_name": "Player"}])
    assert len(d["operations"]) == 4
    assert ask("entity entity --index 1")["data"]["unique_id"] == "player_1" and ask("property entity --id player_1 Team")["data"]["value"] == 2
    assert ask("entity entity --index 9")["status"] == ask("entity entity --id 1")["status"] == ask("entity entity")["status"] == "error"
    for line in ("info", "header", "footer", "schema", "chunks", "events", "types", "help"):
        assert ask(line)["status"] == "ok"
    assert "search" in ask("serach x")["hint"] and ask("frame 1 2 3")["status"] == "error" and ask("")["status"] == "error"
    assert tokens('a "b c" d""') == ["a", "b c", "d"]


def test_commands_keep_recordings_apart(spark, tmp_path):
    """Two recordings in which nothing changes, one with a type that the schema doesn't have."""
    for name, team in (("a", 1), ("b", 2)):
        w = RecordingWriter(str(tmp_path / f"{name}.replay"), SCHEMA, replay_id=name)
        for f in range(3):
            w.add_row({"frame_index": f, "unique_id": "p", "entity_type_id": 0, "Team": team})
            w.add_row({"frame_index": f, "unique_id": "odd", "entity_type_id": -1})
        w.close()
    s = Session(spark)
    ask = lambda line: json.loads(s.run(line))
    opened = ask(f"open {tmp_path}")["data"]
    assert (opened["recording"], opened["recordings"]) == ("a", ["a", "b"])
    for name, team in (("a", 1), ("b", 2)):
        assert ask(f"open {tmp_path} {name}")["data"]["recording"] == name
        assert ask("diff 0 2")["data"]["total_ops"] == 0
        assert ask("frame 1")["data"]["entities"] == 2 and ask("property entity p Team")["data"]["value"] == team
        assert ask("entity entity odd")["data"] == {"unique_id": "odd", "type_name": None, "properties": {}}
        assert len(ask("header")["data"]) == 1
    assert "did you mean a?" in ask(f"open {tmp_path} aa")["hint"]


# --- frames, spans, predicates


def test_range_and_context(spark):
    df = spark.range(5).select(F.col("id").cast("int").alias("frame_index"))
    take = lambda d: sorted(r.frame_index for r in d.collect())
    assert (take(frame_range(df, 1, 2)), take(frame_context(df, 2, 1, 1)), take(frame_context(df, 1, 9, 0)), take(frame_range(df, 99, 2))) == ([1, 2, 3], [1, 2, 3], [0, 1], [])


def test_spans_bridge_frames_without_the_bucket(spark):
    df = spark.createDataFrame([("r", 0, "a", 0, "x"), ("r", 1, "a", 0, "x"), ("r", 5, "a", 0, "x"), ("r", 6, "b", 0, None), ("r", 7, "a", 0, "y"), ("r", 7, "b", 0, None)], "replay_id string, frame_index int, unique_id string, entity_type_id int, v string")
    assert sorted((r.unique_id, r.start_frame, r.end_frame) for r in lifetimes(df).collect()) == [("a", 0, 5), ("a", 7, 7), ("b", 6, 7)]
    assert sorted((r.unique_id, str(r.value), r.start_frame, r.end_frame) for r in value_spans(df, ["v"]).collect()) == [("a", "x", 0, 5), ("a", "y", 7, 7), ("b", "None", 6, 7)]


def test_search_rules(spark):
    df = spark.createDataFrame([(1, 1.0, "x", True), (2, math.nan, None, None), (3, None, "y", False)], "i int, d double, s string, b boolean")
    hit = lambda p, op, v: sorted(r.i for r in df.where(matches(df, p, op, v)).collect())
    assert (hit("d", "!=", "1"), hit("d", "==", "nan"), hit("d", ">", "0"), hit("i", ">=", "2abc"), hit("i", "==", "abc"), hit("i", "==", "0x2")) == ([2], [], [1], [2, 3], [], [2])
    assert (hit("s", "!=", "x"), hit("s", ">", "a"), hit("b", "==", "1"), hit("b", "!=", "true"), hit("b", ">", "0")) == ([3], [], [1], [3], [])
    with pytest.raises(ValueError):
        search(df, "dd", "==", "1")


# --- diff


def test_diff_fixtures(spark):
    shape = "unique_id string, Team int, Health float, Position struct<x:double,y:double,z:double>"
    frame = lambda *r: spark.createDataFrame(list(r), shape)
    ops = lambda a, b, **k: sorted((r.unique_id, r.op, str(r.property)) for r in diff.diff_frames(a, b, ["Team", "Health", "Position"], **k).collect())
    a = frame(("p0", 1, 100.0, (0.0, 0.0, 0.0)), ("alpha", 1, 1.0, None), ("", 9, 9.0, None))
    assert ops(a, a) == []
    b = frame(("p0", 2, 75.0, (10.0, 0.0, 0.0)), ("beta", 1, 1.0, None), ("gamma", 1, 1.0, None))
    assert ops(a, b) == [("alpha", "Remove", "None"), ("beta", "Add", "None"), ("gamma", "Add", "None"), ("p0", "Replace", "Health"), ("p0", "Replace", "Position"), ("p0", "Replace", "Team")]
    near = frame(("p0", 1, 100.000001, (0.0, 1e-7, 0.0)), ("alpha", 1, 1.0, None))
    assert ops(a, near, epsilon=1e-3) == []
    assert ops(a, frame(("p0", None, 100.0, (0.0, 0.0, 0.0)), ("alpha", 1, 1.0, (1.0, 1.0, 1.0)))) == [("alpha", "Add", "Position"), ("p0", "Remove", "Team")]


def test_array_and_map_ops(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [1, 9, 9, 4, 6, 7]), ([1, 2], []), ([], [])], "a array<int>, b array<int>")
    got = [[tuple(o) for o in r[0]] for r in df.select(diff.array_ops(F.col("a"), F.col("b"), T.IntegerType())).collect()]
    assert got == [[("ReplaceRange", 1, 2), ("Replace", 4, 1), ("Add", 5, 1)], [("Remove", 0, 1), ("Remove", 1, 1)], []]
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4})], "x map<string,int>, y map<string,int>")
    assert [(o.op, o.key) for o in df.select(diff.map_ops(F.col("x"), F.col("y"))).first()[0]] == [("Remove", "a"), ("Replace", "b"), ("Add", "c")]


def test_a_row_that_fails_is_kept_or_ends_the_job(spark):
    df = spark.createDataFrame([(1, 4, [1]), (2, 0, [2]), (3, None, None)], "i int, n int, l array<int>")

    def step(row):
        row["l"] = [9]
        row["n"] = 8 // row["n"]

    got = {r.i: (r.n, r.l) for r in mutate.RowFunction(step, "ignore").process(df).collect()}
    assert got == {1: (2, [9]), 2: (0, [2]), 3: (None, None)}
    with pytest.raises(Exception, match="division"):
        mutate.RowFunction(step).process(df.where("i < 3")).collect()
    wrong = mutate.RowFunction(lambda r: {**r, "n": "text"} if r["i"] == 1 else None, "ignore")
    assert {r.i: r.n for r in mutate.Chain(wrong).process(df).collect()} == {1: 4, 2: 0, 3: None}


def test_nested_edits(spark):
    df = spark.createDataFrame([(1, (1, [(1, "a"), (2, "b")])), (2, (None, None)), (3, None)], "i int, s struct<n:int,l:array<struct<k:int,t:string>>>")
    edited = {r.i: r.s for r in mutate.set_nested(mutate.set_nested(df, "s.l[].k", lambda k: k * 10), "s.n", lambda n: F.lit(7), F.col("i") < 3).collect()}
    assert (edited[1].n, [(x.k, x.t) for x in edited[1].l], edited[2].n, edited[2].l, edited[3]) == (7, [(10, "a"), (20, "b")], 7, None, None)
    assert mutate.set_nested(df, "s.none", lambda x: x).schema == df.schema and mutate.set_nested(df, "none.x", lambda x: x) is df


def test_accessors_have_clean_names_and_setters(spark):
    r = S.SchemaRegistry.from_json('{"version": "2", "buckets": ["b"], "property_mapping": [{"struct": "A b", "values": [{"name": "1st", "typeId": "int"}, {"name": "class", "typeId": "FLOAT", "containerType": "ARRAY"}, {"name": "a-b", "typeId": "Bool"}, {"name": "a b", "typeId": "Bool"}]}]}')
    made: dict = {}
    exec(S.accessor_source(r), made)
    own = made["A_b"]
    assert {"_1st", "class_", "a_b", "a_b_2", "set_a_b_2"} <= set(dir(own))
    df = spark.createDataFrame([(0, 5), (1, 5)], "entity_type_id int, `1st` int")
    assert sorted(r[0] for r in own.set__1st(df, F.lit(9)).select(own._1st()).collect()) == [5, 9]
    back = S.SchemaRegistry.from_json(S.schema_text(r))
    told = lambda x: [(s.name, s.type_id, [(f.name, f.ordinal, *f.signature()) for f in s.fields]) for s in x.structs]
    assert told(back) == told(r) and back.buckets == r.buckets and back.version == "2"


def test_nested_operations(spark):
    shape = "unique_id string, s struct<a:int,v:struct<x:double,y:double,z:double>,t:struct<b:string>>, l array<struct<c:int>>, n array<int>, m map<string,struct<c:int>>"
    one = spark.createDataFrame([("u", (1, (0.0, 0.0, 0.0), ("x",)), [(1,), (2,)], [1, 2], {"k": (1,), "g": (2,)}), ("gone", None, None, None, None), ("w", None, [(1,)], None, None)], shape)
    two = spark.createDataFrame([("u", (1, (0.0, 1.0, 0.0), ("y",)), [(1,), (3,)], [1, 2, 3], {"k": (5,), "h": (2,)}), ("new", None, None, None, None), ("w", (7, None, None), [(1,), (2,)], [], None)], shape)
    got = {(r.unique_id, r.op, r.path, r.container) for r in diff.patch(one, two, ["s", "l", "n", "m"]).collect()}
    assert got == {
        ("u", "Replace", "s.v", "Vector"), ("u", "Replace", "s.t.b", "String"), ("u", "Replace", "l[1].c", "Int32"), ("u", "Replace", "n", "Int32Array"), ("u", "Replace", "m{k}.c", "Int32"), ("u", "Remove", "m{g}", "Struct"),
        ("u", "Add", "m{h}", "Struct"), ("gone", "Remove", None, "Entity"), ("new", "Add", None, "Entity"), ("w", "Add", "s", "Struct"), ("w", "Replace", "l", "StructArray"), ("w", "Add", "n", "Int32Array"),
    }


def test_mutation(spark):
    df = spark.createDataFrame([("r", 0, "a", 1, 150.0, True), ("r", 0, "b", 2, -5.0, True), ("r", 0, "c", 2, None, None)], "replay_id string, frame_index int, unique_id string, team int, health double, is_alive boolean")
    out = {r.unique_id: r for r in mutate.Chain(mutate.Clamp("health", count=True), mutate.Alive()).process(df).collect()}
    assert (out["a"].health, out["b"].health, out["b"].is_alive, out["c"].health, out["a"].clamped_health) == (100.0, 0.0, False, None, True)
    with pytest.raises(ValueError):
        mutate.Clamp("none").init(df.columns)

    def fail(_):
        raise RuntimeError("no")

    chain = mutate.Chain(mutate.Function(fail), mutate.Function(lambda r: mutate.remove_if(r, F.col("team") == 2)), on_error="ignore")
    assert chain.process(df).count() == 1
    ranges = mutate.type_ranges(df.withColumn("entity_type_id", F.when(F.col("team") == 2, 2).otherwise(0)), 4).collect()
    assert [tuple(r)[2:] for r in sorted(ranges)] == [(0, 0, 1), (1, 1, 0), (2, 1, 2)]


# --- the clock


def test_step_goldens():
    c, out = step(Clock(), 1.0, None, fps=2, start_utc=1000)
    assert out["created_utc_ticks"] == 10_001_000
    assert step(c, 1.0, None, fps=2, start_utc=1000)[1]["created_utc_ticks"] == 15_001_000
    c, out = step(Clock(), None, 5000)
    assert out["game_time_ticks"] == 0 and step(c, None, 7250)[1]["game_time_ticks"] == 2250 and step(c, None, 5000)[1] is None
    c, out = step(Clock(), None, None, fps=2, start_utc=1000)
    assert (out["game_time_ticks"], out["created_utc_ticks"]) == (0, 1000)
    assert step(c, None, None, fps=2, start_utc=1000)[1]["created_utc_ticks"] == 5_001_000
    c, _ = step(Clock(), 0.1, 1_000_000)
    assert step(c, 0.2, 1_666_664)[1]["is_gap"] and step(c, 0.2, 1_666_664)[1]["marker"] == 2
    c, _ = step(Clock(), 1.0, None)
    assert step(c, 0.5, None)[1]["is_segment"] and step(c, 0.5, None, time_filter="increasing")[1] is None and step(c, None, None)[1] is None


def clock_rows(n=200, seed=5):
    rng = random.Random(seed)
    return [(f"r{i % 3}", i, round(rng.uniform(0, 9), 2), 10**9 + rng.randrange(10**8), i) for i in range(n)]


CLOCK = "replay_id string, source_frame long, game_time double, utc_ticks long, arrival long"


def loop(data, **options):
    out, clocks = [], {}
    for r in data:
        clocks[r[0]], made = step(clocks.get(r[0], Clock()), r[2], r[3], **options)
        if made:
            out.append((r[0], r[1], made["frame_index"], made["created_utc_ticks"]))
    return sorted(out)


def test_batch_stream_and_loop_agree(spark, tmp_path):
    data = clock_rows()
    df = spark.createDataFrame(data, CLOCK)
    pick = lambda rows: sorted((r.replay_id, r.source_frame, r.frame_index, r.created_utc_ticks) for r in rows)
    options = {"time_filter": "increasing"}
    want = loop(data, **options)
    assert pick(accept_batch(df, **options).collect()) == want
    for k in range(4):
        df.where(F.col("arrival").between(50 * k, 50 * k + 49)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        source = spark.readStream.schema(CLOCK).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = accept_stream(source, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert pick(spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_one_filter_is_a_running_extreme(spark):
    data = [(a, b, c, None, e) for a, b, c, _, e in clock_rows()]
    df = spark.createDataFrame(data, CLOCK).withColumn("t", (F.col("game_time") * 100).cast("long"))
    got = sorted((r.replay_id, r.source_frame) for r in timeline.accepted(df, "t").collect())
    assert got == [x[:2] for x in loop(data, time_filter="increasing")]


def test_pipeline(spark, tmp_path):
    spark.range(30).select("id", (F.col("id") * 10.0).alias("health")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, health double").parquet(str(tmp_path / "in"))
    seen = []
    done = RecordPipeline(source, str(tmp_path / "out"), str(tmp_path / "cp"), mutate.Clamp("health")).run(lambda batch, n: seen.append(n), 120)
    assert done and seen[-1] == 30 and spark.read.parquet(str(tmp_path / "out")).agg(F.max("health")).first()[0] == 100.0


# --- functions


def test_time_functions(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c).first()[0]
    assert ask(ticks.format_duration(F.lit(109_251_230_000).cast("long"))) == "3h 2m 5s 123ms" and ask(ticks.format_duration(F.lit(10_000))) == "0s 1ms"
    assert ask(ticks.to_epoch_ticks(F.lit("1970-01-01T00:00:00"), "iso8601")) == ticks.UNIX_EPOCH_TICKS and ask(ticks.to_epoch_ticks(F.lit("invalid"), "iso8601")) == 0
    assert ask(ticks.format_utc(F.lit(17_357_760_001_230_000).cast("long"))) == "02 Jan 2025 00:00:00.123 UTC"
    assert ask(ticks.seconds_to_ticks(F.lit(0.1))) == int(np.float32(np.float32(0.1) * np.float32(1e7)))
    assert ask(ticks.ticks_text(F.lit(15_000_000))) == "1.500000s" and ask(ticks.duration_label(F.lit(3723.004))) == "1h 2m 3s 4ms (3723.0 sec)"
    assert ask(ticks.to_epoch_ticks(F.lit(1), "unix")) - ticks.UNIX_EPOCH_TICKS == 10_000_000 and ask(ticks.to_epoch_ticks(F.lit(1), "odd")) == 0


def test_texts(spark):
    df = spark.createDataFrame([(1.5, 3, True, "s", (1.0, 2.0, 3.0)), (1234567.0, None, None, None, None), (0.000123, 1, False, "", None)], "f double, i int, b boolean, s string, v struct<x:double,y:double,z:double>")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    got = [tuple(r) for r in df.select(*[text.value_text(F.col(c), kinds[c]) for c in df.columns]).collect()]
    assert got[0] == ("1.5", "3", "true", "s", "(1.00,2.00,3.00)") and got[1][1:] == ("", "", "", "") and got[2][0] == "0.000123"
    assert text.closest("Helth", ["Health", "Armor"]) == "Health" and text.closest("zzzzzzz", ["Health"]) is None
    assert (text.path_generation("a.json"), text.path_generation("a_v2.json")) == ("a_v2.json", "a_v3.json")
    assert (number_text(math.nan), number_text(0.1), number_text(1 / 3, True)) == ("null", "0.1", "0.333333")


def test_fixed_numbers_are_printfs(spark):
    rng = random.Random(6)
    xs = [0.5, 1.5, 2.5, 6.85, 1.125, 0.125, 1e-9, 0.045, 1.005, 2.675, -2.5, -0.001, 1e9 + 0.5, 123456.789, 0.0] + [rng.uniform(-1e6, 1e6) for _ in range(300)] + [rng.randint(-9999, 9999) / 1000 for _ in range(300)] + [rng.randint(-9999, 9999) / 64 for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double")
    for digits in (0, 1, 2, 3, 6):
        got = [r.t for r in df.select(text.fixed(F.col("x"), digits).alias("t")).collect()]
        assert got == [f"{x:.{digits}f}" for x in xs] + [None, "nan", "inf", "-inf"]


def test_ragged_arrays(spark):
    df = spark.createDataFrame([([[1, 2], [3]],)], "a array<array<int>>")
    ask = lambda c: df.select(c).first()[0]
    a = F.col("a")
    assert ask(arrays.sub_array(a, 1)) == [3] and ask(arrays.sub_array(a, 9)) == [] and ask(arrays.total_count(a)) == 3
    assert ask(arrays.insert_sub(a, 2, F.array(F.lit(9)))) == [[1, 2], [3], [9]] and ask(arrays.insert_sub(a, 5, F.array(F.lit(9)))) == [[1, 2], [3]]
    assert ask(arrays.erase_sub(a, 0)) == [[3]] and ask(arrays.erase_sub(a, 4)) == [[1, 2], [3]] and ask(arrays.replace_sub(a, 1, F.array(F.lit(7)))) == [[1, 2], [7]]
    assert ask(arrays.push(a, 3, F.lit(5))) == [[1, 2], [3], [], [5]] and ask(arrays.insert(a, 0, 1, F.lit(8))) == [[1, 8, 2], [3]]
    assert ask(arrays.replace(a, 0, 0, F.lit(8))) == [[8, 2], [3]] and ask(arrays.erase(a, 0, 0)) == [[2], [3]] and ask(arrays.erase(a, 0, 1, 5)) == [[1, 2], [3]]
    assert ask(arrays.append_sub(a, F.array(F.lit(4)))) == [[1, 2], [3], [4]]


def test_bones(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(500, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    t, s = rng.uniform(-9000, 9000, (500, 3)), rng.uniform(0, 9, (500, 3))
    for fine, near in ((False, 0.2), (True, 0.03)):
        settings = bones.BoneSettings(fine_position=fine)
        packed = bones.pack(t, q, s, settings)
        assert packed.shape == (500, 16)
        a, b, c = bones.unpack(packed, settings)
        turned = np.where((q * b).sum(axis=1)[:, None] < 0, -b, b)
        assert abs(a - t).max() < near and abs(turned - q).max() < 1e-3
        assert abs(c - s).max() < 0.03 if not fine else (c == 1).all()
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0), (None,) * 10], ", ".join(f"c{i} double" for i in range(10)))
    assert [None if r.packed is None else len(r.packed) for r in bones.pack_column(df, df.columns).collect()] == [16, None]


# --- loaders and exports


def test_binary(spark, tmp_path):
    import struct

    body = struct.pack("<H", 5) + b"Alice" + b"player_42\0" + struct.pack("<if3d", 1, 75.5, 1, 2, 3)
    c = BinaryCursor(body)
    assert (c.read_len_string(), c.read_c_string(), c.read("i32"), c.read("f32"), c.read_vector()) == ("Alice", "player_42", 1, 75.5, {"x": 1.0, "y": 2.0, "z": 3.0}) and c.eof()
    for bad in (lambda: c.read("u8"), lambda: c.seek(999), lambda: c.skip(-1), lambda: c.sub_cursor(1)):
        with pytest.raises(EOFError):
            bad()
    short = BinaryCursor(b"\x09\x00ab")
    with pytest.raises(EOFError):
        short.read_len_string()
    assert short.tell() == 0 and BinaryCursor(b"\x01\x02", big_endian=True).read("u16") == 258
    c.seek(1)
    c.align_to(4)
    assert c.tell() == 4
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.bin").write_bytes(struct.pack("<ii", 4, 5))
    (tmp_path / "b/y.bin").write_bytes(struct.pack("<i", 6) + b"\x01")

    def decode(cursor):
        while not cursor.eof():
            yield {"v": cursor.read("i32")}

    assert sorted(r.v for r in scan_binary(spark, str(tmp_path / "b"), "v int", decode, mode="PERMISSIVE").collect()) == [4, 5, 6]


def test_json_policies(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"Team": 3, "name": "a"}'), (2, '{"team": "4"}'), (3, "{torn"), (4, None)], "i int, j string")
    shape = T.StructType([T.StructField("Team", T.IntegerType()), T.StructField("name", T.StringType())])
    got = {r.i: (r.Team, r.name, r.missing_keys) for r in from_json_text(df, "j", shape).collect()}
    assert got == {1: (3, "a", []), 2: (None, None, ["Team", "name"]), 3: (None, None, ["Team", "name"]), 4: (None, None, ["Team", "name"])}
    assert {r.i: r.Team for r in from_json_text(df, "j", shape, "silent", "lowercase").collect()} == {1: 3, 2: 4, 3: None, 4: None}
    with pytest.raises(Exception, match="missing keys|MALFORMED"):
        from_json_text(df, "j", shape, "strict").collect()
    (tmp_path / "r.json").write_text(json.dumps({"replay_name": "m", "fps": 60, "frames": [{"frame_index": 0, "game_time": 0.0, "utc_ticks": 5, "players": [{"Name": "x", "Team": 2}]}]}))
    out = json_recording(spark, str(tmp_path / "r.json"), S.SchemaRegistry.from_json(SCHEMA), {"players": "Player"}).first()
    assert (out.replay_id, out.type_name, out.Team) == ("m", "Player", 2)
    assert from_records(spark, [{"a": 1}], {"a": lambda r: r["a"]}, "a int").first().a == 1
    keys = spark.createDataFrame([("k", 1, 0), ("", 7, 1), (None, None, 2)], "s string, i int, n int").select(map_key(F.col("s"), F.col("i"), F.col("n")))
    assert [r[0] for r in keys.collect()] == ["k", "7", "Key_2"]


def test_exports(spark, tmp_path):
    lives = spark.createDataFrame([("r", "a,b", 0, 0, 5, 0, 10_000_000), ("r", "a,b", 0, 8, 9, 5, 20_000_000), ("r", 'q"', 7, 1, 2, 0, 0)], "replay_id string, unique_id string, entity_type_id int, start_frame int, end_frame int, start_ticks long, end_ticks long")
    out = lifetime_table(lives, {0: "Player"})
    assert [tuple(r)[1:5] for r in out.collect()] == [("a,b", "Player", 0, "[0-5], [8-9]"), ('q"', "", 7, "[1-2]")]
    write_csv(out.drop("replay_id").coalesce(1), str(tmp_path / "csv"))
    lines = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).splitlines()
    assert lines[0] == "UniqueId,TypeName,TypeId,RangesFrame,RangesGameTime" and lines[1].startswith('"a,b",Player,0,"[0-5], [8-9]"') and lines[2].startswith('"q""",')
    groups = spark.createDataFrame([("x", 2, ["a", "b"])], "p string, n_entities long, unique_ids array<string>")
    assert tuple(unique_table(groups, ["p"]).first()) == ("x", 2, "a;b")
    spans = spark.createDataFrame([("r", "a", "p", None, 0, 3, 0, 5_000_000)], "replay_id string, unique_id string, property string, value string, start_frame int, end_frame int, start_ticks long, end_ticks long")
    assert tuple(span_table(spans).first())[1:] == ("a", "p", "", "[0-3]", "[0.00s-0.50s]")


def test_labels_tree_and_small_things(spark, tmp_path):
    from framelake.functions import labels
    from framelake.operators.tree import property_tree
    from framelake.sources.replay import raw_frames

    df = spark.createDataFrame([("e", ([("k", 1.5)], {"m": 2}, (1.0, 2.0, 3.0)), None)], "id string, p struct<a:array<struct<n:string,w:double>>,b:map<string,int>,c:struct<x:double,y:double,z:double>>, q array<int>")
    got = {r.path: r.value for r in property_tree(df, ["id"], ["p", "q"]).collect()}
    assert got == {"p.a[0].n": "k", "p.a[0].w": "1.5", "p.b{m}": "2", "p.c": "(1.00,2.00,3.00)", "q": None}
    ask = lambda *c: tuple(df.select(*c).first())
    assert ask(labels.offset_label(F.lit(255)), labels.location_label(F.col("p.c")), labels.game_time_label(F.lit(1.5))) == ("0xFF", "(1, 2, 3)", "1.50s")
    assert ask(*labels.clock_parts(F.lit(3661), F.lit(60)).values()) == (1, 1, 1) and ask(*labels.clock_parts(F.lit(31), F.lit(0)).values()) == (0, 1, 1)
    assert ask(*labels.visible_range(F.lit(25), F.lit(30), F.lit(10), F.lit(100))) == (2, 6) and labels.playback(0, 2, 99, 10, 1000) == 200 and labels.playback(5, -9, 1, 10, 20) == 0
    assert ask(diff.is_ancestor(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))), diff.is_ancestor(F.array(F.lit("b")), F.array(F.lit("a"), F.lit("b")))) == (True, False)
    w = RecordingWriter(str(tmp_path / "a.replay"), SCHEMA, replay_id="a", max_frames=3)
    for r in rows(7):
        w.add_row(r)
    w.close()
    raw = {r.frame_index: bytes(r.raw) for r in raw_frames(spark, str(tmp_path)).collect()}
    assert sorted(raw) == list(range(7)) and codec.decode_tables("Bucket", raw[4])["unique_ids"] == ["player_0"]
    times = spark.createDataFrame([("a", 0, 5)], "replay_id string, frame_index int, t int")
    assert timeline.append_times(times, spark.createDataFrame([("a", 0, 9), ("a", 1, 6)], times.schema)).orderBy("frame_index").collect() == [("a", 0, 5), ("a", 1, 6)]


def test_the_round_trip_query_writes_every_row_and_property(spark, data, tmp_path, monkeypatch):
    from framelake.frames import PROPERTIES, frames
    from framelake.plans.reference import container_differences
    from framelake.sources import replay

    rows = frames(spark, data)
    assert container_differences(rows, str(tmp_path / "whole")).count() == 0
    back = read_replays(spark, str(tmp_path / "whole"))
    assert set(PROPERTIES) <= set(back.columns)
    count = lambda df: {r.entity_type_id: r["count"] for r in df.groupBy("entity_type_id").count().collect()}
    assert count(back) == count(rows) and set(count(back)) == {0, 1, 2}
    empty = rows.where("entity_type_id = 0 and name is null").count()
    assert empty > 0 and back.where("entity_type_id = 0 and name = ''").count() == empty
    whole = replay.read_replays
    monkeypatch.setattr(replay, "read_replays", lambda s, at, **more: whole(s, at, **more).withColumn("armor", F.col("armor") + F.when(F.col("entity_type_id") == 0, 1.0)).where("entity_type_id < 2"))
    changed = container_differences(rows, str(tmp_path / "whole")).groupBy("entity_type_id").agg(F.sum(F.when(F.col("missing") > 0, F.col("missing"))).alias("n"), F.sum("missing").alias("left")).collect()
    n = count(rows)
    assert {(r.entity_type_id, r.n, r.left) for r in changed} == {(0, n[0], 0), (2, n[2], n[2])}
