import json
import random

from framelake.operators import drift


def schema(version, structs):
    return json.dumps({"version": version, "buckets": ["entity"], "property_mapping": [{"struct": s, "values": [dict(zip(("name", "typeId", "containerType"), f, strict=False)) for f in fs]} for s, fs in structs.items()]})


def files(spark, bodies):
    return spark.createDataFrame([(f"f{i}", s, i, b) for i, (s, b) in enumerate(bodies)], "file_id string, studio_id string, d int, body string").selectExpr("file_id", "studio_id", "timestamp_ntz'2025-01-01' + make_interval(0,0,0,d) AS delivered_at", "body")


def test_changes_between_versions(spark):
    one = schema("1.9", {"P": [("Id", "String"), ("A", "Int32"), ("B", "Float", "None"), ("Gone", "Bool")], "Q": [("Z", "Int64")]})
    two = schema("v1.10.0 ", {"P": [("Id", "string"), ("A2", "int"), ("B", "String", "array"), ("New", "Bool", "map")], "R": [("Y", "Int8")]})
    torn = two[:40]
    found = drift.schema_changes(drift.schema_fields(files(spark, [("s", two), ("s", one), ("s", torn), ("s", one), ("t", one), ("s", None)]))).collect()
    got = sorted((r.studio_id, r.version, r.struct_name, r.field_name, r.change) for r in found)
    assert got == sorted(
        ("s", "1.10.0", *x) for x in [("P", "A2", "renamed"), ("P", "B", "container_changed"), ("P", "B", "type_changed"), ("P", "Gone", "removed"), ("P", "New", "added"), ("Q", "Z", "removed"), ("R", "Y", "added")]
    )


def test_one_table_and_alternatives(spark):
    bodies = [schema("1.0.0", {"P": [("Id", "String"), ("A", "Int32")]}), schema("1.1.0", {"P": [("Id", "String"), ("B", "Int32")]}), schema("1.2.0", {"P": [("Id", "Int64"), ("B", "Int32", "array")]})]
    fields = drift.schema_fields(files(spark, [("s", b) for b in bodies]))
    alt = {(r.field_name, r.type, r.container): (r.first_version, r.alternative) for r in drift.alternatives(fields).collect()}
    assert alt == {("Id", "String", "None"): ("1.0.0", 1), ("Id", "Int64", "None"): ("1.2.0", 2), ("A", "Int32", "None"): ("1.0.0", 1), ("A", "Int32", "Array"): ("1.2.0", 2)}
    records = spark.createDataFrame(
        [("r1", "s", "1.0.0", "P", 9, '{"Id": "x", "A": 5}'), ("r1", "s", "1.0.0", "P", 9, '{"Id": "x", "A": 5}'), ("r2", "s", "v1.1", "P", 9, '{"Id": "y", "B": 6, "Odd": 1}'), ("r3", "s", "1.2.0", "P", 9, '{"Id": 77, "B": [1, 2]}'), ("r4", "s", None, "P", 1, '{"B": 8}'), ("r5", "s", "1.0.0", "P", 9, "{torn"), ("r6", "u", "1.0.0", "P", 9, '{"A": 1}'), ("r7", "s", "1.0.0", "P", 9, None)],
        "record_id string, studio_id string, schema_version string, struct_name string, d int, payload string",
    ).selectExpr("record_id", "studio_id", "schema_version", "struct_name", "timestamp_ntz'2025-01-01' + make_interval(0,0,0,d) AS recorded_at", "payload")
    out = {r.record_id: r for r in drift.consistent_table(records, files(spark, [("s", b) for b in bodies])).collect()}
    assert len(out) == 7
    assert (out["r1"].Id, out["r1"].A, out["r1"].A__int32) == ("x", "5", 5)
    assert (out["r2"].A, out["r2"].undeclared) == ("6", {"Odd": "1"})
    assert (out["r3"].Id, out["r3"].Id__int64, out["r3"].Id__string, out["r3"].A__int32array) == ("77", 77, None, "[1,2]")
    assert (out["r4"].version, out["r4"].A) == ("1.1.0", "8")
    assert (out["r5"].readable, out["r7"].readable, out["r6"].undeclared) == (False, False, {"A": "1"})


def test_a_name_that_is_used_again(spark):
    """a becomes b, a new a comes: the newcomer is a field of its own; c goes and comes back as itself."""
    bodies = [
        schema("1", {"P": [("a", "Int32"), ("c", "Bool")]}), schema("2", {"P": [("b", "Int32")]}), schema("3", {"P": [("b", "Int32"), ("a", "String"), ("c", "Bool")]}),
        schema("4", {"P": []}), schema("5", {"P": [("B", "Float")]}),
    ]
    fields = drift.schema_fields(files(spark, [("s", b) for b in bodies]))
    roots = {(r.field_name, r.v): r.root for r in drift.lineage(fields).collect()}
    assert roots == {("a", "1.0.0"): "a", ("c", "1.0.0"): "c", ("b", "2.0.0"): "a", ("a", "3.0.0"): "a@3.0.0", ("c", "3.0.0"): "c", ("B", "5.0.0"): "B"}
    gone = {(r.version, r.field_name, r.change) for r in drift.schema_changes(fields).collect()}
    assert {x for x in gone if x[0] == "4.0.0"} == {("4.0.0", n, "removed") for n in ("b", "a", "c")} and ("5.0.0", "B", "added") in gone
    records = spark.createDataFrame(
        [("r1", "s", "1", "P", 9, '{"a": 5}'), ("r2", "s", "3", "P", 9, '{"a": "x", "b": 6, "c": true}'), ("r3", "s", "2", "P", 9, '{"b": 7, "b": 8}'), ("r4", None, "1", "P", 9, '{"a": 1}')],
        "record_id string, studio_id string, schema_version string, struct_name string, d int, payload string",
    ).selectExpr("record_id", "studio_id", "schema_version", "struct_name", "timestamp_ntz'2025-01-01' + make_interval(0,0,0,d) AS recorded_at", "payload")
    given = files(spark, [("s", b) for b in bodies])
    out = {r.record_id: r for r in drift.consistent_table(records, given).collect()}
    assert (out["r1"].a, out["r2"].a, out["r2"]["a@3.0.0"], out["r2"].c) == (5, 6, "x", True)
    assert not out["r3"].readable and out["r4"].undeclared == {"a": "1"}
    narrow = drift.consistent_table(records, given, max_columns=1)
    assert [c for c in narrow.columns if c not in drift._FIXED] == ["a"]
    out = {r.record_id: r for r in narrow.collect()}
    assert out["r2"].more == {"a@3.0.0": "x", "c": "true"} and out["r2"].a == 6
    counts = lambda df: {(r.field_name, r.n_filled) for r in drift.filled(df).collect()}
    assert counts(narrow) == counts(drift.consistent_table(records, given)) == {("a", 2), ("a@3.0.0", 1), ("c", 1)}


def test_changes_against_brute_force(spark):
    rng = random.Random(4)
    bodies, want = [], set()
    for studio in ("s", "t", "u"):
        before = None
        for v in range(1, 12):
            now = {}
            for struct in rng.sample(["P", "Q"], rng.randint(1, 2)):
                names = rng.sample("abcde", rng.randint(0, 4))
                now[struct] = [(n, rng.choice(["Int32", "Float"]), rng.choice(["None", "Array"])) for n in names]
            bodies.append((studio, schema(f"{v}", now)))
            flat = lambda m: {(s, f[0]): (i, f[1], f[2]) for s, fs in m.items() for i, f in enumerate(fs)}
            if before is not None:
                old, new = flat(before), flat(now)
                came = {(k[0], new[k]): k[1] for k in new.keys() - old.keys()}
                went = {(k[0], old[k]): k[1] for k in old.keys() - new.keys()}
                for at in came.keys() | went.keys():
                    want.add((studio, f"{v}.0.0", at[0], came.get(at) or went[at], "renamed" if at in came and at in went else "added" if at in came else "removed"))
                for k in old.keys() & new.keys():
                    want |= {(studio, f"{v}.0.0", *k, c) for c, i in (("type_changed", 1), ("container_changed", 2)) if old[k][i] != new[k][i]}
            before = now
    rng.shuffle(bodies)
    found = drift.schema_changes(drift.schema_fields(files(spark, bodies))).collect()
    assert len(found) == len(want) and {(r.studio_id, r.version, r.struct_name, r.field_name, r.change) for r in found} == want


def test_empty(spark):
    fields = drift.schema_fields(files(spark, []))
    assert drift.schema_changes(fields).count() == 0 and drift.alternatives(fields).count() == 0
