import json

from framelake.operators import shred

MARKS = ("players", "projectiles", "match_state", "frame_index")


def docs(spark, bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "frame_id long, body string")


BODIES = [
    {"frame_index": 1, "players": [{"id": "a", "pos": {"x": 1, "y": 2.5}, "loadout": [{"item": "gun", "mods": [{"m": 1}, None, {"m": 2}]}, None, {"item": "kit"}]}, None, {"id": "b"}], "match_state": {"phase": "x"}},
    {"data": {"frame": {"frame_index": 2, "Players": json.dumps([{"id": "c", "Loadout": {"item": "one"}}]), "MatchState": None}}},
    {"frame_index": 3, "players": {"id": "d", "pos": [4, 5, 6]}, "projectiles": []},
    None, "", "{cut", "[1, 2]", '"text"', {"other": 1}, {"frame": {"players": []}}, {"frame_index": 4, "players": "", "match_state": 7}, {"frame_index": 5, "players": "null", "projectiles": "[]"},
]


def test_entries_and_paths(spark):
    df = docs(spark, BODIES)
    graph = shred.infer_graph(df, "body", MARKS, ["match_state"])
    assert set(graph.tables) == {"players", "players.loadout", "players.loadout.mods", "projectiles", "match_state"}
    rows = shred.shred(df, "frame_id", "body", graph, MARKS).where("node <> ''").collect()
    got = sorted((r.frame_id, r.node, r.path, r.parent_path) for r in rows)
    assert got == [
        (0, "match_state", "0", ""), (0, "players", "0", ""), (0, "players", "2", ""), (0, "players.loadout", "0/0", "0"), (0, "players.loadout", "0/2", "0"), (0, "players.loadout.mods", "0/0/0", "0/0"), (0, "players.loadout.mods", "0/0/2", "0/0"),
        (1, "players", "0", ""), (1, "players.loadout", "0/0", "0"), (2, "players", "0", ""),
    ]


def test_typed_tables_keep_their_parents(spark):
    df = docs(spark, BODIES)
    graph = shred.infer_graph(df, "body", MARKS, ["match_state"])
    long = shred.shred(df, "frame_id", "body", graph, MARKS)
    players = {(r.frame_id, r.path): r for r in shred.flat_table(long, "frame_id", graph, "players").collect()}
    assert players[0, "0"].pos_y == 2.5 and players[2, "0"].pos_x == 4 and players[2, "0"].pos_z == 6 and players[0, "2"].pos_x is None
    mods = shred.flat_table(long, "frame_id", graph, "players.loadout.mods")
    loadout = shred.flat_table(long, "frame_id", graph, "players.loadout")
    parents = loadout.select("frame_id", "path").withColumnRenamed("path", "parent_path")
    assert mods.join(parents, ["frame_id", "parent_path"]).count() == mods.count() == 2
    assert {r.frame_index for r in shred.flat_table(long, "frame_id", graph, "").collect()} == {1, 2, 3, 4, 5, None}


def test_recursion_and_empty(spark):
    df = docs(spark, [{"frame_index": 1, "a": {"b": {"a": {"b": {"v": 1}}}}}])
    graph = shred.infer_graph(df, "body", MARKS)
    assert graph.recursive
    none = docs(spark, [None])
    graph = shred.infer_graph(none, "body", MARKS)
    assert graph.tables == () and shred.shred(none, "frame_id", "body", graph, MARKS).count() == 0


def test_shared_objects_get_one_table_with_all_parents(spark):
    body = {"frame_index": 1, "players": [{"id": "a", "position": {"x": 1, "tags": [{"t": 1}, {"t": 2}]}}, {"id": "b", "position": [3, 4]}, {"id": "c", "position": "lost"}], "projectiles": [{"id": "p", "position": {"x": 2.5, "tags": [{"t": 3}]}, "owner": {"name": "a"}}]}
    df = docs(spark, [body])
    graph = shred.infer_graph(df, "body", MARKS)
    assert graph.shared == {"position"} and set(graph.tables) == {"players", "projectiles", "position", "position.tags"}
    long = shred.shred(df, "frame_id", "body", graph, MARKS)
    table = {t: [r.asDict() for r in shred.flat_table(long, "frame_id", graph, t).collect()] for t in ("", *graph.tables)}
    assert sorted((r["parent_node"], r["parent_path"], r["path"], r["x"], r["y"]) for r in table["position"]) == [("players", "0", "0/0", 1, None), ("players", "1", "1/0", 3, 4), ("projectiles", "0", "0/0", 2.5, None)]
    assert sorted((r["parent_node"], r["parent_path"], r["path"], r["t"]) for r in table["position.tags"]) == [("players.position", "0/0", "0/0/0", 1), ("players.position", "0/0", "0/0/1", 2), ("projectiles.position", "0/0", "0/0/0", 3)]
    assert {(r["id"], r["position"]) for r in table["players"]} == {("a", None), ("b", None), ("c", "lost")} and not any("position_x" in r for r in table["players"])
    assert [r["owner_name"] for r in table["projectiles"]] == ["a"]  # one parent: inlined


def test_recursive_lists_and_objects_keep_every_row(spark):
    tree = {"v": 1, "name": {"name": "x"}, "children": [{"v": 2, "children": [{"v": 3, "children": []}, None, {"v": 4}]}, {"v": 5, "children": None}]}
    df = docs(spark, [{"frame_index": 1, "children": [tree]}, {"frame_index": 2, "a": {"b": {"v": 0, "a": {"b": {"v": 1}}}}}])
    graph = shred.infer_graph(df, "body", MARKS)
    assert graph.recursive == {"children", "a"} and graph.shared == frozenset()
    one = docs(spark, [{"frame_index": 1, "children": [tree]}])
    graph = shred.infer_graph(one, "body", MARKS)
    rows = shred.flat_table(shred.shred(one, "frame_id", "body", graph, MARKS), "frame_id", graph, "children").collect()
    assert sorted((r.path, r.parent_node, r.parent_path, r.v, r.name_name) for r in rows) == [
        ("0", "", "", 1, "x"), ("0/0", "children", "0", 2, None), ("0/0/0", "children", "0/0", 3, None), ("0/0/2", "children", "0/0", 4, None), ("0/1", "children", "0", 5, None),
    ]
    graph = shred.infer_graph(df, "body", MARKS)
    rows = shred.flat_table(shred.shred(df, "frame_id", "body", graph, MARKS), "frame_id", graph, "a").collect()
    assert sorted((r.parent_node, r.b_v) for r in rows) == [("", 0), ("a", 1)]


def test_two_ways_into_one_recursive_table_have_paths_of_their_own(spark):
    leaf = lambda v: {"v": v}
    node = {"v": 1, "left": {"v": 2, "left": leaf(3), "right": {"v": 4, "left": leaf(5)}}, "right": {"v": 6, "right": leaf(7)}}
    df = docs(spark, [{"frame_index": 1, "left": node, "right": leaf(8)}])
    graph = shred.infer_graph(df, "body", MARKS)
    rows = shred.shred(df, "frame_id", "body", graph, MARKS).where("node <> ''").collect()
    assert sorted(int(r.fields["v"]) for r in rows) == [1, 2, 3, 4, 5, 6, 7, 8]
    own = {(r.node, r.path) for r in rows}
    assert len(own) == 8 and all(not r.parent_node or (r.parent_node, r.parent_path) in own for r in rows)
