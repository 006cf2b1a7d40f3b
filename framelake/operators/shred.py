"""Deeply nested semi-structured records as related flat tables.

Shared inlining over a schema graph: the graph of element kinds is inferred from all bodies (or
declared); elements that occur once below their parent are inlined as columns; elements that
repeat, are shared by several parents, are recursive, or are asked for, get tables of their own,
whose rows carry the record's id, their own path and their parent's path as keys.

An element kind is known by its name. An object whose name stands below several kinds is shared:
all its places go to one table named after it, and rows name their own place and their parent's
(``node``, ``parent_node``). An object whose name stands below itself is recursive: its inner places
are folded onto the outermost one, so its rows, at any depth, are one table's. Values that are no
objects or lists are never shared or folded, they stay columns.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_GAP = re.compile(r"[\s\-]+")
#: More distinct paths than this mean that keys hold data; the graph is then no schema.
MAX_PATHS = 10_000


@lru_cache(maxsize=1 << 16)
def plain_name(key: str) -> str:
    """One spelling for keys: snake case in lower case."""
    return _GAP.sub("_", _HUMP.sub("_", key.strip())).lower()


def _no_constant(name: str):
    raise ValueError(name)


def parse(body: str | None):
    """The JSON value of a text, or None where it is null or not valid JSON."""
    if body is None:
        return None
    try:
        return json.loads(body, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def unwrap(value, marks: frozenset[str], depth: int = 6):
    """The object that holds any of the root's own keys, below any wrappers; None if there is none."""
    layer = [value]
    for _ in range(depth):
        below = []
        for v in layer:
            if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
                v = parse(v)
            if isinstance(v, dict):
                if any(plain_name(k) in marks for k in v):
                    return v
                below.extend(v.values())
        layer = [v for v in below if isinstance(v, (dict, str))]
        if not layer:
            return None
    return None


def _opened(value):
    """A list or object that is given as JSON text, as what it is; other texts stay."""
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in ("[", "{"):
            inner = parse(text)
            if isinstance(inner, (list, dict)):
                return inner
    return value


@dataclass(frozen=True)
class Graph:
    """Element kinds by path: the kinds of value seen and whether an element repeats or recurs.

    shared has names, the others paths; folds leads from a recursive element's inner path to its outermost one.
    """

    kinds: dict[str, frozenset[str]]
    repeated: frozenset[str]
    recursive: frozenset[str] = frozenset()
    shared: frozenset[str] = frozenset()
    own_tables: frozenset[str] = frozenset()
    folds: dict[str, str] = field(default_factory=dict)
    places: frozenset[str] = field(init=False)
    tables: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        own = self.repeated | self.recursive | self.own_tables
        object.__setattr__(self, "places", frozenset(p for p in self.kinds if p in own or self._is_shared(p)))
        object.__setattr__(self, "tables", tuple(sorted({self.table_of(p) for p in self.places})))

    def _is_shared(self, path: str) -> bool:
        return path.rpartition(".")[2] in self.shared and "object" in self.kinds.get(path, ())

    def table_of(self, path: str) -> str:
        """The table of a place: its path from the last shared element on."""
        names = path.split(".")
        for i in range(len(names), 0, -1):
            if self._is_shared(".".join(names[:i])):
                return ".".join(names[i - 1 :])
        return path

    def places_of(self, table: str) -> list[str]:
        return sorted(p for p in self.places if self.table_of(p) == table)

    def step(self, path: str, name: str) -> str:
        """The path of an element below another's, folded where it is recursive."""
        here = f"{path}.{name}" if path else name
        return self.folds.get(here, here)

    def inlines_scalar(self, path: str) -> bool:
        """Whether a bare value in an object's place is kept as its parent's column."""
        return path not in self.places or path not in self.repeated and path not in self.own_tables

    def columns(self, table: str) -> dict[str, str]:
        """Inlined columns of a table: column name -> Spark type, descendants joined by underscores."""
        found: dict[str, frozenset[str]] = {}
        for node in self.places_of(table) if table else [""]:
            head = f"{node}." if node else ""
            within = [t for t in self.places if t.startswith(head) and t != node]
            for path in self.kinds:
                if not path.startswith(head) or path == node or any(path.startswith(f"{t}.") for t in within) or not self.inlines_scalar(path):
                    continue
                name = path[len(head) :].replace(".", "_")
                found[name] = found.get(name, frozenset()) | self.kinds[path] - {"object", "null"}
            if node and "object" not in self.kinds[node] and self.kinds[node] - {"null"}:
                found["value"] = found.get("value", frozenset()) | self.kinds[node] - {"null"}
        return {c: _spark_type(k) for c, k in sorted(found.items()) if k}


def _spark_type(kinds: frozenset[str]) -> str:
    """The narrowest type that holds every kind; mixed kinds become text."""
    if kinds <= {"int"}:
        return "bigint"
    if kinds <= {"int", "float"}:
        return "double"
    if kinds <= {"bool"}:
        return "boolean"
    return "string"


KINDS = ("null", "bool", "int", "float", "object", "text", "list")


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return "object" if isinstance(value, dict) else "text"


#: A short list of numbers where objects are usual is a point in positional form.
POINT = ("x", "y", "z", "w")


def _as_object(value):
    value = _opened(value)
    if isinstance(value, list) and 2 <= len(value) <= 4 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value):
        return dict(zip(POINT, value, strict=False))
    return value


_PLAIN = {type(None): "null", bool: "bool", int: "int", float: "float"}


class Edges:
    """(path, kind) pairs of the values below objects; an object below its own kind is taken at the outer place.

    What a key leads to is worked out once per (path, key).
    """

    def __init__(self):
        self.kinds: dict[str, set[str]] = {}
        self.known: dict[tuple[str, str], tuple[str, set[str]]] = {}

    def _step(self, path: str, key: str) -> tuple[str, set[str]]:
        name = plain_name(key)
        here = f"{path}.{name}" if path else name
        names = path.split(".") if path else []
        below = ".".join(names[: names.index(name) + 1]) if name in names else here
        step = self.known[path, key] = below, self.kinds.setdefault(here, set())
        return step

    def add(self, value: dict, path: str = "") -> None:
        known = self.known
        for key, v in value.items():
            below, kinds = known.get((path, key)) or self._step(path, key)
            plain = _PLAIN.get(type(v))
            if plain:
                kinds.add(plain)
                continue
            v = _as_object(v)
            if isinstance(v, list):
                kinds.add("list")
                for entry in v:
                    entry = _as_object(entry)
                    kinds.add(_kind(entry))
                    if isinstance(entry, dict):
                        self.add(entry, below)
            else:
                kinds.add(_kind(v))
                if isinstance(v, dict):
                    self.add(v, below)

    def pairs(self) -> set[tuple[str, str]]:
        return {(path, kind) for path, kinds in self.kinds.items() for kind in kinds}


def infer_graph(docs: DataFrame, body: str, marks: Sequence[str], own_tables: Sequence[str] = ()) -> Graph:
    """The schema graph of all bodies: every body is read; only distinct (path, kind) pairs meet.

    A name that occurs below itself is recursive: its paths are folded onto the outermost one.
    """
    roots = frozenset(marks)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = Edges()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = unwrap(parse(text), roots)
                if found is not None:
                    edges.add(found)
            if len(edges.kinds) > MAX_PATHS:
                raise ValueError("the bodies' keys look like data, not like a schema")
        seen = edges.pairs()
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in seen], "kind": [k for _, k in seen]}, schema=pa.schema([("path", pa.string()), ("kind", pa.string())]))

    pairs = docs.select(body).mapInArrow(walk, "path string, kind string").distinct().limit(MAX_PATHS * len(KINDS) + 1).collect()
    if len(pairs) > MAX_PATHS * len(KINDS):
        raise ValueError("the bodies' keys look like data, not like a schema")
    return graph_of({(r.path, r.kind) for r in pairs}, own_tables)


def graph_of(pairs: set[tuple[str, str]], own_tables: Sequence[str] = ()) -> Graph:
    """The graph of (path, kind) pairs; a list has the kind ``list`` beside its entries' kinds."""
    folds: dict[str, str] = {}

    def folded(path: str) -> str:
        here = ""
        for name in path.split("."):
            here = f"{here}.{name}" if here else name
            here = folds.get(here, here)
        return here

    objects = sorted({p for p, kind in pairs if kind == "object"}, key=lambda p: (p.count("."), p))
    for path in objects:
        head, _, name = path.rpartition(".")
        names = folded(head).split(".") if head else []
        if name in names:
            folds[".".join([*names, name])] = ".".join(names[: names.index(name) + 1])
    kinds: dict[str, set[str]] = {}
    repeated: set[str] = set()
    for path, kind in pairs:
        path = folded(path)
        own = kinds.setdefault(path, set())
        if kind == "list":
            repeated.add(path)
        else:
            own.add(kind)
    if len(kinds) > MAX_PATHS:
        raise ValueError("the bodies' keys look like data, not like a schema")
    parents: dict[str, set[str]] = {}
    for path in kinds:
        if "object" in kinds[path]:
            names = path.split(".")
            parents.setdefault(names[-1], set()).add(names[-2] if len(names) > 1 else "")
    shared = frozenset(name for name, above in parents.items() if len(above) > 1)
    return Graph({p: frozenset(k) for p, k in kinds.items()}, frozenset(repeated), frozenset(folds.values()), shared, frozenset(own_tables), folds)


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if isinstance(value, int) or isinstance(value, float) and math.isfinite(value):
        return repr(value)
    return json.dumps(value, ensure_ascii=False)


def _inline(value: dict, path: str, prefix: str, graph: Graph, out: dict[str, str | None]) -> None:
    for key, v in value.items():
        name = plain_name(key)
        here = graph.step(path, name)
        if type(v) in _PLAIN and here not in graph.places:
            out[f"{prefix}{name}"] = _text(v)
            continue
        v = _as_object(v)
        if here in graph.places and (isinstance(v, (dict, list)) or v is None or not graph.inlines_scalar(here)):
            continue
        if isinstance(v, dict):
            _inline(v, here, f"{prefix}{name}_", graph, out)
        else:
            out[f"{prefix}{name}"] = _text(v)


def entries(value: dict, graph: Graph, node: str = "", place: str = "", path: str | None = None) -> Iterator[tuple[str, str, str, str, object]]:
    """(node, path, parent node, parent path, entry) of every entry below an object; null entries only hold their place.

    node and place are the enclosing row's, path is the object's own where it is inlined. Where
    several elements are recursive, a step into a folded one is written with its inner path, as
    positions alone wouldn't tell two ways to one table apart.
    """
    path = node if path is None else path
    for key, v in value.items():
        if type(v) in _PLAIN or type(v) is str and v.lstrip()[:1] not in ("[", "{"):
            continue  # no entries below
        name = plain_name(key)
        inner = f"{path}.{name}" if path else name
        here = graph.folds.get(inner, inner)
        v = _opened(v) if here in graph.repeated else _as_object(v)
        if here in graph.places:
            given = v if isinstance(v, list) else [v] if isinstance(v, dict) else []
            step = f"{inner}:" if inner != here and len(graph.folds) > 1 else ""
            for i, entry in enumerate(given):
                entry = _as_object(entry)
                if entry is None:
                    continue
                own = f"{place}/{step}{i}" if place else f"{step}{i}"
                yield here, own, node, place, entry
                if isinstance(entry, dict):
                    yield from entries(entry, graph, here, own)
        elif isinstance(v, dict):
            yield from entries(v, graph, node, place, here)


def shred(docs: DataFrame, record: str, body: str, graph: Graph, marks: Sequence[str], with_fields: bool = True, nodes: Sequence[str] | None = None) -> DataFrame:
    """All tables in long form: (record, node, path, parent_path, parent_node, fields); of some nodes where given.

    node is the element's path in the graph and '' for the root, path its position below its
    parent's path, fields its inlined columns as text. Bodies that are null, cut or no JSON give
    no rows; a list given as one object or as JSON text is read as a list; a null list, a null
    entry, an absent key, or a bare text or number in a list's place gives no rows. One narrow pass, no shuffle.
    """
    roots, wanted = frozenset(marks), None if nodes is None else frozenset(nodes)
    kind = docs.schema[record].dataType.simpleString()
    schema = f"`{record}` {kind}, node string, path string, parent_path string, parent_node string" + ", fields map<string,string>" * with_fields

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            rows: list[tuple[str, str, str | None, str | None]] = []
            fields: list[list[tuple[str, str | None]]] = []

            def add(i: int, node: str, own: str, above: str | None, parent: str | None, entry) -> None:
                if wanted is not None and node not in wanted:
                    return
                ids.append(i)
                rows.append((node, own, parent, above))
                if with_fields:
                    flat: dict[str, str | None] = {}
                    if isinstance(entry, dict):
                        _inline(entry, node, "", graph, flat)
                    else:
                        flat["value"] = _text(entry)
                    fields.append(list(flat.items()))

            for i, text in enumerate(batch.column(1).to_pylist()):
                value = parse(text)
                if isinstance(value, (dict, str)):
                    found = unwrap(value, roots)
                    if found is None:
                        continue
                    add(i, "", "", None, None, found)
                    for node, own, above, parent, entry in entries(found, graph):
                        add(i, node, own, above, parent, entry)
            columns = [batch.column(0).take(pa.array(ids, pa.int32())), *[pa.array([r[j] for r in rows], pa.string()) for j in range(4)]]
            names = [record, "node", "path", "parent_path", "parent_node"]
            if with_fields:
                columns.append(pa.array(fields, pa.map_(pa.string(), pa.string())))
                names.append("fields")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(record, body).mapInArrow(walk, schema)


def flat_table(long: DataFrame, record: str, graph: Graph, table: str) -> DataFrame:
    """One table with typed columns: the record's id, path, parent_path (the foreign key) and the inlined fields.

    A table of several places, or of a recursive one, also has node and parent_node, which belong to the keys.
    """
    columns = graph.columns(table) or {"value": "string"}
    places = graph.places_of(table) if table else [""]
    keys = ["path", "parent_path"]
    if len(places) > 1 or any(p in graph.recursive or graph._is_shared(p) for p in places):
        keys = ["node", "path", "parent_node", "parent_path"]
    taken = {record, *keys}
    picked = [F.expr(f"try_cast(element_at(fields, '{c}') AS {t})").alias(f"{c}_" if c in taken else c) for c, t in columns.items()]
    return long.where(F.col("node").isin(places)).select(record, *keys, *picked)


Unwrap = Callable[[object], object]
