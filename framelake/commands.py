"""The line commands over a recording: ``Session(spark).run('search health < 20')`` answers in JSON.

Answers hold what a command asks for about one frame or one recording; whole-table work is done
with the operators instead. Of a folder of recordings one is open at a time: the first, or the one named.
"""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.text import closest
from framelake.operators.analysis import track
from framelake.operators.diff import diff_frames, summary
from framelake.operators.predicates import OPERATORS, search
from framelake.schema import SchemaRegistry
from framelake.sinks.exports import Single, error, ok
from framelake.sources.replay import ReplayError, ReplayFile, _files, metadata, read_replays


def tokens(line: str) -> list[str]:
    """Words of a line; double quotes hold blanks together, there are no escapes."""
    out, word, quoted, begun = [], "", False, False
    for c in line:
        if c == '"':
            quoted, begun = not quoted, True
        elif c.isspace() and not quoted:
            if word or begun:
                out.append(word)
            word, begun = "", False
        else:
            word += c
    return [*out, word] if word or begun else out


class Refusal(Exception):
    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.hint = hint


class Session:
    COMMANDS = ("open", "close", "help", "exit", "quit", "info", "header", "footer", "schema", "chunks", "events", "frame", "buckets", "entities", "entity", "property", "types", "diff", "track", "search")

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path: str | None = None
        self.rows: DataFrame | None = None
        self.registry: SchemaRegistry | None = None
        self.file: ReplayFile | None = None  # the open recording
        self.current = 0
        self.ended = False

    def run(self, line: str) -> str:
        words = tokens(line)
        if not words:
            return error("", "empty command")
        name, args = words[0].lower(), words[1:]
        if name not in self.COMMANDS:
            near = closest(name, self.COMMANDS)
            return error(name, f"unknown command {name}", f"did you mean {near}?" if near else None)
        command = getattr(self, f"do_{name}")
        try:
            inspect.signature(command).bind(*args)
        except TypeError:
            return error(name, "wrong number of arguments")
        try:
            return ok(name, command(*args))
        except Refusal as e:
            return error(name, str(e), e.hint)
        except (ValueError, ReplayError) as e:
            return error(name, str(e))

    def _need(self) -> DataFrame:
        if self.rows is None:
            raise Refusal("no recording is open", "open <path>")
        return self.rows

    def _meta(self, kind: str) -> list[dict]:
        self._need()
        return [r.asDict(recursive=True) for r in metadata(self.spark, self.file.path)[kind].collect()]

    # --- files and session

    def do_open(self, path: str, recording: str | None = None):
        names = {r.replay_id: f for f in reversed(_files(path)) for r in [ReplayFile.open(f)]}
        if recording is not None and recording not in names:
            near = closest(recording, list(names))
            raise Refusal(f"no recording {recording}", f"did you mean {near}?" if near else None)
        chosen = ReplayFile.open(names[recording] if recording is not None else _files(path)[0])
        self.path, self.file, self.registry, self.current = path, chosen, chosen.registry(), 0
        self.rows = read_replays(self.spark, chosen.path)
        return {"path": path, "recording": chosen.replay_id, "recordings": sorted(names), "backend": chosen.backend, "total_frames": chosen.footer.get("total_frames", 0)}

    def do_close(self):
        self._need()
        self.path = self.rows = self.registry = self.file = None
        return {}

    def do_help(self):
        return {"commands": list(self.COMMANDS)}

    def do_exit(self):
        self.ended = True
        return {}

    do_quit = do_exit

    def do_info(self):
        head, foot = self._meta("header")[0], self._meta("footer")[0]
        return {**head, **foot}

    def do_header(self):
        return self._meta("header")

    def do_footer(self):
        return self._meta("footer")

    def do_schema(self):
        return self._meta("schema")

    def do_chunks(self):
        return self._meta("chunks")

    def do_events(self):
        return self._meta("events")

    # --- frames

    def _frame(self) -> DataFrame:
        return self._at(self.current)

    def _at(self, index: int) -> DataFrame:
        """One frame; only its chunk is opened."""
        self._need()
        return read_replays(self.spark, self.file.path, frames=(index, index))

    def do_frame(self, index: str | None = None):
        self._need()
        if index is not None:
            total = max(f["total_frames"] for f in self._meta("footer"))
            if not index.isdigit() or int(index) >= total:
                raise Refusal(f"no frame {index}", f"frames go from 0 to {total - 1}")
            self.current = int(index)
        n = self._frame().agg(F.count_distinct("bucket_index").alias("b"), F.count("*").alias("e")).first()
        return {"frame": self.current, "buckets": n.b, "entities": n.e}

    def _bucket(self, name: str) -> int:
        """By index, by name, or by name whatever the case."""
        names = self.registry.buckets
        if name.isdigit() and int(name) < max(1, len(names)):
            return int(name)
        if name in names:
            return names.index(name)
        lower = [n.lower() for n in names]
        if name.lower() in lower:
            return lower.index(name.lower())
        raise Refusal(f"no bucket {name}", f"buckets: {', '.join(names)}")

    def do_buckets(self):
        found = {r.bucket_index: r.n for r in self._frame().groupBy("bucket_index").agg(F.count("*").alias("n")).collect()}
        return [{"index": i, "name": n, "entities": found.get(i, 0)} for i, n in enumerate(self.registry.buckets)]

    def do_entities(self, bucket: str):
        self._need()
        rows = self._frame().where(F.col("bucket_index") == self._bucket(bucket)).orderBy("entity_index")
        return [r.asDict() for r in rows.select("entity_index", "unique_id", "entity_type_id", "type_name").collect()]

    def _entity(self, bucket: str, *who: str):
        """By ``--index N``, by ``--id ID``, or by a bare word: an index if it is a number of an entity, else an id."""
        self._need()
        rows = self._frame().where(F.col("bucket_index") == self._bucket(bucket))
        at, named = (lambda i: F.col("entity_index") == int(i)), (lambda u: F.col("unique_id") == u)
        if len(who) == 2 and who[0] in ("--index", "--id"):
            if who[0] == "--index" and not who[1].isdigit():
                raise Refusal("--index takes a number")
            tries = [at(who[1]) if who[0] == "--index" else named(who[1])]
        elif len(who) == 1:
            tries = [at(who[0]), named(who[0])] if who[0].isdigit() else [named(who[0])]
        else:
            raise Refusal("name one entity", "an index or id, --index N or --id ID")
        for wanted in tries:
            found = rows.where(wanted).orderBy("entity_index").first()
            if found is not None:
                return found.asDict(recursive=True)
        raise Refusal(f"no entity {who[-1]} in frame {self.current}")

    def _raw(self, r: dict) -> dict:
        """The slots of an entity whose type the schema doesn't have."""
        entry = next(c for c in self.file.seek_table() if c["start_frame"] <= self.current <= c["end_frame"])
        bucket = self.file.chunk(entry)[self.current - entry["start_frame"]]["data"][r["bucket_index"]]
        return {k: v for k, v in bucket["entities"][r["entity_index"]].items() if k not in ("type_id", "content_hash")}

    def do_entity(self, bucket: str, *who: str):
        r = self._entity(bucket, *who)
        known = r["type_name"] is not None
        properties = {n: r.get(n) for n in self.registry.properties(r["type_name"])} if known else self._raw(r)
        singles = {f.name for f in self.registry.by_name[r["type_name"]].fields if f.type == "Float" and f.container == "None"} if known else set()
        return {"unique_id": r["unique_id"], "type_name": r["type_name"], "properties": {n: Single(v) if n in singles and v is not None else v for n, v in properties.items()}}

    def do_property(self, bucket: str, *rest: str):
        if len(rest) < 2:
            raise Refusal("wrong number of arguments", "property <bucket> <entity> <name>")
        *who, name = rest
        r = self._entity(bucket, *who)
        f = self.registry.field(r["type_name"] or "", name)
        if f is None:
            near = closest(name, self.registry.properties(r["type_name"] or ""))
            raise Refusal(f"no property {name}", f"did you mean {near}?" if near else None)
        return {"unique_id": r["unique_id"], "property": name, "type": f.type, "container": f.container, "value": Single(r[name]) if (f.type, f.container) == ("Float", "None") and r.get(name) is not None else r.get(name)}

    def do_types(self):
        self._need()
        return [{"type_id": s.type_id, "name": s.name, "properties": len(s.fields)} for s in self.registry.structs]

    def do_search(self, prop: str, op: str, value: str, bucket: str | None = None):
        rows = self._need()
        if op not in OPERATORS:
            raise Refusal(f"unknown operator {op}", f"one of {' '.join(OPERATORS)}")
        if prop not in rows.columns:
            near = closest(prop, [f.name for s in self.registry.structs for f in s.fields])
            raise Refusal(f"no type has a property {prop}", f"did you mean {near}?" if near else None)
        found = search(rows, prop, op, value, self.current, None if bucket is None else self._bucket(bucket))
        return [r.asDict() for r in found.select("bucket_index", "entity_index", "unique_id", "type_name", F.col(prop).alias("value")).orderBy("bucket_index", "entity_index").collect()]

    def do_track(self, bucket: str, who: str, prop: str, start: str, end: str, step: str = "1"):
        rows = self._need().where(F.col("bucket_index") == self._bucket(bucket))
        if prop not in rows.columns:
            near = closest(prop, rows.columns)
            raise Refusal(f"no property {prop}", f"did you mean {near}?" if near else None)
        found = track(rows, who, prop, int(start), int(end), int(step)).orderBy("replay_id", "frame_index")
        return [r.asDict() for r in found.drop("unique_id").collect()]

    def do_diff(self, a: str, b: str, flag: str | None = None, epsilon: str = "1e-5"):
        rows = self._need()
        properties = [f.name for s in self.registry.structs for f in s.fields if f.name in rows.columns]
        properties = list(dict.fromkeys(properties))
        at = lambda i: self._at(int(i))
        names = at(a).unionByName(at(b)).groupBy("unique_id").agg(F.max_by("type_name", "frame_index").alias("type_name"))
        patch = diff_frames(at(a), at(b), properties, epsilon=float(epsilon)).cache()
        whole = {r.op: r.n for r in patch.where(F.col("property").isNull()).groupBy("op").agg(F.count("*").alias("n")).collect()}
        changed = summary(patch.where(F.col("property").isNotNull())).join(names, "unique_id", "left").orderBy("unique_id")
        total = patch.count()
        out = {"frame_a": int(a), "frame_b": int(b), "total_ops": total, "added": whole.get("Add", 0), "removed": whole.get("Remove", 0), "changed": [r.asDict() for r in changed.collect()]}
        out["operations"] = [r.asDict() for r in patch.orderBy("unique_id", "property").limit(50).collect()]  # the first ones, as a preview
        patch.unpersist()
        return out
