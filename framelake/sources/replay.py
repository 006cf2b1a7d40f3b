"""Recordings in chunked container files as a Spark data source, ``replay``.

A file is: magic, header size, header, then per chunk its size and payload, then footer, footer
size, magic. Payloads may be zstd blobs. Reading splits files by bytes, and small files share a
split; the driver only lists them. A task reads the seek tables of its files and decodes the
chunks that begin in its bytes, one at a time, into Arrow batches; ``frames`` and ``chunks`` skip
all others.
Writing makes one file per recording, chunk by chunk, so a task holds one chunk; files appear
under their names when the job commits, and old ones go only then. Paths may be any that
pyarrow's file systems open (local, hdfs, s3).
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from framelake.schema import SchemaRegistry
from framelake.sources import codec

# Fixed values of the format: magic of either encoding, zstd's own magic, compression level and least size worth compressing.
MAGIC = {"flatbuffers": b"VTXF", "protobuf": b"VTXP"}
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
LEVEL, LEAST_BYTES = 10, 512

KEYS = T.StructType(
    [
        T.StructField("replay_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("frame_index", T.IntegerType()),
        T.StructField("game_time_ticks", T.LongType()), T.StructField("created_utc_ticks", T.LongType()), T.StructField("bucket_index", T.IntegerType()), T.StructField("bucket_name", T.StringType()),
        T.StructField("entity_index", T.IntegerType()), T.StructField("unique_id", T.StringType()), T.StructField("entity_type_id", T.IntegerType()), T.StructField("type_name", T.StringType()), T.StructField("content_hash", T.LongType()),
    ]
)
_SLOTS = {"Bool": "bool_properties", "Int8": "int32_properties", "Int32": "int32_properties", "Enum": "int32_properties", "Int64": "int64_properties", "Float": "float_properties", "Double": "double_properties", "String": "string_properties", "Vector": "vector_properties", "Quat": "quat_properties", "Transform": "transform_properties", "FloatRange": "range_properties", "Struct": "any_struct_properties"}
_ARRAYS = {"Bool": "bool_arrays", "Int8": "byte_array_properties", "Int32": "int32_arrays", "Enum": "int32_arrays", "Int64": "int64_arrays", "Float": "float_arrays", "Double": "double_arrays", "String": "string_arrays", "Vector": "vector_arrays", "Quat": "quat_arrays", "Transform": "transform_arrays", "FloatRange": "range_arrays", "Struct": "any_struct_arrays"}
_EMPTY = {"Bool": False, "Int8": 0, "Int32": 0, "Enum": 0, "Int64": 0, "Float": 0.0, "Double": 0.0, "String": "", "Vector": {"x": 0.0, "y": 0.0, "z": 0.0}, "Quat": {"x": 0.0, "y": 0.0, "z": 0.0, "w": 1.0}, "FloatRange": {"min": 0.0, "max": 0.0, "value_normalized": 0.0},
          "Transform": {"translation": {"x": 0.0, "y": 0.0, "z": 0.0}, "rotation": {"x": 0.0, "y": 0.0, "z": 0.0, "w": 1.0}, "scale": {"x": 1.0, "y": 1.0, "z": 1.0}}, "Struct": {"type_id": -1}}


class ReplayError(ValueError):
    """A file that is no recording, or is torn."""


def inflate(blob: bytes) -> bytes:
    """A blob as it was: compressed ones are told by zstd's magic."""
    if blob[:4] != ZSTD_MAGIC:
        return blob
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(blob)
    except zstandard.ZstdError as e:
        raise ReplayError(f"a compressed block can't be read: {e}") from e


def deflate(blob: bytes, compress: bool = True) -> bytes:
    """Compressed if that is wanted, worth trying and smaller."""
    if not compress or len(blob) < LEAST_BYTES:
        return blob
    out = zstandard.ZstdCompressor(level=LEVEL).compress(blob)
    return out if len(out) < len(blob) else blob


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _codec(backend: str):
    return (codec.encode_tables, codec.decode_tables) if backend == "flatbuffers" else (codec.encode_tagged, codec.decode_tagged)


@dataclass
class ReplayFile:
    """Header, footer and seek table of one file."""

    path: str
    backend: str
    header: dict
    footer: dict

    @classmethod
    def open(cls, path: str) -> ReplayFile:
        try:
            system, inner = file_system(path)
            with system.open_input_file(inner) as f:
                size = f.size()
                magic = f.read(4)
                backend = next((b for b, m in MAGIC.items() if m == magic), None)
                if backend is None:
                    raise ReplayError(f"{path}: no recording")
                raw = f.read(4)
                n = struct.unpack("<I", raw)[0] if len(raw) == 4 else size
                if 8 + n > size:
                    raise ReplayError(f"{path}: the header reaches beyond the file")
                header = f.read(n)
                f.seek(max(0, size - 8))
                tail = f.read(8)
                m = struct.unpack("<I", tail[:4])[0] if len(tail) == 8 else size
                if 16 + n + m > size:
                    raise ReplayError(f"{path}: the footer reaches beyond the file")
                f.seek(size - 8 - m)
                footer = f.read(m)
        except OSError as e:
            raise ReplayError(f"{path}: {e}") from e
        decode = _codec(backend)[1]
        try:
            return cls(path, backend, decode("FileHeader", inflate(header)), decode("FileFooter", inflate(footer)))
        except codec.CodecError as e:
            raise ReplayError(f"{path}: {e}") from e

    @property
    def replay_id(self) -> str:
        return self.header.get("replay_uuid") or self.header.get("replay_name") or os.path.basename(self.path)

    def registry(self) -> SchemaRegistry:
        try:
            return SchemaRegistry.from_json((self.header.get("contextual_schema") or {}).get("schema") or "")
        except ValueError as e:
            raise ReplayError(f"{self.path}: {e}") from e

    def seek_table(self) -> list[dict]:
        keys = ("chunk_index", "start_frame", "end_frame", "file_offset", "chunk_size_bytes")
        return [{k: c.get(k, 0) for k in keys} for c in self.footer.get("chunk_index") or []]

    def chunk(self, entry: dict) -> list[dict]:
        """The frames of one chunk."""
        start, n = entry["file_offset"], entry["chunk_size_bytes"]
        system, inner = file_system(self.path)
        with system.open_input_file(inner) as f:
            if n < 4 or start + n > f.size():
                raise ReplayError(f"{self.path}: chunk {entry['chunk_index']} reaches beyond the file")
            f.seek(start + 4)
            blob = f.read(n - 4)
        try:
            return _codec(self.backend)[1]("Chunk", inflate(blob)).get("frames") or []
        except codec.CodecError as e:
            raise ReplayError(f"{self.path}: {e}") from e


# --- entities and rows


def _sub(array: dict | None, slot: int) -> list | None:
    """Sub-array ``slot`` of a flat array; None where it has none."""
    if not array:
        return None
    offsets = array.get("offsets") or []
    if slot >= len(offsets):
        return None
    data = array.get("data") or []
    return list(data[offsets[slot] : offsets[slot + 1] if slot + 1 < len(offsets) else len(data)])


def _plain(value, registry: SchemaRegistry, struct_name: str):
    if struct_name:
        return unpack(value, registry, struct_name) if value.get("type_id", 0) != -1 or len(value) > 1 else None
    return value


def unpack(entity: dict, registry: SchemaRegistry, struct_name: str) -> dict:
    """Properties of an entity by name; slots that are not there are None."""
    out = {}
    found = registry.by_name.get(struct_name)
    for f in found.fields if found else ():
        value, inner = None, f.struct_type if f.type == "Struct" else ""
        if f.container == "None" and f.type in _SLOTS:
            slots = entity.get(_SLOTS[f.type]) or []
            value = _plain(slots[f.slot], registry, inner) if f.slot < len(slots) else None
        elif f.container == "Array" and f.type in _ARRAYS:
            value = _sub(entity.get(_ARRAYS[f.type]), f.slot)
            if value is not None:
                value = [_plain(v, registry, inner) for v in value]
        elif f.container == "Map":
            maps = entity.get("map_properties") or []
            if f.slot < len(maps):
                m = maps[f.slot]
                value = [{"key": k, "value": _map_value(v, registry, f)} for k, v in zip(m.get("keys") or [], m.get("values") or [], strict=False)]
        out[f.name] = value
    return out


def _map_value(v: dict, registry: SchemaRegistry, f):
    if f.type == "Struct":
        return unpack(v, registry, f.struct_type)
    slots = v.get(_SLOTS.get(f.type, ""), None) or []
    return slots[0] if slots else None


def pack(values: dict, registry: SchemaRegistry, type_id: int, hashed: bool = True) -> dict:
    """The entity that holds these properties; a null scalar is stored as its type's empty value."""
    found = registry.by_id.get(type_id)
    out: dict = {"type_id": type_id}
    for f in found.fields if found else ():
        value, inner = values.get(f.name), f.struct_type if f.type == "Struct" else ""
        nested = lambda v: pack(v, registry, registry.type_id(inner), hashed) if inner else v  # noqa: B023, E731
        if f.container == "None" and f.type in _SLOTS:
            out.setdefault(_SLOTS[f.type], []).append(nested(value) if value is not None else dict(_EMPTY["Struct"]) if inner else _EMPTY[f.type])
        elif f.container == "Array" and f.type in _ARRAYS:
            a = out.setdefault(_ARRAYS[f.type], {"data": [], "offsets": []})
            a["offsets"].append(len(a["data"]))
            a["data"].extend(nested(v) for v in value or [])
        elif f.container == "Map":
            pairs = value or []
            keys = [p["key"] for p in pairs]
            inside = [nested(p["value"]) if inner else {"type_id": -1, _SLOTS[f.type]: [p["value"]]} for p in pairs]
            out.setdefault("map_properties", []).append({"keys": keys, "values": inside})
    if "byte_array_properties" in out:
        out["byte_array_properties"]["data"] = bytes(x & 255 for x in out["byte_array_properties"]["data"])
    if hashed:
        out["content_hash"] = codec.content_hash(out)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def batch_of(replay: ReplayFile, registry: SchemaRegistry, entry: dict, columns: dict, shape: pa.Schema) -> pa.RecordBatch:
    """One chunk's entities as an Arrow batch."""
    times = replay.footer.get("times") or {}
    game, utc = times.get("game_time") or [], times.get("created_utc") or []
    names = {s.type_id: s.name for s in registry.structs}
    keys: list[tuple] = []
    cells: list[list] = [[] for _ in columns]
    wanted = [own for _, own in columns.values()]
    for i, frame in enumerate(replay.chunk(entry)):
        index = entry["start_frame"] + i
        at = (replay.replay_id, entry["chunk_index"], index, game[index] if index < len(game) else None, utc[index] if index < len(utc) else None)
        for b, bucket in enumerate(frame.get("data") or []):
            ids = bucket.get("unique_ids") or []
            where = (*at, b, registry.buckets[b] if b < len(registry.buckets) else None)
            for e, entity in enumerate(bucket.get("entities") or []):
                type_id = entity.get("type_id", 0)
                values = unpack(entity, registry, names.get(type_id, ""))
                keys.append((*where, e, ids[e] if e < len(ids) else None, type_id, names.get(type_id), _signed(entity.get("content_hash", 0))))
                for cell, own in zip(cells, wanted, strict=True):
                    cell.append(values.get(own[type_id].name) if type_id in own else None)
    made = [*(list(c) for c in zip(*keys, strict=True)), *cells] if keys else [[] for _ in shape]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, shape, strict=True)], schema=shape)


def _dicts(value):
    """Spark rows as dicts."""
    if value is None:
        return None
    if isinstance(value, T.Row):
        return {k: _dicts(v) for k, v in value.asDict().items()}
    return [_dicts(v) for v in value] if isinstance(value, list) else value


# --- the data source


def _listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the recordings in a folder, or of a file or pattern."""
    if "://" not in path and any(c in path for c in "*?[") and not os.path.exists(path):
        import glob

        return [(p, os.path.getsize(p)) for p in sorted(glob.glob(path))]
    system, inner = file_system(path)
    head = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        found = [f for f in system.get_file_info(pafs.FileSelector(inner)) if not f.base_name.startswith((".", "_")) and f.base_name.endswith(".replay")]
        return sorted((head + f.path, f.size) for f in found)
    return [(path, info.size or 0)]


def _files(path: str) -> list[str]:
    return [p for p, _ in _listed(path)]


#: Bytes of a split at most, and what opening a file counts as.
SPLIT_BYTES, OPEN_BYTES = 128 << 20, 1 << 16


@dataclass
class Split(InputPartition):
    """Byte ranges of files; a chunk belongs to the range in which it begins."""

    ranges: list[tuple[str, int, int]]


def splits(path: str, parallelism: int = 8, most: int = SPLIT_BYTES) -> list[Split]:
    """Files in splits of about equal bytes: large ones are cut, small ones put together. No file is opened."""
    files = _listed(path)
    total = sum(n + OPEN_BYTES for _, n in files)
    target = max(OPEN_BYTES, min(most, total // max(1, parallelism)))
    out: list[Split] = []
    held, filled = [], 0
    for name, n in files:
        cuts = max(1, round(n / target))
        for i in range(cuts):
            low, high = n * i // cuts, n * (i + 1) // cuts if i + 1 < cuts else max(n, 1)
            if held and filled + high - low + OPEN_BYTES > target:
                out.append(Split(held))
                held, filled = [], 0
            held.append((name, low, high))
            filled += high - low + OPEN_BYTES
    return [*out, Split(held)] if held else out


def chunks_in(split: Split, wanted=None, permissive: bool = False) -> Iterator[tuple[ReplayFile, dict]]:
    """(file, seek entry) of a split's chunks."""
    for path, low, high in split.ranges:
        try:
            replay = ReplayFile.open(path)
        except ReplayError:
            if permissive:
                continue
            raise
        for entry in replay.seek_table():
            if low <= entry["file_offset"] < high and (wanted is None or wanted(entry)):
                yield replay, entry


def _range(options: dict, name: str) -> tuple[float, float]:
    given = options.get(name)
    if not given:
        return float("-inf"), float("inf")
    low, high = given.split(",")
    return float(low), float(high)


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict, columns: dict, registry_text: str):
        self.options, self.columns, self.registry_text = options, columns, registry_text
        self.frames, self.chunks = _range(options, "frames"), _range(options, "chunks")
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def partitions(self) -> Sequence[InputPartition]:
        return splits(self.options["path"], int(self.options.get("parallelism", 8)), int(self.options.get("splitbytes", SPLIT_BYTES))) or [Split([])]

    def _wanted(self, entry: dict) -> bool:
        (low, high), (first, last) = self.frames, self.chunks
        return entry["end_frame"] >= low and entry["start_frame"] <= high and first <= entry["chunk_index"] <= last

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(T.StructType([*KEYS.fields, *[T.StructField(n, kind) for n, (kind, _) in self.columns.items()]]))
        try:
            for replay, entry in chunks_in(partition, self._wanted, self.permissive):
                try:
                    registry = replay.registry()
                    columns = self.columns
                    if registry.text != self.registry_text:  # another schema in this file: its own slots, the table's columns
                        own = registry.columns()
                        columns = {k: own.get(k, (kind, {})) if own.get(k, (kind, {}))[0] == kind else (kind, {}) for k, (kind, _) in self.columns.items()}
                    yield batch_of(replay, registry, entry, columns, shape)
                except ReplayError:
                    if not self.permissive:
                        raise
        except pa.ArrowInvalid as e:
            raise ReplayError(f"a value does not fit its declared type: {e}") from e


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ReplayWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path = options["path"]
        self.backend = options.get("backend", "flatbuffers")
        if self.backend not in MAGIC:
            raise ValueError(f"backend must be one of {sorted(MAGIC)}")
        self.schema_text = options["schema"]
        self.max_frames = int(options.get("maxframes", options.get("maxFrames", 1000)))
        self.max_bytes = int(options.get("maxbytes", options.get("maxBytes", 0)))
        self.compress = str(options.get("compression", "zstd")) != "none"
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        files, out, now = [], None, None
        for row in iterator:
            r = row.asDict()
            if out is None or now != r["replay_id"]:
                if out is not None:
                    out.close()
                now = r["replay_id"]
                name = file_name(now)
                staged = f".{self.job}.{attempt}.{len(files)}.part"
                out = RecordingWriter(f"{self.path.rstrip('/')}/{staged}", self.schema_text, self.backend, now or "", max_frames=self.max_frames, max_bytes=self.max_bytes, compress=self.compress)
                files.append((staged, name))
            out.add_row(r)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        """New files take their names first, each in one step; only then do the ones they replace go."""
        system, inner = file_system(self.path)
        made = {name for m in messages if m for _, name in m.files}
        if made or self.overwrite:
            system.create_dir(inner, recursive=True)
        for m in messages:
            for staged, name in m.files if m else []:
                system.move(f"{inner}/{staged}", f"{inner}/{name}")
        for f in system.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            old = self.overwrite and f.base_name.endswith(".replay") and f.base_name not in made
            if f.type == pafs.FileType.File and (old or f.base_name.startswith(f".{self.job}.")):  # what lost attempts left goes too
                system.delete_file(f.path)

    def abort(self, messages: list) -> None:
        system, inner = file_system(self.path)
        for m in messages:
            for staged, _ in m.files if m else []:
                if system.get_file_info(f"{inner}/{staged}").type == pafs.FileType.File:
                    system.delete_file(f"{inner}/{staged}")


def file_name(replay_id: str | None) -> str:
    """A file name of a recording's id; different ids (null too) have different names."""
    if replay_id is None:
        return "%.replay"
    name = quote(replay_id, safe="")
    if name[:1] in (".", "_", "-", "~"):
        name = f"%{ord(name[0]):02X}{name[1:]}"
    if len(name) > 180:
        name = f"{name[:120]}%-{hashlib.sha256(replay_id.encode('utf-8', 'surrogatepass')).hexdigest()}"
    return f"{name or '%-'}.replay"


class RecordingWriter:
    """One file, written frame by frame. Rows must come by frame, bucket and entity order.

    A chunk ends before it would hold more than ``max_frames`` frames or ``max_bytes`` encoded bytes (0: no such bound); a frame is never split.
    """

    def __init__(self, path: str, schema_text: str, backend: str = "flatbuffers", replay_id: str = "", name: str = "", max_frames: int = 1000, max_bytes: int = 0, compress: bool = True, recorded: int = 0):
        self.registry = SchemaRegistry.from_json(schema_text)
        self.path, self.backend, self.replay_id, self.max_frames, self.max_bytes, self.compress = path, backend, replay_id, max_frames, max_bytes, compress
        self.encode = _codec(backend)[0]
        system, inner = file_system(path)
        self.file = system.open_output_stream(inner)
        self.size = 0
        header = {
            "version": {"format_major": 1, "format_minor": 0, "schema_version": 0},
            "contextual_schema": {"data_identifier": "", "data_version": 0, "data_version_string": self.registry.version, "schema": schema_text},
            "replay_uuid": replay_id or "uuid_placeholder", "replay_name": name or replay_id, "recorded_utc_timestamp": recorded, "custom_json_metadata": "{}",
        }
        blob = deflate(self.encode("FileHeader", header), compress)
        self.file.write(MAGIC[backend] + struct.pack("<I", len(blob)) + blob)
        self.seek: list[dict] = []
        self.frames: list[dict] = []
        self.total = 0
        self.game: list[int] = []
        self.utc: list[int] = []
        self.gaps: list[int] = []
        self.segments: list[int] = []
        self.now: int | None = None
        self.held: dict[int, list[tuple[int, str, dict]]] = {}
        self.closed = False

    def add_row(self, r: dict) -> None:
        if self.now != r["frame_index"]:
            self._end_frame()
            self.now = r["frame_index"]
            self.game.append(r.get("game_time_ticks") or 0)
            self.utc.append(r.get("created_utc_ticks") or 0)
        type_id = r["entity_type_id"] if r.get("entity_type_id") is not None else -1
        own = self.registry.by_id.get(type_id)
        values = {}
        for column, (_, fields) in self._columns().items():
            if type_id in fields:
                values[fields[type_id].name] = _dicts(r.get(column))
        entity = pack(values, self.registry, type_id) if own else {"type_id": type_id}
        self.held.setdefault(r.get("bucket_index") or 0, []).append((type_id, r.get("unique_id") or "", entity))

    def _columns(self) -> dict:
        if not hasattr(self, "_own"):
            self._own = self.registry.columns()
        return self._own

    def _end_frame(self) -> None:
        if self.now is None:
            return
        buckets = []
        for b in range(max(self.held, default=-1) + 1):
            entities = sorted(self.held.get(b, []), key=lambda x: x[0])  # stable: by type, then as given
            known = [t for t, _, _ in entities if t >= 0]
            ranges, start = [], sum(t < 0 for t, _, _ in entities)
            for t in range(max(known, default=-1) + 1):
                n = known.count(t)
                ranges.append({"start_index": start, "count": n})
                start += n
            buckets.append({"unique_ids": [u for _, u, _ in entities], "entities": [e for _, _, e in entities], "type_ranges": ranges})
        frame = {"data": buckets}
        n = len(self.encode("Chunk", {"frames": [frame]})) if self.max_bytes else 0
        if len(self.frames) >= self.max_frames or self.frames and self.size + n > self.max_bytes > 0:
            self.flush()
        self.frames.append(frame)
        self.size += n
        self.total += 1
        self.held, self.now = {}, None

    def flush(self) -> None:
        """Ends the chunk; nothing happens where it is empty."""
        if not self.frames or self.closed:
            return
        blob = deflate(self.encode("Chunk", {"chunk_index": len(self.seek), "frames": self.frames}), self.compress)
        at = self.file.tell()
        self.file.write(struct.pack("<I", len(blob)) + blob)
        self.seek.append({"chunk_index": len(self.seek), "start_frame": self.total - len(self.frames), "end_frame": self.total - 1, "file_offset": at, "chunk_size_bytes": len(blob) + 4})
        self.frames, self.size = [], 0

    def close(self) -> None:
        """Writes the footer; later calls do nothing."""
        if self.closed:
            return
        self._end_frame()
        self.flush()
        for i in range(1, self.total):
            step = self.utc[i] - self.utc[i - 1]
            if i > 1 and step > 3 * max(1, self.utc[1] - self.utc[0]):
                self.gaps.append(i + 1)
            if self.game[i] < self.game[i - 1]:
                self.segments.append(i + 1)
        footer = {"total_frames": self.total, "duration_seconds": (self.utc[-1] - self.utc[0]) / 1e7 if self.utc else 0.0, "times": {"game_time": self.game, "created_utc": self.utc, "gaps": self.gaps, "segments": self.segments}, "chunk_index": self.seek}
        blob = deflate(self.encode("FileFooter", footer), self.compress)
        self.file.write(blob + struct.pack("<I", len(blob)) + MAGIC[self.backend])
        self.file.close()
        self.closed = True


class ReplayDataSource(DataSource):
    """``spark.read.format("replay").load(path)``; options: mode (FAILFAST, PERMISSIVE), frames, chunks (from,to), splitBytes. Writing: backend, schema, maxFrames, maxBytes, compression."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def _first(self) -> SchemaRegistry:
        files = _files(self.options["path"])
        for path in files:
            try:
                return ReplayFile.open(path).registry()
            except ReplayError:
                if self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE":
                    raise
        raise ReplayError(f"no readable recording at {self.options['path']}")

    def schema(self) -> T.StructType:
        return T.StructType([*KEYS.fields, *[T.StructField(n, kind) for n, (kind, _) in self._first().columns().items()]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        registry = self._first()
        return ReplayReader(dict(self.options), registry.columns(), registry.text)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ReplayWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplayDataSource)


def read_replays(spark: SparkSession, path: str, mode: str = "FAILFAST", frames: tuple[int, int] | None = None, chunks: tuple[int, int] | None = None) -> DataFrame:
    """Entities of all recordings of a folder; with ``frames`` or ``chunks`` (from, to) only those, other chunks are not opened.

    The source takes no filters from Spark: sessions refuse such Python sources by default, and where they don't, a
    reader keeps the filters of one query for others over the same DataFrame.
    """
    register(spark)
    rows = spark.read.format("replay").option("mode", mode).option("parallelism", str(spark.sparkContext.defaultParallelism))
    for key, bound in (("frames", frames), ("chunks", chunks)):
        if bound is not None:
            rows = rows.option(key, f"{bound[0]},{bound[1]}")
    out = rows.load(path)
    for name, bound in (("frame_index", frames), ("chunk_index", chunks)):
        if bound is not None:
            out = out.where(F.col(name).between(*bound))
    return out


def write_replays(rows: DataFrame, path: str, schema_text: str, backend: str = "flatbuffers", max_frames: int = 1000, mode: str = "overwrite", compression: str = "zstd", max_bytes: int = 0) -> None:
    """One file per recording. A recording is one ordered file, so one task writes it, holding a chunk at a time."""
    register(rows.sparkSession)
    keys = [c for c in ("frame_index", "bucket_index", "entity_type_id", "unique_id") if c in rows.columns]
    out = rows.repartition("replay_id").sortWithinPartitions("replay_id", *keys)
    out.write.format("replay").option("schema", schema_text).option("backend", backend).option("maxFrames", str(max_frames)).option("maxBytes", str(max_bytes)).option("compression", compression).mode(mode).save(path)


def as_stored(rows: DataFrame, schema_text: str) -> DataFrame:
    """Keys of an entity and its properties as a file gives them back: a null scalar of a type's own property is the property's empty value.

    Properties that a row's type doesn't declare are null.
    """
    columns = {}
    for name, (kind, own) in SchemaRegistry.from_json(schema_text).columns().items():
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        for type_id, f in own.items():
            empty = _EMPTY.get(f.type)
            if f.container == "None" and f.type not in ("Struct", "Transform"):
                filled = F.struct(*[F.lit(v).alias(k) for k, v in empty.items()]) if isinstance(empty, dict) else F.lit(empty)
                value = F.when(F.col("entity_type_id") == type_id, F.coalesce(value, filled.cast(kind))).otherwise(value)
        columns[name] = F.when(F.col("entity_type_id").isin(*own), value).alias(name)
    return rows.select("replay_id", "created_utc_ticks", "unique_id", "entity_type_id", *columns.values())


#: The tables of a recording's metadata.
_METADATA = {
    "header": "replay_id string, backend string, format_major int, format_minor int, replay_name string, recorded_utc_timestamp long, custom_json_metadata string",
    "footer": "replay_id string, total_frames int, duration_seconds double, n_chunks int, n_gaps int, n_segments int",
    "chunks": "replay_id string, chunk_index int, start_frame int, end_frame int, file_offset long, chunk_size_bytes long",
    "events": "replay_id string, game_time double, event_type string, label string, location struct<x:double,y:double,z:double>, entity_unique_id string",
    "times": "replay_id string, frame_index int, game_time_ticks long, created_utc_ticks long",
    "markers": "replay_id string, kind string, marker int, frame_index int",
    "schema": "replay_id string, data_identifier string, data_version int, data_version_string string, schema string",
}


def _metadata_rows(r: ReplayFile, table: str) -> list[tuple]:
    h, t = r.header, r.footer.get("times") or {}
    if table == "header":
        v = h.get("version") or {}
        return [(r.replay_id, r.backend, v.get("format_major", 0), v.get("format_minor", 0), h.get("replay_name"), h.get("recorded_utc_timestamp", 0), h.get("custom_json_metadata"))]
    if table == "footer":
        return [(r.replay_id, r.footer.get("total_frames", 0), float(r.footer.get("duration_seconds", 0.0)), len(r.seek_table()), len(t.get("gaps") or []), len(t.get("segments") or []))]
    if table == "chunks":
        return [(r.replay_id, *c.values()) for c in r.seek_table()]
    if table == "events":
        return [(r.replay_id, float(e.get("game_time", 0.0)), e.get("event_type"), e.get("label"), e.get("location"), e.get("entity_unique_id")) for e in r.footer.get("events") or []]
    if table == "times":
        return [(r.replay_id, i, g, u) for i, (g, u) in enumerate(zip(t.get("game_time") or [], t.get("created_utc") or [], strict=False))]
    if table == "markers":
        return [(r.replay_id, kind, m, m - 1) for kind in ("gaps", "segments") for m in t.get(kind) or []]
    s = h.get("contextual_schema") or {}
    return [(r.replay_id, s.get("data_identifier"), s.get("data_version", 0), s.get("data_version_string"), s.get("schema"))]


def _over_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, over as many partitions as there are cores."""
    names = [(p,) for p in _files(path)]
    return spark.createDataFrame(names, "path string").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))


def metadata(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """header, footer, chunks, events, times, markers and schema of each file, as tables; files are opened by tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    files = _over_files(spark, path)

    def reading(table: str, shape: pa.Schema):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    rows = _metadata_rows(ReplayFile.open(name), table)
                    cells = list(zip(*rows, strict=True)) if rows else [[] for _ in shape]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cells, shape, strict=True)], schema=shape)

        return walk

    return {table: files.mapInArrow(reading(table, to_arrow_schema(T._parse_datatype_string(shape))), shape) for table, shape in _METADATA.items()}


def raw_frames(spark: SparkSession, path: str) -> DataFrame:
    """(replay_id, frame_index, raw): bucket 0 of each frame as encoded bytes of its file's encoding."""
    work = [(i, *r) for i, s in enumerate(splits(path, spark.sparkContext.defaultParallelism)) for r in s.ranges]
    plan = spark.createDataFrame(work, "split int, path string, low long, high long")
    plan = plan.repartition(max(1, work[-1][0] + 1 if work else 1), "split")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for replay, entry in chunks_in(Split([(row["path"], row["low"], row["high"])])):
                    encode = _codec(replay.backend)[0]
                    raw = [encode("Bucket", (f.get("data") or [{}])[0]) for f in replay.chunk(entry)]
                    n = len(raw)
                    yield pa.RecordBatch.from_arrays([pa.array([replay.replay_id] * n, pa.string()), pa.array(range(entry["start_frame"], entry["start_frame"] + n), pa.int32()), pa.array(raw, pa.binary())], names=["replay_id", "frame_index", "raw"])

    return plan.mapInArrow(walk, "replay_id string, frame_index int, raw binary")


def content_hashes(rows: DataFrame, schema_text: str) -> DataFrame:
    """(replay_id, frame_index, unique_id, content_hash): the format's own 64-bit token, computed in Arrow batches."""
    registry = SchemaRegistry.from_json(schema_text)
    columns = registry.columns()
    names = [n for n in columns if n in rows.columns]

    def walk(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                t = r["entity_type_id"] if r["entity_type_id"] is not None else -1
                values = {own[t].name: r[n] for n, (_, own) in columns.items() if t in own and n in r}
                out.append(_signed(codec.content_hash(pack(values, registry, t, hashed=False))))
            yield pa.RecordBatch.from_arrays([batch["replay_id"], batch["frame_index"], batch["unique_id"], pa.array(out, pa.int64())], names=["replay_id", "frame_index", "unique_id", "content_hash"])

    picked = rows.select("replay_id", F.col("frame_index").cast("int"), "unique_id", F.col("entity_type_id").cast("int"), *names)
    return picked.mapInArrow(walk, "replay_id string, frame_index int, unique_id string, content_hash long")
