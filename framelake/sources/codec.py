"""The two encodings of recordings' messages: tables with vtables, and tagged fields.

One description of the messages serves both. Messages are plain dicts; absent fields are left out.
"""

from __future__ import annotations

import struct
from typing import Any

import flatbuffers
import flatbuffers.number_types as N
from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

# Layouts of inline structs, and of tables as (field, type, field number of the tagged encoding) in vtable order.
STRUCTS: dict[str, tuple[str, int, tuple[str, ...]]] = {
    "Vector": ("<3d", 8, ("x", "y", "z")),
    "Quat": ("<4f", 4, ("x", "y", "z", "w")),
    "Transform": ("<3d4f3d", 8, ("translation", "rotation", "scale")),
    "FloatRange": ("<3f", 4, ("min", "max", "value_normalized")),
    "EntityRange": ("<2i", 4, ("start_index", "count")),
}
TABLES: dict[str, list[tuple[str, str, int]]] = {
    "FlatBoolArray": [("data", "[bool]", 1), ("offsets", "[uint]", 2)],
    "FlatBytesArray": [("data", "[ubyte]", 1), ("offsets", "[uint]", 2)],
    "FlatIntArray": [("data", "[int]", 1), ("offsets", "[uint]", 2)],
    "FlatInt64Array": [("data", "[long]", 1), ("offsets", "[uint]", 2)],
    "FlatFloatArray": [("data", "[float]", 1), ("offsets", "[uint]", 2)],
    "FlatDoubleArray": [("data", "[double]", 1), ("offsets", "[uint]", 2)],
    "FlatStringArray": [("data", "[string]", 1), ("offsets", "[uint]", 2)],
    "FlatVectorArray": [("data", "[Vector]", 1), ("offsets", "[uint]", 2)],
    "FlatQuatArray": [("data", "[Quat]", 1), ("offsets", "[uint]", 2)],
    "FlatTransformArray": [("data", "[Transform]", 1), ("offsets", "[uint]", 2)],
    "FlatRangeArray": [("data", "[FloatRange]", 1), ("offsets", "[uint]", 2)],
    "FlatPropertyContainerArray": [("data", "[PropertyContainer]", 1), ("offsets", "[uint]", 2)],
    "FlatMapArray": [("data", "[MapContainer]", 1), ("offsets", "[uint]", 2)],
    "MapContainer": [("keys", "[string]", 1), ("values", "[PropertyContainer]", 2)],
    "PropertyContainer": [
        ("type_id", "int", 1), ("bool_properties", "[bool]", 2), ("int32_properties", "[int]", 3), ("int64_properties", "[long]", 4),
        ("float_properties", "[float]", 5), ("double_properties", "[double]", 6), ("string_properties", "[string]", 7), ("transform_properties", "[Transform]", 8),
        ("vector_properties", "[Vector]", 9), ("quat_properties", "[Quat]", 10), ("range_properties", "[FloatRange]", 11), ("byte_array_properties", "FlatBytesArray", 12),
        ("int32_arrays", "FlatIntArray", 13), ("int64_arrays", "FlatInt64Array", 14), ("float_arrays", "FlatFloatArray", 15), ("double_arrays", "FlatDoubleArray", 16),
        ("vector_arrays", "FlatVectorArray", 17), ("quat_arrays", "FlatQuatArray", 18), ("transform_arrays", "FlatTransformArray", 19), ("range_arrays", "FlatRangeArray", 20),
        ("bool_arrays", "FlatBoolArray", 21), ("string_arrays", "FlatStringArray", 22), ("any_struct_properties", "[PropertyContainer]", 23),
        ("any_struct_arrays", "FlatPropertyContainerArray", 24), ("map_properties", "[MapContainer]", 25), ("map_arrays", "FlatMapArray", 26), ("content_hash", "ulong", 27),
    ],
    "Bucket": [("unique_ids", "[string]", 1), ("entities", "[PropertyContainer]", 2), ("type_ranges", "[EntityRange]", 3)],
    "Frame": [("data", "[Bucket]", 1)],
    "VersionInfo": [("format_major", "uint", 1), ("format_minor", "uint", 2), ("schema_version", "uint", 3)],
    "ContextualSchema": [("data_identifier", "string", 1), ("data_version", "int", 2), ("data_version_string", "string", 3), ("schema", "string", 4)],
    "TimelineEvent": [("game_time", "float", 1), ("event_type", "string", 2), ("label", "string", 3), ("location", "Vector", 4), ("entity_unique_id", "string", 5)],
    "FileHeader": [("version", "VersionInfo", 2), ("contextual_schema", "ContextualSchema", 3), ("replay_uuid", "string", 4), ("replay_name", "string", 5), ("recorded_utc_timestamp", "long", 6), ("custom_json_metadata", "string", 7)],
    "Chunk": [("chunk_index", "int", 1), ("is_compressed", "bool", 2), ("compressed_data", "[ubyte]", 3), ("frames", "[Frame]", 4), ("compressed_frames", "[ubyte]", 5)],
    "ChunkIndexEntry": [("chunk_index", "int", 1), ("start_frame", "int", 2), ("end_frame", "int", 3), ("file_offset", "ulong", 4), ("chunk_size_bytes", "uint", 5)],
    "ReplayTimeData": [("game_time", "[long]", 1), ("created_utc", "[long]", 2), ("gaps", "[int]", 3), ("segments", "[int]", 4)],
    "FileFooter": [("total_frames", "int", 1), ("duration_seconds", "float", 2), ("times", "ReplayTimeData", 3), ("chunk_index", "[ChunkIndexEntry]", 4), ("events", "[TimelineEvent]", 5), ("payload_checksum", "ulong", 6)],
}
#: Fields whose tagged type is not the usual one for their kind.
TAGGED = {("ReplayTimeData", "game_time"): "uint64", ("ReplayTimeData", "created_utc"): "uint64", ("ReplayTimeData", "gaps"): "uint32", ("ReplayTimeData", "segments"): "uint32",
          ("PropertyContainer", "int32_properties"): "sint32", ("PropertyContainer", "int64_properties"): "sint64", ("FlatIntArray", "data"): "sint32", ("FlatInt64Array", "data"): "sint64",
          ("FlatBytesArray", "data"): "bytes*", ("Chunk", "compressed_frames"): "bytes*", ("Chunk", "compressed_data"): "bytes"}
_SCALARS = {"bool": ("<?", N.BoolFlags, "?"), "int": ("<i", N.Int32Flags, "i"), "uint": ("<I", N.Uint32Flags, "I"), "long": ("<q", N.Int64Flags, "q"), "ulong": ("<Q", N.Uint64Flags, "Q"), "float": ("<f", N.Float32Flags, "f"), "double": ("<d", N.Float64Flags, "d"), "ubyte": ("<B", N.Uint8Flags, "B")}


class CodecError(ValueError):
    """Bytes that are no message of the expected kind."""


def _pack(kind: str, value: dict) -> bytes:
    form, _, names = STRUCTS[kind]
    if kind == "Transform":
        flat = [value["translation"][c] for c in "xyz"] + [value["rotation"][c] for c in "xyzw"] + [value["scale"][c] for c in "xyz"]
    else:
        flat = [value[n] for n in names]
    return struct.pack(form, *flat)


def _unpack(kind: str, buffer: bytes, at: int) -> dict:
    form, _, names = STRUCTS[kind]
    v = struct.unpack_from(form, buffer, at)
    if kind == "Transform":
        return {"translation": dict(zip("xyz", v[:3], strict=True)), "rotation": dict(zip("xyzw", v[3:7], strict=True)), "scale": dict(zip("xyz", v[7:], strict=True))}
    return dict(zip(names, v, strict=True))


# --- tables with vtables


def _blob(builder: flatbuffers.Builder, data: bytes, size: int, count: int, align: int) -> int:
    builder.StartVector(size, count, align)
    builder.head -= len(data)
    builder.Bytes[builder.head : builder.head + len(data)] = data
    return builder.EndVector()


def _offsets(builder: flatbuffers.Builder, offsets: list[int]) -> int:
    builder.StartVector(4, len(offsets), 4)
    for o in reversed(offsets):
        builder.PrependUOffsetTRelative(o)
    return builder.EndVector()


def _build(builder: flatbuffers.Builder, name: str, message: dict) -> int:
    made: dict[int, tuple[str, Any]] = {}
    for slot, (f, kind, _) in enumerate(TABLES[name]):
        value = message.get(f)
        if value is None:
            continue
        if kind[0] == "[":
            inner = kind[1:-1]
            if not len(value):
                continue
            if inner in _SCALARS:
                letter = _SCALARS[inner][2]
                size = struct.calcsize("<" + letter)
                data = bytes(value) if inner == "ubyte" else struct.pack(f"<{len(value)}{letter}", *value)
                made[slot] = ("offset", _blob(builder, data, size, len(value), size))
            elif inner == "string":
                made[slot] = ("offset", _offsets(builder, [builder.CreateString(v) for v in value]))
            elif inner in STRUCTS:
                form, align, _ = STRUCTS[inner]
                made[slot] = ("offset", _blob(builder, b"".join(_pack(inner, v) for v in value), struct.calcsize(form), len(value), align))
            else:
                made[slot] = ("offset", _offsets(builder, [_build(builder, inner, v) for v in value]))
        elif kind == "string":
            made[slot] = ("offset", builder.CreateString(value))
        elif kind in TABLES:
            made[slot] = ("offset", _build(builder, kind, value))
        else:
            made[slot] = (kind, value)
    builder.StartObject(len(TABLES[name]))
    for slot, (kind, value) in made.items():
        if kind == "offset":
            builder.PrependUOffsetTRelativeSlot(slot, value, 0)
        elif kind in STRUCTS:
            data = _pack(kind, value)
            builder.Prep(STRUCTS[kind][1], len(data))
            builder.head -= len(data)
            builder.Bytes[builder.head : builder.head + len(data)] = data
            builder.PrependStructSlot(slot, builder.Offset(), 0)
        elif value:
            builder.PrependSlot(_SCALARS[kind][1], slot, value, 0)
    return builder.EndObject()


def encode_tables(name: str, message: dict) -> bytes:
    builder = flatbuffers.Builder(1024)
    builder.Finish(_build(builder, name, message))
    return bytes(builder.Output())


_U16, _U32, _I32 = struct.Struct("<H"), struct.Struct("<I"), struct.Struct("<i")


def _plan(name: str) -> list[tuple]:
    """How each slot of a table is read: (field, kind of reading, what it needs)."""
    out: list[tuple] = []
    for f, kind, _ in TABLES[name]:
        inner = kind.strip("[]")
        if kind == "[ubyte]":
            out.append((f, "bytes", None))
        elif kind[0] == "[":
            how = "scalars" if inner in _SCALARS else "structs" if inner in STRUCTS else "strings" if inner == "string" else "tables"
            out.append((f, how, _SCALARS[inner][2] if how == "scalars" else inner))
        else:
            how = "string" if kind == "string" else "table" if kind in TABLES else "struct" if kind in STRUCTS else "scalar"
            out.append((f, how, struct.Struct(_SCALARS[kind][0]) if how == "scalar" else kind))
    return out


_PLANS = {name: _plan(name) for name in TABLES}
_SIZES = {name: struct.calcsize(form) for name, (form, _, _) in STRUCTS.items()} | {letter: struct.calcsize("<" + letter) for _, _, letter in _SCALARS.values()}


def _string(buffer: bytes, at: int) -> str:
    n = _U32.unpack_from(buffer, at)[0]
    if at + 4 + n > len(buffer):
        raise CodecError("a text reaches beyond the message")
    return str(buffer[at + 4 : at + 4 + n], "utf-8", "replace")


def _read(buffer: bytes, pos: int, name: str) -> dict:
    """A table: its vtable is read at once, and only the slots that are there are looked at."""
    vtable = pos - _I32.unpack_from(buffer, pos)[0]
    if vtable < 0 or pos < 0:
        raise CodecError("a table lies before the message")
    slots = struct.unpack_from(f"<{max(0, (_U16.unpack_from(buffer, vtable)[0] - 4) // 2)}H", buffer, vtable + 4)
    out: dict[str, Any] = {}
    for o, (f, how, inner) in zip(slots, _PLANS[name]):  # noqa: B905
        if not o:
            continue
        at = pos + o
        if how == "scalar":
            out[f] = inner.unpack_from(buffer, at)[0]
            continue
        if how == "struct":
            out[f] = _unpack(inner, buffer, at)
            continue
        at += _U32.unpack_from(buffer, at)[0]
        if how == "string":
            out[f] = _string(buffer, at)
        elif how == "table":
            out[f] = _read(buffer, at, inner)
        else:
            n, start = _U32.unpack_from(buffer, at)[0], at + 4
            if start + n * _SIZES.get(inner, 1) > len(buffer):
                raise CodecError("a vector reaches beyond the message")
            if how == "scalars":
                out[f] = list(struct.unpack_from(f"<{n}{inner}", buffer, start))
            elif how == "structs":
                size = _SIZES[inner]
                out[f] = [_unpack(inner, buffer, start + i * size) for i in range(n)]
            elif how == "bytes":
                out[f] = bytes(buffer[start : start + n])
            else:
                places = struct.unpack_from(f"<{n}I", buffer, start)
                if how == "strings":
                    out[f] = [_string(buffer, start + 4 * i + p) for i, p in enumerate(places)]
                else:
                    out[f] = [_read(buffer, start + 4 * i + p, inner) for i, p in enumerate(places)]
    return out


def decode_tables(name: str, data: bytes) -> dict:
    try:
        return _read(bytes(data), _U32.unpack_from(data, 0)[0], name)
    except CodecError:
        raise
    except Exception as e:  # wherever torn offsets lead
        raise CodecError(f"no {name}: {e}") from e


# --- tagged fields

_PB = {"bool": "TYPE_BOOL", "int": "TYPE_INT32", "uint": "TYPE_UINT32", "long": "TYPE_INT64", "ulong": "TYPE_UINT64", "float": "TYPE_FLOAT", "double": "TYPE_DOUBLE", "string": "TYPE_STRING", "sint32": "TYPE_SINT32", "sint64": "TYPE_SINT64", "uint32": "TYPE_UINT32", "uint64": "TYPE_UINT64", "bytes": "TYPE_BYTES"}
_PB_STRUCTS = {"Vector": [(c, "double") for c in "xyz"], "Quat": [(c, "float") for c in "xyzw"], "Transform": [("translation", "Vector"), ("rotation", "Quat"), ("scale", "Vector")], "FloatRange": [(c, "float") for c in ("min", "max", "value_normalized")], "EntityRange": [("start_index", "int"), ("count", "int")]}
_classes: dict[str, Any] = {}


def _messages() -> dict[str, Any]:
    if not _classes:
        file = descriptor_pb2.FileDescriptorProto(name="framelake_replay.proto", package="framelake_replay", syntax="proto3")
        D = descriptor_pb2.FieldDescriptorProto

        def add(message, name: str, number: int, kind: str, repeated: bool) -> None:
            f = message.field.add(name=name, number=number, label=D.LABEL_REPEATED if repeated else D.LABEL_OPTIONAL)
            if kind in _PB:
                f.type = getattr(D, _PB[kind])
            else:
                f.type, f.type_name = D.TYPE_MESSAGE, f".framelake_replay.{kind}"

        for name, fields in _PB_STRUCTS.items():
            m = file.message_type.add(name=name)
            for i, (f, kind) in enumerate(fields):
                add(m, f, i + 1, kind, False)
        for name, table in TABLES.items():
            m = file.message_type.add(name=name)
            for f, kind, number in table:
                own = TAGGED.get((name, f))
                inner = own.rstrip("*") if own else kind.strip("[]")
                add(m, f, number, inner, own.endswith("*") if own and inner == "bytes" else kind[0] == "[")
        pool = descriptor_pool.DescriptorPool()
        pool.Add(file)
        for name in [*_PB_STRUCTS, *TABLES]:
            _classes[name] = message_factory.GetMessageClass(pool.FindMessageTypeByName(f"framelake_replay.{name}"))
    return _classes


def _fill(message: Any, name: str, value: dict) -> None:
    if name in _PB_STRUCTS:
        for f, kind in _PB_STRUCTS[name]:
            if kind in _PB_STRUCTS:
                _fill(getattr(message, f), kind, value[f])
            else:
                setattr(message, f, value[f])
        return
    for f, kind, _ in TABLES[name]:
        v = value.get(f)
        if v is None:
            continue
        own, inner = TAGGED.get((name, f)), kind.strip("[]")
        if own == "bytes*":
            getattr(message, f).append(bytes(v))
        elif own == "bytes":
            setattr(message, f, bytes(v))
        elif kind[0] == "[":
            if inner in _PB:
                getattr(message, f).extend(v)
            else:
                for item in v:
                    _fill(getattr(message, f).add(), inner, item)
        elif kind in _PB:
            setattr(message, f, v)
        else:
            getattr(message, f).SetInParent()
            _fill(getattr(message, f), kind, v)


def _dump(message: Any, name: str) -> dict:
    if name in _PB_STRUCTS:
        return {f: _dump(getattr(message, f), kind) if kind in _PB_STRUCTS else getattr(message, f) for f, kind in _PB_STRUCTS[name]}
    out: dict[str, Any] = {}
    for f, kind, _ in TABLES[name]:
        own, inner = TAGGED.get((name, f)), kind.strip("[]")
        v = getattr(message, f)
        if own == "bytes*":
            if len(v):
                out[f] = b"".join(v)
        elif own == "bytes":
            if v:
                out[f] = v
        elif kind[0] == "[":
            if len(v):
                out[f] = list(v) if inner in _PB else [_dump(x, inner) for x in v]
        elif kind in _PB:
            if v:
                out[f] = v
        elif message.HasField(f):
            out[f] = _dump(v, kind)
    return out


def encode_tagged(name: str, message: dict) -> bytes:
    out = _messages()[name]()
    _fill(out, name, message)
    return out.SerializeToString()


def decode_tagged(name: str, data: bytes) -> dict:
    message = _messages()[name]()
    try:
        message.ParseFromString(data)
    except Exception as e:
        raise CodecError(f"no {name}: {e}") from e
    return _dump(message, name)


# --- the equality token of an entity's content


def content_hash(entity: dict) -> int:
    """64-bit hash over an entity's bytes: type, scalars, arrays with offsets, nested entities by their own hashes."""
    import xxhash

    h = xxhash.xxh3_64()
    h.update(struct.pack("<i", entity.get("type_id", 0)))
    simple = {"bool_properties": "?", "int32_properties": "i", "int64_properties": "q", "float_properties": "f", "double_properties": "d"}
    for f, letter in simple.items():
        v = entity.get(f) or []
        h.update(struct.pack(f"<{len(v)}{letter}", *v))
    for s in entity.get("string_properties") or []:
        h.update(s.encode())
    for f, kind in (("transform_properties", "Transform"), ("vector_properties", "Vector"), ("quat_properties", "Quat"), ("range_properties", "FloatRange")):
        for v in entity.get(f) or []:
            h.update(_pack(kind, v))

    def ragged(f: str, write) -> None:
        a = entity.get(f)
        if a and a.get("data"):
            for v in a["data"] if not isinstance(a["data"], bytes) else [a["data"]]:
                write(v)
            h.update(struct.pack(f"<{len(a.get('offsets') or [])}I", *(a.get("offsets") or [])))

    def entries(m: dict) -> None:
        for k in m.get("keys") or []:
            h.update(k.encode())
        for v in m.get("values") or []:
            h.update(struct.pack("<Q", content_hash(v)))

    nested = lambda v: h.update(struct.pack("<Q", content_hash(v)))
    ragged("byte_array_properties", h.update)
    for f, letter in (("int32_arrays", "<i"), ("int64_arrays", "<q"), ("float_arrays", "<f"), ("double_arrays", "<d")):
        ragged(f, lambda v, letter=letter: h.update(struct.pack(letter, v)))
    for v in entity.get("any_struct_properties") or []:
        nested(v)
    ragged("any_struct_arrays", nested)
    for m in entity.get("map_properties") or []:
        entries(m)
    ragged("map_arrays", entries)
    for f, kind in (("vector_arrays", "Vector"), ("quat_arrays", "Quat"), ("transform_arrays", "Transform"), ("range_arrays", "FloatRange")):
        ragged(f, lambda v, kind=kind: h.update(_pack(kind, v)))
    ragged("bool_arrays", lambda v: h.update(struct.pack("<?", v)))
    ragged("string_arrays", lambda v: h.update(v.encode()))
    return h.intdigest()
