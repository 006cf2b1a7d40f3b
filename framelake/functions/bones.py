"""Transforms in 16 bytes: 41 bits of rotation (smallest three), then position and scale, or a finer position."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Bits per part and the factors between numbers and codes.
ROTATION_SHIFT, ROTATION_FACTOR, ROTATION_UNIT = np.float32(0.707107), np.float32(5791.9103), np.float32(0.000172654)
FINE_UNIT, COARSE_UNIT, SCALE_UNIT = np.float32(0.000000476837), np.float32(0.000015259021), np.float32(0.00392157)


@dataclass(frozen=True)
class BoneSettings:
    position_minimum: float = -10000.0
    position_range: float = 20000.0
    scale_minimum: float = 0.0
    scale_range: float = 10.0
    default_scale: tuple[float, float, float] = (1.0, 1.0, 1.0)
    fine_position: bool = False


def _code(x: np.ndarray, most: int) -> np.ndarray:
    rounded = np.where(x >= 0, np.floor(x + np.float32(0.5)), np.ceil(x - np.float32(0.5)))
    return np.clip(rounded, 0, most).astype(np.uint64)


def pack(translation: np.ndarray, rotation: np.ndarray, scale: np.ndarray, settings: BoneSettings = BoneSettings()) -> np.ndarray:
    """n x 16 bytes from n x 3, n x 4 (x, y, z, w) and n x 3 numbers; numbers out of range take the nearest code."""
    q = rotation.astype(np.float32)
    q = q / np.sqrt((q * q).sum(axis=1, dtype=np.float32))[:, None]
    q = np.where(q[:, 3:4] < 0, -q, q)
    largest = np.abs(q).argmax(axis=1)
    rows = np.arange(len(q))
    q = np.where(q[rows, largest][:, None] < 0, -q, q)
    parts = [_code((q[rows, (largest + k) % 4] + ROTATION_SHIFT) * ROTATION_FACTOR, 8191) for k in (1, 2, 3)]
    low = largest.astype(np.uint64) | parts[0] << np.uint64(2) | parts[1] << np.uint64(15) | parts[2] << np.uint64(28)
    high = np.zeros(len(q), np.uint64)
    span = np.float32(max(1e-4, settings.position_range))
    most = 2097151 if settings.fine_position else 65535
    place = [_code((translation[:, k].astype(np.float32) - np.float32(settings.position_minimum)) * (np.float32(most) * (np.float32(1) / span)), most) for k in range(3)]
    fields = [(p, 21 if settings.fine_position else 16) for p in place]
    if not settings.fine_position:
        factor = np.float32(255) * (np.float32(1) / np.float32(max(1e-4, settings.scale_range)))
        fields += [(_code((scale[:, k].astype(np.float32) - np.float32(settings.scale_minimum)) * factor, 255), 8) for k in range(3)]
    at = 41
    for value, bits in fields:
        if at < 64:
            low = low | value << np.uint64(at)
            if at + bits > 64:
                high = high | value >> np.uint64(64 - at)
        else:
            high = high | value << np.uint64(at - 64)
        at += bits
    return np.stack([low, high], axis=1).astype("<u8").view(np.uint8).reshape(len(q), 16)


def unpack(packed: np.ndarray, settings: BoneSettings = BoneSettings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(translation, rotation, scale) of n x 16 bytes."""
    words = np.ascontiguousarray(packed).reshape(-1, 16).view("<u8")
    low, high = words[:, 0], words[:, 1]

    def field(at: int, bits: int) -> np.ndarray:
        mask = np.uint64((1 << bits) - 1)
        if at >= 64:
            return high >> np.uint64(at - 64) & mask
        value = low >> np.uint64(at)
        return (value | high << np.uint64(64 - at) if at + bits > 64 else value) & mask

    n = len(low)
    index = field(0, 2).astype(int)
    rows = np.arange(n)
    q = np.zeros((n, 4), np.float32)
    for k, at in ((1, 2), (2, 15), (3, 28)):
        q[rows, (index + k) % 4] = field(at, 13).astype(np.float32) * ROTATION_UNIT - ROTATION_SHIFT
    q[rows, index] = np.sqrt(np.maximum(0, 1 - (q * q).sum(axis=1)))
    bits = 21 if settings.fine_position else 16
    unit = np.float32(settings.position_range) * (FINE_UNIT if settings.fine_position else COARSE_UNIT)
    place = np.stack([field(41 + k * bits, bits).astype(np.float32) * unit + np.float32(settings.position_minimum) for k in range(3)], axis=1)
    if settings.fine_position:
        scale = np.tile(np.array(settings.default_scale), (n, 1))
    else:
        scale = np.stack([field(89 + 8 * k, 8).astype(np.float32) * (np.float32(settings.scale_range) * SCALE_UNIT) + np.float32(settings.scale_minimum) for k in range(3)], axis=1)
    return place.astype(float), q, scale.astype(float)


def pack_column(rows: DataFrame, columns: list[str], settings: BoneSettings = BoneSettings()) -> DataFrame:
    """``rows`` (all its columns) with ``packed`` (binary); columns: the ten numbers of a transform; null where any is null."""

    def walk(batches):
        for batch in batches:
            x = np.stack([batch[c].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            ok = ~np.isnan(x).any(axis=1)
            x[~ok] = 1.0
            made = pack(x[:, :3], x[:, 3:7], x[:, 7:], settings)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.tobytes() if k else None for m, k in zip(made, ok, strict=True)], pa.binary())], names=[*batch.schema.names, "packed"])

    from pyspark.sql import types as T

    return rows.mapInArrow(walk, T.StructType([*rows.schema.fields, T.StructField("packed", T.BinaryType())]))
