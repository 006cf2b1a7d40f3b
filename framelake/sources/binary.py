"""Raw binary layouts: a bounds-checked cursor and a scan of binary files through it."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_FORMS = {"i8": "b", "u8": "B", "i16": "h", "u16": "H", "i32": "i", "u32": "I", "i64": "q", "u64": "Q", "f32": "f", "f64": "d", "bool": "?"}


class BinaryCursor:
    """Reads values one after another; going beyond either end raises EOFError and does not move."""

    def __init__(self, data: bytes, big_endian: bool = False):
        self.data, self.at, self.order = memoryview(data), 0, ">" if big_endian else "<"

    def tell(self) -> int:
        return self.at

    def size(self) -> int:
        return len(self.data)

    def remaining(self) -> int:
        return len(self.data) - self.at

    def eof(self) -> bool:
        return self.at >= len(self.data)

    def _need(self, n: int) -> None:
        if n < 0 or self.at + n > len(self.data):
            raise EOFError(f"{n} bytes at {self.at} reach beyond {len(self.data)}")

    def seek(self, position: int) -> None:
        if not 0 <= position <= len(self.data):
            raise EOFError(f"no position {position}")
        self.at = position

    def skip(self, n: int) -> None:
        self._need(n)
        self.at += n

    def align_to(self, n: int) -> None:
        """Moves on to the next multiple of n."""
        self.skip(-self.at % n)

    def read(self, kind: str, big_endian: bool | None = None):
        form = (self.order if big_endian is None else ">" if big_endian else "<") + _FORMS[kind]
        n = struct.calcsize(form)
        self._need(n)
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += n
        return value

    def read_bytes(self, n: int) -> bytes:
        self._need(n)
        out = bytes(self.data[self.at : self.at + n])
        self.at += n
        return out

    def read_string(self, n: int) -> str:
        return self.read_bytes(n).decode("utf-8", "replace")

    def read_c_string(self) -> str:
        """Up to a zero byte, which is passed over."""
        end = bytes(self.data[self.at :]).find(0)
        if end < 0:
            raise EOFError("no zero byte")
        text = self.read_string(end)
        self.at += 1
        return text

    def read_len_string(self, kind: str = "u16") -> str:
        """A length, then as many bytes; where they are not there the cursor stays before the length."""
        start = self.at
        n = self.read(kind)
        try:
            return self.read_string(n)
        except EOFError:
            self.at = start
            raise

    def read_vector(self, kind: str = "f64") -> dict:
        return {c: float(self.read(kind)) for c in "xyz"}

    def sub_cursor(self, n: int) -> BinaryCursor:
        """A cursor over the next n bytes, which this one passes over."""
        return BinaryCursor(self.read_bytes(n), self.order == ">")


def scan_binary(spark: SparkSession, path: str, schema: str, decode: Callable[[BinaryCursor], Iterator[dict]], big_endian: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Rows that ``decode`` makes of each file, one task per group of files; PERMISSIVE leaves out torn files' rests."""
    import pyspark.sql.types as T

    kinds = T._parse_datatype_string(schema)
    arrow = spark.createDataFrame([], kinds).toArrow().schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                try:
                    for row in decode(BinaryCursor(content.as_py(), big_endian)):
                        rows.append(row)
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                except EOFError:
                    if mode.upper() != "PERMISSIVE":
                        raise
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(walk, kinds)
