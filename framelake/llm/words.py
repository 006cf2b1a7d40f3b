"""Word statistics of a corpus of any size, and registers of any size: what memory has no room for stays in a file.

The file is SQLite's, which is read a page at a time and shared by the processes of a machine, so memory doesn't
follow the corpus or the register and nothing is left out.
"""

from __future__ import annotations

import atexit
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Container, Iterable, Iterator, Mapping, Sequence
from itertools import chain, islice
from typing import BinaryIO

from pyspark import SparkContext, SparkFiles

Counts = tuple[int, ...]


def new_file() -> str:
    """A path in a folder of its own, which goes with the process."""
    folder = tempfile.mkdtemp(prefix="framelake-words-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return os.path.join(folder, f"{os.path.basename(folder)}.sqlite")  # Spark tells files by their names


def _opened(path: str) -> sqlite3.Connection:
    """A new file, written without a journal."""
    db = sqlite3.connect(path)
    db.execute("PRAGMA journal_mode = OFF")
    db.execute("PRAGMA synchronous = OFF")
    return db


class Filed:
    """What has a file that goes with it: to the executors, and to where it is saved."""

    def __init__(self, path: str):
        self.path, self._db = path, None

    def _ask(self, sql: str, values: Iterable = ()) -> sqlite3.Cursor:
        if self._db is None:
            path = self.path if os.path.exists(self.path) else SparkFiles.get(os.path.basename(self.path))
            self._db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True, check_same_thread=False)
        return self._db.execute(sql, values)

    def __getstate__(self):
        return self.__dict__ | {"_db": None}

    def share(self, context: SparkContext) -> None:
        """Brings the file to the executors."""
        context.addFile(self.path)

    def write(self, to: BinaryIO) -> None:
        to.write(os.path.getsize(self.path).to_bytes(8))
        with open(self.path, "rb") as f:
            shutil.copyfileobj(f, to)

    def read(self, source: BinaryIO) -> None:
        """Takes its file from ``source``, as ``write`` left it there."""
        self.path, self._db = new_file(), None
        left = int.from_bytes(source.read(8))
        with open(self.path, "wb") as f:
            while left:
                part = source.read(min(left, 1 << 20))
                if not part:
                    raise EOFError("the saved file ends early")
                f.write(part)
                left -= len(part)


class Words(Filed, Mapping[str, Counts]):
    """word -> counts: of ``held`` words in memory, of the others from the file at ``path``."""

    def __init__(self, held: dict[str, Counts], path: str):
        super().__init__(path)
        self.held = held

    @staticmethod
    def of(rows: Iterator[tuple[str, Counts]], max_held: int) -> Mapping[str, Counts]:
        """Words that come once each; the first ``max_held`` are held. A plain dict if these are all."""
        held = dict(islice(rows, max_held))
        more = next(rows, None)
        if more is None:
            return held
        path = new_file()
        with _opened(path) as db:
            db.execute(f"CREATE TABLE words (word TEXT, {', '.join(f'c{i} INTEGER' for i in range(len(more[1])))})")
            db.executemany(f"INSERT INTO words VALUES (?{', ?' * len(more[1])})", ((w, *n) for w, n in chain([more], rows)))
            db.execute("CREATE UNIQUE INDEX by_word ON words (word)")  # sorted at once, on disk
        db.close()
        return Words(held, path)

    def get(self, word: str, default: Counts | None = None) -> Counts | None:
        found = self.held.get(word)
        if found is None:
            row = self._ask("SELECT * FROM words WHERE word = ?", (word,)).fetchone()
            found = default if row is None else row[1:]
        return found

    def __getitem__(self, word: str) -> Counts:
        found = self.get(word)
        if found is None:
            raise KeyError(word)
        return found

    def __contains__(self, word: object) -> bool:
        return self.get(word) is not None

    def __iter__(self) -> Iterator[str]:
        return (w for w, _ in self.items())

    def items(self) -> Iterator[tuple[str, Counts]]:
        yield from self.held.items()
        for row in self._ask("SELECT * FROM words"):
            yield row[0], row[1:]

    def __len__(self) -> int:
        return len(self.held) + self._ask("SELECT count(*) FROM words").fetchone()[0]


class Register(Filed, Sequence[tuple[str, str]]):
    """The (first name, last name) pairs of a register in order, from a file; ``first``, ``last`` and ``last_written`` are its names."""

    def __init__(self, path: str, size: int):
        super().__init__(path)
        self.size = size
        self.first, self.last, self.last_written = (Names(self, t) for t in ("firsts", "lasts", "written"))

    @staticmethod
    def of(pairs: Iterable[tuple[str, str]]) -> Register:
        """Pairs may repeat; names whose other half is empty are names, but no pairs."""
        path = new_file()
        with _opened(path) as db:
            db.create_function("short", 1, lambda name: name[:-1] if len(name) > 2 else name, deterministic=True)
            db.execute("CREATE TEMP TABLE given (f TEXT, l TEXT)")
            db.executemany("INSERT INTO given VALUES (?, ?)", pairs)
            db.execute("CREATE TABLE members (id INTEGER PRIMARY KEY, f TEXT, l TEXT)")
            db.execute("INSERT INTO members (f, l) SELECT DISTINCT f, l FROM given WHERE f <> '' AND l <> '' ORDER BY f, l")
            db.execute("CREATE INDEX by_first ON members (f, l)")
            db.execute("CREATE INDEX by_last ON members (l, f)")
            for table, names in (("firsts", "SELECT f FROM given"), ("lasts", "SELECT l FROM given"), ("written", "SELECT l FROM given UNION SELECT short(l) FROM given")):
                db.execute(f"CREATE TABLE {table} (name TEXT PRIMARY KEY) WITHOUT ROWID")
                db.execute(f"INSERT OR IGNORE INTO {table} {names}")
                db.execute(f"DELETE FROM {table} WHERE name = ''")
            size = db.execute("SELECT count(*) FROM members").fetchone()[0]
        db.close()
        return Register(path, size)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int) -> tuple[str, str]:
        if not -self.size <= at < self.size:
            raise IndexError(at)
        return self._ask("SELECT f, l FROM members WHERE id = ?", (at % self.size + 1,)).fetchone()

    def __iter__(self) -> Iterator[tuple[str, str]]:
        yield from self._ask("SELECT f, l FROM members ORDER BY id")

    def __contains__(self, pair: object) -> bool:
        return self._ask("SELECT 1 FROM members WHERE f = ? AND l = ?", pair).fetchone() is not None

    def lasts_of(self, first: str) -> list[str]:
        return [l for (l,) in self._ask("SELECT l FROM members WHERE f = ?", (first,))]

    def firsts_of(self, last: str) -> list[str]:
        return [f for (f,) in self._ask("SELECT f FROM members WHERE l = ?", (last,))]


class Names(Container[str]):
    """The names in a table of a register."""

    def __init__(self, register: Register, table: str):
        self.register, self.table = register, table

    def __contains__(self, name: object) -> bool:
        return self.register._ask(f"SELECT 1 FROM {self.table} WHERE name = ?", (name,)).fetchone() is not None
