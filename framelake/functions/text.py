"""Texts: nearest names, labels, value texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def _distance(a: str, b: str) -> int:
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def closest(word: str, names: Iterable[str], most: int = 3) -> str | None:
    """The nearest name within ``most`` edits; of equals the first."""
    best, distance = None, most + 1
    for name in names:
        d = _distance(word, name)
        if d < distance:
            best, distance = name, d
    return best


def type_label(type_id: Column, name: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Type_"), type_id.cast("string")))


def range_text(start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("]"))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact value, ties to even (as printf does, and the JVM's formats don't).

    The product with 10^digits is taken with its rounding error, so values that only look like ties are told apart.
    Exact below 2^53 after scaling; beyond that doubles have no decimals.
    """
    x = x.cast("double")
    a, s = F.abs(x), 10.0**digits
    half = 134_217_729.0  # splits a double into two of 26 bits
    p = a * s
    a1 = half * a - (half * a - a)
    a2 = a - a1
    s1 = half * s - (half * s - s)
    s2 = s - s1
    lost = ((a1 * s1 - p) + a1 * s2 + a2 * s1) + a2 * s2
    down = F.floor(p).cast("double")
    over = (p - down - 0.5) + lost
    n = (down + F.when((over > 0) | (over == 0) & (down % 2 == 1), 1.0).otherwise(0.0)).cast("decimal(38,0)")
    base = F.lit(10**digits).cast("decimal(38,0)")
    plain = n.cast("string") if not digits else F.concat(F.floor(n / base).cast("string"), F.lit("."), F.lpad((n % base).cast("bigint").cast("string"), digits, "0"))
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(F.isnan(x), "nan").when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(x.isNotNull(), F.concat(sign, plain))


def numbers(open_: str, parts: list[Column], digits: int, by: str, close: str) -> Column:
    """Several ``fixed`` numbers between brackets; null where one is."""
    cells = [c for p in parts for c in (F.lit(by), fixed(p, digits))][1:]
    return F.concat(F.lit(open_), *cells, F.lit(close))


def size_label(n_bytes: Column) -> Column:
    """MB or KB with two decimals, or bytes."""
    return (
        F.when(n_bytes >= 1 << 20, F.concat(fixed(n_bytes / float(1 << 20), 2), F.lit(" MB")))
        .when(n_bytes >= 1 << 10, F.concat(fixed(n_bytes / 1024.0, 2), F.lit(" KB")))
        .otherwise(F.concat(n_bytes.cast("string"), F.lit(" B")))
    )


def _general(x: Column) -> Column:
    """Six significant digits without trailing zeros, as printf's %g gives for usual magnitudes."""
    x = x.cast("double")
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(x)))).cast("int")
    shift = F.pow(F.lit(10.0), digits)
    fixed = F.rint(x * shift) / shift
    plain = F.when(fixed == F.floor(fixed), fixed.cast("decimal(20,0)").cast("string")).otherwise(F.regexp_replace(F.format_string("%.12f", fixed), r"\.?0+$", ""))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, "0").otherwise(plain)


def value_text(column: Column, kind: T.DataType) -> Column:
    """The canonical text of a scalar; vectors with two decimals; other kinds and null give ''."""
    if isinstance(kind, T.BooleanType):
        text = F.when(column, "true").otherwise("false")
    elif isinstance(kind, T.StringType):
        text = column
    elif isinstance(kind, (T.IntegerType, T.LongType)):
        text = column.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = _general(column)
    elif isinstance(kind, T.StructType) and [f.name for f in kind.fields] == ["x", "y", "z"]:
        text = numbers("(", [column[c] for c in "xyz"], 2, ",", ")")
    elif isinstance(kind, T.StructType) and [f.name for f in kind.fields] == ["x", "y", "z", "w"]:
        text = numbers("(", [column[c] for c in "xyzw"], 4, ",", ")")
    elif isinstance(kind, T.StructType) and [f.name for f in kind.fields][:2] == ["min", "max"]:
        text = F.concat(F.lit("["), _general(column["min"]), F.lit("-"), _general(column["max"]), F.lit("]"))
    elif isinstance(kind, T.StructType) and [f.name for f in kind.fields][:1] == ["translation"]:
        t = column["translation"]
        text = numbers("T(", [t[c] for c in "xyz"], 2, ",", ")")
    else:
        return F.lit("")
    return F.coalesce(F.when(column.isNotNull(), text), F.lit(""))


def path_generation(path: str) -> str:
    """The next-version name of a schema file: ``a.json`` -> ``a_v2.json``, ``a_v2.json`` -> ``a_v3.json``."""
    import re

    stem, dot, end = path.rpartition(".")
    stem, end = (stem, dot + end) if dot else (path, "")
    m = re.search(r"_v(\d+)$", stem)
    return f"{stem[: m.start()]}_v{int(m.group(1)) + 1}{end}" if m else f"{stem}_v2{end}"
