"""Ticks (10^7 a second), epochs, and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.text import fixed

TICKS_PER_SECOND = 10_000_000
#: Fixed value: ticks from the year 1 to 1970.
UNIX_EPOCH_TICKS = 621_355_968_000_000_000


def whole(value: Column, by: int) -> Column:
    """Integer division that is exact for ticks, which exceed a double's 53 bits."""
    return ((value - F.pmod(value, F.lit(by))) / by).cast("bigint")


def seconds_to_ticks(seconds: Column) -> Column:
    """Single-precision product, cut to a whole number."""
    return (seconds.cast("float") * F.lit(TICKS_PER_SECOND).cast("float")).cast("bigint")


def ticks_to_seconds(ticks: Column) -> Column:
    return ticks / float(TICKS_PER_SECOND)


def to_epoch_ticks(value: Column, form: str) -> Column:
    """Ticks since the year 1 from ``ticks``, ``unix`` seconds, ``unix_ms``, ``seconds`` or ``iso8601``; 0 where unreadable."""
    if form == "ticks":
        return value.cast("bigint")
    if form == "unix":
        return value.cast("bigint") * TICKS_PER_SECOND + UNIX_EPOCH_TICKS
    if form == "unix_ms":
        return value.cast("bigint") * 10_000 + UNIX_EPOCH_TICKS
    if form == "seconds":
        return seconds_to_ticks(value)
    if form == "iso8601":
        read = F.try_to_timestamp(F.substring(value, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
        days = F.datediff(F.to_date(read), F.to_date(F.lit("1970-01-01"))).cast("bigint")
        seconds = days * 86_400 + F.hour(read) * 3600 + F.minute(read) * 60 + F.second(read)
        return F.coalesce(seconds * TICKS_PER_SECOND + UNIX_EPOCH_TICKS, F.lit(0).cast("bigint"))
    return F.lit(0).cast("bigint")


def unix_ticks(ticks: Column) -> Column:
    """Ticks of either epoch as ticks since 1970."""
    return F.when(ticks >= UNIX_EPOCH_TICKS, ticks - UNIX_EPOCH_TICKS).otherwise(ticks)


def duration_parts(ticks: Column) -> dict[str, Column]:
    """Hours, minutes, seconds and milliseconds, rounded half up to the millisecond."""
    ms = whole(ticks + 5_000, 10_000)
    return {"hours": whole(ms, 3_600_000), "minutes": whole(ms % 3_600_000, 60_000), "seconds": whole(ms % 60_000, 1000), "milliseconds": ms % 1000}


def format_duration(ticks: Column) -> Column:
    """Such as ``3h 2m 5s 123ms``; leading zero parts are left out."""
    p = {k: v.cast("string") for k, v in duration_parts(ticks).items()}
    h, m = duration_parts(ticks)["hours"], duration_parts(ticks)["minutes"]
    return F.concat(
        F.when(h > 0, F.concat(p["hours"], F.lit("h "))).otherwise(""),
        F.when((h > 0) | (m > 0), F.concat(p["minutes"], F.lit("m "))).otherwise(""),
        p["seconds"], F.lit("s "), p["milliseconds"], F.lit("ms"),
    )


def format_utc(ticks: Column) -> Column:
    """Such as ``01 Jan 2025 00:00:00.000 UTC``; needs a session in UTC."""
    t = unix_ticks(ticks)
    ms = whole(F.pmod(t, F.lit(TICKS_PER_SECOND)), 10_000)
    return F.concat(F.date_format(F.timestamp_seconds(whole(t, TICKS_PER_SECOND)), "dd MMM yyyy HH:mm:ss"), F.lit("."), F.lpad(ms.cast("string"), 3, "0"), F.lit(" UTC"))


def ticks_text(ticks: Column) -> Column:
    return F.concat(fixed(ticks / float(TICKS_PER_SECOND), 6), F.lit("s"))


def duration_label(seconds: Column) -> Column:
    """Such as ``1h 2m 3s 4ms (3723.0 sec)``; below zero counts as zero."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    ms = F.floor(s * 1000 + 0.5).cast("bigint")
    part = lambda x: F.floor(x).cast("bigint").cast("string")
    return F.concat(part(ms / 3_600_000), F.lit("h "), part(ms % 3_600_000 / 60_000), F.lit("m "), part(ms % 60_000 / 1000), F.lit("s "), (ms % 1000).cast("string"), F.lit("ms ("), fixed(s, 1), F.lit(" sec)"))


def display(ticks: Column, mode: str = "formatted") -> Column:
    """A time as it is shown: ``raw`` ticks, ``formatted`` (UTC where the ticks count from the year 1, else a duration), or ``both``."""
    if mode not in ("raw", "formatted", "both"):
        raise ValueError("mode must be raw, formatted or both")
    raw = ticks.cast("string")
    shown = F.when(ticks >= UNIX_EPOCH_TICKS, format_utc(ticks)).otherwise(format_duration(ticks))
    return raw if mode == "raw" else shown if mode == "formatted" else F.concat(shown, F.lit(" ("), raw, F.lit(")"))
