"""Reading the input tables and the small normalisations that every query shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS_PER_SECOND = 10_000_000
TICKS_PER_DAY = 86_400 * TICKS_PER_SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(column: Column | str) -> Column:
    """Ids are compared and given trimmed and in lower case."""
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column))


def ticks_of(column: Column | str) -> Column:
    """Ticks (10^7 a second since 1970) of a timestamp's calendar reading, whatever the session zone."""
    ts = F.col(column) if isinstance(column, str) else column
    days = F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01"))).cast("bigint")
    seconds = F.hour(ts).cast("bigint") * 3600 + F.minute(ts) * 60
    return days * TICKS_PER_DAY + seconds * TICKS_PER_SECOND + (F.extract(F.lit("SECOND"), ts) * TICKS_PER_SECOND).cast("bigint")


def month_of_ticks(column: Column | str) -> Column:
    ticks = F.col(column) if isinstance(column, str) else column
    day = F.date_add(F.to_date(F.lit("1970-01-01")), ((ticks - F.pmod(ticks, F.lit(TICKS_PER_DAY))) / TICKS_PER_DAY).cast("int"))
    return F.date_format(day, "yyyy-MM")


def is_blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column) == "")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where a scan gives fewer.

    For work that costs far more than a shuffle of its rows. A scan of many files or blocks has
    more partitions than cores already and is left as it is; so is what has been shuffled, whose
    partitions could only be counted by running it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
