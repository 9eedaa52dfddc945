"""Typed access to the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import prepare


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table; zone-less timestamps become TIMESTAMP, read as UTC.

    Watermarks and ``unix_micros`` reject the zone-less type, so the cast happens once, here.
    """
    prepare(spark)
    df = spark.read.parquet(f"{base}/{name}.parquet")
    casts = {
        f.name: F.col(f.name).cast(T.TimestampType())
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


# Only set where all tables are known to be small, as in tests and the benchmark.
INPUT_PARTITIONS = "spark.docweave.inputPartitions"
WAVES = 4  # of tasks for every core, or for every part that a scan would cut from the files


def partitions(df: DataFrame) -> int:
    """Into how many parts an input is dealt out: what the session asks for, or enough for all cores and its bytes."""
    spark = df.sparkSession
    wanted = spark.conf.get(INPUT_PARTITIONS, None)
    if wanted:
        return int(wanted)
    return WAVES * max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table dealt out by its key.

    What a scan gives a task follows the bytes of the files, at worst a whole file of one row group. What is
    rendered from a row, and the patterns tried on it, take thousands of times longer than to move it.
    """
    return df.repartition(partitions(df), *keys)
