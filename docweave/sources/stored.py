"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.session import scratch


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """``df`` written and read back: lineage ends here, and a lost executor costs no earlier work.

    ``tidy``: what the write has shuffled goes when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, str(tidy or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, path: str, whole_only: bool = True) -> list[str]:
    """Names of the folders below ``path``, those only whose writers have finished; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found = [f.getPath() for f in system.listStatus(place) if f.isDirectory()]
    done = lambda p: system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(p.getName() for p in found if not whole_only or done(p))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
