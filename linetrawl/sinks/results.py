"""Writing result tables: a partition per run, and a fixed place for the latest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_run(table: DataFrame, root: str, slug: str, latest: str | None = None, format: str = "parquet") -> DataFrame:
    """Write ``table`` below ``root/run_ts=<slug>`` and mirror it to ``latest``.

    The mirror is read back from the run just written, so the query behind ``table`` runs once. It is
    skipped when both names are the same place.
    """
    spark = table.sparkSession
    target = f"{root.rstrip('/')}/run_ts={slug}"
    table.write.mode("overwrite").format(format).save(target)
    written = spark.read.format(format).schema(table.schema).load(target)
    if latest and latest.rstrip("/") != target:
        written.write.mode("overwrite").format(format).save(latest)
    return written


def read_runs(spark: SparkSession, root: str, format: str = "parquet") -> DataFrame:
    """All runs with their ``run_ts``."""
    return spark.read.format(format).option("basePath", root).load(f"{root.rstrip('/')}/run_ts=*").withColumn(
        "run_ts", F.col("run_ts").cast("string"))
