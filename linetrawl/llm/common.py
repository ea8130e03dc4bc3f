"""What several operators share: reading tables, tables in the shared folder, ordinals without a hot key."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from linetrawl.workspace import shared_dir

#: A word: a longest run of anything but these six characters of white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Stands for a null id where ids are joined.
NULL_ID = -(2 ** 63)
#: Hashes that order rows lie below this.
SPREAD = 2 ** 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write ``rows`` to the shared folder and read them back: cuts the lineage, survives lost executors."""
    path = shared_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the input: neither is broadcast, whatever size Spark gives it.

    Spark sizes a table by its compressed files, and an array, also once it is exploded, as one element, so what it
    takes for a few MB may be millions of rows, which the driver would hold.
    """
    return left.join(right.hint("merge"), on, how)


@contextlib.contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of jobs that are planned and run within go when their job ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def without(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` without columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return rows.drop(*[c for c in rows.columns if c.lower() in taken])


def spread(*columns: str) -> Column:
    """A hash of the columns, evenly spread over 0 to ``SPREAD`` - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def earlier_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, blocks: int = 4096) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` that come earlier.

    Rows come in the order of the first column of ``order``, which ``spread`` made, then of the others.
    Each key is cut into ``blocks`` (a power of two) ranges of that hash: block sums are a partial
    aggregate, and only one block at a time is sorted, so a key may own any share of the rows.
    """
    cut = rows.withColumn("__block", F.shiftright(F.col(order[0]), 62 - (blocks.bit_length() - 1)))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
        .select(*keys, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("a")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__block"]]
    kept = [F.col(f"a.`{c}`") for c in rows.columns]
    return cut.join(starts.alias("b"), same).select(*kept, (F.col("a.__inside") + F.col("b.__start")).alias(name))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc(value: Column) -> Column:
    """CRC-32 of the value as text; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8"))


def groups(batches, keys: int):
    """Runs of rows with equal leading columns of sorted Arrow batches: ``(key, list of columns)``."""
    held: list[list] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        names = list(zip(*columns[:keys]))
        at = 0
        while at < len(names):
            end = at + 1
            while end < len(names) and names[end] == names[at]:
                end += 1
            if held and tuple(c[0] for c in held[:keys]) != names[at]:
                yield tuple(c[0] for c in held[:keys]), held
                held = []
            held = [h + c[at:end] for h, c in zip(held, columns)] if held else [c[at:end] for c in columns]
            at = end
    if held:
        yield tuple(c[0] for c in held[:keys]), held
