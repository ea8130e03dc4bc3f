"""Time-varying curriculum: sources mixed to target weights along a training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linetrawl.llm.common import earlier_sum, without, word_count

EPOCHS = 3


def place(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ramp: float = 0.5) -> DataFrame:
    """Add ``size, source_size, target, taken, takes`` to documents.

    Size counts words (null text: 0). Sources in code point order, null last, weigh ``weights`` in
    turn and share the words of the whole table; a source's target stops at ``EPOCHS`` times its size
    and the excess goes to the others by weight until none is above. ``taken`` are the words of the
    document that the mix takes, repeats counted: a source is read in the order of an MD5 of the id,
    again and again, until its target, rounded down, is met, so its last document may be cut.

    Each source has a weight schedule over the run, time 0 to 1: a line of mean 1 that rises by
    ``ramp`` (odd ranks) or falls by it (even ranks) from the middle to the ends. Its integral is the source's
    cumulative demand; where demand passes a document's first word lies its training position.
    ``takes`` lists ``(epoch, words, position)``, empty if the document is not taken.

    A null id counts as empty text in the order; equal rows are interchangeable; documents without words are
    never taken. An empty table gives no rows. Columns of the added names are replaced.
    """
    docs = without(docs, "size", "source_size", "target", "taken", "takes")
    sized = docs.withColumn("__words", word_count(F.col("text")))
    targets = _targets(sized.groupBy("source").agg(F.sum("__words").alias("__source_size")), weights, ramp)
    digest = F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    order = F.shiftrightunsigned(F.conv(F.substring(digest, 1, 16), 16, -10).cast("long"), 2)
    sized = sized.withColumns({"__order": order, "__digest": digest})
    begins = earlier_sum(sized, ["source"], ["__order", "__digest", "__words"], "__words", "__begin").alias("a")
    placed = begins.join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select("a.*", "__source_size", "__target", "__slope")
    budget = F.floor("__target").cast("long")
    epoch = lambda e: F.col("__begin") + F.lit(e) * F.col("__source_size")
    words = lambda e: F.greatest(F.lit(0), F.least(F.col("__words"), budget - epoch(e)))
    takes = F.filter(F.array(*[
        F.struct(F.lit(e).alias("epoch"), words(e).cast("long").alias("words"), _time(F.try_divide(epoch(e), F.col("__target")), F.col("__slope")).alias("position"))
        for e in range(EPOCHS)]), lambda t: t["words"] > 0)
    placed = placed.withColumn("takes", takes)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    return placed.select(
        *[f"`{c}`" for c in docs.columns], F.col("__words").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), taken.alias("taken"), "takes")


def _targets(sources: DataFrame, weights: tuple[int, ...], ramp: float) -> DataFrame:
    """Per source (one row each): target and slope. The sources that stop are those first in ``size / weight``."""
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    ranked = sources.withColumn("__rank", F.row_number().over(everyone) - 1)
    ranked = ranked.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")))
    cap = F.col("__source_size") * EPOCHS
    filling = Window.orderBy(F.col("__source_size") / F.col("__weight"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "__whole": F.sum("__source_size").over(total),
        "__full": F.coalesce(F.sum(cap).over(filling), F.lit(0)),
        "__left": F.sum("__weight").over(total) - F.coalesce(F.sum("__weight").over(filling), F.lit(0)),
    })
    level = (F.col("__whole") - F.col("__full")) / F.col("__left")
    ranked = ranked.withColumns({"__stops": level * F.col("__weight") >= cap, "__level": level})
    level = F.max(F.when(~F.col("__stops"), F.col("__level"))).over(total)
    return ranked.select(
        "source", "__source_size", F.when(F.col("__stops"), cap.cast("double")).otherwise(level * F.col("__weight")).alias("__target"),
        F.when(F.col("__rank") % 2 == 0, F.lit(ramp)).otherwise(F.lit(-ramp)).alias("__slope"))


def _time(share: Column, slope: Column) -> Column:
    """When a source with weight ``1 + slope * (2t - 1)`` has met ``share`` of its demand ``t + slope * (t*t - t)``."""
    start = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(start * start + 4 * slope * share) - start) / (2 * slope))


def schedule(placed: DataFrame, partitions: int | None = None, keep_untaken: bool = False) -> DataFrame:
    """One row per take, with its words and position, range-sorted into training order.

    With ``keep_untaken`` documents that are not taken follow at the end, with a null take.
    """
    unfold = F.explode_outer if keep_untaken else F.explode
    takes = without(placed, "take").withColumn("take", unfold("takes")).drop("takes")
    keys = [F.col("take.position").asc_nulls_last(), F.col("source"), F.col("doc_id")]
    ranged = takes.repartitionByRange(partitions, *keys) if partitions else takes.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)
