"""Exact duplicates: frequent digests are settled map-side from a broadcast, the others by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linetrawl.llm.common import stored

#: White space that does not tell texts apart.
IGNORED = " \t\n\x0b\x0c\r"
#: A digest is frequent above this share of all rows, so there are at most ``1 / SUPPORT`` of them.
SUPPORT = 1 / 2000


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.translate(_known(text), IGNORED, ""), "UTF-8"), 256))


def _known(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, id, chars, digest`` of every row, stored: the one place that reads whole texts.

    ``row`` numbers the rows uniquely, so that repeated rows can be told apart.
    """
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"),
        F.char_length(_known(F.col(text))).cast("long").alias("chars"), digest(F.col(text)).alias("digest"))
    return stored(narrow, "digests")


def winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``digest, group_size, best`` of the digests that more than ``support`` of all rows share.

    Misra-Gries counters (``freqItems``) merge from all tasks into at most ``1 / support`` candidates and miss
    none that is frequent; being approximate, they may name others. An exact aggregate, partial in every task,
    verifies them and finds each one's winner: the most characters, then the least id (null last), then the first row. The
    result has fewer than ``1 / support`` rows of constant width, which bounds its broadcast whatever the input.
    """
    keyed = rows.withColumn("key", F.xxhash64("digest"))
    candidates = keyed.stat.freqItems(["key"], support).select(F.explode("key_freqItems").alias("key")).distinct()
    counted = keyed.join(F.broadcast(candidates), "key", "left_semi").groupBy("digest").agg(
        F.count("*").alias("group_size"), F.min(F.struct((-F.col("chars")).alias("size"), F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"))
    frequent = counted.filter((F.col("group_size") > rows.count() * support) & (F.col("group_size") > 1))
    return stored(frequent, "winners")


def mark_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """``<id>, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal if they are identical without the six characters of white space. Of equal texts one row is kept:
    that with the most characters, then the least id (a null id comes last), then any one of equal rows. ``keep_id`` is
    the id of the kept row. A null text counts as empty; all empty texts are equal. An empty table gives no rows, and
    further columns play no part.

    Rows of frequent digests meet the broadcast ``winners`` where they lie and never enter a shuffle. What is left is
    dealt by digest; no digest among it has more than ``support`` of all rows, so no task is hot.
    """
    rows = digests(docs, id, text)
    frequent = winners(rows, support)
    settled = rows.join(F.broadcast(frequent), "digest").select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    order = Window.partitionBy("digest").orderBy(F.desc("chars"), F.asc_nulls_last("id"), "row")
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shuffled = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti").select(
        "id", F.first("id").over(everyone).alias("keep_id"), F.count("*").over(everyone).alias("group_size"),
        (F.first("row").over(everyone) == F.col("row")).alias("kept"), "digest")
    both = settled.unionAll(shuffled)
    return both.select(F.col("id").alias(id), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs``, whole, that ``mark_copies`` keeps.

    Losing rows of frequent digests are removed map-side, before their texts are shuffled. The rest meets in one
    aggregate by digest, partial in every task, which also collapses repeats of a winning row.
    """
    frequent = winners(digests(docs, id, text), support).select("digest", F.col("best.size").alias("size"), F.col("best.id").alias("best_id"))
    size, mine = -F.char_length(_known(F.col(text))).cast("long"), F.col(id)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), size.alias("size"), mine.alias("id"), digest(F.col(text)).alias("digest"))
    joined = whole.alias("w").join(F.broadcast(frequent).alias("f"), "digest", "left")
    staying = joined.filter("f.size IS NULL OR (w.size = f.size AND w.id <=> f.best_id)").select("digest", "w.doc", "w.size", "w.id")
    order = F.struct("size", F.col("id").isNull().alias("no_id"), "id")
    return staying.groupBy("digest").agg(F.min_by("doc", order).alias("doc")).select("doc.*")
