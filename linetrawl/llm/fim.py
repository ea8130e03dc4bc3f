"""Fill-in-the-middle: texts cut into prefix, middle and suffix by one match of a pattern made for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linetrawl.functions.text import quote_literal
from linetrawl.llm.common import without

#: A token: a longest run of ASCII letters, or any other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Add ``n, form, fim`` to documents.

    ``n`` is the number of tokens of the text. Four numbers h1 to h4 come from the SHA-256 of seed and id; the
    prefix ends after the smaller, the middle after the larger of h1 and h2 modulo n + 1 tokens. ``form`` is
    ``plain`` for empty texts, texts that hold a mark and ``plain_percent`` of the others (by h3); else ``spm``
    for ``spm_percent`` (by h4), else ``psm``. ``fim`` is the text in that form.

    ``n`` counts the pattern's matches; each row then has a pattern of its own, in which a possessive group takes
    exactly as many tokens as the prefix has and a second one those of the middle, so one match captures all
    three parts and its replacement is the result. Possessive groups neither backtrack nor recurse: time is linear
    in the text and the stack does not grow with it. Rows are independent, so there is no shuffle.

    Null text counts as empty, a null id as the empty string; equal rows get equal results. An empty
    table gives no rows. Columns of the added names are replaced, all others kept.
    """
    kept = without(docs, "n", "form", "fim")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"), 256)
    numbers = F.array(*[F.conv(F.substring(F.col("__digest"), 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    counted = docs.select(*[f"`{c}`" for c in kept.columns], text.alias("__text"), digest.alias("__digest")).select(
        "*", F.regexp_count("__text", F.lit(UNIT)).cast("long").alias("n"), numbers.alias("__h"))
    cuts = [F.col("__h")[i] % (F.col("n") + 1) for i in (0, 1)]
    ends = F.array(F.least(*cuts), F.greatest(*cuts))
    marked = (F.col("__text") == "") | F.col("__text").rlike("|".join(map(quote_literal, marks)))
    form = F.when(marked | (F.col("__h")[2] % 100 >= 100 - plain_percent), "plain").when(F.col("__h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    formed = counted.select("*", form.alias("form"), ends.alias("__ends"))
    return formed.select(*[f"`{c}`" for c in kept.columns], "n", "form", _rewritten(F.col("__ends"), marks).alias("fim"))


def _rewritten(ends: Column, marks: tuple[str, str, str]) -> Column:
    pattern = F.concat(
        F.lit(r"(?s)\A((?:[A-Za-z]++|[^A-Za-z]){"), ends[0].cast("string"), F.lit(r"}+)((?:[A-Za-z]++|[^A-Za-z]){"),
        (ends[1] - ends[0]).cast("string"), F.lit(r"}+)(.*)\z"))
    p, s, m = (mark.replace("\\", "\\\\").replace("$", "\\$") for mark in marks)
    shape = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    return F.when(F.col("form") == "plain", F.col("__text")).otherwise(F.regexp_replace(F.col("__text"), pattern, shape))


def parts(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Add ``prefix, middle, suffix``, read back from ``form`` and ``fim`` alone; null where the form is plain.

    A text in another form holds no mark itself, and none can arise where a mark meets a text, so
    the marks of ``fim`` are its cuts.
    """
    rows = without(rows, "prefix", "middle", "suffix")
    pieces = F.when(F.col("form") != "plain", F.split("fim", "|".join(map(quote_literal, marks)), -1))
    cut = rows.withColumn("__pieces", pieces)
    first, second = F.get("__pieces", F.lit(1)), F.get("__pieces", F.lit(2))
    spm = F.col("form") == "spm"
    return cut.select(
        *[f"`{c}`" for c in rows.columns], F.when(spm, second).otherwise(first).alias("prefix"),
        F.get("__pieces", F.lit(3)).alias("middle"), F.when(spm, first).otherwise(second).alias("suffix"))


def restore(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Add ``restored``, the exact text, to rows with ``form`` and ``fim``, and the ``parts``."""
    cut = parts(without(rows, "restored"), marks)
    return cut.withColumn("restored", F.when(F.col("form") == "plain", F.col("fim")).otherwise(F.concat("prefix", "middle", "suffix")))
