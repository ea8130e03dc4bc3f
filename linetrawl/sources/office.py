"""Office packages as segments: the meaning of the unpacked items, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linetrawl.functions import locators
from linetrawl.functions.paths import basename, resolve_target
from linetrawl.functions.similarity import WHITESPACE
from linetrawl.functions.text import is_blank
from linetrawl.sources import packages

# Relationship types that tie a sheet to its drawing and comment parts.
REL_DRAWING = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/drawing"
REL_COMMENTS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments"
REL_THREADS = "http://schemas.microsoft.com/office/2017/10/relationships/threadedComment"
SEGMENT_COLUMNS = ["path", "idx", "kind", "locator", "text"]


def xlsx_parts(files: DataFrame) -> DataFrame:
    """Item rows of workbooks; damaged containers give none."""
    return packages.unpack(files, packages.read_workbook).filter(F.col("kind") != "error")


def segment_order(part: Column, row: Column, item: Column) -> Column:
    """A sparse, increasing segment number built inside the row, so no file needs a global sort."""
    return (F.shiftleft(part.cast("bigint"), 37)
            + F.shiftleft(F.coalesce(row, F.lit(0)).cast("bigint"), 15)
            + F.coalesce(item, F.lit(0)).cast("bigint"))


def xlsx_segments(parts: DataFrame, granularity: str = "cell") -> DataFrame:
    """Segments of :func:`xlsx_parts`: sheet names, cells or rows, shapes, charts and comments.

    One spreadsheet row arrives as one row with its cells, so both granularities, and the lookups
    of sheet, author and person, are expressions on that row: nothing is shuffled.
    """
    keys = ["path", "part_ord", "part", "kind", "sheet", "row", "links", "people", "authors"]
    if granularity == "row":
        filled = F.filter("items", lambda i: i["text"].isNotNull() & (i["text"] != ""))
        joined = F.when(F.size(filled) > 0, F.array(F.struct(
            F.lit(0).alias("ord"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("who"),
            F.lit(None).cast("string").alias("parent"),
            F.array_join(F.transform(filled, lambda i: i["text"]), "\t").alias("text"),
        )))
        parts = parts.withColumn("items", F.when(F.col("kind") == "row", joined).otherwise(F.col("items")))
    named = F.struct(
        F.lit(0).alias("ord"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("who"), F.lit(None).cast("string").alias("parent"),
        F.col("sheet").alias("text"),
    )
    items = F.when(F.col("kind") == "sheet", F.array(named)).otherwise(F.col("items"))
    flat = parts.select(*keys, F.explode(items).alias("i")).select(*keys, "i.*")

    rel_type = (
        F.when(F.col("kind").isin("shape", "graphic"), REL_DRAWING)
        .when(F.col("kind") == "comment", REL_COMMENTS)
        .when(F.col("kind") == "thread", REL_THREADS)
    )
    owners = F.filter("links", lambda l: (l["type"] == rel_type)
                      & (resolve_target(l["base"], l["target"]) == F.lower("part")))
    owner = F.coalesce(F.col("sheet"), F.get(owners, F.size(owners) - 1)["sheet"], F.lit(""))
    who = (
        F.when(F.col("kind") == "comment", F.get("authors", F.col("who").try_cast("int")))
        .when(F.col("kind") == "thread", F.try_element_at("people", F.col("who")))
    )
    text = F.when(F.col("kind").isin("comment", "thread"), F.trim("text", F.lit(WHITESPACE))).otherwise(F.col("text"))
    out = flat.select(
        "path", segment_order(F.col("part_ord"), F.col("row"), F.col("ord")).alias("idx"), "kind",
        F.col("row"), owner.alias("sheet"), "ref", "name", "parent", F.coalesce(who, F.lit("")).alias("who"),
        basename(F.col("part")).alias("leaf"), text.alias("text"),
    ).filter(F.col("text").isNotNull() & ((F.col("kind") == "row") | (F.col("text") != "")))
    return out.select("path", "idx", "kind", locators.workbook(granularity).alias("locator"), "text")


def docx_parts(files: DataFrame) -> DataFrame:
    return packages.unpack(files, packages.read_document, whole=True)


def pptx_parts(files: DataFrame) -> DataFrame:
    return packages.unpack(files, packages.read_slides, whole=True)


def package_segments(parts: DataFrame) -> DataFrame:
    """Segments of word documents and slides; blank texts are left out."""
    return (
        parts.select("path", "part_ord", "kind", "row", F.explode("items").alias("i"))
        .filter(~is_blank(F.col("i.text")))
        .select(
            "path", segment_order(F.col("part_ord"), F.col("row"), F.col("i.ord")).alias("idx"), "kind",
            locators.package(F.col("kind"), F.col("row"), F.col("i.ord"), F.col("i.name"), F.col("i.who")).alias("locator"),
            F.col("i.text").alias("text"),
        )
    )


def extract_errors(parts: DataFrame) -> DataFrame:
    """Files whose container could not be read."""
    return parts.filter(F.col("error").isNotNull()).select("path", "error")


def grid_cells(grid: DataFrame) -> DataFrame:
    """``(path, sheet, row, col, value)`` of a used range as cell segments; NULL values are left out."""
    return grid.filter(F.col("value").isNotNull()).select(
        "path", locators.cell(F.col("sheet"), F.col("col"), F.col("row")).alias("locator"),
        F.col("value").cast("string").alias("text"),
    )


def attach_sheets(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Sheet of each ``(path, part, ...)`` row from a ``(path, sheet, base, target, type)`` table.

    For part tables that are stored apart from their relationships. The key includes the part, so
    one large workbook is still spread.
    """
    owned = links.select("path", F.col("sheet"), resolve_target(F.col("base"), F.col("target")).alias("_part"), "type")
    keyed = parts.withColumn("_part", F.lower("part"))
    return keyed.join(owned, ["path", "_part", "type"], "left").drop("_part").withColumn(
        "sheet", F.coalesce("sheet", F.lit("")))


def attach_people(threads: DataFrame, people: DataFrame) -> DataFrame:
    """Display name of each comment's ``person_id``; empty where unknown."""
    names = people.select("path", "person_id", "name")
    return threads.join(names, ["path", "person_id"], "left").withColumn("who", F.coalesce("name", F.lit(""))).drop("name")


def author_at(authors: Column, author_id: Column) -> Column:
    """Author by zero-based index; empty where the id is no valid index."""
    return F.coalesce(F.get(authors, author_id.try_cast("int")), F.lit(""))
