"""Human-readable places of a hit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from linetrawl.functions.paths import column_letters


def _some(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _tail(who: Column) -> Column:
    return F.when(_some(who), F.concat(F.lit(" ("), who, F.lit(")"))).otherwise(F.lit(""))


def cell(sheet: Column, col: Column, row: Column) -> Column:
    return F.concat(sheet, F.lit("!"), column_letters(col), row.cast("string"))


def workbook(granularity: str) -> Column:
    """Locator of a workbook item with columns kind, sheet, row, ref, name, parent, who, leaf."""
    sheet, ref, name, leaf = F.col("sheet"), F.col("ref"), F.col("name"), F.col("leaf")
    in_sheet = F.when(_some(sheet), F.concat(sheet, F.lit("!"))).otherwise(F.lit(""))
    of_sheet = F.when(_some(sheet), F.concat(sheet, F.lit(": "))).otherwise(F.lit(""))

    def named(label):
        return F.concat(of_sheet, F.lit(label), F.when(_some(name), F.concat(F.lit("「"), name, F.lit("」")))
                        .otherwise(F.concat(F.lit(" ("), leaf, F.lit(")"))))

    def remark(label):
        return F.concat(F.when(_some(ref), F.concat(in_sheet, ref, F.lit(" "), label)).otherwise(label), _tail(F.col("who")))

    place = F.concat(F.lit("Row "), F.col("row").cast("string")) if granularity == "row" else ref
    kind = F.col("kind")
    return (
        F.when(kind == "row", F.concat(sheet, F.lit("!"), place))
        .when(kind == "sheet", F.concat(F.lit("シート名: "), sheet))
        .when(kind == "shape", named("図形"))
        .when(kind == "graphic", named("グラフ/図解"))
        .when(kind == "chart", F.concat(F.lit("グラフ ("), leaf, F.lit(")")))
        .when(kind == "smartart", F.concat(F.lit("SmartArt ("), leaf, F.lit(")")))
        .when(kind == "comment", remark(F.lit("コメント")))
        .when(kind == "thread", remark(F.when(_some(F.col("parent")), "スレッド返信").otherwise("スレッドコメント")))
    )


def package(kind: Column, number: Column, ord: Column, name: Column, who: Column) -> Column:
    """Locator of a document or slide item."""
    section = lambda label: F.concat(F.lit("セクション "), number.cast("string"), F.lit(" / " + label))
    slide = F.concat(F.lit("スライド "), number.cast("string"))
    return (
        F.when(kind == "body", F.lit("本文"))
        .when(kind == "header", section("ヘッダー"))
        .when(kind == "footer", section("フッター"))
        .when(kind == "textbox", F.when(_some(name), F.concat(F.lit("図形「"), name, F.lit("」"))).otherwise("図形"))
        .when(kind == "note", F.concat(F.lit("コメント #"), ord.cast("string"), _tail(who)))
        .when(kind == "slide", F.when(_some(name), F.concat(slide, F.lit(" / "), name)).otherwise(slide))
        .when(kind == "notes", F.concat(slide, F.lit(" / ノート")))
    )
