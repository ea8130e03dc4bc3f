"""Column functions over path strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; leading dots of a name do not start one."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)[^.].*(\.[^.]*)$", 1))


def dir_parts(path: Column, root: str = "") -> Column:
    """Directory names below ``root``."""
    prefix = root.rstrip("/") + "/" if root else ""
    below = F.when(path.startswith(prefix), path.substr(F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    parts = F.split(below, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def display_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def glob_to_regex(pattern: str) -> str:
    """Shell glob (``* ? [seq] [!seq]``) as an anchored Java regex."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        inside = i + 2 if pattern[i + 1:i + 2] == "!" else i + 1
        close = pattern.find("]", inside + 1) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            out.append(_char_class(pattern[inside:close], inside == i + 2))
            i = close
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", ch) if ch.isascii() else ch)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def _char_class(body: str, negate: bool) -> str:
    """One bracket of a glob; a range that runs backwards holds nothing."""
    body = re.sub(r"(.)-(.)", lambda m: m.group() if m[1] <= m[2] else "", body, flags=re.S)
    if not body:
        return "." if negate else "(?!)"
    return f"[{'^' if negate else ''}" + re.sub(r"([\\\[\]&^])", r"\\\1", body) + "]"


def resolve_target(base: Column, target: Column) -> Column:
    """Package part that a relative relationship target points to, lower-cased."""
    parts = F.split(base, "/")
    start = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    walked = F.aggregate(
        F.split(target, "/"),
        start,
        lambda acc, step: F.when(step == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((step == "") | (step == "."), acc)
        .otherwise(F.array_append(acc, step)),
    )
    absolute = F.regexp_replace(target, "^/+", "")
    return F.lower(F.when(target.startswith("/"), absolute).otherwise(F.array_join(walked, "/")))


def rels_path(part: Column) -> Column:
    return F.regexp_replace(part, r"([^/]+)$", r"_rels/$1.rels")


def apply_timestamp(template: Column, slug: Column) -> Column:
    return F.replace(template, F.lit("{ts}"), slug)


def timestamp_slug(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def human_bytes(size: Column) -> Column:
    """``B`` below 1024, then one decimal in KB, MB, GB or TB (base 1024).

    Integer arithmetic on quotient and remainder; halves go to the even digit, as printf-style
    formatting of the exact binary value does.
    """
    power = F.when(size < 1024 ** 2, 1).when(size < 1024 ** 3, 2).when(size < 1024 ** 4, 3).otherwise(4)
    divide = lambda a, b: ((a - a % b) / b).cast("bigint")

    def render(p):
        unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), p * 10)
        rest = size % unit * 10
        digit, twice = divide(rest, unit), rest % unit * 2
        up = (twice > unit) | ((twice == unit) & (digit % 2 == 1))
        tenths = divide(size, unit) * 10 + digit + F.when(up, 1).otherwise(0)
        name = F.element_at(F.array(*map(F.lit, ("KB", "MB", "GB", "TB"))), p)
        return F.concat(divide(tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" "), name)

    scaled = F.transform(F.array(power), render)[0]
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(scaled)


def column_letters(number: Column) -> Column:
    """Spreadsheet column name: 1 is A, 27 is AA; below 1 is empty. Fourteen letters hold any BIGINT."""
    step = lambda acc, _: F.when(
        acc["left"] > 0,
        F.struct(
            F.call_function("div", acc["left"] - 1, F.lit(26)).alias("left"),
            F.concat(F.chr((acc["left"] - 1) % 26 + 65), acc["name"]).alias("name"),
        ),
    ).otherwise(acc)
    start = F.struct(number.cast("bigint").alias("left"), F.lit("").alias("name"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["name"])
