"""Connected components by joins: hook every node to its least neighbour, shorten, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linetrawl.llm.common import merged, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (long); root is the least node of its component.

    Each round at least halves the nodes that still have edges, and its tables are written to the shared folder.
    """
    edges = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    roots = None
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hooks = _shortened(stored(hooks, "hooks"))
        edges = stored(_renamed(_renamed(edges, "a", hooks), "b", hooks).filter("a <> b").distinct(), "edges")
        if roots is None:
            roots = hooks
        else:
            later = hooks.select(F.col("node").alias("root"), F.col("root").alias("new"))
            roots = stored(merged(roots, later, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def _renamed(edges: DataFrame, end: str, hooks: DataFrame) -> DataFrame:
    names = hooks.select(F.col("node").alias(end), F.col("root").alias("__root"))
    return merged(edges, names, end).select(*[F.col("__root").alias(c) if c == end else c for c in "ab"])


def _shortened(hooks: DataFrame) -> DataFrame:
    """Follow the pointers until each ends at a root."""
    while True:
        above = hooks.select(F.col("node").alias("root"), F.col("root").alias("new"))
        longer = merged(hooks, above, "root").filter("new <> root")
        if not longer.take(1):
            return hooks
        hooks = stored(merged(hooks, above, "root").select("node", F.col("new").alias("root")), "hooks")
