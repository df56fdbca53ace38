"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Staged, stage


def _star(both: DataFrame, large: bool) -> DataFrame:
    """One star step: every neighbour is linked to the least of the neighbourhood."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> Staged:
    """(node, component): the least node of its component, for every node with a link.

    links: (a, b) longs, in any order, repeats allowed.  Each round is written
    as a table; rounds end when one changes nothing, after a number that grows
    with the logarithm of the largest component.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.df.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        larger = _star(both, large=True).filter("a <> b").distinct()
        down = larger.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        smaller = _star(down, large=False).filter("a <> b").distinct()
        following = stage(smaller, "links")
        edges.drop()
        edges = following
        state = edges.df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    out = edges.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    result = stage(out.unionByName(out.select(F.col("component").alias("node"), "component").distinct()), "components")
    edges.drop()
    return result
