"""Connected components by alternating stars, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize, spread


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours above it (large), or it and those below it (small), linked to the
    least of them. The least is a partial aggregate joined back, so a hub isn't one task's."""
    n = _both(e) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = n.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    j = n.join(spread(least), "u")
    out = j.where(F.col("v") > F.col("u")).select("v", "m") if large else j.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return out.where(F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, of each node of links (a, b). Each round is written
    to the shared folder; the rounds needed grow with the logarithm of a chain's length."""
    e = materialize(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    told = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == told or not now[0]:
            break
        told = now
        e = materialize(_star(_star(e, True), False), "links")
    roots = e.select(F.col("a").alias("root")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots.select(F.col("root").alias("node"), "root"))
