"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.common import stored


def _least(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step over edges (u, v): neighbours are linked to the least of u and all of them.
    Large star moves the neighbours above u, small star those below it and u itself."""
    if keep_larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    joined = both.join(least, "u")
    if keep_larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node of edges (u, v) is either a root or has one edge, which leads to a root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    both = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return both.where(F.col("out") + F.col("root") > 1).limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(u, label) of each node of ``edges`` (u, v: long): the least node of its component.  Each
    round is stored; the driver sees one number of it."""
    edges = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(edges):
        edges = stored(_least(_least(edges, True), False), "edges")
    roots = edges.select(F.col("v").alias("u"), F.col("v").alias("label")).distinct()
    return edges.select("u", F.col("v").alias("label")).unionByName(roots)


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` after more edges: the stars found so far stand for the edges before."""
    return components(labels.select("u", F.col("label").alias("v")).unionByName(edges))
