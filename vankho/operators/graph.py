"""Property graph as two DataFrames: vertices(id, label) and edges(src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): each edge in both directions, once, loops left out."""
    pairs = edges.where("src <> dst").select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))
    return pairs.distinct()


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, target, hop): every vertex within `hops` undirected edges of each of seeds(id), with its least distance; a seed is not its
    own target. Each hop joins only what the last one reached for the first time."""
    links = both_ways(edges)
    reached = seeds.select(F.col("id").alias("seed"), F.col("id").alias("target"), F.lit(0).alias("hop")).distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.select("seed", F.col("target").alias("a")).join(links, "a").select("seed", F.col("b").alias("target")).distinct()
        frontier = step.join(reached.select("seed", "target"), ["seed", "target"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached.where("hop > 0").withColumn("hop", F.col("hop").cast("bigint"))


def chains(edges: DataFrame, kind: str) -> DataFrame:
    """(a, b, c): directed chains of two edges of one type, the ends different."""
    one = edges.where(F.col("type") == kind).select("src", "dst").distinct()
    return one.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(one.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a <> c").select("a", "b", "c")


def lonely(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without an edge in either direction."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return vertices.join(ends, "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree)."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def with_stubs(vertices: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Vertices and a stub for each end of an edge that has none."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    missing = ends.join(vertices.select("id"), "id", "left_anti").select("id", F.lit(label).alias("label"))
    return vertices.select("id", "label").unionByName(missing)
