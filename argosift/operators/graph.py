"""Graph operators over edge tables ``(src, dst)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosift.runtime import cut


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """``(id, rank)``: power iteration; the mass of nodes without links is spread evenly. Repeated edges count once; ranks sum to 1.

    A round reads the ranks of the round before from the checkpoint folder, once for its join and once for the loose mass: a plan that
    held several rounds would double with each.
    """
    links = cut(edges.select("src", "dst").distinct())
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    degree = links.groupBy("src").agg(F.count("*").alias("deg"))
    weighted = cut(links.join(degree, "src"))
    nodes = cut(nodes.join(degree.select(F.col("src").alias("id"), F.lit(True).alias("links")), "id", "left"))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds if n else 0):
        loose = ranks.where("links is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = weighted.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        share = (1 - damping) / n + damping * loose / n
        ranks = cut(nodes.join(given, "id", "left").select("id", "links", (F.lit(share) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks.select("id", "rank")


def bfs_levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(id, level, parent)`` of nodes within ``depth`` undirected steps; the parent is the smallest neighbour of the level before."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both)
    none = F.lit(None).cast(dict(both.dtypes)["src"])
    seen = seeds.select(F.col("id"), F.lit(0).alias("level"), none.alias("parent"))
    front = seen
    for level in range(1, depth + 1):
        step = both.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level"), "parent"))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def cocitation(edges: DataFrame, least: int = 2) -> DataFrame:
    """``(dst, n_src)``: distinct sources of each target, at least ``least``."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n_src")).where(F.col("n_src") >= least)


def coupling(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """``(src, n_refs, n_shared, coupling, in_degree)``: the share of a node's links that lead into the pool's links, self excluded."""
    refs = edges.select("src", "dst").distinct()
    shared = refs.join(pool.select("dst").distinct(), "dst", "left_semi").where("src <> dst").groupBy("src").agg(F.count("*").alias("n_shared"))
    degree = refs.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("in_degree"))
    out = refs.groupBy("src").agg(F.count("*").alias("n_refs")).join(shared, "src", "left").join(degree, "src", "left")
    return out.select("src", "n_refs", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.round(F.coalesce("n_shared", F.lit(0)) / F.greatest(F.lit(1), F.col("n_refs")), 6).alias("coupling"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def expand_neighbours(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """``(id, seed, weight, place)``: neighbours of ranked seeds ``(id, pos)`` that are no seeds; the first seed to reach one keeps it."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    reached = both.join(seeds.select(F.col("id").alias("src"), "pos"), "src").join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti")
    one = reached.withColumn("i", F.row_number().over(Window.partitionBy("dst").orderBy("pos", F.desc("weight")))).where("i = 1")
    one = one.orderBy("pos", F.desc("weight"), "dst").limit(most)
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos", F.desc("weight"), "dst")))
    return placed.select(F.col("dst").alias("id"), F.col("src").alias("seed"), "weight", "place")
