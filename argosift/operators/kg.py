"""Co-occurrence knowledge graph over mentions ``(doi, entity, year)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def document_frequency(mentions: DataFrame, before: int, cap: int = 200_000) -> DataFrame:
    """``(entity, df)``: distinct dois before a year, at most ``cap`` (what the lookup counts, not what it reads)."""
    df = mentions.where(F.col("year") < before).groupBy("entity").agg(F.count_distinct("doi").alias("df"))
    return df.withColumn("df", F.least("df", F.lit(cap)))


def cooccurrences(mentions: DataFrame, anchors: DataFrame, before: int, excluded: DataFrame | None = None, pool: int = 40, limit: int = 8) -> DataFrame:
    """``(entity, papers, latest, association, place)`` of entities in the dois of any anchor, before a year, without the anchors.

    The ``pool`` most frequent are ranked again by papers / df, then papers, then name, and the first ``limit`` stay.
    """
    dated = mentions.where(F.col("year") < before).select("doi", "entity", "year")
    if excluded is not None:
        dated = dated.join(excluded.select("doi").distinct(), "doi", "left_anti")
    topics = anchors.select("entity").distinct()
    dois = dated.join(topics, "entity", "left_semi").select("doi").distinct()
    near = dated.join(dois, "doi", "left_semi").join(topics, "entity", "left_anti")
    counted = near.groupBy("entity").agg(F.count_distinct("doi").alias("papers"), F.max("year").alias("latest"))
    first = counted.orderBy(F.desc("papers"), "entity").limit(pool)
    scored = first.join(document_frequency(mentions, before), "entity").withColumn("association", F.round(F.col("papers") / F.greatest(F.lit(1), F.col("df")), 4))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("association"), F.desc("papers"), "entity")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("entity", "papers", "latest", "association", "place")


def share_idf(mentions: DataFrame, anchors: DataFrame, before: int, universe: float = 5e6, least: int = 5, newest: int = 3000) -> DataFrame:
    """``(anchor, entity, papers, score)``: share of an anchor's newest dois that mention an entity, times ln(universe / df)."""
    dated = mentions.where(F.col("year") < before).select("doi", "entity", "year").distinct()
    own = dated.join(anchors.select("entity").distinct(), "entity", "left_semi").select(F.col("entity").alias("anchor"), "doi", "year")
    recent = own.withColumn("i", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("year"), "doi"))).where(F.col("i") <= newest)
    size = recent.groupBy("anchor").agg(F.count("*").alias("n"))
    met = recent.select("anchor", "doi").join(dated.select("doi", "entity"), "doi").where("anchor <> entity").groupBy("anchor", "entity").agg(F.count_distinct("doi").alias("papers"))
    kept = met.join(size, "anchor").where((F.col("papers") >= least) & (F.col("papers") <= F.col("n") / 2))
    return kept.join(document_frequency(mentions, before), "entity").select("anchor", "entity", "papers", F.round(F.col("papers") / F.col("n") * F.ln(F.lit(universe) / F.col("df")), 6).alias("score"))
