"""Date rules: eligibility before a cutoff, chronological splits, grounding within a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chronological_split(date: Column, train_through: int, validation_year: int) -> Column:
    """'train', 'validation', 'test' (also years between the two) or 'excluded_missing_date'."""
    year = F.year(date)
    return F.when(date.isNull(), "excluded_missing_date").when(year <= train_through, "train").when(year == validation_year, "validation").otherwise("test")


def eligible_counts(cases: DataFrame, works: DataFrame) -> DataFrame:
    """``(case_id, n_eligible, newest)``: works before a case's date that are not the case nor of its family.

    Both tables have id, date and family; an empty family matches nothing. No pair of case and work is formed: works are summed by
    day, and by family and day, and a case takes the running totals before its date. The newest day is the last before the date, less
    the days next to it that hold the case's family only. Cases without eligible works give no row.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row a day
    days = works.where("date is not null").groupBy("date").agg(F.count("*").alias("n"))
    total = days.select("date", "n", F.sum("n").over(w).alias("upto"), F.row_number().over(w).alias("i"))
    asked = cases.where("date is not null").select(F.col("id").alias("case_id"), F.col("date").alias("cutoff"), F.coalesce("family", F.lit("")).alias("family"))
    before = asked.select("cutoff").distinct().join(F.broadcast(total), total.date < F.col("cutoff"))  # days, not works
    by_day = before.groupBy("cutoff").agg(F.max("upto").alias("n_before"), F.max("i").alias("last"))
    kin_days = works.where("date is not null and family <> ''").groupBy("family", "date").agg(F.count("*").alias("k")).join(total.select("date", "n", "i"), "date")
    own = asked.where("family <> ''").join(kin_days, "family").where("date < cutoff")
    kin = own.groupBy("case_id").agg(F.sum("k").alias("kin"), F.sort_array(F.collect_list(F.when(F.col("k") == F.col("n"), F.col("i"))), asc=False).alias("full"))
    out = asked.join(by_day, "cutoff").join(kin, "case_id", "left").withColumn("n_eligible", F.col("n_before") - F.coalesce("kin", F.lit(0)))
    none = F.array().cast("array<int>")
    newest = F.aggregate(F.coalesce("full", none), F.col("last"), lambda at, i: F.when(i == at, at - 1).otherwise(at))
    out = out.where("n_eligible > 0").select("case_id", "n_eligible", newest.alias("i"))
    return out.join(total.select("i", F.col("date").alias("newest")), "i").select("case_id", "n_eligible", "newest")


def grounded_spans(units: DataFrame, records: DataFrame) -> DataFrame:
    """``(unit_id, n_spans, n_grounded)``: distinct spans of a unit, and those that a record of the unit's paper contains.

    A paper may hold a large share of both tables; spans of a paper meet its records in parts (records salted), and a span is
    grounded if one part says so.
    """
    parts = 16
    spans = units.where("unit_id is not null").select("unit_id", "paper_id", F.explode("evidence_spans").alias("span")).where("span is not null").distinct()
    texts = records.where("text is not null").select("paper_id", "text").distinct().withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    sent = spans.withColumn("part", F.explode(F.array(*(F.lit(i).cast("long") for i in range(parts)))))
    hit = sent.join(texts, ["paper_id", "part"]).where(F.col("text").contains(F.col("span"))).select("unit_id", "span").distinct().withColumn("hit", F.lit(True))
    return spans.select("unit_id", "span").distinct().join(hit, ["unit_id", "span"], "left").groupBy("unit_id").agg(F.count("*").alias("n_spans"), F.count("hit").alias("n_grounded"))
