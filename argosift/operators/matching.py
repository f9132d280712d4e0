"""Matching of texts and records: containment of many needles, anchoring, cascades, patches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosift.runtime import cut


def contains_any(texts: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str, block: int = 200_000) -> DataFrame:
    """``(key, needle_key)`` for every needle a text contains. One pass of the texts for each block of needles, by an Aho-Corasick automaton.

    The needles are a stated set and are streamed to the scan in blocks of ``block``; empty needles and nulls match nothing.
    """
    kinds = dict(texts.dtypes)[key], dict(needles.dtypes)[needle_key]
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    wanted = needles.where(F.coalesce(F.length(needle), F.lit(0)) > 0).select(F.col(needle_key).alias("n"), F.col(needle).alias("s"))
    found, part = None, []

    def search(part):
        pairs = [(r["s"], r["n"]) for r in part]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            tree, owners = ahocorasick.Automaton(), {}
            for s, n in pairs:
                owners.setdefault(s, []).append(n)
            for s, ns in owners.items():
                tree.add_word(s, ns)
            tree.make_automaton()
            for pdf in batches:
                out = [(k, n) for k, t in zip(pdf["k"], pdf["t"], strict=True) for n in {n for _, ns in tree.iter(t) for n in ns}]
                yield pd.DataFrame(out, columns=["k", "n"])

        return rows.mapInPandas(run, f"k {kinds[0]}, n {kinds[1]}")

    for row in wanted.toLocalIterator():
        part.append(row)
        if len(part) == block:
            found, part = (search(part) if found is None else found.unionByName(search(part))), []
    if part:
        found = search(part) if found is None else found.unionByName(search(part))
    if found is None:
        found = texts.sparkSession.createDataFrame([], f"k {kinds[0]}, n {kinds[1]}")
    return found.select(F.col("k").alias(key), F.col("n").alias(needle_key))


def anchor_spans(units: DataFrame, records: DataFrame, keep_text: bool = False, parts: int = 16) -> DataFrame:
    """``(unit_id, span_hash, record_id, at)``: the first record of the unit's paper that holds a span, and the offset of the first hit.

    Records are salted within their paper, so that a paper with much of the table is matched in parts; the first record of all parts wins.
    """
    spans = units.select("unit_id", "paper_id", F.explode("evidence_spans").alias("span")).where("length(span) > 0").distinct()
    texts = records.where("text is not null").select("record_id", "paper_id", "text").distinct().withColumn("part", F.pmod(F.xxhash64("record_id"), F.lit(parts)))
    sent = spans.withColumn("part", F.explode(F.array(*(F.lit(i).cast("long") for i in range(parts)))))
    hits = sent.join(texts, ["paper_id", "part"]).where(F.col("text").contains(F.col("span")))
    hits = hits.select("unit_id", "span", F.struct("record_id", (F.expr("position(span in text)") - 1).cast("long").alias("at"), *(["text"] if keep_text else [])).alias("h"))
    first = hits.groupBy("unit_id", "span").agg(F.min("h").alias("h"))
    if keep_text:
        return first.select("unit_id", "span", "h.record_id", "h.at", "h.text")
    return first.select("unit_id", F.md5("span").alias("span_hash"), "h.record_id", "h.at")


def best_match(queries: DataFrame, sets: DataFrame, key: str, items: str) -> DataFrame:
    """``(a, b, jaccard)``: the set most similar to each query's, by shared items; ties go to the larger key. Queries are a stated set.

    Equal sets are one class, of which only the largest key can be found, and equal queries are asked once. A query with an equal set beside its own
    has its largest other key; only the rest are compared with the classes.
    """
    asked = queries.where(F.size(items) > 0).select(F.col(key).alias("a"), F.array_sort(F.array_distinct(items)).alias("s")).distinct()
    rows = sets.where(F.size(items) > 0).select(F.col(key).alias("b"), F.array_sort(F.array_distinct(items)).alias("s"))
    top = cut(rows.groupBy("s").agg(F.max("b").alias("m1")))
    others = rows.join(top, "s").where("b <> m1").groupBy("s").agg(F.max("b").alias("m2"))
    near = cut(asked.join(top.join(others, "s", "left"), "s", "left").withColumn("b", F.when(F.col("m1") != F.col("a"), F.col("m1")).otherwise(F.col("m2"))))
    same = near.where("b is not null").select("a", "b", F.lit(1.0).alias("jaccard"))
    rest = near.where("b is null").select("a", "s")  # no other key has this set
    q = rest.select("s").distinct().select("s", F.size("s").alias("na"), F.explode("s").alias("t"))
    x = top.select(F.col("s").alias("sb"), F.col("m1").alias("b"), F.explode("s").alias("t"), F.size("s").alias("nb"))
    shared = q.join(x, "t").where("s <> sb").groupBy("s", "b", "na", "nb").agg(F.count("*").alias("c"))
    scored = shared.select("s", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("j"))
    best = scored.groupBy("s").agg(F.max(F.struct(F.round("j", 9).alias("r"), "b", "j")).alias("m"))
    return same.unionByName(rest.join(best, "s").select("a", "m.b", F.round("m.j", 6).alias("jaccard")))


def best_match_each(sets: DataFrame, key: str, items: str) -> DataFrame:
    """What ``best_match`` gives with every set as a query."""
    return best_match(sets, sets, key, items)


def jaccard_join(left: DataFrame, right: DataFrame, key: str, other: str, least: float) -> DataFrame:
    """``(key, other, jaccard)`` of all pairs of a left and a right set (array columns ``s``) of at least ``least``: prefix filter, exact.

    Tokens are ordered from rare to common over both tables; sets that are alike share one of their first ``n - ceil(least * n) + 1`` tokens.
    """
    clean = lambda df, k: df.select(k, F.array_distinct("s").alias("s")).where(F.size("s") > 0).distinct()
    a, b = clean(left, key), clean(right, other)
    both = a.select("s").unionByName(b.select("s"))
    df = cut(both.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("df")))

    def prefix(rows: DataFrame, k: str) -> DataFrame:
        n = F.size("s")
        each = rows.select(k, n.alias("n"), F.explode("s").alias("t"), F.xxhash64("s").alias("h")).join(df, "t")
        order = Window.partitionBy(k, "h").orderBy("df", "t")
        return each.withColumn("p", F.row_number().over(order)).where(F.col("p") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select(k, "h", "t")

    pairs = prefix(a, key).withColumnRenamed("h", "ha").join(prefix(b, other).withColumnRenamed("h", "hb"), "t").select(key, "ha", other, "hb").distinct()
    x, y = a.withColumn("ha", F.xxhash64("s")).withColumnRenamed("s", "sa"), b.withColumn("hb", F.xxhash64("s")).withColumnRenamed("s", "sb")
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = pairs.join(x, [key, "ha"]).join(y, [other, "hb"]).select(key, other, (shared / (F.size("sa") + F.size("sb") - shared)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= least - 1e-9)


def identity_reasons(candidates: DataFrame, held: DataFrame, ids: list[str], same: float = 0.8, kin: float = 0.5) -> DataFrame:
    """``(key, reason)``: 'identifier' where a candidate has one of a held-out record's ``ids``, else 'title' where their titles are alike to ``same``,
    else 'title and author' where they are alike to ``kin`` with the same author, else null. Titles are array columns ``s``; an empty one is like nothing.

    Both tables have key, s, author and the ``ids``; null ids and authors are equal to none.
    """
    by_id = None
    for c in ids:
        hit = candidates.where(F.col(c).isNotNull()).join(held.select(c).distinct(), c, "left_semi").select("key")
        by_id = hit if by_id is None else by_id.unionByName(hit)
    # Records with the same title and author are one class, so that common titles give no pairs of records.
    named = F.sha2(F.concat_ws("\x1f", F.array_join("s", "\x1e"), F.coalesce("author", F.lit("\x1d"))), 256)
    a, b = candidates.withColumn("c", named), held.withColumn("d", named).select("d", "s", F.col("author").alias("y")).distinct()
    classes = a.select("c", "s", F.col("author").alias("x")).distinct()
    alike = jaccard_join(classes.select("c", "s"), b.select("d", "s"), "c", "d", kin)
    rated = alike.join(classes.select("c", "x"), "c").join(b.select("d", "y"), "d")
    rated = rated.groupBy("c").agg(F.max("jaccard").alias("best"), F.coalesce(F.bool_or(F.col("x") == F.col("y")), F.lit(False)).alias("author"))
    titles = a.select("key", "c").join(rated, "c").drop("c")
    known = by_id.distinct().withColumn("known", F.lit(True))
    out = candidates.select("key").join(known, "key", "left").join(titles, "key", "left")
    return out.select("key", F.when(F.col("known"), "identifier").when(F.col("best") >= same - 1e-9, "title").when(F.col("author"), "title and author").alias("reason"))


def resolve_by_title(references: DataFrame, targets: DataFrame, ids: list[str], least: float = 0.6) -> DataFrame:
    """``(ref, target, method, score)``: the smallest target with an equal id, by the order of ``ids``, else the one whose title is most like the reference's, if
    alike to ``least``; equal ones: the smallest target. null where none is found. Titles are array columns ``s``."""
    found = None
    for prio, c in enumerate(ids):
        first = targets.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("target").alias("target"))
        one = references.select("ref", c).join(first, c).select("ref", "target", F.lit(c).alias("method"), F.lit(1.0).alias("score"), F.lit(prio).alias("prio"))
        found = one if found is None else found.unionByName(one)
    smallest = targets.groupBy("s").agg(F.min("target").alias("target"))  # of equal titles only the smallest can be found
    alike = jaccard_join(references.select("ref", "s"), smallest.select("target", "s"), "ref", "target", least)
    alike = alike.select("ref", "target", F.lit("title").alias("method"), F.round("jaccard", 6).alias("score"), F.lit(len(ids)).alias("prio"))
    best = first_by(found.unionByName(alike), ["ref"], [F.col("prio"), F.desc("score"), F.col("target")]).drop("prio")
    return references.select("ref").join(best, "ref", "left")


def resolve(references: DataFrame, targets: DataFrame, ref: str, target: str, rules: list[list[str]]) -> DataFrame:
    """``(ref, target, prio)``: the target found by the first rule (columns to agree in); the smallest target of several. Null without one."""
    found = None
    for prio, columns in enumerate(rules, 1):
        first = targets.groupBy(*columns).agg(F.min(target).alias(target))
        one = references.select(ref, *columns).join(first, columns).select(ref, F.struct(F.lit(prio).alias("prio"), F.col(target)).alias("m"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(ref).agg(F.min("m").alias("m"))
    return references.select(ref).join(best, ref, "left").select(ref, F.col(f"m.{target}"), "m.prio")


def apply_patch(table: DataFrame, deletes: DataFrame, updates: DataFrame, inserts: DataFrame, keys: list[str]) -> DataFrame:
    """The table without deleted keys, with updated values, and with inserted rows whose key was not there."""
    values = [c for c in table.columns if c not in keys]
    renamed = updates.select(*keys, F.struct(*values).alias("_new"))
    kept = table.join(deletes, keys, "left_anti").join(renamed, keys, "left")
    merged = kept.select(*keys, *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values))
    return merged.unionByName(inserts.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def first_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
