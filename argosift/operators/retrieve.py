"""Lexical retrieval, capped top-k and packing under budgets."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosift.functions.text import tokens
from argosift.runtime import cut, widen


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, token, tf)`` of every token of every text."""
    return docs.select(key, F.explode(tokens(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, k1: float = 1.2, b: float = 0.75, small: int = 1_000_000) -> DataFrame:
    """``(item_key, doc_key, score)`` for every pair that shares a token; both tables have a column text.

    Distinct query tokens count once; idf is ln(1 + (n - df + 0.5) / (df + 0.5)) over all documents with a text. Documents are
    partitioned once, by key; counting, weighing and summing by (item, document) then stay where they are, as the items' tokens are
    broadcast if there are at most ``small`` of them (counted first). More are joined by token.
    """
    texts = docs.where(F.col("text").isNotNull()).select(doc_key, tokens("text").alias("ts")).select(doc_key, "ts", F.size("ts").alias("dl"))
    stats = texts.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    asked = items.where(F.col("text").isNotNull()).select(item_key, F.explode(F.array_distinct(tokens("text"))).alias("token")).distinct()
    hint = F.broadcast if asked.count() <= small else (lambda x: x)
    wanted = asked.select("token").distinct()
    tf = (
        texts.repartition(doc_key).select(doc_key, "dl", F.explode("ts").alias("token"))
        .join(hint(wanted), "token", "left_semi")
        .groupBy(doc_key, "dl", "token").agg(F.count("*").alias("tf"))
    )
    df = tf.groupBy("token").agg(F.count("*").alias("df"))  # no more rows than the items have tokens
    weight = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    weighted = tf.join(hint(df), "token").crossJoin(F.broadcast(stats)).select(doc_key, "token", weight.alias("w"))  # stats is one row
    return weighted.join(hint(asked), "token").groupBy(item_key, doc_key).agg(F.sum("w").alias("score"))


def bm25_best(
    docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, k: int, cap: int | None = None, cap_by: str | None = None,
    factor: str | None = None, k1: float = 1.2, b: float = 0.75, block: int = 2048,
) -> DataFrame:
    """``(item_key, doc_key, score, place)``: the k best documents an item by :func:`bm25`, at most ``cap`` with the same ``cap_by``.

    Scores are multiplied by the column ``factor`` if one is named. Ties: the smaller document key. See :func:`_scan` for the way.
    """

    def prepare(vectors: DataFrame, size: int):
        n, mean = vectors.agg(F.count("*"), F.avg("dl")).first()
        df = np.zeros(size)
        for r in vectors.select(F.explode("js").alias("j")).groupBy("j").agg(F.count("*").alias("df")).toLocalIterator():  # one row a token of the items
            df[r["j"]] = r["df"]
        return np.log(1 + (n - df + 0.5) / (df + 0.5)), mean

    def weigh(given, tf, dl, js, asked):
        idf, mean = given
        return idf[js] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))

    return _scan(docs, items, doc_key, item_key, k, cap, cap_by, factor, None, block, prepare, weigh, lambda sums, dl, ql: sums)


def coverage_best(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, k: int, tie: str | None = None, block: int = 2048) -> DataFrame:
    """``(item_key, doc_key, score, place)``: the k best documents an item by twice the share of the item's tokens covered, plus covered tokens over the root of
    the text's. Ties: the smaller ``tie``, null first, then the smaller document key. See :func:`_scan` for the way."""
    return _scan(docs, items, doc_key, item_key, k, None, None, None, tie, block, lambda vectors, size: None, lambda given, tf, dl, js, asked: np.minimum(tf, asked), lambda m, dl, ql: 2 * m / ql + m / np.sqrt(dl))


def _scan(docs, items, doc_key, item_key, k, cap, cap_by, factor, tie, block, prepare, weigh, finish) -> DataFrame:
    """The best documents for a stated set of items, without a row a pair.

    One pass over the texts counts the items' tokens in each, without a shuffle, and writes these counts. A batch of them then meets the items'
    postings (for each token the items that have it, a few numbers an item token, in the closure): ``weigh`` gives what a token adds, ``finish``
    the score from the sums. Only the best rows of a batch leave it; the exact ranking is made from these. Items go to the scan in blocks of
    ``block``, and what a task holds is a block's postings and the scores of a few hundred documents.
    """
    asked = items.where(F.col("text").isNotNull()).select(F.col(item_key).alias("i"), F.array_sort(tokens("text")).alias("ts")).distinct()
    group = F.col(cap_by).cast("string") if cap_by else F.lit("")
    order = F.coalesce(F.unix_date(F.col(tie)).cast("double") if dict(docs.dtypes).get(tie) == "date" else F.col(tie).cast("double"), F.lit(float("-inf"))) if tie else F.lit(0.0)
    texts = widen(docs.where(F.col("text").isNotNull()).select(F.col(doc_key).alias("d"), F.coalesce(group, F.lit("")).alias("g"), (F.col(factor) if factor else F.lit(1.0)).alias("f"), order.alias("o"), F.col("text").alias("t")))
    key_type, item_type = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    token = re.compile("[a-z0-9]+")

    def search(part) -> DataFrame:
        counts = [Counter(r["ts"]) for r in part]
        at = {t: j for j, t in enumerate(sorted({t for c in counts for t in c}))}
        cells = sorted((at[t], q, n) for q, c in enumerate(counts) for t, n in c.items())
        owner, times = np.array([c[1] for c in cells], dtype=np.int64), np.array([c[2] for c in cells], dtype=float)
        starts = np.searchsorted([c[0] for c in cells], np.arange(len(at) + 1))
        ql = np.array([max(1, c.total()) for c in counts], dtype=float)
        names = np.array([r["i"] for r in part])

        def count(batches):
            for pdf in batches:
                sizes, js, tfs = [], [], []
                for text in pdf["t"]:
                    found = [w for w in token.findall(text.lower().replace("ß", "ss")) if len(w) > 2]
                    seen = Counter(at[w] for w in found if w in at)
                    sizes.append(len(found))
                    js.append(list(seen))
                    tfs.append(list(seen.values()))
                yield pd.DataFrame({"d": pdf["d"], "g": pdf["g"], "f": pdf["f"], "o": pdf["o"], "dl": sizes, "js": js, "tfs": tfs})

        vectors = cut(texts.mapInPandas(count, f"d {key_type}, g string, f double, o double, dl int, js array<int>, tfs array<int>"))
        given = prepare(vectors, len(at))

        def run(batches):
            for pdf in batches:
                for low in range(0, len(pdf), 256):
                    rows = pdf.iloc[low : low + 256]
                    at_row = np.repeat(np.arange(len(rows)), rows["js"].map(len).to_numpy())
                    js, tf = np.concatenate(rows["js"].to_numpy()).astype(np.int64), np.concatenate(rows["tfs"].to_numpy()).astype(float)
                    dl = rows["dl"].to_numpy(float)
                    # Every (document, token) met by the items that have the token.
                    n = starts[js + 1] - starts[js]
                    cell = np.repeat(starts[js] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    each = np.repeat(np.arange(len(js)), n)
                    value = weigh(given, tf[each], dl[at_row][each], js[each], times[cell])
                    where = at_row[each] * len(part) + owner[cell]
                    sums = np.bincount(where, weights=value, minlength=len(rows) * len(part)).reshape(len(rows), len(part))
                    scores = np.round(finish(sums, dl[:, None], ql[None, :]) * rows["f"].to_numpy(float)[:, None], 6)
                    keys, groups, ties = rows["d"].to_numpy(), rows["g"].to_numpy(), rows["o"].to_numpy(float)
                    for g in np.unique(groups):
                        inside = np.flatnonzero(groups == g)
                        wide = lambda x, inside=inside: np.broadcast_to(x[inside][:, None], (len(inside), len(part)))
                        best = np.lexsort((wide(keys), wide(ties), -scores[inside]), axis=0)[: min(cap or k, k)]
                        chosen = inside[best]
                        top = np.take_along_axis(scores, chosen, axis=0)
                        out = pd.DataFrame({"i": np.broadcast_to(names, chosen.shape).ravel(), "d": keys[chosen].ravel(), "g": g, "o": ties[chosen].ravel(), "score": top.ravel()})
                        yield out[out["score"] > 0]

        return vectors.where(F.size("js") > 0).mapInPandas(run, f"i {item_type}, d {key_type}, g string, o double, score double")

    found, part = None, []
    for row in asked.toLocalIterator():
        part.append(row)
        if len(part) == block:
            found, part = (search(part) if found is None else found.unionByName(search(part))), []
    if part:
        found = search(part) if found is None else found.unionByName(search(part))
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"i {item_type}, d {key_type}, g string, o double, score double")
    best = top_k(found, k, [F.desc("score"), F.col("o"), F.col("d")], ["i"], cap, "g" if cap else None)
    return best.select(F.col("i").alias(item_key), F.col("d").alias(doc_key), "score", "place")


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str], cap: int | None = None, cap_by: str | None = None) -> DataFrame:
    """First k rows a group in order, at most ``cap`` of them with the same ``cap_by``; with their place."""
    if cap is not None:
        within = Window.partitionBy(*by, cap_by).orderBy(*order)
        df = df.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= cap).drop("_n")
    if not by:
        df = df.orderBy(*order).limit(k)  # k rows to number
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("place", F.row_number().over(part.orderBy(*order))).where(F.col("place") <= k)


def greedy_pack(df: DataFrame, by: str, order: list[str], key: str, size: str, budget: int, cap: int, most: int, slack: int = 200) -> DataFrame:
    """``(by, key, place, used)``: walks each group in order, skips what does not fit, stops at ``most`` or within ``slack`` of the budget.

    What does not fit now never will, as the room only shrinks. So a round takes, of the rows that still fit a group, the first ``most`` in
    order, and walks over these; the next goes on behind them. Each round takes at least one row of every group that goes on, and no task holds more than
    ``most`` rows of a group.
    """
    kind = dict(df.dtypes)[key]
    rows = cut(df.select(by, F.struct(*order, F.col(key).alias("_k")).alias("at"), F.least(F.col(size).cast("long"), F.lit(cap)).alias("s"), F.col(key).alias("k")).where("s is not null"))
    state = rows.select(by).distinct().withColumns({"used": F.lit(0).cast("long"), "n": F.lit(0), "last": F.lit(None).cast(rows.schema["at"].dataType)})
    start = lambda used, n: F.struct(used.alias("used"), n.alias("n"), F.array().cast(f"array<struct<k:{kind},place:int,used:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] < most) & (acc["used"] < budget - slack) & (acc["used"] + x["s"] <= budget)
        used, place = acc["used"] + x["s"], acc["n"] + 1
        took = F.struct(used.alias("used"), place.alias("n"), F.concat(acc["taken"], F.array(F.struct(x["k"].alias("k"), place.alias("place"), used.alias("used")))).alias("taken"))
        return F.when(fits, took).otherwise(acc)

    out = None
    while True:
        open_ = rows.join(state.where((F.col("n") < most) & (F.col("used") < budget - slack)), by)
        open_ = open_.where((F.col("last").isNull() | (F.col("at") > F.col("last"))) & (F.col("used") + F.col("s") <= budget))
        next_ = top_k(open_, most, [F.col("at")], [by])
        walked = next_.groupBy(by, "used", "n").agg(F.array_sort(F.collect_list(F.struct("at", "s", "k"))).alias("xs"))  # at most ``most`` rows
        walked = cut(walked.select(by, F.aggregate("xs", start(F.col("used"), F.col("n")), step).alias("a"), F.element_at("xs", -1)["at"].alias("last")))
        if not walked.head(1):
            break
        taken = walked.select(by, F.explode("a.taken").alias("t")).select(by, F.col("t.k").alias(key), F.col("t.place").alias("place"), F.col("t.used").alias("used"))
        out = taken if out is None else out.unionByName(taken)
        state = walked.select(by, F.col("a.used").alias("used"), F.col("a.n").alias("n"), "last")
    return out if out is not None else df.select(by, key, F.lit(0).alias("place"), F.lit(0).cast("long").alias("used")).limit(0)


def prefix_pack(df: DataFrame, by: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows of each group up to the first that does not fit the budget, with the running total ``used``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def round_robin(df: DataFrame, by: str, order: list[Column], key: str, limit: int) -> DataFrame:
    """Takes the first row of each group, then the second of each, and so on, until ``limit``; with round and place."""
    rounds = df.withColumn("round", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("round") <= limit)
    taken = rounds.orderBy("round", by, key).limit(limit)
    return taken.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("round", by, key)))


def first_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
