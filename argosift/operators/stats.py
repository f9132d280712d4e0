"""Statistics over groups: ranks, correlation, agreement, resampling with hash draws."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosift.functions.digests import Tails
from argosift.operators.ordering import average_ranks, numbered
from argosift.runtime import cut


def average_rank(order: Column, *by: str, name: str = "rank") -> Column:
    """Rank from 1 within groups, ascending; equal values share the mean of their ranks. For a whole table: ``ordering.average_ranks``."""
    w = Window.partitionBy(*by)
    return (F.rank().over(w.orderBy(order)) + (F.count("*").over(w.partitionBy(*by, order)) - 1) / 2).alias(name)


def _ranked(df: DataFrame, x: str, by: tuple[str, ...], name: str) -> DataFrame:
    return df.withColumn(name, average_rank(F.col(x), *by)) if by else average_ranks(df, x, name)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null for constants."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / spread)


def spearman(df: DataFrame, x: str, y: str, *by: str, least: int = 3) -> DataFrame:
    """``(*by, n, rho)``: Pearson correlation of average ranks; null below ``least`` rows or for constants. Rows with nulls are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = _ranked(_ranked(rows.select(*by, F.col(x).alias("x"), F.col(y).alias("y")), "x", by, "rx"), "y", by, "ry")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("rx", "ry").alias("r"))
    return out.select(*by, "n", F.round(F.when(F.col("n") >= least, F.col("r")), 6).alias("rho"))


def kendall_tau_a(df: DataFrame, key: str, x: str, y: str, *by: str) -> DataFrame:
    """``(*by, n, tau)``; ties count as neither and stay in the denominator. For groups of bounded size: pairs are formed."""
    a, b = df.alias("a"), df.alias("b")
    same = F.lit(True)
    for c in by:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pairs = a.join(b, same & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    sign = F.signum((F.col(f"a.{x}") - F.col(f"b.{x}")).cast("double")) * F.signum((F.col(f"a.{y}") - F.col(f"b.{y}")).cast("double"))
    return pairs.groupBy(*(F.col(f"a.{c}").alias(c) for c in by)).agg(F.count("*").alias("pairs"), F.round(F.sum(sign) / F.count("*"), 6).alias("tau"))


def cohen_kappa(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """``(*by, n, kappa)`` of two label columns; null where chance agreement is 1."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    margins = (
        cells.select(*by, F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("c").alias("ca"), F.lit(0).cast("bigint").alias("cb")), F.struct(F.col("y").alias("v"), F.lit(0).cast("bigint").alias("ca"), F.col("c").alias("cb")))).alias("m"))
        .groupBy(*by, "m.v").agg(F.sum("m.ca").alias("na"), F.sum("m.cb").alias("nb"))
        .groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    )
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("hit"))
    joined = total.join(margins, list(by)) if by else total.crossJoin(margins)
    po, pe = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return joined.select(*by, "n", F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def auc(df: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """``(*by, n_pos, n_neg, auc)``: Mann-Whitney from average ranks, without pairs; null if a side is empty."""
    rows = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    ranked = _ranked(rows.select(*by, F.col(positive).alias("p"), F.col(score).alias("s")), "s", by, "r")
    out = ranked.groupBy(*by).agg(F.count_if("p").alias("n_pos"), F.count_if(~F.col("p")).alias("n_neg"), F.sum(F.when(F.col("p"), F.col("r"))).alias("s"))
    u = F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return out.select(*by, "n_pos", "n_neg", F.round(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), u / (F.col("n_pos") * F.col("n_neg"))), 6).alias("auc"))


def icc1(df: DataFrame, unit: str, order: str, value: str, *by: str) -> DataFrame:
    """``(*by, n_units, k, icc)``: one-way; units of one rating are dropped, all others cut to the smallest number of ratings."""
    w = Window.partitionBy(*by, unit)
    rows = df.where(F.col(value).isNotNull()).select(*by, unit, F.col(value).cast("double").alias("v"), F.count("*").over(w).alias("m"), F.row_number().over(w.orderBy(order)).alias("i")).where("m >= 2")
    least = rows.groupBy(*by).agg(F.min("m").alias("k"))
    kept = (rows.join(least, list(by)) if by else rows.crossJoin(F.broadcast(least))).where("i <= k")  # one row a group
    per = kept.groupBy(*by, unit).agg(F.avg("v").alias("mean"), F.sum(F.col("v") * F.col("v")).alias("sq"), F.max("k").alias("k"))
    out = per.groupBy(*by).agg(F.count("*").alias("n_units"), F.max("k").alias("k"), F.var_samp("mean").alias("vm"), F.sum(F.col("sq") - F.col("k") * F.col("mean") * F.col("mean")).alias("within"))
    msb = F.col("k") * F.col("vm")
    msw = F.col("within") / (F.col("n_units") * (F.col("k") - 1))
    down = msb + (F.col("k") - 1) * msw
    return out.select(*by, "n_units", "k", F.round(F.when((F.col("n_units") > 1) & (down != 0), (msb - msw) / down), 6).alias("icc"))


def binomial_sum(n: Column, low: Column, high: Column, p: float = 0.5) -> Column:
    """P(low <= X <= high) for n draws; by logarithms, for n up to some thousands."""
    import math

    def log_factorial(m: Column) -> Column:
        return F.aggregate(F.when(m >= 1, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.ln(i))

    lp, lq = math.log(p), math.log(1 - p)
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * F.lit(lp) + (n - i) * F.lit(lq))
    return F.when(high >= low, F.aggregate(F.sequence(low.cast("int"), high.cast("int")), F.lit(0.0), lambda a, i: a + term(i))).otherwise(F.lit(0.0))


def sign_test(df: DataFrame, diff: str, *by: str) -> DataFrame:
    """``(*by, up, down, p)``: exact, two-sided, zeros dropped; 1 when nothing is left."""
    counts = df.groupBy(*by).agg(F.count_if(F.col(diff) > 0).alias("up"), F.count_if(F.col(diff) < 0).alias("down"))
    n, k = F.col("up") + F.col("down"), F.least("up", "down")
    return counts.select(*by, "up", "down", F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_sum(n, F.lit(0), k))), 6).alias("p"))


def holm(df: DataFrame, p: str, key: str, *by: str) -> DataFrame:
    """All rows with ``p_adjusted``: running maximum of (m - rank + 1) p, at most 1; equal p by ``key``. A family of tests is small."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = part.orderBy(p, key)
    m = F.count("*").over(part)
    step = df.withColumn("_step", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return step.withColumn("p_adjusted", F.round(F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)).drop("_step")


def draw(seed: int, *parts: Column, n: Column) -> Column:
    """A number from 0 to n-1 from the MD5 of the seed and the parts; the same in any SQL engine with MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n)


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, *by: str, resamples: int = 10_000, seed: int = 20260421, most: int = 1_000_000) -> DataFrame:
    """``(*by, n_clusters, point, low, high)``: mean of cluster means; bounds are order statistics of the resampled means.

    Rows are brought to one mean a cluster first. Draws are spread over the resamples, not over the clusters: a task makes its share of the
    resamples of all groups, so no group is in one task, and what a resample leaves is one number. Up to ``most`` means (8 bytes each) go to
    every task; more stay a table that the draws are joined to.
    """
    means = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.avg(value).alias("m"))
    if by:
        part = Window.partitionBy(*by)
        counted = cut(means.select(*by, "m", (F.row_number().over(part.orderBy(cluster)) - 1).cast("long").alias("i"), F.count("*").over(part).alias("n")))
        size = counted.count()
    else:
        counted = cut(numbered(means, [cluster], "i").select("m", "i"))
        size = counted.count()  # of the written means: to count them beside their numbers would read the table twice
        counted = counted.withColumn("n", F.lit(size).cast("long"))
    drawn = _means_drawn(counted, by, resamples, seed) if size <= most else _means_joined(counted, by, resamples, seed)
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row a resample
    ranked = drawn.withColumn("r", F.row_number().over(order.orderBy("mean", "rep")) - 1)
    bounds = ranked.groupBy(*by).agg(
        F.max(F.when(F.col("r") == int(0.025 * resamples), F.col("mean"))).alias("low"), F.max(F.when(F.col("r") == int(0.975 * resamples) - 1, F.col("mean"))).alias("high")
    )
    points = counted.groupBy(*by).agg(F.count("*").alias("n_clusters"), F.avg("m").alias("point"))
    joined = points.join(bounds, list(by)) if by else points.crossJoin(bounds)
    return joined.select(*by, "n_clusters", *(F.round(c, 6).alias(c) for c in ("point", "low", "high")))


def _means_joined(counted: DataFrame, by: tuple[str, ...], resamples: int, seed: int) -> DataFrame:
    """``(*by, rep, mean)`` by a join of every draw with the mean it draws."""
    blocks = -(-resamples // 500)
    reps = F.sequence(F.col("block") * 500, F.least((F.col("block") + 1) * 500, F.lit(resamples)) - 1)
    spread_out = counted.select(*by, "n", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    slots = spread_out.select(*by, "n", "j", F.explode(reps).alias("rep")).withColumn("i", draw(seed, F.col("rep"), F.col("j"), n=F.col("n")))
    return slots.join(counted.select(*by, "i", "m"), [*by, "i"]).groupBy(*by, "rep").agg(F.avg("m").alias("mean"))


def _means_drawn(counted: DataFrame, by: tuple[str, ...], resamples: int, seed: int) -> DataFrame:
    """``(*by, rep, mean)`` with all means in every task. A draw's digest is the same in all groups, so it is made once."""
    spark = counted.sparkSession
    ids = cut(counted.select(*by).distinct().withColumn("_g", F.monotonically_increasing_id())) if by else None
    rows = counted.join(ids, list(by)) if by else counted.withColumn("_g", F.lit(0).cast("long"))
    rows = rows.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("ms")).collect()
    groups = spark.sparkContext.broadcast([(r["_g"], np.array(r["ms"], dtype=np.float64)) for r in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longest = max((len(m) for _, m in groups.value), default=0)
        tails, at_once = Tails(str(j).encode() for j in range(longest)), max(1, (1 << 18) // max(1, longest))
        for pdf in batches:
            reps = pdf["rep"].to_numpy()
            for low in range(0, len(reps), at_once):
                part = reps[low : low + at_once]
                drawn = np.concatenate([tails.digests(f"{seed}|{r}|".encode()) for r in part])
                for g, m in groups.value:
                    yield pd.DataFrame({"_g": g, "rep": part, "mean": np.take(m, drawn[:, : len(m)] % np.uint32(len(m))).mean(axis=1)})

    tasks = min(resamples, 4 * spark.sparkContext.defaultParallelism)
    out = spark.range(0, resamples, 1, tasks).select(F.col("id").alias("rep")).mapInPandas(run, "_g long, rep long, mean double")
    return out.join(F.broadcast(ids), "_g").drop("_g") if by else out.drop("_g")  # one row a group


def paired_differences(df: DataFrame, cluster: str, arm: str, value: str, new: str, base: str) -> DataFrame:
    """``(cluster, diff)``: mean of the new arm minus mean of the base arm where a cluster has both."""
    sides = df.groupBy(cluster).agg(F.avg(F.when(F.col(arm) == new, F.col(value))).alias("x"), F.avg(F.when(F.col(arm) == base, F.col(value))).alias("y"))
    return sides.where("x is not null and y is not null").select(cluster, (F.col("x") - F.col("y")).alias("diff"))


def permutation_trend(df: DataFrame, cluster: str, dose: str, value: str, permutations: int = 1000, seed: int = 20260421, cells: int = 500_000) -> DataFrame:
    """``(n_clusters, rho, p)``: mean Spearman correlation of value with dose within clusters, against shuffles within clusters.

    A shuffle orders a cluster's doses by their MD5. A task makes a share of the permutations for the clusters of about ``cells`` doses, and leaves one
    number a permutation.
    """
    spark = df.sparkSession
    by_dose = df.groupBy(cluster, F.col(dose).alias("dose")).agg(F.avg(value).alias("v"))
    w = Window.partitionBy(cluster)
    ranked = by_dose.select(cluster, average_rank(F.col("v"), cluster, name="rv"), F.row_number().over(w.orderBy("dose")).alias("rd"), F.count("*").over(w).alias("m")).where("m >= 3")
    rows = cut(ranked.groupBy(cluster).agg(correlation("rv", "rd").alias("r"), F.array_sort(F.collect_list(F.struct("rd", "rv")))["rv"].alias("rv")))
    observed = rows.agg(F.count("*").alias("n_clusters"), F.avg(F.coalesce("r", F.lit(0.0))).alias("rho"), F.sum(F.size("rv")).alias("cells"))
    parts = -(-(observed.first()["cells"] or 1) // cells)
    blocks = min(permutations, -(-4 * spark.sparkContext.defaultParallelism // parts))
    size = -(-permutations // blocks)
    lists = rows.withColumn("part", F.pmod(F.xxhash64(cluster), F.lit(parts))).groupBy("part").agg(F.collect_list(F.struct(F.col(cluster).cast("string").alias("c"), "rv")).alias("x"))
    lists = lists.select(F.col("x")["c"].alias("c"), F.transform("x", lambda x: F.size(x["rv"])).alias("m"), F.flatten(F.col("x")["rv"]).alias("rv"))
    work = lists.withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1), F.lit(size)))).repartition(parts * blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, m, rv, low in zip(pdf["c"], pdf["m"], pdf["rv"], pdf["low"], strict=True):
                shuffled = Shuffles(list(c), np.asarray(m), np.asarray(rv, dtype=np.float64), seed)
                reps = range(low, min(low + size, permutations))
                yield pd.DataFrame({"rep": list(reps), "s": [shuffled.total(r) for r in reps]})

    null = work.mapInPandas(run, "rep int, s double").groupBy("rep").agg(F.sum("s").alias("s"))
    return observed.crossJoin(null).groupBy("n_clusters", "rho").agg(F.count_if(F.col("s") / F.col("n_clusters") >= F.col("rho") - 1e-12).alias("x")).select(
        "n_clusters", F.round("rho", 6).alias("rho"), F.round((F.col("x") + 1) / F.lit(permutations + 1), 6).alias("p")
    )


class Shuffles:
    """The sum over clusters of the correlation of ranks ``rv`` with a shuffled order; ``sizes`` says how many of the ranks are each cluster's."""

    def __init__(self, names: list[str | None], sizes: np.ndarray, rv: np.ndarray, seed: int):
        self.seed, self.classes = seed, []
        starts = np.cumsum(sizes) - sizes
        for m in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == m)
            ranks = rv[starts[at][None, :] + np.arange(m)[:, None]]  # (m, clusters)
            spread = ranks.std(axis=0) * math.sqrt((m * m - 1) / 12)
            weights = np.where(spread > 1e-12, (ranks - ranks.mean(axis=0)) / np.where(spread > 1e-12, spread, 1) / m, 0.0)
            tails = [(f"{d}" if names[i] is None else f"{names[i]}|{d}").encode() for d in range(1, m + 1) for i in at]
            self.classes.append((m, len(at), weights, tails, Tails(tails)))

    def total(self, rep: int) -> float:
        head = f"{self.seed}|{rep}|".encode()
        out = 0.0
        for m, n, weights, tails, hashed in self.classes:
            first, second = hashed.digests(head, 2).astype(np.uint64)
            keys = (first << np.uint64(32) | second).reshape(m, n)
            out += float((places(keys, lambda i: [hashlib.md5(head + tails[d * n + i]).digest() for d in range(m)]) * weights).sum())  # noqa: B023
        return out


def places(keys: np.ndarray, whole: Callable[[int], list[bytes]]) -> np.ndarray:
    """From 0, the place of each key in its column; columns with equal keys are ordered by their ``whole`` digests."""
    m, n = keys.shape
    if m > 24:
        order = np.argsort(keys, axis=0)
        out, ordered = np.empty(keys.shape, dtype=np.int64), np.take_along_axis(keys, order, axis=0)
        np.put_along_axis(out, order, np.broadcast_to(np.arange(m)[:, None], keys.shape), axis=0)
        tied = (ordered[1:] == ordered[:-1]).any(axis=0)
    else:
        out, tied = np.zeros((m, n), dtype=np.int8), np.zeros(n, dtype=bool)
        for d in range(m):
            for e in range(d + 1, m):
                later = (keys[e] < keys[d]).view(np.int8)
                out[d] += later
                out[e] += 1 - later
                tied |= keys[e] == keys[d]
    for i in np.flatnonzero(tied).tolist():
        digests = whole(i)
        out[:, i] = [sorted(digests).index(x) for x in digests]
    return out


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k); 1 if fewer than k are wrong, null if n < k."""
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * (n - c - F.lit(i)) / (n - F.lit(i))
    return F.when(n < k, F.lit(None)).when(n - c < k, F.lit(1.0)).otherwise(1 - miss)


def factorial_2x2(df: DataFrame, cluster: str, a: str, b: str, value: str) -> DataFrame:
    """``(effect, n, mean)`` of a, b and their interaction over clusters with all four cells (a and b are boolean)."""
    mean = lambda x, y: F.avg(F.when((F.col(a) == x) & (F.col(b) == y), F.col(value)))
    cells = df.groupBy(cluster).agg(mean(True, True).alias("tt"), mean(True, False).alias("tf"), mean(False, True).alias("ft"), mean(False, False).alias("ff")).dropna()
    tt, tf, ft, ff = (F.col(c) for c in ("tt", "tf", "ft", "ff"))
    effects = F.array(
        F.struct(F.lit("a").alias("effect"), ((tt + tf - ft - ff) / 2).alias("d")),
        F.struct(F.lit("b").alias("effect"), ((tt + ft - tf - ff) / 2).alias("d")),
        F.struct(F.lit("a:b").alias("effect"), (tt - tf - ft + ff).alias("d")),
    )
    return cells.select(F.explode(effects).alias("e")).groupBy("e.effect").agg(F.count("*").alias("n"), F.round(F.avg("e.d"), 6).alias("mean"))


def z_within(value: str, *by: str) -> Column:
    """Population z-score within groups; a spread of 0 counts as 1."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
