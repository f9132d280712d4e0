"""Draws by MD5 made many at once equal those of hashlib, and resampling by them equals the plain way."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from argosift.functions.digests import CHUNK, Tails
from argosift.operators import stats as S


def test_digests():
    tails = [str(j).encode() for j in range(0, 3 * CHUNK, 2)] + [b"", b"x" * 40, b"y" * 200, "ä|7".encode()]
    hashed = Tails(tails)
    for head in (b"20260421|7|", b"20260421|9999|", b"", b"z" * 55):
        for words in (1, 2):
            want = [[int(hashlib.md5(head + t).hexdigest()[8 * k : 8 * k + 8], 16) for t in tails] for k in range(words)]
            assert (hashed.digests(head, words) == np.array(want)).all()


def test_bootstrap_drawn_and_joined(spark):
    rng = random.Random(2)
    rows = [(g, c, rng.random()) for g, n in (("a", 40), ("b", 7), (None, 3), ("c", 1)) for c in range(n) for _ in range(2)]
    d = spark.createDataFrame(rows, "g string, c int, v double")
    for by in ((), ("g",)):
        d2 = d if by else d.where("g = 'a'")
        drawn, joined = (sorted(S.cluster_bootstrap(d2, "c", "v", *by, resamples=200, most=most).collect()) for most in (1000, 0))
        assert drawn == joined and len(drawn) == (3 if by else 1)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_bootstrap_reads_its_rows_once(spark, by):
    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    d = spark.range(1000).select(F.lit("a").alias("g"), (F.col("id") % 50).alias("c"), F.rand(5).alias("v")).mapInPandas(watched, "g string, c long, v double")
    assert S.cluster_bootstrap(d, "c", "v", *by, resamples=20).first()["n_clusters"] == 50
    assert read.value == 1000


def test_bootstrap_of_nothing(spark):
    d = spark.createDataFrame([(1, None), (2, None)], "c int, v double")
    for most in (1000, 0, -1):
        assert S.cluster_bootstrap(d, "c", "v", resamples=20, most=most).collect() == [(0, None, None, None)]


@pytest.mark.parametrize("cells", [500_000, 10])
def test_permutations_by_hand(spark, cells):
    rng = random.Random(3)
    rows = [(c, d, rng.choice([0.1, 0.2, 0.3, 0.5])) for c in range(12) for d in range(rng.choice([2, 3, 5, 30]))]
    d = spark.createDataFrame(rows, "c int, dose int, v double")
    got = S.permutation_trend(d, "c", "dose", "v", permutations=100, cells=cells).first()

    def ranks(xs):
        return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]

    clusters = {c: ranks([v for k, _, v in rows if k == c]) for c in {c for c, _, _ in rows}}
    clusters = {c: r for c, r in clusters.items() if len(r) >= 3}
    corr = lambda x, y: float(np.corrcoef(x, y)[0, 1]) if np.std(x) > 0 else 0.0
    rho = np.mean([corr(r, range(len(r))) for r in clusters.values()])

    def shuffled(rep, c, m):
        return ranks([hashlib.md5(f"20260421|{rep}|{c}|{d}".encode()).hexdigest() for d in range(1, m + 1)])

    null = [np.mean([corr(r, shuffled(rep, c, len(r))) for c, r in clusters.items()]) for rep in range(100)]
    assert (got["n_clusters"], got["rho"]) == (len(clusters), pytest.approx(rho, abs=1e-6))
    assert got["p"] == pytest.approx((sum(x >= rho - 1e-12 for x in null) + 1) / 101, abs=1e-6)


def test_places_of_equal_keys():
    keys = np.array([[5, 1], [5, 2], [1, 3]], dtype=np.uint64)
    assert S.places(keys, lambda i: [b"c", b"b", b"a"]).tolist() == [[2, 0], [1, 1], [0, 2]]


@pytest.mark.parametrize("what", ["grouped", "whole", "trend"])
def test_ten_thousand_values_in_time(spark, what):
    """A hundred million digests, one for each value and resample."""
    d = spark.range(10_000).select((F.col("id") % 2000).alias("c"), (F.col("id") / 2000).cast("int").alias("dose"), F.rand(5).alias("v")).cache()
    began = time.time()
    if what == "trend":
        S.permutation_trend(d, "c", "dose", "v", permutations=10_000).collect()
    else:
        values = d.select(F.lit("a").alias("g"), (F.col("c") * 5 + F.col("dose")).alias("c"), "v")
        S.cluster_bootstrap(values, "c", "v", *(["g"] if what == "grouped" else []), resamples=10_000).collect()
    assert time.time() - began < 60
