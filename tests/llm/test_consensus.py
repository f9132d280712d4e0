import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from argosift.llm import consensus as C

FIELDS = {"cls": ("a_b", "c", "d")}
SCHEMA = "run string, who string, cls string, at timestamp, annotator string, item string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA).withColumn("at", F.col("at"))


def test_labels_are_tidied_and_the_latest_counts(spark):
    from datetime import datetime

    t = [datetime(2026, 1, d) for d in (1, 2, 3)]
    data = [("r", " Ann ", "A-B", t[0]), ("r", "ann", "C", t[1]), ("r", "ann", "bogus", t[2]), ("r", "bob", " a b ", None), ("r", None, "c", t[0]), (None, "bob", "c", t[0]), ("r", "", "c", t[0]), ("r", "cy", None, t[0])]
    got = C.long_labels(rows(spark, data), "run", "who", FIELDS, "at").collect()
    assert {(r["annotator"], r["label"]) for r in got} == {("ann", "c"), ("bob", "a_b")}


def test_reliable_minority_beats_unreliable_majority(spark):
    rng = random.Random(3)
    values, data, truth = FIELDS["cls"], [], {}
    for i in range(250):
        truth[f"r{i}"] = true = rng.choice(values)
        for who, right in (("good1", 0.95), ("good2", 0.95), ("bad1", 0.34), ("bad2", 0.34), ("bad3", 0.34)):
            data.append((f"r{i}", who, true if rng.random() < right else rng.choice(values), None))
    labels = C.long_labels(rows(spark, data), "run", "who", FIELDS, "at")
    found, reliability = C.minimax_consensus(labels, FIELDS)
    got = {r["item"]: r["consensus"] for r in found.collect()}
    assert sum(got[k] == v for k, v in truth.items()) / len(truth) > 0.93
    rel = {r["annotator"]: r["reliability"] for r in reliability.collect()}
    assert min(rel["good1"], rel["good2"]) > max(rel["bad1"], rel["bad2"], rel["bad3"]) + 0.2


def test_tilts_as_a_table_give_the_same_and_every_annotator_has_its_own(spark):
    rng = random.Random(5)
    values = FIELDS["cls"]
    data = [(f"r{i}", f"w{rng.randrange(9)}", rng.choice(values), None) for i in range(60) for _ in range(4)]
    data += [(f"r{i}", "main", values[i % 3], None) for i in range(60)]
    labels = C.long_labels(rows(spark, data), "run", "who", FIELDS, "at").cache()
    both = [C.minimax_consensus(labels, FIELDS, rounds=5, local_bytes=n) for n in (1 << 20, 0)]
    (one, rated), (many, rated_too) = [(c.toPandas().sort_values("item", ignore_index=True), r.toPandas().sort_values("annotator", ignore_index=True)) for c, r in both]
    assert len(one) == 60 and one.drop(columns="probability").equals(many.drop(columns="probability"))
    assert np.allclose(one["probability"], many["probability"], atol=1e-6)
    assert len(rated) == 10 and rated["reliability"].nunique() == 10 and np.allclose(rated["reliability"], rated_too["reliability"], atol=1e-6)


def test_item_tilts_reach_the_optimum_of_the_dual():
    rng = np.random.default_rng(2)
    k, n, n_items, beta = 3, 40, 6, 1.5
    sigma, prior = rng.normal(size=(n, k, k)), np.array([0.5, 0.3, 0.2])
    item, label, times = rng.integers(0, n_items, n), rng.integers(0, k, n), rng.integers(1, 3, n)

    def dual(tau, j):
        rows = np.flatnonzero(item == j)
        x = sigma[rows] + tau
        log_p = x - np.log(np.exp(x).sum(axis=2, keepdims=True))
        likely = np.log(prior) + (times[rows, None] * log_p[np.arange(len(rows)), :, label[rows]]).sum(axis=0)
        return np.log(np.exp(likely).sum()) - beta / 2 * (tau**2).sum()

    _, tau, _ = C.fit_items(sigma, prior, item, label, times, n_items, beta, tolerance=1e-7, most=500)
    _, short, _ = C.fit_items(sigma, prior, item, label, times, n_items, beta, most=2)
    for j in range(n_items):
        best = dual(tau[j], j)
        assert best >= dual(short[j], j) - 1e-9
        for c in np.ndindex(k, k):
            for d in (1e-3, -1e-3):
                near = tau[j].copy()
                near[c] += d
                assert dual(near, j) <= best + 1e-9


def test_empty_input_and_single_labels(spark):
    empty, reliability = C.minimax_consensus(C.long_labels(rows(spark, []), "run", "who", FIELDS, "at"), FIELDS, rounds=2)
    assert empty.count() == 0 and reliability.count() == 0
    one, _ = C.minimax_consensus(C.long_labels(rows(spark, [("r", "a", "c", None)]), "run", "who", FIELDS, "at"), FIELDS, rounds=2)
    r = one.first()
    assert (r["consensus"], r["agreement"], r["n_labels"]) == ("c", None, 1)


def test_alpha(spark):
    same = [(f"r{i}", w, v, None) for i, v in enumerate(["a_b", "c", "d"]) for w in "xy"]
    assert C.krippendorff_alpha(C.long_labels(rows(spark, same), "run", "who", FIELDS, "at")).first()["alpha"] == pytest.approx(1.0)
    split = [("r0", "x", "c", None), ("r0", "y", "d", None), ("r1", "x", "c", None), ("r1", "y", "c", None)]
    # coincidences: c-c 2, c-d 1, d-c 1; values c 3, d 1: alpha = 1 - 3 * 2 / (16 - 10)
    assert C.krippendorff_alpha(C.long_labels(rows(spark, split), "run", "who", FIELDS, "at")).first()["alpha"] == pytest.approx(0.0)
    constant = [("r0", "x", "c", None), ("r0", "y", "c", None)]
    assert C.krippendorff_alpha(C.long_labels(rows(spark, constant), "run", "who", FIELDS, "at")).first()["alpha"] is None
