import random
from datetime import datetime

import pytest

from argosift.llm import ranking as R

SCHEMA = "new_method string, base_method string, judge string, unit string, pair_order string, winner string, new_won boolean, baseline_won boolean, judged_at timestamp, points double, name string"
T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def votes(spark, data):
    return spark.createDataFrame([(*r, 9.0, "clash") for r in data], SCHEMA)


def test_outcomes(spark):
    data = [
        ("a", "b", "j", "u1", "new_first", "B", True, False, T1),  # the flags decide
        ("a", "b", "j", "u2", " BASE_FIRST", " b ", None, None, T1),
        ("a", "b", "j", "u3", "new_first", "tie", None, None, T1),
        ("a", "b", "j", "u4", None, "A", None, None, T1),  # no order: nothing known
        ("a", "b", "j", "u5", "new_first", "A", False, True, T1),
        ("a", "b", "j", "u5", "new_first", "A", True, False, T2),  # later
        ("a", "a", "j", "u6", "new_first", "A", True, False, T1),
        (None, "a", "j", "u7", "new_first", "A", True, False, T1),
        ("a", "b", None, "u8", "new_first", "", False, False, None),
    ]
    got = {r["unit"]: r["points"] for r in R.votes_as_points(votes(spark, data)).collect()}
    assert got == {"u1": 1.0, "u2": 1.0, "u3": 0.5, "u5": 1.0, "u8": 0.5}


def simulated(seed=5):
    rng = random.Random(seed)
    strength = {f"m{i}": 2 ** (i / 2) for i in range(8)}
    data = []
    for n in range(6000):
        a, b = ("m0", f"m{rng.randrange(1, 8)}") if rng.random() < 0.5 else rng.sample(sorted(strength), 2)
        first = rng.random() < 0.8
        p = strength[a] / (strength[a] + strength[b])
        p = min(0.97, p + 0.08) if first else max(0.03, p - 0.08)  # who is shown first has an advantage
        won = rng.random() < p
        data.append((a, b, "j", f"u{n}", "new_first" if first else "baseline_first", None, won, not won, T1))
    return strength, data


def test_recovers_the_order_despite_uneven_comparisons(spark):
    strength, data = simulated()
    found = R.offence_defence(R.win_matrix(R.votes_as_points(votes(spark, data)))).orderBy("place").collect()
    assert [r["name"] for r in found] == sorted(strength, key=strength.get, reverse=True)
    assert sum(r["n_comparisons"] for r in found) == 12000


def test_joins_give_the_same_as_the_driver(spark):
    _, data = simulated(6)
    cells = R.win_matrix(R.votes_as_points(votes(spark, data[:400])))
    one = {r["name"]: r for r in R.offence_defence(cells).collect()}
    many = {r["name"]: r for r in R.offence_defence(cells, local_cells=0).collect()}
    assert one.keys() == many.keys() and all(r["converged"] for r in [*one.values(), *many.values()])
    for name, r in one.items():
        assert many[name]["place"] == r["place"] and many[name]["n_comparisons"] == r["n_comparisons"]
        assert all(many[name][c] == pytest.approx(r[c], rel=1e-6) for c in ("strength", "offence", "defence"))


def graph(spark, pairs):
    rng = random.Random(3)
    rows = [(f"i{a:03}", f"i{b:03}", float(rng.randrange(4)), 3) for pair in pairs for a, b in (pair, pair[::-1])]
    return rows, spark.createDataFrame(rows, "winner string, loser string, points double, n long")


def test_sparse_graphs_converge_and_a_stop_before_is_told(spark):
    rng = random.Random(4)
    chain = [(i, i + d) for i in range(100) for d in (1, 2) if i + d < 100]  # plain rounds need more than 5,000
    sparse = sorted({(min(a, b), max(a, b)) for a in range(400) for b in rng.sample(range(400), 2) if a != b})
    star = [(0, i) for i in range(1, 30)]
    for pairs in (chain, sparse, star):
        rows, cells = graph(spark, pairs)
        found = R.offence_defence(cells).toPandas()
        assert found["converged"].all() and sorted(found["place"]) == list(range(1, len(found) + 1))
        offence, defence = (dict(zip(found["name"], found[c], strict=True)) for c in ("offence", "defence"))
        got = {k: 0.5 / defence[k] for k in offence}
        for a, b, points, _ in rows:
            got[a] += (points + 0.5) / defence[b]
        ratios = [got[k] / offence[k] for k in got]
        assert max(ratios) / min(ratios) - 1 < 1e-6  # a fixed point
    assert not any(r["converged"] for r in R.offence_defence(cells, max_rounds=3).collect())


def test_empty_unbeaten_and_ties(spark):
    assert R.offence_defence(R.win_matrix(R.votes_as_points(votes(spark, [])))).count() == 0
    won = [("a", "b", "j", f"u{i}", "new_first", "A", None, None, T1) for i in range(3)]
    found = R.offence_defence(R.win_matrix(R.votes_as_points(votes(spark, won)))).orderBy("place").collect()
    assert [r["name"] for r in found] == ["a", "b"] and found[0]["strength"] < float("inf")
    even = [("b", "a", "j", "u", "new_first", "TIE", None, None, T1)]
    assert [r["name"] for r in R.offence_defence(R.win_matrix(R.votes_as_points(votes(spark, even)))).orderBy("place").collect()] == ["a", "b"]
