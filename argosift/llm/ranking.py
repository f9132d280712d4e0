"""Global ranking from pairwise comparisons by offence-defence scaling.

With ``W[i, j]`` the (smoothed) points item *i* took from item *j*, Sinkhorn steps alternate
``offence[i] = sum_j W[i, j] / defence[j]`` and ``defence[i] = sum_j W[j, i] / offence[j]``; strength is
``offence / defence``. If the points follow ``n_ij * s_i / (s_i + s_j)``, strengths proportional to ``s`` are a fixed
point whatever the numbers ``n_ij`` are, so unequal numbers of comparisons do not favour anybody.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosift.llm.textforms import clock_micros
from argosift.operators.ordering import numbered
from argosift.runtime import cut


def tidy(column: str) -> Column:
    """Lower case without outer spaces, hyphens and spaces as underscores; empty becomes null."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.col(column).cast("string")), r"^\s+|\s+$", ""), r"[\s-]+", "_")
    return F.when(text != "", text)


def votes_as_points(df: DataFrame) -> DataFrame:
    """Rows ``(new, base, unit, judge, new_first, points)`` from votes in the form of pairwise_votes.

    points are those of ``new``: 1, 0.5 (tie) or 0. ``new_won`` and ``baseline_won`` decide where both are given and are not
    both true; otherwise winner with pair_order does. Votes that name no outcome, or compare an item with itself or null, are
    dropped. Of votes that repeat (new, base, unit, judge, order) the latest by judged_at counts, equal times: the larger points.
    """
    order, winner = tidy("pair_order"), F.upper(tidy("winner"))
    new_first = F.when(order == "new_first", True).when(order.isin("baseline_first", "base_first"), False)
    by_flag = (
        F.when(F.col("new_won") & ~F.col("baseline_won"), 1.0)
        .when(~F.col("new_won") & F.col("baseline_won"), 0.0)
        .when(~F.col("new_won") & ~F.col("baseline_won"), 0.5)
    )
    by_winner = (
        F.when(winner == "TIE", 0.5)
        .when((winner == "A") & new_first, 1.0)
        .when((winner == "B") & ~new_first, 1.0)
        .when((winner == "A") & ~new_first, 0.0)
        .when((winner == "B") & new_first, 0.0)
    )
    rows = df.select(
        tidy("new_method").alias("new"),
        tidy("base_method").alias("base"),
        F.coalesce(F.col("unit").cast("string"), F.lit("")).alias("unit"),
        F.coalesce(tidy("judge"), F.lit("")).alias("judge"),
        new_first.alias("new_first"),
        F.coalesce(by_flag, by_winner).alias("points"),
        F.col("judged_at").alias("at"),
    ).where("new is not null and base is not null and new <> base and points is not null")
    # Time and points (0, 1 or 2 halves) as one number, so that the latest is a plain maximum; no time comes before all times.
    halves = (F.col("points") * 2).cast("long")
    last = clock_micros(F.col("at")) * 4 + halves
    return (
        rows.groupBy("new", "base", "unit", "judge", "new_first")
        .agg(F.max(last).alias("last"))
        .select("new", "base", "unit", "judge", "new_first", (F.pmod("last", F.lit(4)) / 2).alias("points"))
    )


def win_matrix(points: DataFrame, balance_order: bool = True) -> DataFrame:
    """Points as cells ``(winner, loser, points, n)``: what ``winner`` took from ``loser`` in their n comparisons.

    With ``balance_order`` the mean of a pair is taken over the mean of each order it was shown in (orders weigh the same where
    both occur), which removes a liking for the first or second place. Each unordered pair gives two cells.
    """
    flat = points.select(
        F.least("new", "base").alias("a"),
        F.greatest("new", "base").alias("b"),
        F.when(F.col("new") < F.col("base"), F.col("points")).otherwise(1 - F.col("points")).alias("p"),
        (F.col("new_first") == (F.col("new") < F.col("base"))).alias("a_first"),
    )
    place = F.col("a_first") if balance_order else F.lit(True)
    by_order = flat.groupBy("a", "b", place.alias("place")).agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    known = F.col("place").isNotNull()
    by_pair = by_order.groupBy("a", "b").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.avg(F.when(known, F.col("s") / F.col("n"))), F.sum("s") / F.sum("n")).alias("mean"),
    )
    cell = lambda x, y, mean: F.struct(F.col(x).alias("winner"), F.col(y).alias("loser"), (mean * F.col("n")).alias("points"), F.col("n"))
    return by_pair.select(F.explode(F.array(cell("a", "b", F.col("mean")), cell("b", "a", 1 - F.col("mean")))).alias("c")).select("c.*")


#: How many earlier rounds the acceleration looks back on.
_MEMORY = 30


class _Accelerated:
    """Anderson acceleration of a map on vectors that it never sees: it gets the products of the changes and gives the mixing weights."""

    def __init__(self):
        self.kept: list[int] = []
        self.last = float("inf")

    def weights(self, products: np.ndarray, rounds: list[int], size: float) -> dict[int, float]:
        """Weights, summing to 1, of the rounds whose mapped vectors make the next one. ``products[a, b]`` is the scalar product of the
        changes of rounds a and b; the newest is last. A round that made things much worse starts the memory anew."""
        if size > 4 * self.last:
            rounds, products = rounds[-1:], products[-1:, -1:]
        self.last, self.kept = size, rounds
        n = len(rounds)
        if n == 1:
            return {rounds[0]: 1.0}
        # The least squared length of sum(w * change) with sum(w) = 1, in differences to the newest.
        g = products[:-1, :-1] - products[:-1, -1:] - products[-1:, :-1] + products[-1, -1]
        h = products[-1, -1] - products[:-1, -1]
        w = np.linalg.lstsq(g + 1e-12 * np.trace(g) / (n - 1) * np.eye(n - 1), h, rcond=None)[0]
        if not np.isfinite(w).all() or np.abs(w).max() > 1e4:
            self.kept = rounds[-1:]
            return {rounds[-1]: 1.0}
        return {**dict(zip(rounds[:-1], w.tolist(), strict=True)), rounds[-1]: 1.0 - float(w.sum())}


def offence_defence(
    cells: DataFrame, smoothing: float = 0.5, tolerance: float = 1e-9, max_rounds: int = 2000, local_cells: int = 2_000_000
) -> DataFrame:
    """``(name, strength, offence, defence, n_comparisons, place, converged)`` of every item in ``cells`` (see :func:`win_matrix`).

    ``smoothing`` points are added to both cells of every pair that met, so that unbeaten and winless items stay finite, and stand in
    every item's cell with itself: a tie with an equal, which moves no strength but without which graphs such as a star or two sides
    that only meet each other have no scaling, or no single one. Pairs that never met stay empty. Strengths have geometric mean 1; place counts from 1, equal strengths by name. Empty input gives an
    empty table. Items in groups that never met each other are scaled alike but are not comparable between the groups.

    Rounds go on until no offence changes by more than ``tolerance`` (relative), or ``max_rounds``; ``converged`` says which. Up to
    ``local_cells`` cells (counted first) are scaled on the driver, more by joins with checkpoints: the same rounds, acceleration and
    tolerance on both ways.
    """
    smooth = cells.select("winner", "loser", (F.col("points") + smoothing).alias("w"), F.col("n").cast("double").alias("n"))
    smooth = cut(smooth)
    itself = smooth.groupBy("winner").agg(F.lit(float(smoothing)).alias("w"), F.lit(0.0).alias("n")).select("winner", F.col("winner").alias("loser"), "w", "n")
    smooth = smooth.unionByName(itself)
    scaled = _on_driver if smooth.count() <= local_cells else _by_joins
    found = scaled(smooth, tolerance, max_rounds)
    centre = found.agg(F.avg(F.log(F.col("offence") / F.col("defence"))).alias("centre"))
    ranked = found.crossJoin(F.broadcast(centre)).withColumn(  # one row
        "strength", F.exp(F.log(F.col("offence") / F.col("defence")) - F.col("centre"))
    )
    placed = numbered(ranked, [F.desc("strength"), F.col("name")], "place")
    return placed.select(
        "name", "strength", "offence", "defence", F.col("n").cast("long").alias("n_comparisons"), (F.col("place") + 1).cast("int").alias("place"), "converged"
    )


def _on_driver(smooth: DataFrame, tolerance: float, max_rounds: int) -> DataFrame:
    rows = smooth.toPandas()  # at most local_cells rows
    names = sorted(set(rows["winner"]) | set(rows["loser"]))
    at = {x: i for i, x in enumerate(names)}
    i, j = rows["winner"].map(at).to_numpy(int), rows["loser"].map(at).to_numpy(int)
    w, size = rows["w"].to_numpy(), len(names)
    x, defence, done = np.zeros(size), np.ones(size), not size
    faster, mapped, changes = _Accelerated(), {}, {}
    for turn in range(max_rounds if size else 0):
        defence = np.bincount(j, w / np.exp(x)[i], size)
        g = np.log(np.bincount(i, w / defence[j], size))
        g -= g.mean()
        mapped[turn], changes[turn] = g, g - x
        largest = np.abs(changes[turn]).max()
        done = bool(largest < tolerance)
        if done:
            x = g
            break
        kept = [r for r in [*faster.kept, turn] if r > turn - _MEMORY]
        stack = np.array([changes[r] for r in kept])
        mix = faster.weights(stack @ stack.T, kept, float(np.sqrt(stack[-1] @ stack[-1])))
        x = sum(c * mapped[r] for r, c in mix.items())
        x -= x.mean()
        mapped, changes = ({r: m[r] for r in faster.kept} for m in (mapped, changes))
    if size:
        defence = np.bincount(j, w / np.exp(x)[i], size)
    met = np.bincount(i, rows["n"].to_numpy(), size)
    return smooth.sparkSession.createDataFrame(
        [(name, float(np.exp(x[k])), float(defence[k]), float(met[k]), done) for k, name in enumerate(names)],
        "name string, offence double, defence double, n double, converged boolean",
    )


def _by_joins(smooth: DataFrame, tolerance: float, max_rounds: int) -> DataFrame:
    """The rounds of :func:`_on_driver` on a table of items: the last mapped vectors and changes are its columns."""
    state = cut(smooth.groupBy(F.col("winner").alias("name")).agg(F.lit(0.0).alias("x"), F.sum("n").alias("n")))

    def defences(x: DataFrame) -> DataFrame:
        given = smooth.join(x.select(F.col("name").alias("winner"), "x"), "winner")
        return given.groupBy(F.col("loser").alias("name")).agg(F.sum(F.col("w") / F.exp("x")).alias("defence"))

    faster, done = _Accelerated(), False
    for turn in range(max_rounds):
        taken = smooth.join(defences(state).withColumnRenamed("name", "loser"), "loser")
        g = taken.groupBy(F.col("winner").alias("name")).agg(F.log(F.sum(F.col("w") / F.col("defence"))).alias("raw"))
        fresh = cut(state.join(g, "name"))
        centre = fresh.agg(F.avg("raw")).first()[0]
        fresh = fresh.withColumn(f"g{turn}", F.col("raw") - F.lit(centre)).withColumn(f"d{turn}", F.col(f"g{turn}") - F.col("x"))
        kept = [r for r in [*faster.kept, turn] if r > turn - _MEMORY]
        pairs = [(a, b) for a in kept for b in kept if a <= b]
        sums = fresh.agg(F.max(F.abs(f"d{turn}")), *(F.sum(F.col(f"d{a}") * F.col(f"d{b}")) for a, b in pairs)).first()
        done = sums[0] < tolerance
        if done:
            state = fresh.select("name", F.col(f"g{turn}").alias("x"), "n")
            break
        products = np.zeros((len(kept), len(kept)))
        for (a, b), value in zip(pairs, sums[1:], strict=True):
            products[kept.index(a), kept.index(b)] = products[kept.index(b), kept.index(a)] = value
        mix = faster.weights(products, kept, float(np.sqrt(products[-1, -1])))
        x = sum((F.col(f"g{r}") * F.lit(c) for r, c in mix.items()), F.lit(0.0))  # mapped vectors have mean 0, so their mixture has
        state = fresh.select("name", x.alias("x"), "n", *(f"{v}{r}" for r in faster.kept for v in "gd"))
    return state.select("name", F.exp("x").alias("offence"), "n").join(defences(state), "name").withColumn("converged", F.lit(done))
