"""Consensus from several annotators' labels by minimax conditional entropy.

The probability that annotator *i* gives item *j* of true class *c* the label *k* is
``softmax_k(sigma_i[c, k] + tau_j[c, k])``: *sigma* tilts by annotator, *tau* by item. Both are the
multipliers of the dual problem and are fitted by regularised coordinate ascent (diagonal Newton steps),
in turn with the posteriors of the true classes.

Distribution: items are independent given *sigma*, so a round is one pass over the items. *tau* and the
posterior of an item are brought to their optimum from *sigma* in that pass (they need no state between rounds), and the pass
returns only sums by (field, annotator, class, label), which Spark aggregates. Every annotator has a *sigma* of its own. Up to
``local_bytes`` of them (counted first) are held by the driver and broadcast each round; more stay a table, are joined to the labels by
annotator and updated where they lie. The steps are the same functions on both ways.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosift.llm.textforms import clock_micros
from argosift.operators.ordering import numbered
from argosift.runtime import cut


def tidy_label(column: Column | str) -> Column:
    """Lower case, no outer spaces, underscores for inner spaces and hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), r"^\s+|\s+$", ""), r"[\s-]", "_")


def tidy_name(column: Column | str) -> Column:
    """Lower case without outer spaces; empty becomes null."""
    name = F.regexp_replace(F.lower(column), r"^\s+|\s+$", "")
    return F.when(name != "", name)


def long_labels(
    df: DataFrame, item: str, annotator: str, fields: dict[str, Sequence[str]], at: str | None = None, repeat: str | None = None
) -> DataFrame:
    """Valid labels as rows ``(item, field, annotator, label)``.

    ``fields`` names the label columns and the values allowed in them. Labels outside these values, and rows without item or
    annotator, are dropped as invalid. Of an annotator's labels for an item and field the latest by ``at`` counts (a null time
    is the earliest; equal times: the larger label); with ``repeat``, the latest for each value of that column.
    """
    time = F.col(at) if at else F.lit(None).cast("timestamp")
    again = F.coalesce(F.col(repeat).cast("string"), F.lit("")) if repeat else F.lit("")
    rows = df.select(
        F.col(item).cast("string").alias("item"),
        tidy_name(F.col(annotator).cast("string")).alias("annotator"),
        again.alias("again"),
        time.alias("at"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tidy_label(F.col(f).cast("string")).alias("label")) for f in fields))).alias("v"),
    ).select("item", "annotator", "again", "at", "v.*")
    valid = F.lit(False)
    for field, values in fields.items():
        valid = valid | ((F.col("field") == field) & F.col("label").isin([str(v) for v in values]))
    rows = rows.where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & valid)
    # Time and label as one number, so that the latest is a plain maximum.
    names = sorted({str(v) for values in fields.values() for v in values})
    number = F.create_map(*(x for i, v in enumerate(names) for x in (F.lit(v), F.lit(i))))
    last = clock_micros(F.col("at")) * len(names) + number[F.col("label")]
    return (
        rows.groupBy("item", "field", "annotator", "again")
        .agg(F.max(last).alias("last"))
        .select("item", "field", "annotator", F.array(*map(F.lit, names))[F.pmod("last", F.lit(len(names))).cast("int")].alias("label"))
    )


def _start(k: int, n: int = 1) -> np.ndarray:
    """The tilt every annotator starts with: right in seven of ten cases."""
    return np.tile(np.where(np.eye(k, dtype=bool), np.log(0.7), np.log(0.3 / max(k - 1, 1))), (n, 1, 1))


def _log_sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    return x - _log_sum_exp(x)


def fit_items(sigma, prior, item, label, times, n_items, beta, tolerance=1e-3, most=50):
    """``(q, tau, p)``: posteriors and tilts of the items of a batch, and the label probabilities that go with them.

    One entry a (item, annotator, label): ``sigma`` is that annotator's tilt, ``times`` how often the label was given, ``item`` is
    0..n_items-1. Each item's tilt climbs ``log sum_c prior_c prod p(labels | c) - beta / 2 * |tau|^2`` until no cell moves by more than
    ``tolerance``; items that have settled are left out of further steps.
    """
    k, n = len(prior), len(item)
    tau, q = np.zeros((n_items, k, k)), np.tile(prior, (n_items, 1))
    p = np.zeros((n, k, k))
    order = np.argsort(item, kind="stable")
    item, sigma, label, times = item[order], sigma[order], label[order], times[order].astype(float)
    hot = np.eye(k)[label]
    active = np.arange(n)
    for turn in range(most + 1):
        at = item[active]
        starts = np.flatnonzero(np.r_[True, np.diff(at) > 0]) if len(at) else np.zeros(0, int)
        present = at[starts]
        log_p = _log_softmax(sigma[active] + tau[at])
        weight = times[active]
        given = np.take_along_axis(log_p, label[active][:, None, None], axis=2)[:, :, 0] * weight[:, None]
        likely = np.log(prior) + (np.add.reduceat(given, starts, axis=0) if len(at) else given)
        now = np.exp(_log_softmax(likely))
        probability = np.exp(log_p)
        q[present], p[active] = now, probability
        if turn == most or not len(at):
            break
        gap = np.add.reduceat((hot[active][:, None, :] - probability) * weight[:, None, None], starts, axis=0)
        bend = np.add.reduceat(probability * (1 - probability) * weight[:, None, None], starts, axis=0)
        step = (now[:, :, None] * gap - beta * tau[present]) / (now[:, :, None] * bend + beta)
        step = 0.8 * np.clip(step, -2, 2)
        tau[present] += step
        moving = np.zeros(n_items, bool)
        moving[present[np.abs(step).max(axis=(1, 2)) > tolerance]] = True
        active = active[moving[at]]
    back = np.empty(n, int)
    back[order] = np.arange(n)
    return q, tau, p[back]


def move_annotators(sigma, seen, expected, curve, centre, alpha):
    """One damped Newton step of the annotators' tilts, which the penalty draws to ``centre``."""
    step = (seen - expected - alpha * (sigma - centre)) / (curve + alpha)
    return _log_softmax(sigma + np.clip(step, -1, 1))


def smoothed_start(seen, total):
    """Tilts from confusion counts, smoothed by four labels a class of the mean annotator."""
    mean = total + 1.0
    mean = mean / mean.sum(axis=1, keepdims=True)
    counts = seen + 4 * mean
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def _flat(pdf: pd.DataFrame):
    sizes = pdf["who"].map(len).to_numpy()
    item = np.repeat(np.arange(len(pdf)), sizes)
    return item, *(np.concatenate(pdf[c].to_numpy()) for c in ("who", "label", "times"))


_CELLS = "field string, who long, cell int, seen double, expected double, curve double"


def _sum_cells(field, who, q, p, hot, times) -> pd.DataFrame:
    """Sums of a batch by annotator and cell."""
    k = q.shape[1]
    names, at = np.unique(who, return_inverse=True)
    weight = q[:, :, None] * times[:, None, None]
    columns = {}
    for name, x in (("seen", weight * hot[:, None, :]), ("expected", weight * p), ("curve", weight * p * (1 - p))):
        x = x.reshape(len(x), k * k)
        columns[name] = np.stack([np.bincount(at, weights=x[:, c], minlength=len(names)) for c in range(k * k)], axis=1).ravel()
    return pd.DataFrame({"field": field, "who": np.repeat(names, k * k), "cell": np.tile(np.arange(k * k), len(names)), **columns})


def _tilts_by_row(tilts, pdf: pd.DataFrame, who, k: int) -> np.ndarray:
    """A tilt an entry: from the broadcast tilts, or from what was joined to the entries."""
    if tilts is not None:
        return tilts[who][:, :k, :k]
    return np.array([t for tilt in pdf["tilt"] for t in tilt], dtype=float).reshape(-1, k, k)


def minimax_consensus(
    labels: DataFrame,
    fields: dict[str, Sequence[str]],
    rounds: int = 25,
    alpha: float = 2.0,
    beta: float = 6.0,
    tolerance: float = 0.005,
    local_bytes: int = 64 << 20,
    entries: int = 250_000,
    rough: float = 0.03,
) -> tuple[DataFrame, DataFrame]:
    """``(consensus, reliability)`` of labels in the form of :func:`long_labels`.

    consensus: item, field, consensus, probability (posterior of the consensus), agreement (share of the item's pairs of
    labels that agree; null for one label), n_annotators, n_labels. Equal posteriors: the value earlier in ``fields``.
    reliability: field, annotator, n_labels, reliability (probability of a right label, classes weighted by their estimated
    frequency). Empty input gives two empty tables.

    alpha, beta: weights of the quadratic penalties, towards the mean annotator for sigma and towards 0 for tau. An item's list holds one
    entry for each annotator and label, however often it was given. ``entries``: about how many entries a task takes (Python starts and
    the sums a task returns weigh little against them); there are never fewer tasks than cores. ``rough``: how near to their optimum the
    item tilts come while the annotators' still move; the result is made with the closer tolerance of :func:`fit_items`.
    """
    spark = labels.sparkSession
    values = {f: [str(v) for v in vs] for f, vs in fields.items()}
    counted = cut(numbered(labels.groupBy("field", "annotator").agg(F.count("*").alias("n_labels")), ["field", "annotator"], "who"))
    n_who, n_labels = counted.agg(F.count("*"), F.coalesce(F.sum("n_labels"), F.lit(0))).first()
    local = n_who * max((len(v) for v in values.values()), default=1) ** 2 * 8 <= local_bytes
    codes = F.create_map(*(x for f, vs in values.items() for x in (F.lit(f), F.create_map(*(y for i, v in enumerate(vs) for y in (F.lit(v), F.lit(i)))))))
    coded = labels.join(counted, ["field", "annotator"]).select(
        "item", "field", "who", codes[F.col("field")][F.col("label")].alias("code")
    )
    given = coded.groupBy("item", "field", "who", "code").agg(F.count("*").cast("int").alias("times"))
    parts = max(spark.sparkContext.defaultParallelism, -(-n_labels // entries))
    if local:
        listed = given.groupBy("item", "field").agg(F.sort_array(F.collect_list(F.struct("who", "code", "times"))).alias("e"))
        base = cut(listed.select("item", "field", F.col("e.who").alias("who"), F.col("e.code").alias("label"), F.col("e.times").alias("times")).repartition(parts))
    else:
        base = cut(given.repartition(parts, "who"))
    priors = {f: np.full(len(v), 1.0 / len(v)) for f, v in values.items()}

    def items(tilts: DataFrame | None) -> DataFrame:
        """Items with their entries; with each entry's tilt where tilts are a table."""
        if tilts is None:
            return base
        joined = base.join(tilts.select("who", "tilt"), "who")
        listed = joined.groupBy("item", "field").agg(F.sort_array(F.collect_list(F.struct("who", "code", "times", "tilt"))).alias("e"))
        return listed.select("item", "field", *(F.col(f"e.{a}").alias(b) for a, b in (("who", "who"), ("code", "label"), ("times", "times"), ("tilt", "tilt"))))

    def fitted(pdf: pd.DataFrame, tilts, prior, **near):
        item, who, label, times = _flat(pdf)
        sigma = _tilts_by_row(tilts, pdf, who, len(prior))
        q, _, p = fit_items(sigma, prior, item, label, times, len(pdf), beta, **near)
        return q, p, item, who, np.eye(len(prior))[label], times

    def summer(tilts, prior):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = []
            for pdf in batches:
                for field, part in pdf.groupby("field"):
                    q, p, item, who, hot, times = fitted(part, tilts.value if tilts else None, prior[field], tolerance=rough)
                    found.append(_sum_cells(field, who, q[item], p, hot, times))
                if len(found) > 1:
                    found = [pd.concat(found).groupby(["field", "who", "cell"], as_index=False).sum()]
            yield from found

        return run

    # On the driver: one array [who, class, label] for all fields, padded to the largest number of values.
    k_most = max((len(v) for v in values.values()), default=1)
    field_of = {r["who"]: r["field"] for r in counted.select("who", "field").toLocalIterator()} if local else {}
    sigma = {f: _start(len(v)) for f, v in values.items()}
    tilts = None
    if local:
        tilts = _Ragged({w: sigma[f][0] for w, f in field_of.items()}, n_who, k_most)
    else:
        starts = F.create_map(*(x for f, s in sigma.items() for x in (F.lit(f), F.array(*(F.lit(float(v)) for v in s.ravel())))))
        table = cut(counted.select("who", "field", starts[F.col("field")].alias("tilt")))

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(tilts) if local else None
        sums = items(None if local else table).mapInPandas(summer(shared, priors), _CELLS)
        sums = sums.groupBy("field", "who", "cell").agg(*(F.sum(c).alias(c) for c in ("seen", "expected", "curve")))
        if local:
            found = sums.toPandas()  # within local_bytes a column
            totals = found.groupby(["field", "cell"], as_index=False)["seen"].sum()
        else:
            sums = cut(sums)
            totals = sums.groupBy("field", "cell").agg(F.sum("seen").alias("seen")).toPandas()  # one row a cell
        total = {f: np.zeros(len(v) ** 2) for f, v in values.items()}
        for f, c, s in totals.itertuples(index=False):
            total[f][c] = s
        total = {f: t.reshape(len(values[f]), -1) for f, t in total.items()}
        centre = {}
        if turn:
            if local:
                size = found.groupby("who")["seen"].sum()
                for f in values:
                    who = [w for w in size.index if field_of[w] == f]
                    weight = size.loc[who].to_numpy()
                    centre[f] = np.tensordot(weight / max(weight.sum(), 1e-9), tilts[np.array(who, int)][:, : len(values[f]), : len(values[f])], 1) if who else _start(len(values[f]))[0]
            else:
                weight = sums.groupBy("who").agg(F.sum("seen").alias("n"))
                spread_out = table.join(weight, "who").select("field", "n", F.posexplode("tilt").alias("cell", "s"))
                means = spread_out.groupBy("field", "cell").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("m")).collect()  # one row a cell
                centre = {f: _start(len(v))[0].ravel() for f, v in values.items()}
                for r in means:
                    centre[r["field"]][r["cell"]] = r["m"]
                centre = {f: c.reshape(len(values[f]), -1) for f, c in centre.items()}

        def moved(field, old, cells, turn=turn, total=total, centre=centre):
            """New tilts of annotators of a field from ``[annotator, cell]`` sums (seen, expected, curve)."""
            k = len(total[field])
            seen, expected, curve = (x.reshape(-1, k, k) for x in cells)
            return move_annotators(old, seen, expected, curve, centre[field], alpha) if turn else smoothed_start(seen, total[field])

        if local:
            change = 0.0
            for f, part in found.groupby("field"):
                k = len(values[f])
                who, at = np.unique(part["who"], return_inverse=True)
                cells = np.zeros((3, len(who), k * k))
                cells[:, at, part["cell"]] = part[["seen", "expected", "curve"]].to_numpy().T
                old = tilts[who][:, :k, :k]
                new = moved(f, old, cells)
                change = max(change, float(np.abs(new - old).max()))
                tilts.put(who, new)
            shared.unpersist()
        else:

            def update(batches: Iterator[pd.DataFrame], moved=moved) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    out = []
                    for r in pdf.itertuples(index=False):
                        k = int(np.sqrt(len(r.tilt)))
                        cells = np.zeros((3, 1, k * k))
                        cells[:, 0, list(r.cell)] = [list(r.seen), list(r.expected), list(r.curve)]
                        old = np.asarray(r.tilt, float).reshape(1, k, k)
                        new = moved(r.field, old, cells)
                        out.append((r.who, r.field, new.ravel().tolist(), float(np.abs(new - old).max())))
                    yield pd.DataFrame(out, columns=["who", "field", "tilt", "change"])

            lists = sums.groupBy("who").agg(F.collect_list(F.struct("cell", "seen", "expected", "curve")).alias("c"))  # one entry a cell
            ready = table.select("who", "field", "tilt").join(lists, "who").select("who", "field", "tilt", *(F.col(f"c.{c}").alias(c) for c in ("cell", "seen", "expected", "curve")))
            table = cut(ready.mapInPandas(update, "who long, field string, tilt array<double>, change double"))
            change = table.agg(F.max("change")).first()[0] or 0.0
        for f, t in total.items():
            mass = t.sum(axis=1) + 1.0
            priors[f] = mass / mass.sum()
        if turn and change < tolerance:
            break
    shared, final = spark.sparkContext.broadcast(tilts) if local else None, dict(priors)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for field, part in pdf.groupby("field"):
                q, _, item, who, hot, times = fitted(part, shared.value if shared else None, final[field])
                best = q.argmax(axis=1)
                votes = np.zeros((len(part), len(final[field])))
                np.add.at(votes, item, hot * times[:, None])
                n = votes.sum(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    agreement = (votes * (votes - 1)).sum(axis=1) / (n * (n - 1))
                yield pd.DataFrame(
                    {
                        "item": part["item"].to_numpy(),
                        "field": field,
                        "consensus": [values[field][b] for b in best],
                        "probability": q[np.arange(len(part)), best],
                        "agreement": [None if np.isnan(a) else float(a) for a in agreement],
                        "n_annotators": [len(set(w)) for w in part["who"]],
                        "n_labels": n.astype(int),
                    }
                )

    consensus = items(None if local else table).mapInPandas(
        decide, "item string, field string, consensus string, probability double, agreement double, n_annotators long, n_labels long"
    )

    def right(field, tilt):
        k = len(final[field])
        return float(np.exp(_log_softmax(tilt))[np.arange(k), np.arange(k)] @ final[field])

    if local:
        rows = [(w, right(f, tilts[np.array([w])][0, : len(values[f]), : len(values[f])])) for w, f in field_of.items()]
        rated = spark.createDataFrame(rows, "who long, reliability double")
    else:

        def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                shaped = [right(f, np.asarray(t, float).reshape(len(final[f]), -1)) for f, t in zip(pdf["field"], pdf["tilt"], strict=True)]
                yield pd.DataFrame({"who": pdf["who"], "reliability": shaped})

        rated = table.select("who", "field", "tilt").mapInPandas(rate, "who long, reliability double")
    return consensus, counted.join(rated, "who").select("field", "annotator", "n_labels", "reliability")


class _Ragged:
    """Square tilts of different sizes in one array, by annotator."""

    def __init__(self, tilts: dict[int, np.ndarray], n: int, k: int):
        self.all = np.zeros((n, k, k))
        for who, t in tilts.items():
            self.all[who, : len(t), : len(t)] = t

    def __getitem__(self, who: np.ndarray) -> np.ndarray:
        return self.all[who]

    def put(self, who: np.ndarray, tilts: np.ndarray) -> None:
        self.all[who, : tilts.shape[1], : tilts.shape[2]] = tilts


def krippendorff_alpha(labels: DataFrame) -> DataFrame:
    """Nominal alpha of each field: field, n_items (with at least two labels), n_labels in them, alpha.

    Null where all these labels are the same. Aggregated in the JVM: by (item, field, label), then by field.
    """
    cells = labels.groupBy("item", "field", "label").agg(F.count("*").alias("n"))
    per_item = (
        cells.groupBy("item", "field")
        .agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("same"))
        .where("m >= 2")
        .withColumn("differ", (F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1))
    )
    observed = per_item.groupBy("field").agg(
        F.count("*").alias("n_items"), F.sum("m").alias("n_labels"), F.sum("differ").alias("differ")
    )
    totals = (
        cells.join(per_item.select("item", "field"), ["item", "field"], "left_semi")
        .groupBy("field", "label")
        .agg(F.sum("n").alias("n"))
        .groupBy("field")
        .agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
    )
    chance = F.col("n_labels") * F.col("n_labels") - F.col("squares")
    return observed.join(totals, "field").select(
        "field",
        "n_items",
        "n_labels",
        F.round(F.when(chance > 0, 1 - (F.col("n_labels") - 1) * F.col("differ") / chance), 6).alias("alpha"),
    )
