"""Rows of two tables that a paper has in common, met in blocks: no row for a pair is made, and no block outgrows a task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def met(left: DataFrame, right: DataFrame, on: str, kernel: Callable[[list, list], Iterable[tuple]], schema: str, left_size: int = 32_768, right_size: int = 8_192) -> DataFrame:
    """What ``kernel`` gives for each pair of blocks of a left and a right table with the same ``on``; null is equal to none.

    The kernel gets the rows of both blocks as lists, without ``on``, and gives tuples of ``schema``. A block has about ``left_size`` or ``right_size``
    rows at most. Each row is sent once for every block of the other side of its ``on``, so once where that is one block.
    """
    counts = left.groupBy(on).agg(F.count("*").alias("n"), F.lit(0).alias("m")).unionByName(right.groupBy(on).agg(F.lit(0).alias("n"), F.count("*").alias("m")))
    blocks = counts.groupBy(on).agg(F.ceil(F.sum("n") / left_size).alias("_l"), F.ceil(F.sum("m") / right_size).alias("_r"))
    large = F.broadcast(blocks.where("_l > 1 or _r > 1"))  # not more than there are full blocks

    # A whole number goes as text, as pandas would make it a float beside nulls.
    whole = {c for df in (left, right) for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}
    back = [{i for i, c in enumerate(c for c in df.columns if c != on) if c in whole} for df in (left, right)]

    def sent(df: DataFrame, side: int) -> DataFrame:
        names = [c for c in df.columns if c != on]
        own, other = ("_l", "_r") if side == 0 else ("_r", "_l")
        rows = df.where(F.col(on).isNotNull()).join(large, on, "left").withColumns({c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("_l", "_r")})
        place = F.pmod(F.xxhash64(*names), F.col(own)).alias(own)
        return rows.select(on, place, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), F.lit(side).alias("_s"), *((F.col(c).cast("string") if c in whole else F.col(c)).alias(f"_{side}_{i}") for i, c in enumerate(names)))

    key = [on, "_l", "_r"]
    n_left = len(left.columns) - 1
    rows = sent(left, 0).unionByName(sent(right, 1), allowMissingColumns=True)
    rows = rows.repartition(*key).sortWithinPartitions(*key, "_s")
    rows = rows.select(*key, "_s", *(c for c in rows.columns if c not in (*key, "_s")))
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sides, out = None, ([], []), []
        for pdf in batches:
            for at, l, r, s, *values in zip(*(pdf[c].array if pdf[c].dtype == object else pdf[c].tolist() for c in pdf.columns), strict=True):
                if (at, l, r) != now:
                    if sides[0] and sides[1]:
                        out.extend(kernel(*sides))
                    now, sides = (at, l, r), ([], [])
                row = values[:n_left] if s == 0 else values[n_left:]
                for i in back[s]:
                    row[i] = None if row[i] is None else int(row[i])
                sides[s].append(row)
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if sides[0] and sides[1]:
            out.extend(kernel(*sides))
        yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, schema)


def numbered_repeats(tokens: Iterable[str]) -> list[tuple[str, int]]:
    """Each token with how often it stood before, so that shared elements are tokens each as often as in both."""
    seen: dict[str, int] = defaultdict(int)
    out = []
    for t in tokens:
        out.append((t, seen[t]))
        seen[t] += 1
    return out


class Postings:
    """Which of some sets hold an item: as a row of flags where many do, else as their places."""

    def __init__(self, sets: Iterable[Iterable]):
        places: dict = defaultdict(list)
        self.n = 0
        for i, s in enumerate(sets):
            self.n += 1
            for t in s:
                places[t].append(i)
        self.places = {}
        for t, at in places.items():
            if len(at) * 32 < self.n:
                self.places[t] = np.array(at, dtype=np.int32)
            else:
                self.places[t] = np.zeros(self.n, dtype=np.uint8)
                self.places[t][at] = 1

    def shared(self, items: Iterable) -> np.ndarray:
        """For each set, how many of the items (each once) it holds."""
        items = [self.places[t] for t in items if t in self.places]
        out = np.zeros(self.n, dtype=np.uint8 if len(items) < 256 else np.int32)
        for p in items:
            if p.dtype == np.uint8:
                out += p
            else:
                out[p] += 1
        return out


class Counts:
    """How often each text has an item: as a row of numbers where many texts have it, else by their places."""

    def __init__(self, counters: list[dict]):
        self.n = len(counters)
        found: dict = defaultdict(list)
        for i, c in enumerate(counters):
            for t, n in c.items():
                found[t].append((i, n))
        self.found = {}
        for t, pairs in found.items():
            at, n = np.array([i for i, _ in pairs], dtype=np.int32), np.array([n for _, n in pairs])
            kind = np.uint16 if n.max() < 65_536 else np.int64
            if len(at) * 32 < self.n:
                self.found[t] = at, n
            else:
                self.found[t] = None, np.zeros(self.n, dtype=kind)
                self.found[t][1][at] = n

    def shared(self, counter: dict) -> np.ndarray:
        """For each text, how many items it shares with ``counter``, each as often as in both."""
        out = np.zeros(self.n, dtype=np.uint16 if sum(counter.values()) < 65_536 else np.int64)
        for t, n in counter.items():
            if t in self.found:
                at, m = self.found[t]
                if at is None:
                    out += np.minimum(m, min(n, np.iinfo(m.dtype).max)).astype(out.dtype, copy=False)
                else:
                    out[at] += np.minimum(m, n).astype(out.dtype)
        return out
