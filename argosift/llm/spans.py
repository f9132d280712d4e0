"""Long exact spans shared between records, found by difference-cover anchors.

Windows of ``w = length - period + 1`` characters are hashed only at positions whose remainder modulo ``period`` is in a difference
cover. For any two places i and j there is a shift d < period with both i + d and j + d in the cover, so two texts that share
``length`` characters share the hash of an aligned window. An anchor that occurs at two to ``FEW`` places is extended between each two of
them, character by character: at most a fixed number of pairs for each place. Around the other shared anchors, windows of the full length
are hashed: those with equal hash stand in one group. Any window that two texts share holds an anchor of theirs, so it is met on one of the ways.

A group is never expanded into pairs to find spans: each of its windows is compared, character by character, with the group's
representative (the window of the smallest class) only, in runs of consecutive windows. As all are equal to the representative, they
are equal to each other. What the shares need is therefore linear in the shared characters, however many texts share a passage. Pairs are
made only where pairs are asked for, from the distinct sets of texts that share some window.

Exact copies are folded to one text before, and unfolded after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosift.runtime import cut, spread

#: Perfect difference sets, by period. Each difference modulo the period occurs once.
DIFFERENCE_COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}
#: Places of an anchor up to which they are compared two by two.
FEW = 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest period below a third of ``length``, and its difference cover."""
    period = max([m for m in DIFFERENCE_COVERS if m <= length // 3], default=0)
    return (period, DIFFERENCE_COVERS[period]) if period else (1, (0,))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(codes: np.ndarray, starts: np.ndarray, width: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at ``starts``; up and down hold powers of the base and of its inverse."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + _BASE) * up[: len(codes)], dtype=np.uint64)])
        return _mix((sums[starts + width] - sums[starts]) * down[starts]).view(np.int64)


class _Hasher:
    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, codes, starts, width):
        if len(codes) >= len(self.up):
            n = 2 * len(codes) + 16
            self.up, self.down = _powers(n, _BASE), _powers(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        return window_hashes(codes, starts, width, self.up, self.down)


def gather_texts(*sources: tuple[DataFrame, str, str]) -> DataFrame:
    """``(id, text)`` from tables given as (table, id column, text column); a text column of arrays gives a row an element."""
    rows = None
    for df, key, text in sources:
        column = F.col(text)
        if dict(df.dtypes)[text].startswith("array"):
            column = F.explode(column)
        part = df.select(F.col(key).cast("string").alias("id"), column.alias("text")).select("id", F.col("text").cast("string").alias("text"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def shared_spans(texts: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, sets, spans)`` of texts ``(id, text)``; an id may have several texts, each of which stands for itself.

    members: id, class, n_chars: the class is that of equal texts (null ids, null texts and texts under ``length`` take no part).
    sets: set, class: the classes that share a passage of ``length`` characters (code points), one set for all passages that the same
    classes share; sets whose texts all belong to one id are none. :func:`links` gives their pairs.
    spans: class, start, end: maximal stretches of a text whose every window of ``length`` characters stands under another id too (not
    merged where they overlap).
    """
    period, cover = cover_for(length)
    width = length - period + 1
    rows = texts.where(F.col("id").isNotNull() & (F.length("text") >= length)).select("id", "text", F.sha2("text", 256).alias("sha"))
    folded = rows.select("sha", "text").distinct().withColumn("class", F.monotonically_increasing_id())
    classes = cut(spread(folded))
    members = cut(rows.select("id", "sha").distinct().join(classes.select("sha", "class", F.length("text").alias("n_chars")), "sha").select("id", "class", "n_chars"))
    classes = classes.select("class", "text")

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for pdf in batches:
            out = []
            for c, text in zip(pdf["class"], pdf["text"], strict=True):
                codes = code_points(text)
                n = len(codes) - width + 1
                starts = (np.arange(0, n, period)[:, None] + np.array(cover)[None, :]).ravel()
                starts = starts[starts < n]
                out.append(pd.DataFrame({"hash": hasher(codes, starts, width), "class": c, "pos": starts.astype(np.int32)}))
            if out:
                yield pd.concat(out)

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for pdf in batches:
            out = []
            for c, text, places in zip(pdf["class"], pdf["text"], pdf["places"], strict=True):
                codes = code_points(text)
                starts = np.unique((np.asarray(places)[:, None] - np.arange(period)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts + length <= len(codes))]
                out.append(pd.DataFrame({"hash": hasher(codes, starts, length), "class": c, "pos": starts.astype(np.int32)}))
            if out:
                yield pd.concat(out)

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, diagonal, seeds, ta, tb in zip(*(pdf[c] for c in ("class_a", "class_b", "diagonal", "seeds", "text_a", "text_b")), strict=True):
                x, y = code_points(ta), code_points(tb)
                low, high = max(0, diagonal), min(len(x), len(y) + diagonal)
                same = x[low:high] == y[low - diagonal : high - diagonal]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
                for s, e in zip(edge[::2] + low, edge[1::2] + low, strict=True):
                    if e - s >= length and any(s <= p < e for p in seeds):
                        out.append((a, b, int(s), int(e), int(s - diagonal), int(e - diagonal)))
            yield pd.DataFrame(out, columns=["class_a", "class_b", "start_a", "end_a", "start_b", "end_b"])

    found = classes.mapInPandas(anchors, "hash long, class long, pos int")
    shared = found.groupBy("hash").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).where("low <> high")
    kept = cut(found.join(shared.select("hash", (F.col("n") <= FEW).alias("few")), "hash"))
    ids = members.groupBy("class").agg(F.min("id").alias("low"), F.max("id").alias("high"))

    few = kept.where("few").select("hash", "class", "pos")
    a, b = few.alias("a"), few.alias("b")
    seeds = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.class") < F.col("b.class"))).select(
        F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b"), (F.col("a.pos") - F.col("b.pos")).alias("diagonal"), F.col("a.pos").alias("pos")
    )
    seeds = seeds.groupBy("class_a", "class_b", "diagonal").agg(F.collect_list("pos").alias("seeds"))  # places of one text
    both = seeds.join(classes.withColumnsRenamed({"class": "class_a", "text": "text_a"}), "class_a").join(classes.withColumnsRenamed({"class": "class_b", "text": "text_b"}), "class_b")
    matches = both.mapInPandas(extend, "class_a long, class_b long, start_a int, end_a int, start_b int, end_b int")
    of = lambda side: ids.select(F.col("class").alias(f"class_{side}"), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}"))
    apart = F.least("low_a", "low_b") != F.greatest("high_a", "high_b")
    matches = cut(matches.join(of("a"), "class_a").join(of("b"), "class_b").where(apart).drop("low_a", "low_b", "high_a", "high_b"))

    places = kept.where("not few").groupBy("class").agg(F.collect_list("pos").alias("places"))  # positions of one text
    windows = cut(classes.join(places, "class").mapInPandas(refine, "hash long, class long, pos int"))
    while True:
        groups = (
            windows.groupBy("hash", "class").agg(F.min("pos").alias("pos"))
            .groupBy("hash").agg(
                F.min("class").alias("rep"), F.min_by("pos", "class").alias("rep_pos"), F.count("*").alias("n"),
                F.bit_xor(F.xxhash64("class")).alias("s1"), F.bit_xor(F.xxhash64("class", F.lit(7))).alias("s2"),
            )
            .where("n > 1")
        )
        groups = cut(groups)
        # Consecutive windows of a text whose representatives are consecutive too are one run, compared at once.
        placed = windows.join(groups.select("hash", "rep", "rep_pos"), "hash").withColumn("diagonal", F.col("pos") - F.col("rep_pos"))
        run = F.col("pos") - F.row_number().over(Window.partitionBy("class", "rep", "diagonal").orderBy("pos"))
        runs = placed.where("class <> rep or diagonal <> 0").withColumn("run", run)
        runs = runs.groupBy("class", "rep", "diagonal", "run").agg(F.min("pos").alias("start"), (F.max("pos") + length).alias("end"))
        wrong = cut(_unequal(runs, classes, length).join(placed, ["class", "pos"]).select("hash").distinct())
        if not wrong.head(1):
            break
        # A hash stood for different characters: its windows are keyed anew by the characters themselves.
        doubtful = windows.join(wrong, "hash", "left_semi").join(classes, "class")
        renamed = doubtful.select(F.xxhash64(F.sha2(F.expr(f"substring(text, pos + 1, {length})"), 256), "hash").alias("hash"), "class", "pos")
        windows = cut(windows.join(wrong, "hash", "left_anti").unionByName(renamed))
    # One set for all groups of the same classes; it counts if its texts stand under two ids.
    first = groups.groupBy("n", "s1", "s2").agg(F.min("hash").alias("set"))
    in_set = first.join(windows.withColumnRenamed("hash", "set"), "set").select("set", "n", "s1", "s2", "class").distinct().join(ids, "class")
    several = in_set.groupBy("set", "n", "s1", "s2").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    several = cut(several.select("set", "n", "s1", "s2"))
    sets = in_set.join(several.select("set"), "set", "left_semi").select(F.col("set").cast("string").alias("set"), "class")
    pair = F.concat_ws("-", "class_a", "class_b").alias("set")
    sets = sets.unionByName(matches.select("class_a", "class_b").distinct().select(pair, F.explode(F.array("class_a", "class_b")).alias("class")))
    good = groups.join(several, ["n", "s1", "s2"], "left_semi").select("hash")
    stretch = F.col("pos") - F.row_number().over(Window.partitionBy("class").orderBy("pos"))
    covered = windows.join(good, "hash", "left_semi").select("class", "pos").distinct().withColumn("run", stretch)
    spans = covered.groupBy("class", "run").agg(F.min("pos").alias("start"), (F.max("pos") + length).alias("end")).drop("run")
    sides = (F.struct(F.col(f"class_{x}").alias("class"), F.col(f"start_{x}").alias("start"), F.col(f"end_{x}").alias("end")) for x in "ab")
    spans = spans.unionByName(matches.select(F.explode(F.array(*sides)).alias("s")).select("s.*")).distinct()
    return members, sets, spans


def _unequal(runs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """``(class, pos)`` of the windows in ``runs`` that differ from their representative's in some character."""
    mine, other = classes.select("class", F.col("text").alias("text_a")), classes.select(F.col("class").alias("rep"), F.col("text").alias("text_b"))
    a = F.substring(F.col("text_a"), F.col("start") + 1, F.col("end") - F.col("start"))
    b = F.substring(F.col("text_b"), F.col("start") - F.col("diagonal") + 1, F.col("end") - F.col("start"))
    pieces = runs.join(mine, "class").withColumn("a", a).drop("text_a").join(other, "rep").withColumn("b", b).drop("text_b").where("a <> b")
    each = pieces.select("class", "start", "a", "b", F.explode(F.sequence(F.lit(0), F.length("a") - length)).alias("i"))
    differs = F.substring(F.col("a"), F.col("i") + 1, F.lit(length)) != F.substring(F.col("b"), F.col("i") + 1, F.lit(length))
    return each.where(differs).select("class", (F.col("start") + F.col("i")).cast("int").alias("pos"))


def _pairs_within(df: DataFrame, group: str, key: str, slice_: int = 1000) -> DataFrame:
    """``(a, b)``, a < b, of all keys with the same ``group``. A group of more than ``slice_`` keys is cut into slices: each row is met by one
    slice at a time, so that no task holds more than a slice and its partners' share of the group."""
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / slice_).alias("slices")).where("slices > 1")
    rows = df.join(sizes, group, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    left = rows.select(group, F.col(key).alias("a"), F.pmod(F.xxhash64(key), F.col("slices")).alias("slice"))
    right = rows.select(group, F.col(key).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    return left.join(right, [group, "slice"]).where("a < b").select("a", "b")


def links(sets: DataFrame) -> DataFrame:
    """``(class_a, class_b)``, class_a < class_b: pairs of different texts that share at least ``length`` consecutive characters."""
    return _pairs_within(sets, "set", "class").distinct().select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def pairs_of_ids(members: DataFrame, linked: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: pairs of ids with a text in the same class or in linked classes.

    This lists every pair, so it grows with the square of the number of ids that share one passage; :func:`memberships` does not.
    """
    copies = _pairs_within(members.select("class", "id"), "class", "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    m = members.select("class", "id")
    across = (
        linked.join(m.withColumnsRenamed({"class": "class_a", "id": "x"}), "class_a")
        .join(m.withColumnsRenamed({"class": "class_b", "id": "y"}), "class_b")
        .where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return copies.unionByName(across).distinct()


def memberships(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(id, class_id, passages)`` for each text of an id that has ``length`` characters or more: the smallest id with the same text, and
    the sets of texts it shares passages with, as ``first|number`` with the smallest id in the set. Two ids share a passage if their texts are in one class or
    one set, so this says the same as :func:`pairs_of_ids`, in rows that are as many as the texts."""
    low = members.groupBy("class").agg(F.min("id").alias("class_id"))
    named = sets.join(low, "class")
    named = named.join(named.groupBy("set").agg(F.min("class_id").alias("first")), "set").groupBy("class").agg(F.array_sort(F.collect_list(F.concat_ws("|", "first", "set"))).alias("passages"))
    return members.join(low, "class").join(named, "class", "left").select("id", "class_id", F.coalesce("passages", F.array().cast("array<string>")).alias("passages"))


def shared_share(texts: DataFrame, members: DataFrame, spans: DataFrame) -> DataFrame:
    """``(id, n_texts, n_chars, shared_chars, share)`` for every id: characters that lie in a span shared with another text.

    An equal text under another id is shared as a whole. Equal texts of one id count once. Texts below the length count in n_chars only; share is null if n_chars is 0.
    """
    w = Window.partitionBy("class").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        spans.withColumn("from", F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
        .groupBy("class")
        .agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("covered"))
    )
    copies = members.groupBy("class").agg((F.count_distinct("id") > 1).alias("copied"))
    whole = texts.where("id is not null").distinct().groupBy("id").agg(
        F.count("text").alias("n_texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars")
    )
    part = (
        members.join(covered, "class", "left")
        .join(copies, "class", "left")
        .select("id", F.when(F.coalesce("copied", F.lit(False)), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("n"))
        .groupBy("id")
        .agg(F.sum("n").alias("shared_chars"))
    )
    return whole.join(part, "id", "left").select(
        "id", "n_texts", "n_chars", F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"),
        F.round(F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")), 6).alias("share"),
    )
