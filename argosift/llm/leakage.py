"""Evaluation texts leaking into training text, by greedy string tiling.

Items and documents become sequences of word hashes (see :mod:`argosift.llm.textforms`). Seeds are runs of ``least`` words that occur in some
item. Where a document has seeds of an item, the two are tiled by running Karp-Rabin: runs of a search length are found by rolling hashes
and checked word by word, the longest that overlap no earlier tile are marked first, and the search length falls until it is ``least``.
A document holds an item whose words are covered to at least ``coverage``.

Distribution: one pass over the documents, without a shuffle of texts. What goes to that pass is a Bloom filter of the items' seeds (32 bits a
seed, at most ``filter_bits`` in all, so its size is bounded; a fuller filter only lets more through). Out come, for documents that may hold
something, the stretches of words under seeds. These are joined to the items by seed. An item that is covered to the threshold has a known
number of its seed places in the document. Half of that number of places, the commonest, are left out of the join, and of the others the other
half must be met: so a seed that very many items have ("in the present study") brings no items by itself, and the words of a document and an
item come together only where enough seeds have met.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosift.llm.textforms import bare_word, plain
from argosift.runtime import cut

_KNOWN_WORDS = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Words:
    """Texts as sequences of 64-bit hashes of their bare words (never 0)."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        out, known = [], self.known
        for raw in plain(text).split():
            code = known.get(raw)
            if code is None:
                word = bare_word(raw)
                code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1 if word else 0
                if len(known) >= _KNOWN_WORDS:
                    known.clear()
                known[raw] = code
            if code:
                out.append(code)
        return np.array(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of a sequence for any window length, from one running sum."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray):
        if len(codes) >= len(Rolling._up):
            size = 2 * len(codes) + 64
            with np.errstate(over="ignore"):
                Rolling._up, Rolling._down = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INVERSE))
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(codes * Rolling._up[: len(codes)], dtype=np.uint64)]

    def windows(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        with np.errstate(over="ignore"):
            return _mix((self.sums[width : width + n] - self.sums[:n]) * Rolling._down[:n])


class SeedFilter:
    """A Bloom filter with three places a key."""

    def __init__(self, n: int, most_bits: int):
        bits = 1 << max(10, (32 * max(n, 1) - 1).bit_length())
        while bits > most_bits and bits > 1 << 10:
            bits >>= 1
        self.mask, self.field = np.uint64(bits - 1), np.zeros(bits >> 3, np.uint8)

    def _places(self, keys: np.ndarray):
        for shift in (0, 17, 34):
            at = (keys >> np.uint64(shift)) & self.mask
            yield (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def add(self, keys: np.ndarray) -> None:
        for byte, bit in self._places(keys):
            np.bitwise_or.at(self.field, byte, bit)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for byte, bit in self._places(keys):
            out &= (self.field[byte] & bit) > 0
        return out


def _free_starts(taken: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows without a taken place."""
    before = np.r_[0, np.cumsum(taken)]
    return np.flatnonzero(before[width:] == before[: len(before) - width]) if len(taken) >= width else np.zeros(0, int)


def tile(item, doc, least: int, search: int = 32) -> list[tuple[int, int, int]]:
    """Tiles ``(place in item, place in document, length)``, longest first, none overlapping another in either text; 0 in ``doc`` is a break.

    Running Karp-Rabin: the search length starts at ``search``, is raised where a match is more than twice as long, and falls by halves.
    Equally long matches are marked in order of their places.
    """
    item, doc = np.asarray(item, dtype=np.uint64), np.asarray(doc, dtype=np.uint64)
    mine, other = Rolling(item), Rolling(doc)
    taken_item, taken_doc = np.zeros(len(item), bool), doc == 0
    tiles: list[tuple[int, int, int]] = []

    def scan(width: int) -> list[tuple[int, int, int]]:
        """Matches of at least ``width`` free words that cannot begin earlier, as ``(-length, i, j)``."""
        left, right = _free_starts(taken_item, width), _free_starts(taken_doc, width)
        if not len(left) or not len(right):
            return []
        keys, asked = mine.windows(width)[left], other.windows(width)[right]
        order = np.argsort(keys, kind="stable")
        low, high = (np.searchsorted(keys[order], asked, side) for side in ("left", "right"))
        found = []
        for at in np.flatnonzero(high > low):
            j = int(right[at])
            for i in left[order[low[at] : high[at]]].tolist():
                if i and j and item[i - 1] == doc[j - 1] and not taken_item[i - 1] and not taken_doc[j - 1]:
                    continue
                n = min(len(item) - i, len(doc) - j)
                same = (item[i : i + n] == doc[j : j + n]) & ~taken_item[i : i + n] & ~taken_doc[j : j + n]
                k = n if same.all() else int(same.argmin())
                if k >= width:
                    found.append((-k, i, j))
        return found

    width = max(least, min(search, len(item), len(doc)))
    while True:
        matches = scan(width)
        longest = -min(matches)[0] if matches else 0
        if longest > 2 * width:
            width = longest
            continue
        heapq.heapify(matches)
        while matches:
            k, i, j = heapq.heappop(matches)
            free = ~taken_item[i : i - k] & ~taken_doc[j : j - k]
            if free.all():
                taken_item[i : i - k] = taken_doc[j : j - k] = True
                tiles.append((i, j, -k))
                continue
            edges = np.flatnonzero(np.diff(np.r_[0, free.view(np.int8), 0]))
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if e - s >= width:
                    heapq.heappush(matches, (s - e, i + s, j + s))
        if width == least:
            return tiles
        width = max(least, width // 2) if width > 2 * least else least


def _seeds(codes: np.ndarray, least: int) -> np.ndarray:
    return Rolling(codes).windows(least)


def _item_words(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            codes = [words(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "item": pdf["item"], "item_id": pdf["item_id"], "words": [c.view(np.int64) for c in codes],
                "seeds": [_seeds(c, least).view(np.int64) for c in codes],
            })

    return run


def _pack_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"keys": [np.unique(np.concatenate([np.asarray(s, np.int64) for s in pdf["seeds"]])).tobytes() if len(pdf) else b""]})


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = 4,
    coverage: float = 0.5,
    filter_bits: int = 1 << 30,
) -> DataFrame:
    """``(doc_id, item_id, coverage, longest, tiles, item_words)`` for every document that holds an item to at least ``coverage``.

    Null ids or texts, and items of fewer than ``least`` words, match nothing. A document row that occurs twice gives two equal rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(
        "doc_id is not null and text is not null"
    )
    queries = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(
        "item_id is not null and text is not null"
    ).distinct().withColumn("item", F.monotonically_increasing_id())
    asked = cut(queries.mapInPandas(_item_words(least), "item long, item_id long, words array<long>, seeds array<long>").where(F.size("seeds") > 0))
    n = F.size("words")
    # A document that covers an item holds at least this many of its seed places.
    needed = F.ceil(F.ceil(n * F.lit(coverage) - 1e-9) / least).cast("int")
    sized = asked.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0)), F.coalesce(F.min(needed), F.lit(1))).first()
    seeds = SeedFilter(sized[0], filter_bits)
    for row in asked.select("seeds").mapInPandas(_pack_seeds, "keys binary").toLocalIterator():  # one batch of items at a time
        seeds.add(np.frombuffer(row["keys"], np.uint64))
    shared = spark.sparkContext.broadcast(seeds)
    fewest = max(1, sized[1])

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            out = []
            for row, d, t in zip(pdf["row"], pdf["doc_id"], pdf["text"], strict=True):
                codes = words(t)
                keys = _seeds(codes, least)
                hit = np.flatnonzero(shared.value.holds(keys))
                if len(hit) < fewest:
                    continue
                under = np.zeros(len(codes), bool)
                for i in range(least):
                    under[hit + i] = True
                places = np.flatnonzero(under)
                kept = np.insert(codes[places], np.flatnonzero(np.diff(places) > 1) + 1, 0)
                out.append((row, d, kept.view(np.int64), np.unique(keys[hit]).view(np.int64)))
            yield pd.DataFrame(out, columns=["row", "doc_id", "stretch", "seeds"])

    near = docs.withColumn("row", F.monotonically_increasing_id()).mapInPandas(stretches, "row long, doc_id long, stretch array<long>, seeds array<long>")
    near = cut(near)
    half = F.ceil(needed / 2).cast("int")
    each = asked.select("item", (F.size("seeds") - needed + half).alias("most"), half.alias("least"), F.explode("seeds").alias("seed"))
    often = each.groupBy("seed").agg(F.count_distinct("item").alias("items"))
    order = Window.partitionBy("item").orderBy("items", "seed")  # the places of one item
    rarest = each.join(often, "seed").withColumn("n", F.row_number().over(order)).where("n <= most").groupBy("seed", "item", "least").agg(F.count("*").alias("places"))
    met = near.select("row", F.explode("seeds").alias("seed")).join(rarest, "seed").groupBy("row", "item", "least").agg(F.sum("places").alias("places"))
    candidates = met.where("places >= least").select("row", "item")

    def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, i, stretch, words, held, own in zip(*(pdf[c] for c in ("doc_id", "item_id", "stretch", "words", "held", "own")), strict=True):
                if np.isin(own, held).sum() * least < coverage * len(words):
                    continue
                tiles = tile(np.asarray(words).view(np.uint64), np.asarray(stretch).view(np.uint64), least)
                covered = sum(x[2] for x in tiles)
                if covered >= coverage * len(words):
                    out.append((d, i, covered / len(words), max(x[2] for x in tiles), len(tiles), len(words)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage", "longest", "tiles", "item_words"])

    pairs = candidates.join(asked.withColumnRenamed("seeds", "own"), "item").join(near.withColumnRenamed("seeds", "held"), "row")
    return pairs.select("doc_id", "item_id", "stretch", "words", "held", "own").mapInPandas(
        tiled, "doc_id long, item_id long, coverage double, longest int, tiles int, item_words int"
    )
