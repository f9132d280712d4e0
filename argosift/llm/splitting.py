"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is cut into atomic segments at every natural boundary. Adjacent segments wait in a heap, weakest boundary first; a pair is
merged while the merged core still leaves room for the overlap under the limit. Segments that alone exceed the limit are cut at
white space, or anywhere if there is none; a text that needs this is marked ``forced``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosift.runtime import spread

#: A blank line, a line break, a sentence end before white space. Strength: paragraph 3, line 2, sentence 1, none 0.
_BOUNDARY = re.compile(r"(?P<stop>[.!?])?(?P<gap>\s+)")
_BREAK = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")


def boundaries(text: str) -> list[tuple[int, int, int]]:
    """Natural boundaries as ``(end of the stretch before, start of the next, strength)``."""
    found = []
    for m in _BOUNDARY.finditer(text):
        breaks = len(_BREAK.findall(m["gap"]))
        if breaks or m["stop"]:
            found.append((m.start("gap"), m.end(), min(3, breaks + 1) if breaks else 1))
    return found


def atoms(text: str, limit: int, overlap: int = 0) -> tuple[list[tuple[int, int, int]], bool]:
    """Segments ``(start, end, strength of the boundary at the end)`` that tile the text, and whether a cut was forced.

    White space at a boundary belongs to the segment before it, except what would carry that segment over the limit. What must be cut
    between boundaries is cut short enough to leave room for the overlap.
    """
    room = max(1, limit - overlap)
    pieces: list[tuple[int, int, int]] = []
    forced, start = False, 0
    for stop, end, strength in [*boundaries(text), (len(text), len(text), 3)]:
        if stop - start > limit:
            forced = True
        while stop - start > limit:  # no natural boundary within reach: at white space, or anywhere
            cut_at = max(text.rfind(" ", start + room // 2, start + room) + 1, text.rfind("\t", start + room // 2, start + room) + 1)
            cut_at = cut_at if cut_at > start else start + room
            pieces.append((start, cut_at, 0))
            start = cut_at
        while end - start > limit:  # a long run of white space
            pieces.append((start, start + room, strength))
            start += room
        if end > start:
            pieces.append((start, end, strength))
            start = end
    return pieces, forced


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Pieces ``(start, core start, end)`` of a text longer than the limit, and whether a cut was forced.

    Cores tile the text. A piece starts up to ``overlap`` characters before its core: at the earliest natural boundary that leaves at least
    half of the overlap, else at the earliest start of a word, else as early as it may. The overlap is shorter only where the piece
    before, or the room under the limit, is.
    """
    parts, forced = atoms(text, limit, overlap)
    n = len(parts)
    start, end = [p[0] for p in parts], [p[1] for p in parts]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    room = max(1, limit - overlap)
    heap = [(parts[i][2], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        strength, size, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] != b or end[b] - start[a] != size:
            continue
        if size > (limit if a == 0 else room):
            continue  # sizes only grow: this pair never fits again
        end[a], right[a], alive[b] = end[b], right[b], False
        if right[a] >= 0:
            left[right[a]] = a
            heapq.heappush(heap, (_strength_at(parts, right[a]), end[right[a]] - start[a], a, right[a]))
        if left[a] >= 0:
            heapq.heappush(heap, (_strength_at(parts, a), end[a] - start[left[a]], left[a], a))
    edges = [p[0] for p in parts]
    pieces = []
    for i in range(n):
        if alive[i]:
            begin = start[i]
            if pieces:
                least = max(begin - min(overlap, max(0, limit - (end[i] - begin))), pieces[-1][1])
                natural = _between(edges, least, begin - (begin - least) // 2)
                begin = natural[0] if natural else _word_start(text, least, begin)
            pieces.append((begin, start[i], end[i]))
    return pieces, forced


def _strength_at(parts, i: int) -> int:
    """Strength of the boundary before segment i."""
    return parts[i - 1][2]


def _between(edges, low: int, high: int):
    from bisect import bisect_left

    return edges[bisect_left(edges, low) : bisect_left(edges, high)]


_WORD = re.compile(r"(?<=\s)\S")


def _word_start(text: str, low: int, high: int) -> int:
    """The first start of a word in the first half of the stretch, else its beginning."""
    m = _WORD.search(text, low, low + (high - low) // 2 + 1)
    return m.start() if m else low


def split_oversized(
    df: DataFrame, key: str = "chunk_id", text: str = "text", carry: tuple[str, ...] = ("section",), limit: int = 4000, overlap: int = 200
) -> DataFrame:
    """``(key, *carry, piece, n_pieces, start, core_start, end, cut, text)`` for every text longer than ``limit`` code points.

    start, core_start and end count code points; cores tile the text without gap, ``start..core_start`` repeats the end of the piece
    before. cut is 'forced' or 'natural' for the whole text. Texts within the limit, empty and null texts give no rows; exact repeats
    of (key, carry, text) are split once; null keys are kept. Texts are independent of each other: no shuffle but that of the repeats
    (only texts over the limit take part), whose 64-bit-hashed row spreads any hot key.
    """
    long = df.select(F.col(key).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(text).cast("string").alias("t"))
    long = long.where(F.length("t") > limit).withColumn("h", F.xxhash64("t", *(f"c{i}" for i in range(len(carry)))))
    once = spread(long, "k", "h").dropDuplicates(["k", *(f"c{i}" for i in range(len(carry))), "t"]).drop("h")
    kept = [f for f in once.schema.fields if f.name != "t"]
    schema = T.StructType(
        [
            *kept,
            *(T.StructField(n, T.IntegerType()) for n in ("piece", "n_pieces", "start", "core_start", "end")),
            T.StructField("cut", T.StringType()),
            T.StructField("t", T.StringType()),
        ]
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                pieces, forced = split_text(row.t, limit, overlap)
                out = {f.name: [getattr(row, f.name)] * len(pieces) for f in kept}
                out |= {
                    "piece": list(range(len(pieces))),
                    "n_pieces": [len(pieces)] * len(pieces),
                    "start": [p[0] for p in pieces],
                    "core_start": [p[1] for p in pieces],
                    "end": [p[2] for p in pieces],
                    "cut": ["forced" if forced else "natural"] * len(pieces),
                    "t": [row.t[p[0] : p[2]] for p in pieces],
                }
                yield pd.DataFrame(out)

    return once.mapInPandas(work, schema).select(
        F.col("k").alias(key), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "piece", "n_pieces", "start", "core_start", "end", "cut", F.col("t").alias("text")
    )
