"""Filling fixed-capacity containers with whole texts, by balanced cost.

Each text costs ``linear * n + quadratic * n * n`` (n tokens; the square stands for attention). Texts are taken in descending order of
tokens, and each goes to the container of least cost so far that still has room for it. Only texts above the capacity are cut.

Distribution: tokens are counted where the texts lie; from then on only (document, piece, tokens) moves. These rows are dealt at random
to shards of about ``shard_containers`` containers, each packed by one task. Containers that stay below ``good_fill`` are opened
again and their texts dealt to fewer shards, round by round; the shards of the last round keep what they pack.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosift.runtime import cut, spread

SCHEMA = "doc_id long, piece int, n_tokens int, container long, round int"


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file: folder in ARGOSIFT_TOKENIZERS, else /opt/tokenizers."""
    return os.path.join(os.environ.get("ARGOSIFT_TOKENIZERS", "/opt/tokenizers"), name)


#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("file", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` a row; null and empty texts have 0 tokens, rows with a null key are dropped."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path)
        for pdf in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.array(sizes, dtype=np.int32)})

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInPandas(count, "doc_id long, n_tokens int")


class _Open:
    """Open containers by room left; finds the one of least cost with enough room in log(capacity) steps."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]
        self.best: list = [None] * (2 * self.size)

    def _refresh(self, room: int) -> None:
        heap, i = self.heaps[room], room + self.size
        self.best[i] = (*heap[0], room) if heap else None
        i >>= 1
        while i:
            a, b = self.best[2 * i], self.best[2 * i + 1]
            self.best[i] = a if b is None or (a is not None and a <= b) else b
            i >>= 1

    def put(self, cost: float, number: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, number))
        self._refresh(room)

    def take(self, least_room: int):
        """Remove and return (cost, number, room) of least cost with room for ``least_room``, or None."""
        low, high, found = least_room + self.size, 2 * self.size, None
        while low < high:
            if low & 1:
                if self.best[low] is not None and (found is None or self.best[low] < found):
                    found = self.best[low]
                low += 1
            if high & 1:
                high -= 1
                if self.best[high] is not None and (found is None or self.best[high] < found):
                    found = self.best[high]
            low, high = low >> 1, high >> 1
        if found:
            heapq.heappop(self.heaps[found[2]])
            self._refresh(found[2])
        return found


def pack(sizes: list[int], capacity: int, linear: float, quadratic: float) -> list[int]:
    """Container number of each of the sizes, which must be in descending order and at most ``capacity``."""
    containers = max(1, math.ceil(sum(sizes) / capacity)) if sizes else 0
    free = _Open(capacity)
    for number in range(containers):
        free.put(0.0, number, capacity)
    placed = []
    for n in sizes:
        found = free.take(n)
        if found is None:
            found = (0.0, containers, capacity)
            containers += 1
        cost, number, room = found
        free.put(cost + linear * n + quadratic * n * n, number, room - n)
        placed.append(number)
    return placed


def pack_documents(
    counts: DataFrame,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    shard_containers: int = 2000,
    good_fill: float = 0.985,
    rounds: int = 4,
) -> DataFrame:
    """``(doc_id, piece, n_pieces, token_start, n_tokens, container, fill)`` from ``(doc_id, n_tokens)``.

    Every row of ``counts`` with at least one token is placed (equal doc_ids are told apart by order in the table only through their
    pieces; texts of 0 tokens or null need no room and get no row). A text above the capacity is cut every ``capacity`` tokens: its
    whole pieces fill a container each, the rest is packed like a text. container numbers are unique, not consecutive.
    fill is the share of the container's capacity that is used. Which shard a row is dealt to depends on a hash of its doc_id and
    piece, so that neither a source nor a run of ids gathers in one shard.
    """
    spark = counts.sparkSession
    cap = F.lit(capacity)
    rows = counts.where(F.col("n_tokens") > 0).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("int").alias("total"), F.monotonically_increasing_id().alias("row")
    )
    pieces = rows.select(
        "doc_id", "row", F.ceil(F.col("total") / cap).cast("int").alias("n_pieces"), "total", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / cap) - 1).cast("int"))).alias("piece")
    ).withColumn("n_tokens", F.least(cap, F.col("total") - F.col("piece") * cap).cast("int"))
    pieces = cut(pieces.drop("total"))
    total = pieces.agg(F.sum("n_tokens")).first()[0] or 0
    full = pieces.where(F.col("n_tokens") == capacity).select(
        "row", "piece", "doc_id", "n_pieces", "n_tokens", F.concat_ws("-", F.lit("w"), "row", "piece").alias("container")
    )
    rest = pieces.where(F.col("n_tokens") < capacity).withColumn("size", F.col("n_tokens"))

    def work(turn: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["n_tokens", "doc_id", "row", "piece"], ascending=[False, True, True, True], ignore_index=True)
            placed = np.array(pack(pdf["n_tokens"].tolist(), capacity, linear, quadratic), dtype=np.int64)
            used = np.bincount(placed, weights=pdf["n_tokens"], minlength=placed.max() + 1 if len(placed) else 0)
            pdf["done"] = used[placed] >= good_fill * capacity if turn else used[placed] >= 0
            pdf["container"] = [f"{turn}-{key[0]}-{c}" for c in placed]
            return pdf[["row", "piece", "doc_id", "n_pieces", "n_tokens", "container", "done"]]

        return run

    schema = "row long, piece int, doc_id long, n_pieces int, n_tokens int, container string, done boolean"
    placed = full
    shards = max(1, math.ceil(total / (capacity * shard_containers)))
    for turn in range(rounds - 1, -1, -1):
        if turn and shards == 1:
            continue  # what one task holds is packed once, for good
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(turn)), F.lit(shards)))
        packed = cut(dealt.groupBy("shard").applyInPandas(work(turn), schema))
        placed = placed.unionByName(packed.where("done").drop("done"))
        if not turn:
            break
        rest = packed.where("not done").select("row", "piece", "doc_id", "n_pieces", "n_tokens")
        left = rest.agg(F.sum("n_tokens")).first()[0] or 0
        shards = max(1, math.ceil(left / (capacity * shard_containers)))
        if not left:
            break
    filled = placed.groupBy("container").agg((F.sum("n_tokens") / F.lit(capacity)).alias("fill"))
    return placed.join(filled, "container").select(
        "doc_id", "piece", "n_pieces", (F.col("piece") * F.lit(capacity)).alias("token_start"), "n_tokens", "container", F.round("fill", 6).alias("fill")
    )
