"""Operators whose steps depend on one another: chunking, fuzzy grounding, tournaments, search loops, model boundaries."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosift.operators.blocks import Postings, met
from argosift.operators.ordering import numbered
from argosift.runtime import cut

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset("al approx ca cf dr e.g eq eqs etc fig figs i.e no nos prof ref refs resp sec st tab vol vs".split())
_STOP = re.compile(r"[.!?][\"')\]]*(\s+)(?=[\"'(\[]?[A-Z0-9])")
_LAST_WORD = re.compile(r"[\w.]*\w$")


def sentence_ends(text: str) -> Iterator[tuple[int, int]]:
    """``(end of a sentence, start of the next)``: a stop, white space, then a capital, digit or bracket; not after an abbreviation or initial."""
    for m in _STOP.finditer(text):
        word = _LAST_WORD.search(text, max(0, m.start() - 20), m.start())
        short = word and text[m.start()] == "." and (word[0].lower() in ABBREVIATIONS or len(word[0]) == 1 and word[0].isupper())
        if not short:
            yield m.start(1), m.end(1)


def split_sentences(text: str) -> list[str]:
    """Sentences without the white space between them; their order and characters are those of the text."""
    text = (text or "").strip()
    starts = [0]
    ends = []
    for end, start in sentence_ends(text):
        ends.append(end)
        starts.append(start)
    return [text[a:b] for a, b in zip(starts, [*ends, len(text)], strict=True) if a < b]


def paragraph_chunks(text: str, most: int = 1600, least: int = 200) -> list[str]:
    """Paragraphs joined up to ``most`` characters; a longer paragraph is cut by sentences; a short rest joins the chunk before."""
    out, buffer = [], ""

    def flush():
        nonlocal buffer
        if buffer:
            if out and len(buffer) < least and len(out[-1]) + 2 + len(buffer) <= most + least:
                out[-1] += "\n\n" + buffer
            else:
                out.append(buffer)
        buffer = ""

    for block in re.split(r"\n\s*\n", text or ""):
        block = block.strip()
        parts = [block] if len(block) <= most else split_sentences(block)
        for part in parts:
            if buffer and len(buffer) + 2 + len(part) > most:
                flush()
            buffer = f"{buffer}\n\n{part}" if buffer else part
    flush()
    return out


def line_chunks(text: str, budget: int, overlap: float = 0.1) -> list[tuple[int, int]]:
    """Line ranges ``(first, end)`` of at most ``budget`` estimated tokens (a line at least), overlapping by a share of the lines."""
    lines = (text or "").split("\n")
    cost = [len(x) // 4 + 1 for x in lines]
    out, start = [], 0
    while start < len(lines):
        end, used = start, 0
        while end < len(lines) and (end == start or used + cost[end] <= budget):
            used += cost[end]
            end += 1
        out.append((start, end))
        if end == len(lines):
            break
        start = max(start + 1, end - int((end - start) * overlap))
    return out


def map_texts(df: DataFrame, key: str, text: str, run: Callable[[str], list], schema: str) -> DataFrame:
    """``(key, pos, ...)``: what ``run`` gives for each text, as rows with the given columns."""
    names = [c.split()[0] for c in schema.split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                for i, r in enumerate(run(t) if t is not None else []):
                    rows.append((k, i, *(r if isinstance(r, tuple) else (r,))))
            yield pd.DataFrame(rows, columns=["k", "pos", *names])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(work, f"k {dict(df.dtypes)[key]}, pos int, {schema}").withColumnRenamed("k", key)


def longest_word(span: str) -> str:
    """The word whose places in a source are tried; empty if the span has none."""
    return max(re.findall(r"\w+", span or "") or [""], key=len)


def _reachable(span: str, window: str) -> float:
    """The most that ``fuzzy_ratio`` can give for a window: blocks of three or more consist of places whose three characters occur in it."""
    end = covered = 0
    for i in range(len(span) - 2):
        if span[i : i + 3] in window:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered / len(span)


def fuzzy_ratio(span: str, source: str, margin: float = 0.3, least: float = 0.0) -> float:
    """Best sequence-matcher ratio of the span against windows of the source around all places of its longest word.

    Windows that cannot give more than ``least`` are not matched; a result of ``least`` or below then means no more than that.
    """
    if not span or not source:
        return 0.0
    if span in source:
        return 1.0
    word = longest_word(span)
    best, at = 0.0, source.find(word) if word else -1
    offset = span.find(word)
    pad = int(len(span) * margin) + 1
    while at >= 0:
        low = max(0, at - offset - pad)
        window = source[low : at - offset + len(span) + pad]
        if _reachable(span, window) > max(best, least):
            matcher = difflib.SequenceMatcher(None, span, window, autojunk=False)
            covered = sum(b.size for b in matcher.get_matching_blocks() if b.size >= 3)
            best = max(best, covered / len(span))
        at = source.find(word, at + 1)
    return best


def fuzzy_grounding(units: DataFrame, records: DataFrame) -> DataFrame:
    """``(unit_id, span, ratio)``: how much of a unit's span stands in the best record of its paper, in blocks of three characters or more.

    1 for a span that a record holds, 0 for one without any likeness or without characters, null where the paper has no text. Spans and records of a
    paper are met in blocks. Only what no record of a block holds goes to the matcher, and only with records that have its longest word, those
    that share most runs of three characters first, so that the others seldom can give more.
    """
    spans = units.select("unit_id", "paper_id", F.explode("evidence_spans").alias("span")).distinct()
    texts = records.where("text is not null").select("paper_id", "text").distinct()
    asked = spans.where("length(span) > 0").select("paper_id", F.col("paper_id").alias("paper"), "span").distinct()

    def best(asked: list, texts: list) -> Iterator[tuple]:
        texts = [t for (t,) in texts]
        words = Postings(set(re.findall(r"\w+", t)) for t in texts)
        vocabulary = "\n".join(words.places)
        held = Postings({t[i : i + 3] for i in range(len(t) - 2)} for t in texts)
        having: dict[str, list[int]] = {}

        def with_word(word: str) -> list[int]:
            """The texts that have the word, also within a longer one."""
            if word not in having:
                found, at = set(), vocabulary.find(word)
                while at >= 0:
                    end = vocabulary.find("\n", at)
                    found.add(vocabulary[vocabulary.rfind("\n", 0, at) + 1 : end if end >= 0 else None])
                    at = vocabulary.find(word, end) if end >= 0 else -1
                if len(having) > 10_000:
                    having.clear()
                having[word] = np.flatnonzero(words.shared(found)).tolist()
            return having[word]

        for paper, span in asked:
            word = longest_word(span)
            near = with_word(word) if word else range(len(texts))
            if any(span in texts[i] for i in near):
                yield paper, span, 1.0
            elif word:
                ratio = 0.0
                shared = held.shared({span[i : i + 3] for i in range(len(span) - 2)})
                for i in sorted(near, key=lambda i: -int(shared[i])):  # noqa: B023
                    ratio = max(ratio, fuzzy_ratio(span, texts[i], least=ratio))
                yield paper, span, ratio

    kind = dict(spans.dtypes)["paper_id"]
    rated = met(asked, texts, "paper_id", best, f"paper_id {kind}, span string, ratio double", 2_048, 8_192)
    rated = rated.groupBy("paper_id", "span").agg(F.max("ratio").alias("ratio"))
    known = texts.select("paper_id").distinct().withColumn("known", F.lit(True))
    out = spans.join(rated, ["paper_id", "span"], "left").join(known, "paper_id", "left")
    ratio = F.when(F.col("known"), F.coalesce("ratio", F.lit(0.0)))
    return out.groupBy("unit_id", "span").agg(F.round(F.max(ratio), 6).alias("ratio"))


def verify_quote(quote: str, text: str) -> str:
    """'exact', 'loose' (four fifths of the tokens of more than two letters) or 'none'."""
    squeeze = lambda s: re.sub(r"\s+", " ", s or "").strip().casefold()
    q, t = squeeze(quote), squeeze(text)
    if q and q in t:
        return "exact"
    words = {w for w in re.findall(r"[a-z0-9]+", q) if len(w) > 2}
    return "loose" if words and len(words & set(re.findall(r"[a-z0-9]+", t))) >= 0.8 * len(words) else "none"


def swiss_round(standings: DataFrame, met: DataFrame) -> DataFrame:
    """``(a, b)``: the pairings of one round, from ``standings (player, points, seed)`` and ``met (a, b)``, the pairs that have played.

    Players are ranked by points, then seed. Each wishes for the nearest in rank it has not met; a pair is made where two wish for each other,
    and the rest are ranked and wish again, until no pair can be made. Of an odd number, the last of those with the most games has the bye;
    players that are left with only opponents they have met have one too. Nearest first, and of equally near ones
    those that make the first pair with the second, the third with the fourth and so on, so that most pairs are made in one pass. A
    player that has met m others finds one within m + 1 ranks, so wishes are equi-joins of ranks, not of all with all.
    """
    played = cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = played.select(F.col("a").alias("p")).unionByName(played.select(F.col("b").alias("p")))
    reach = (ends.groupBy("p").count().agg(F.max("count")).first()[0] or 0) + 1
    left, pairs = standings.select("player", "points", "seed"), None
    if left.count() % 2:
        games = left.join(ends.groupBy(F.col("p").alias("player")).agg(F.count("*").alias("n")), "player", "left")
        last = games.orderBy(F.coalesce("n", F.lit(0)).desc(), "points", F.desc("seed"), F.desc("player")).limit(1)
        left = left.join(last.select("player"), "player", "left_anti")
    while True:
        left = cut(numbered(left, [F.desc("points"), F.col("seed"), F.col("player")], "rank"))
        near = left.select("player", "rank", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("apart")).withColumn("other", F.col("rank") + F.col("apart"))
        open_ = near.alias("x").join(left.alias("y"), F.col("x.other") == F.col("y.rank")).select(
            F.least("x.player", "y.player").alias("a"), F.greatest("x.player", "y.player").alias("b"), F.struct("x.apart", (F.col("x.rank") % 2).alias("odd"), F.col("x.rank").alias("high")).alias("wish")
        )
        open_ = open_.join(played, ["a", "b"], "left_anti")
        best = open_.select(F.explode(F.array("a", "b")).alias("p"), "wish").groupBy("p").agg(F.min("wish").alias("best"))
        made = open_.join(best.withColumnRenamed("p", "a"), "a").where("wish = best").drop("best").join(best.withColumnRenamed("p", "b"), "b").where("wish = best")
        made = cut(made.select("a", "b"))
        if not made.head(1):
            return pairs if pairs is not None else made
        pairs = made if pairs is None else pairs.unionByName(made)
        left = left.drop("rank").join(made.select(F.explode(F.array("a", "b")).alias("player")), "player", "left_anti")


def swiss(players: DataFrame, beats: Callable[[DataFrame], DataFrame], rounds: int = 5) -> DataFrame:
    """``(player, points, played)`` after ``rounds`` Swiss rounds of ``players (player, seed)``.

    ``beats`` turns pairings ``(a, b)`` into ``(a, b, got)``, got being a's points (1, 0.5 or 0); b has the rest. Byes give nothing.
    """
    spark = players.sparkSession
    kind = dict(players.dtypes)["player"]
    results = spark.createDataFrame([], f"a {kind}, b {kind}, got double")

    def standings() -> DataFrame:
        won = results.select(F.col("a").alias("player"), F.col("got").alias("p")).unionByName(results.select(F.col("b").alias("player"), (1 - F.col("got")).alias("p")))
        sums = won.groupBy("player").agg(F.sum("p").alias("points"), F.count("*").alias("played"))
        table = players.select("player", "seed").join(sums, "player", "left")
        return table.select("player", "seed", F.coalesce("points", F.lit(0.0)).alias("points"), F.coalesce("played", F.lit(0)).alias("played"))

    for _ in range(rounds):
        pairs = swiss_round(standings(), results.select("a", "b"))
        results = cut(results.unionByName(beats(pairs).select("a", "b", F.col("got").cast("double").alias("got"))))
    return standings().select("player", "points", "played")


def ridge_without_group(df: DataFrame, group: str, features: list[str], target: str, penalty: float = 10.0) -> DataFrame:
    """``(group, coefficients)`` of ridge regressions (no intercept) that leave out one group each.

    Cross products are summed by group in the JVM; a group's own sums are subtracted from the total, so rows are read once. What is solved
    is one small system a group.
    """
    n = len(features)
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    sums = df.groupBy(F.col(group).alias("g")).agg(*cross, *(F.sum(F.col(a) * F.col(target)).alias(f"y{i}") for i, a in enumerate(features)))
    names = [c for c in sums.columns if c != "g"]
    total = sums.agg(*(F.sum(c).alias(f"t_{c}") for c in names))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                left = {c: r[f"t_{c}"] - r[c] for c in names}
                a = np.array([[left[f"x{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
                out.append((r["g"], np.linalg.solve(a + penalty * np.eye(n), np.array([left[f"y{i}"] for i in range(n)], float)).round(6).tolist()))
            yield pd.DataFrame(out, columns=["g", "coefficients"])

    kind = dict(df.dtypes)[group]
    return sums.crossJoin(F.broadcast(total)).mapInPandas(solve, f"g {kind}, coefficients array<double>").withColumnRenamed("g", group)  # total is one row


def ready_order(tasks: dict[str, list[str]]) -> tuple[list[list[str]], list[str]]:
    """Levels of tasks whose dependencies are done (unknown ones count as done), and what can never start."""
    done: set[str] = set()
    levels, waiting = [], dict(tasks)
    while waiting:
        level = sorted(t for t, deps in waiting.items() if all(d in done or d not in tasks for d in deps))
        if not level:
            return levels, sorted(waiting)
        levels.append(level)
        done |= set(level)
        waiting = {t: d for t, d in waiting.items() if t not in done}
    return levels, []


def beam_search(start: list, expand: Callable, score: Callable, width: int = 2, rounds: int = 2):
    """The best state of a beam search that ends when the best score no longer rises."""
    beam = sorted(start, key=score, reverse=True)[:width]
    best = beam[0] if beam else None
    for _ in range(rounds):
        pool = beam + [x for b in beam for x in expand(b)]
        beam = sorted(pool, key=score, reverse=True)[:width]
        if not beam or score(beam[0]) <= score(best):
            break
        best = beam[0]
    return best


def critique_loop(draft, review: Callable, revise: Callable, rounds: int = 3):
    """``(best, rounds used, reason)``: at least one revision; the earlier draft wins ties; stops when fine or no better."""
    best, best_score = draft, review(draft)[0]
    for turn in range(1, rounds + 1):
        fresh = revise(best)
        score, fine = review(fresh)
        better = score > best_score
        if better:
            best, best_score = fresh, score
        if fine:
            return best, turn, "fine"
        if not better:
            return best, turn, "no improvement"
    return best, rounds, "rounds"


def ask_model(df: DataFrame, key: str, prompt: str, client: Callable[[], Callable[[str], str]], retries: int = 2) -> DataFrame:
    """``(key, answer, error)``: a model's JSON answers. ``client`` is called once a task and gives the function that answers a prompt.

    Answers that are no JSON object are asked for again; what fails to the end has the error instead.
    """
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in batches:
            out = []
            for k, p in zip(pdf["k"], pdf["p"], strict=True):
                answer, error = None, "no prompt"
                for _ in range(retries + 1 if p else 0):
                    try:
                        parsed = lenient_json(ask(p))
                        if isinstance(parsed, dict):
                            answer, error = json.dumps(parsed, sort_keys=True), None
                            break
                        error = "no object"
                    except Exception as problem:  # noqa: BLE001
                        error = f"{type(problem).__name__}: {problem}"
                out.append((k, answer, error))
            yield pd.DataFrame(out, columns=["k", "answer", "error"])

    return df.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(work, f"k {kind}, answer string, error string").withColumnRenamed("k", key)


def lenient_json(text: str):
    """The first JSON object or array in an answer, or None."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text or ""):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except json.JSONDecodeError:
            continue
    return None
