"""Evidence retrieval around units and papers: facets, sections, excerpts, best passages, expansion, and the typed graph."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosift.functions import text as X
from argosift.operators.blocks import Counts, Postings, met
from argosift.operators.retrieve import top_k

def multiset_overlap(queries: DataFrame, texts: DataFrame, q: str, t: str, on: list[str], counted: bool = True) -> DataFrame:
    """``(*on, q, t, overlap)``: shared tokens of the array columns ``q_tokens`` and ``t_tokens``, each as often as in both (or once)."""
    count = F.count("*") if counted else F.lit(1)
    a = queries.select(*on, q, F.explode("q_tokens").alias("token")).groupBy(*on, q, "token").agg(count.alias("n"))
    b = texts.select(*on, t, F.explode("t_tokens").alias("token")).groupBy(*on, t, "token").agg(count.alias("m"))
    return a.join(b, [*on, "token"]).groupBy(*on, q, t).agg(F.sum(F.least("n", "m")).alias("overlap"))


def filled(c: str) -> Column:
    """Whether a map has a value that is neither empty nor a filler."""
    values = F.coalesce(F.map_values(c), F.array().cast("array<string>"))
    return F.exists(values, lambda v: v.isNotNull() & ~F.lower(F.trim(v)).isin("", "n/a", "none", "-", "unknown"))


def facet_retrieval(questions: DataFrame, units: DataFrame, required: tuple[str, ...], k: int, cap: int) -> DataFrame:
    """``(item_id, unit_id, score, place)``: keywords shared, plus three times the share of required facets a unit has, plus its confidence.

    Units with neither a shared keyword nor a required facet are none; at most ``cap`` a paper. questions: item_id, q_tokens; units: unit_id,
    paper_id, confidence, t_tokens and a map column a facet.
    """
    share = sum((filled(f).cast("int") for f in required), F.lit(0)) / F.lit(len(required))
    base = units.select("unit_id", "paper_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), share.alias("share"))
    overlap = multiset_overlap(questions, units, "item_id", "unit_id", [], counted=False)
    score = F.col("overlap") + 3.0 * F.col("share") + F.col("confidence")
    hit = overlap.join(base, "unit_id").select("item_id", "unit_id", "paper_id", score.alias("score"))
    best = top_k(hit, k, [F.round("score", 9).desc(), F.col("unit_id")], ["item_id"], cap, "paper_id")
    # What shares no keyword ranks by facets and confidence alone, the same for all questions: its best k by paper complete each list.
    alone = base.where("share > 0").select(F.lit(0).alias("z"), "unit_id", "paper_id", (3.0 * F.col("share") + F.col("confidence")).alias("score"))
    within = top_k(alone, k + cap * k, [F.round("score", 9).desc(), F.col("unit_id")], ["z", "paper_id"]).drop("place")
    spare = within.orderBy(F.round("score", 9).desc(), "unit_id").limit(k * (k + 1) * (cap + 1))
    more = questions.select("item_id").distinct().join(F.broadcast(spare.drop("z")))  # a bounded list for every question
    more = more.join(hit.select("item_id", "unit_id"), ["item_id", "unit_id"], "left_anti")
    pool = best.select("item_id", "unit_id", "paper_id", "score").unionByName(more.select("item_id", "unit_id", "paper_id", "score"))
    return top_k(pool, k, [F.round("score", 9).desc(), F.col("unit_id")], ["item_id"], cap, "paper_id").select("item_id", "unit_id", F.round("score", 6).alias("score"), "place")


def boosted_candidates(questions: DataFrame, records: DataFrame, k: int, same: float = 1.5, current: float = 0.4) -> DataFrame:
    """``(item_id, record_id, score, place)``: records dated no later than the question's cutoff that share a token, by the share of the question's tokens
    covered, ``same`` for its own paper and ``current`` for records marked current.

    questions: item_id, paper_id, cutoff, q_tokens; records: record_id, paper_id, date, current, t_tokens.
    """
    overlap = multiset_overlap(questions, records, "item_id", "record_id", [])
    q = questions.select("item_id", F.col("paper_id").alias("q_paper"), "cutoff", F.size("q_tokens").alias("n"))
    r = records.select("record_id", "paper_id", "date", "current")
    rows = overlap.join(q, "item_id").join(r, "record_id").where("date <= cutoff")
    score = F.when(F.col("paper_id") == F.col("q_paper"), same).otherwise(0.0) + F.when(F.col("current"), current).otherwise(0.0) + F.col("overlap") / F.greatest("n", F.lit(1))
    best = top_k(rows.withColumn("score", score), k, [F.round("score", 9).desc(), F.col("date"), F.col("record_id")], ["item_id"])
    return best.select("item_id", "record_id", F.round("score", 6).alias("score"), "place")


def cross_section_chunks(units: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``(unit_id, chunk_id, score, place)``: chunks of a unit's paper that hold none of its spans, by the share of the unit's tokens, 2 for each exact term,
    3 for each figure or table reference, 0.5 for another section and 0.75 from results to methods or discussion.

    units: unit_id, paper_id, section, spans, terms (lower case), references (lower case, without full stops), q_tokens; chunks: chunk_id, paper_id,
    section, chunk_index, text, t_tokens. Units and chunks of a paper are met in blocks; a chunk is searched for spans only where it would be taken.
    """
    low = F.lower("text")
    u = units.select("paper_id", "unit_id", F.lower("section").alias("q_section"), *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("spans", "terms", "references", "q_tokens")))
    c = chunks.select("paper_id", "chunk_id", "chunk_index", F.lower("section").alias("section"), "text", low.alias("low"), F.coalesce("t_tokens", F.array().cast("array<string>")).alias("t_tokens"))
    turned = ("methods", "materials", "materials and methods", "experimental", "discussion", "results and discussion")

    def best(units: list, chunks: list) -> Iterator[tuple]:
        first = lambda x: (x is not None and x == x, 0 if x is None or x != x else x)
        chunks.sort(key=lambda x: (first(x[1]), first(x[0])))
        ids, places, sections, texts, lows, tokens = map(list, zip(*chunks, strict=True))
        held = Counts([Counter(t) for t in tokens])
        undotted = [t.replace(".", "") for t in lows]
        at = {s: np.array([x == s for x in sections]) for s in {*sections, *(x[1] for x in units)} - {None}}
        nowhere, to = np.array([x is None for x in sections]), np.array([x in turned for x in sections])
        having: dict[tuple, np.ndarray] = {}

        def have(word: str, hay: list, kind: str) -> np.ndarray:
            if (kind, word) not in having:
                if len(having) > 1000:
                    having.clear()
                having[kind, word] = np.fromiter((word in t for t in hay), dtype=np.int64, count=len(hay))
            return having[kind, word]

        for unit, section, spans, terms, references, q in units:
            overlap = held.shared(Counter(q))
            n_terms = sum((have(t, lows, "term") for t in terms), np.zeros(len(ids), dtype=np.int64))
            n_refs = sum((have(t, undotted, "reference") for t in references), np.zeros(len(ids), dtype=np.int64))
            other = ~at[section] | nowhere if section is not None else np.ones(len(ids), dtype=bool)
            methods = to if section is not None and section.startswith("result") else np.zeros(len(ids), dtype=bool)
            score = overlap / max(1, len(q)) + 2.0 * n_terms + 3.0 * n_refs + 0.5 * other + 0.75 * methods
            able = np.flatnonzero((overlap > 0) | (n_terms > 0))
            left = k
            for i in able[np.argsort(-np.round(score[able], 9), kind="stable")].tolist():
                if not any(s in texts[i] for s in spans):
                    yield unit, ids[i], places[i], float(score[i])
                    left -= 1
                    if not left:
                        break

    kinds = dict(units.dtypes)["unit_id"], dict(chunks.dtypes)["chunk_id"], dict(chunks.dtypes)["chunk_index"]
    found = met(u, c, "paper_id", best, f"unit_id {kinds[0]}, chunk_id {kinds[1]}, chunk_index {kinds[2]}, score double", 8_192, 2_048)
    best_k = top_k(found, k, [F.round("score", 9).desc(), F.col("chunk_index"), F.col("chunk_id")], ["unit_id"])
    return best_k.select("unit_id", "chunk_id", F.round("score", 6).alias("score"), "place")


def excerpt(text: str, query: Counter, spans: list[str], most: int = 2400, around: int = 500, pieces: int = 8) -> str:
    """Windows around the spans, then the pieces of the text that share most with the query (shorter first), up to ``most`` characters in all."""
    parts: dict[str, None] = {}
    for at, span in ((text.find(s), s) for s in spans if s):
        if at >= 0:
            parts[text[max(0, at - around) : at + len(span) + around].strip()] = None

    def shared(piece: str) -> int:
        return (Counter(t for t in re.findall("[a-z0-9]+", piece.casefold()) if len(t) > 2) & query).total()

    found = [p.strip() for p in re.split(r"\n{2,}|(?<=[.!?])\s+(?=[A-Z])", text) if p.strip()]
    parts |= dict.fromkeys(sorted(found, key=lambda p: (-shared(p), len(p)))[:pieces])
    out, left = [], most
    for part in parts:
        if left <= 0:
            break
        out.append(part[:left])
        left -= len(out[-1]) + 2
    return "\n\n".join(out)


def excerpts(pairs: DataFrame, key: str) -> DataFrame:
    """``(key, excerpt)`` from ``(key, text, q_tokens, spans)``; null texts give null."""
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["text"], pdf["q_tokens"], pdf["spans"], strict=True)
            none = lambda x: [] if x is None else x
            yield pd.DataFrame({"k": pdf["k"], "excerpt": [None if t is None else excerpt(t, Counter(none(q)), list(none(s))) for t, q, s in rows]})

    return pairs.select(F.col(key).alias("k"), "text", "q_tokens", "spans").mapInPandas(run, f"k {kind}, excerpt string").withColumnRenamed("k", key)


def best_passages(claims: DataFrame, passages: DataFrame, least: float = 0.55) -> DataFrame:
    """``(claim_id, passage_id, score)``: the first passage of a claim's paper that holds it (score 1), else the one most like it, if that is ``least`` or more.

    Texts are compared in lower case with single spaces. Likeness is the larger of the share of the claim's words that the passage has and the
    quick ratio of their characters; equal ones: the smaller passage_id. claims: claim_id, paper_id, text; passages: passage_id, paper_id, text.
    A claim and the passages of its paper are met in blocks. For a block, the words and characters that a claim shares with each passage are counted by
    array arithmetic; only a passage with all characters of a claim, and all words but those at its ends, is searched for it.
    """
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    asked = claims.where("text is not null").select("claim_id", "paper_id", plain.alias("claim")).where("claim <> ''").distinct()
    texts = passages.where("text is not null").select("paper_id", "passage_id", plain.alias("passage")).distinct()

    def best(asked: list, texts: list) -> Iterator[tuple]:
        texts.sort(key=lambda x: x[0])
        ids, texts = [p for p, _ in texts], [t for _, t in texts]
        held, sizes = Postings(set(t.split()) for t in texts), np.array([len(t) for t in texts])
        letters = Counts([Counter(t) for t in texts])
        for paper, claim in asked:
            words = set(claim.split())
            same = letters.shared(Counter(claim))
            shared = held.shared(words)
            whole = next((i for i in np.flatnonzero((same == len(claim)) & (shared >= max(0, len(words) - 2))).tolist() if claim in texts[i]), None)
            if whole is not None:
                yield paper, claim, ids[whole], 1.0, True
                continue
            score = np.round(np.maximum(shared / max(1, len(words)), 2 * same.astype(np.int64) / (len(claim) + sizes)), 9)
            at = int(score.argmax())  # the first of equal ones
            if score[at] >= least:
                yield paper, claim, ids[at], float(score[at]), False

    kinds = dict(claims.dtypes)["paper_id"], dict(passages.dtypes)["passage_id"]
    each = asked.select("paper_id", F.col("paper_id").alias("paper"), "claim").distinct()
    found = met(each, texts, "paper_id", best, f"paper_id {kinds[0]}, claim string, passage_id {kinds[1]}, score double, whole boolean")
    every = top_k(asked.join(found, ["paper_id", "claim"]), 1, [F.desc("whole"), F.desc("score"), F.col("passage_id")], ["claim_id", "claim"])
    return every.select("claim_id", "claim", "passage_id", F.round("score", 6).alias("score"))


def expansion(seeds: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """``(seed, ref, place)``: for each seed in order up to ``k`` references no earlier seed has taken: cited by most seeds, then most relevant, then most
    cited, then the smaller id.

    seeds: seed, pos; references: seed, ref, relevance, citations. What a seed may take lies within its first ``k * number of seeds`` references, so
    the walk over the seeds, a stated list, holds no more than that for each.
    """
    common = references.join(seeds.select("seed"), "seed", "left_semi").distinct()
    cited = common.groupBy("ref").agg(F.count_distinct("seed").alias("cocited"))
    n = seeds.count()  # a stated list
    order = [F.desc("cocited"), F.desc("relevance"), F.desc("citations"), F.col("ref")]
    pool = top_k(common.join(cited, "ref"), k * n, order, ["seed"]).join(seeds, "seed").orderBy("pos", "place").toPandas()
    taken: set = set()
    rows = []
    for seed, part in pool.groupby("seed", sort=False):
        fresh = [r for r in part["ref"].tolist() if r not in taken][:k]
        taken.update(fresh)
        rows += [(seed, r, i + 1) for i, r in enumerate(fresh)]
    kinds = dict(references.dtypes)
    return seeds.sparkSession.createDataFrame(rows, f"seed {kinds['seed']}, ref {kinds['ref']}, place int")


def typed_graph(relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, dropped)`` of evidence relations: nodes (id, paper, first type seen, degree), edges (source, target, type, relations, confidence) without
    repeats, and how many relations were dropped for which reason. An edge whose end has no id is dropped, not half kept."""
    rows = relations.select(
        "relation_id", F.lower(F.trim("relation_type")).alias("type"), F.col("source_entity_id").alias("source"), F.explode_outer("target_entity_ids").alias("target"), "confidence"
    ).distinct()
    reason = F.coalesce(
        F.when(F.col("relation_id").isNull(), "no id"), F.when(F.col("source").isNull(), "no source"), F.when(F.col("target").isNull(), "no target"),
        F.when(F.col("source") == F.col("target"), "to itself"), F.when(F.coalesce("type", F.lit("")) == "", "no type"),
    )
    marked = rows.withColumn("reason", reason)
    edges = marked.where("reason is null").groupBy("source", "target", "type").agg(F.count_distinct("relation_id").alias("relations"), F.max("confidence").alias("confidence"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), "type"), F.struct(F.col("target").alias("id"), "type"))).alias("e")).select("e.*")
    nodes = ends.groupBy("id").agg(F.min("type").alias("first_type"), F.count("*").alias("degree")).withColumn("paper", F.substring_index("id", "::", 1))
    return nodes, edges, marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def gap_before_own_work(text: Column, own: str, most: int = 6) -> Column:
    """Up to ``most`` sentences before the first that speaks of the authors' own work; null where none does or fewer than two stand before it."""
    s = X.sentences(text)
    at = F.array_position(F.transform(s, lambda x: F.lower(x).rlike(own)), F.lit(True))
    start = F.greatest(F.lit(1).cast("long"), at - most)
    return F.when(at >= 3, F.array_join(F.slice(s, start.cast("int"), (at - start).cast("int")), " "))


def strip_back_matter(text: Column, heading: str, after: float = 0.4) -> Column:
    """The text up to the first line that is a heading of back matter and starts beyond the share ``after`` of it."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("cut"))

    def step(acc: Column, line: Column) -> Column:
        hit = (acc["cut"] < 0) & (acc["at"] > F.length(text) * after) & F.lower(F.trim(line)).rlike(heading)
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.when(hit, acc["at"]).otherwise(acc["cut"]).alias("cut"))

    cut_at = F.aggregate(lines, start, step)["cut"]
    return F.when(cut_at >= 0, F.regexp_replace(F.substring(text, F.lit(1), cut_at), r"\s+$", "")).otherwise(text)


def best_overlap(captions: DataFrame, passages: DataFrame) -> DataFrame:
    """``(caption_id, passage_id, overlap)``: the passage of a caption's paper that has most of its tokens (each counted once), equal ones: the smaller id;
    captions without a shared token have no row. Both have a paper_id and an array column, q_tokens and t_tokens; they are met in blocks."""
    asked = captions.where(F.size("q_tokens") > 0).select("paper_id", "caption_id", F.array_distinct("q_tokens").alias("q"))
    texts = passages.where(F.size("t_tokens") > 0).select("paper_id", "passage_id", F.array_distinct("t_tokens").alias("t"))

    def best(asked: list, texts: list) -> Iterator[tuple]:
        texts.sort(key=lambda x: x[0])
        held = Postings(t for _, t in texts)
        for c, q in asked:
            shared = held.shared(q)
            at = int(shared.argmax())  # the first of equal ones
            if shared[at]:
                yield c, texts[at][0], int(shared[at])

    kinds = dict(captions.dtypes)["caption_id"], dict(passages.dtypes)["passage_id"]
    found = met(asked, texts, "paper_id", best, f"caption_id {kinds[0]}, passage_id {kinds[1]}, overlap long")
    return top_k(found, 1, [F.desc("overlap"), F.col("passage_id")], ["caption_id"]).select("caption_id", "passage_id", "overlap")


def hashed_vectors(df: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """``(key, bucket, weight)``: a text's tokens counted in ``size`` buckets (at most 256) by the first byte of their MD5, scaled to length one; only buckets
    that hold something have a row."""
    bucket = (F.conv(F.substring(F.md5("token"), 1, 2), 16, 10).cast("int") % size).alias("bucket")
    counts = df.select(key, F.explode(X.tokens(text)).alias("token")).groupBy(key, bucket).agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))  # at most ``size`` rows a key
    return counts.select(key, "bucket", (F.col("n") / length).alias("weight"))
