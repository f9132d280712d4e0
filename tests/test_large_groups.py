"""Operators on many rows that are alike or that one paper holds, which were compared pair by pair."""

import random
import time

from pyspark.sql import functions as F

from argosift.operators import evidence as V
from argosift.operators import matching as H
from argosift.operators import procedural as P
from argosift.operators import similarity as M
from argosift.operators.blocks import met


def test_best_match_of_many_equal_sets(spark):
    s = spark.range(40_000).select("id", F.array(F.lit("ring"), (F.col("id") % 8).cast("string")).alias("s"))
    s = s.unionByName(spark.createDataFrame([(50_000, ["ring", "alone"]), (50_001, []), (50_002, None)], "id long, s array<string>"))
    began = time.time()
    got = {r["a"]: (r["b"], r["jaccard"]) for r in H.best_match(s.where("id % 2 = 0"), s, "id", "s").collect()}
    assert time.time() - began < 40
    want = {a: (39_992 + a % 8 if a < 39_992 else a - 8, 1.0) for a in range(0, 40_000, 2)} | {50_000: (39_999, round(1 / 3, 6))}
    assert got == want


def test_best_match_by_hand(spark):
    rng = random.Random(6)
    sets = {i: set(rng.sample("abcdefghij", rng.randrange(0, 5))) for i in range(150)}
    df = spark.createDataFrame([(k, list(s)) for k, s in sets.items()], "k int, s array<string>")
    want = {}
    for a, s in sets.items():
        if found := [(round(len(s & t) / len(s | t), 9), b) for b, t in sets.items() if b != a and s & t]:
            want[a] = max(found)
    for part in ("k % 3 = 0", "k >= 0"):
        got = {r["a"]: (r["jaccard"], r["b"]) for r in H.best_match(df.where(part), df, "k", "s").collect()}
        assert got == {a: (round(j, 6), b) for a, (j, b) in want.items() if part != "k % 3 = 0" or a % 3 == 0}


def test_caption_passages_of_a_large_paper(spark):
    """Four million pairs of one paper that share words; every pair was a row with its tokens."""
    words = F.array(F.lit("alloy"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("x"), F.col("id") % 1000))
    c = spark.range(2000).select(F.col("id").alias("caption_id"), F.lit("p").alias("paper_id"), words.alias("q_tokens"))
    p = spark.range(2000).select(F.col("id").alias("passage_id"), F.lit("p").alias("paper_id"), words.alias("t_tokens"))
    p = p.unionByName(spark.createDataFrame([(-1, "q", ["alloy"]), (-2, None, ["alloy"]), (-3, "p", [])], "passage_id long, paper_id string, t_tokens array<string>"))
    c = c.unionByName(spark.createDataFrame([(9000, "q", ["other"]), (9001, "q", ["alloy", "alloy"]), (9002, None, ["alloy"])], "caption_id long, paper_id string, q_tokens array<string>"))
    got = {r["caption_id"]: (r["passage_id"], r["overlap"]) for r in V.best_overlap(c, p).collect()}
    assert got == {i: (i, 3) for i in range(2000)} | {9001: (-1, 1)}


def test_blocks_meet_once(spark):
    a = spark.createDataFrame([(p, i) for p in ("x", "y", None) for i in range(50)] + [("z", 1)], "p string, a int")
    b = spark.createDataFrame([(p, i) for p in ("x", "y", None) for i in range(30)] + [("u", 1)], "p string, b int")
    pairs = lambda left, right: [(i, j) for (i,) in left for (j,) in right]
    for sizes in ((1000, 1000), (7, 4), (1000, 4)):
        got = sorted(map(tuple, met(a, b, "p", pairs, "a int, b int", *sizes).collect()))
        assert got == sorted(2 * [(i, j) for i in range(50) for j in range(30)])


def test_best_passages_of_a_large_paper(spark):
    """A million pairs of one paper, none of them exact; each was compared in Python. Then a claim of 255 words that one passage holds whole."""
    rng = random.Random(8)
    text = lambda k, n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n)) + f" {k}"
    passages = [(k, "p", text(k, 20)) for k in range(1500)]
    claims = [(k, "p", passages[k][2][3:].replace("a", "b", 1)) for k in range(700)]
    long = text("long", 300)
    passages.append((7000, "p", long + " end"))
    claims.append((7000, "p", " ".join(long.split()[:255])))
    began = time.time()
    got = V.best_passages(spark.createDataFrame(claims, "claim_id int, paper_id string, text string"), spark.createDataFrame(passages, "passage_id int, paper_id string, text string")).collect()
    assert time.time() - began < 15
    assert {r["claim_id"]: r["passage_id"] for r in got} == {k: k for k in (*range(700), 7000)} and max(r["score"] for r in got) == 1.0


def test_cross_section_chunks_of_a_large_paper(spark):
    """Four million pairs of one paper; every pair was a row with the texts of both. Equal scores go by chunk_index, without one first, and large ids stay whole."""
    big = 1 << 60
    texts = [(big + i, "p", ("methods", None, "results")[i % 3], None if i == 5 else i, f"Alloy {i % 50} grain size{i}. See Fig. {i % 4}." + " filler words" * 50) for i in range(2000)]
    c = spark.createDataFrame(texts, "chunk_id long, paper_id string, section string, chunk_index int, text string").withColumn("t_tokens", F.array(F.lit("grain"), F.concat(F.lit("size"), F.col("chunk_id") - big)))
    units = [(u, "p", "Results", [f"grain size{u}."], [f"alloy {u % 50} "], [f"fig {u % 4}"], ["grain", f"size{u}"]) for u in range(2000)]
    u = spark.createDataFrame(units, "unit_id int, paper_id string, section string, spans array<string>, terms array<string>, references array<string>, q_tokens array<string>")
    began = time.time()
    got = {}
    for r in V.cross_section_chunks(u, c, 2).collect():
        got.setdefault(r["unit_id"], []).append((r["place"], r["chunk_id"] - big, r["score"]))
    assert time.time() - began < 30
    for n in (0, 5, 7, 1234):
        scored = []
        for i, _, section, index, text in texts:
            i -= big
            if f"grain size{n}." not in text:
                score = (1 + (i == n)) / 2 + 2 * (i % 50 == n % 50) + 3 * (i % 4 == n % 4) + 0.5 * (section != "results") + 0.75 * (section == "methods")
                scored.append((-score, -1 if index is None else index, i))
        assert sorted(got[n]) == [(p + 1, i, -s) for p, (s, _, i) in enumerate(sorted(scored)[:2])]


def test_jaccard_of_many_loosely_alike_sets(spark):
    """Eight million candidates with a common word, few links: candidates are made in no table."""
    rng = random.Random(9)
    sets = {f"k{i:05}": frozenset(["common", *(f"w{rng.randrange(2000)}" for _ in range(12))]) for i in range(4000)}
    df = spark.createDataFrame([(k, list(s)) for k, s in sets.items()], "k string, s array<string>")
    got = M.jaccard_pairs(df, "k", "s", 0.12, block=1500).collect()
    keys = list(sets)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (c := len(sets[a] & sets[b])) > 1 and c / (len(sets[a]) + len(sets[b]) - c) >= 0.12}
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want) and all(r["jaccard"] >= 0.12 for r in got)
    small = spark.createDataFrame([(i, rng.sample("abcdefghijkl", rng.randrange(0, 6))) for i in range(200)], "k int, s array<string>")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(M.jaccard_pairs(small, "k", "s", 0.4, block=30, dense=1)) == rows(M.jaccard_pairs(small, "k", "s", 0.4))


def test_jaccard_shuffles_a_set_as_often_for_many_blocks_as_for_one(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([(i, [f"w{rng.randrange(300)}" for _ in range(20)]) for i in range(2400)], "k int, s array<string>")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.3)
        spark.range(1).collect()  # the store is brought up to date as a task ends
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    written, found = [], []
    for block in (2400, 60):
        before = shuffled()
        found.append(sorted(map(tuple, M.jaccard_pairs(df, "k", "s", 0.15, block=block).collect())))
        written.append(shuffled() - before)
    assert found[0] == found[1] and len(found[0]) > 1000
    assert 0 < written[1] < 1.5 * written[0], written


def test_jaccard_of_repeated_rows_and_equal_sets_over_many_blocks(spark):
    rng = random.Random(12)
    rows = [(f"k{i:03}", str(i), rng.sample("abcdefghij", rng.randrange(0, 5))) for i in range(300)]
    rows += rows[:50] + [(k, t + "x", s) for k, t, s in rows[40:60]]  # the same rows once more, and other texts of the same set
    got = M.jaccard_pairs(spark.createDataFrame(rows, "k string, t string, s array<string>"), "k", "s", 0.12, block=30, apart="t").collect()
    once = {(k, t): frozenset(s) for k, t, s in rows if s}
    rep = {}
    for (k, _), s in once.items():
        rep[s] = min(k, rep.get(s, k))
    want = [(rep[s], k, 1.0) for (k, _), s in once.items() if k != rep[s]]
    want += [(rep[s], rep[t], len(s & t) / len(s | t)) for s in rep for t in rep if rep[s] < rep[t] and len(s & t) / len(s | t) >= 0.12]
    assert sorted(map(tuple, got)) == sorted(want)


def test_fuzzy_grounding_makes_no_row_for_a_pair(spark):
    rng = random.Random(10)
    text = lambda n: " ".join("".join(rng.choices("abcde", k=rng.randrange(2, 7))) for _ in range(n))
    texts = [text(25) for _ in range(60)]
    spans = [texts[i][5:40] for i in range(0, 60, 3)] + [texts[i][5:25] + "e" + texts[i][26:45] for i in range(60)] + ["...", "a"]
    units = spark.createDataFrame([("u", "p", spans), ("v", "none", ["ab"])], "unit_id string, paper_id string, evidence_spans array<string>")
    out = P.fuzzy_grounding(units, spark.createDataFrame([("p", t) for t in texts], "paper_id string, text string"))
    assert "Contains(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["span"]: r["ratio"] for r in out.collect()}
    assert got == {s: round(max(P.fuzzy_ratio(s, t) for t in texts), 6) for s in spans} | {"ab": None}
