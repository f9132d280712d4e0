import difflib
import random
from collections import Counter

from pyspark.sql import functions as F

from argosift.operators import evidence as V
from argosift.operators import matching as H


def test_excerpts(spark):
    text = "Start here. " + "Filler words stand about. " * 60 + "The span itself. " + "Grain growth was fast. " * 3 + "End."
    got = V.excerpt(text, Counter(["grain", "growth"]), ["The span itself.", "not there"], most=400, around=50)
    assert len(got) <= 400 and "The span itself." in got and got.index("The span itself.") < 70 and "Grain growth was fast." in got
    assert V.excerpt("", Counter(), []) == "" and len(V.excerpt("x" * 10_000, Counter(), [])) == 2400
    rows = spark.createDataFrame([(1, text, ["grain"], ["The span itself."]), (2, None, None, None), (3, "Short.", None, None)], "k int, text string, q_tokens array<string>, spans array<string>")
    assert {r["k"]: r["excerpt"] and r["excerpt"][:6] for r in V.excerpts(rows, "k").collect()}.keys() == {1, 2, 3}


def test_best_passages_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(2, 5)))
    passages = [(f"r{i:02}", rng.choice("pq"), " ".join(word() for _ in range(12))) for i in range(40)] + [("r99", "p", None), ("r98", "p", "")]
    claims = []
    for i in range(40):
        p = rng.choice(passages[:40])
        words = p[2].split()[2:8]
        if i % 2:
            words[rng.randrange(6)] = word()
        claims.append((f"c{i}", p[1], " ".join(words).upper()))
    claims += [("n", "p", None), ("e", "p", " "), ("o", "other", "abc"), claims[0]]
    want = {}
    for c, paper, text in claims:
        text = " ".join((text or "").lower().split())
        mine = sorted((k, " ".join(t.split())) for k, q, t in passages if q == paper and t is not None)
        if not text or not mine:
            continue
        exact = [k for k, t in mine if text in t]
        if exact:
            want[c] = (exact[0], 1.0)
            continue
        scores = [(-round(max(len(set(text.split()) & set(t.split())) / len(set(text.split())), difflib.SequenceMatcher(None, text, t, autojunk=False).quick_ratio()), 9), k) for k, t in mine]
        if -min(scores)[0] >= 0.55:
            want[c] = (min(scores)[1], round(-min(scores)[0], 6))
    got = V.best_passages(spark.createDataFrame(claims, "claim_id string, paper_id string, text string"), spark.createDataFrame(passages, "passage_id string, paper_id string, text string"))
    assert {r["claim_id"]: (r["passage_id"], r["score"]) for r in got.collect()} == want and len(want) > 30


def test_expansion_takes_nothing_twice(spark):
    rng = random.Random(6)
    refs = sorted({(s, rng.randrange(30)) for s in range(8) for _ in range(12)})
    info = {r: (rng.randrange(3), rng.randrange(9)) for r in range(30)}
    cited = Counter(r for _, r in refs)
    taken, want = set(), []
    for s in range(8):
        mine = sorted((r for t, r in refs if t == s), key=lambda r: (-cited[r], -info[r][0], -info[r][1], r))
        fresh = [r for r in mine if r not in taken][:3]
        taken |= set(fresh)
        want += [(s, r, i + 1) for i, r in enumerate(fresh)]
    seeds = spark.createDataFrame([(s, s) for s in range(8)], "seed int, pos int")
    rows = spark.createDataFrame([(s, r, float(info[r][0]), info[r][1]) for s, r in refs], "seed int, ref int, relevance double, citations int")
    assert sorted(tuple(r) for r in V.expansion(seeds, rows, 3).collect()) == sorted(want)


def test_boosts_and_cutoff(spark):
    q = spark.createDataFrame([(1, "p", "2020-01-01", ["grain", "growth", "rate", "low"])], "item_id int, paper_id string, cutoff string, q_tokens array<string>")
    data = [("same", "p", "2019-01-01", False, ["grain"]), ("claim", "q", "2019-01-01", True, ["grain", "growth"]), ("late", "p", "2021-01-01", True, ["grain"]), ("none", "p", "2019-01-01", True, ["other"]), ("all", "q", "2018-01-01", False, ["grain", "growth", "rate", "low", "low"])]
    r = spark.createDataFrame(data, "record_id string, paper_id string, date string, current boolean, t_tokens array<string>")
    got = [(x["record_id"], x["score"]) for x in V.boosted_candidates(q, r, 4).orderBy("place").collect()]
    assert got == [("same", 1.75), ("all", 1.0), ("claim", 0.9)]


def test_gap_and_back_matter(spark):
    df = spark.createDataFrame([("One is known. Two is not. We measured it. More.",), ("We begin.",), (None,)], "t string")
    assert [r[0] for r in df.select(V.gap_before_own_work(F.col("t"), r"\bwe\b")).collect()] == ["One is known. Two is not.", None, None]
    text = "References\nline of text\nmore of it\nReferences\n[1] x"
    one = spark.createDataFrame([(text,), ("no heading",), ("",), (None,)], "t string")
    assert [r[0] for r in one.select(V.strip_back_matter(F.col("t"), "^references$")).collect()] == ["References\nline of text\nmore of it", "no heading", "", None]


def test_typed_graph(spark):
    rows = [("r1", "X", "p::a", ["p::b", "q::c"], 0.5), ("r2", " x", "p::a", ["p::b"], 0.9), ("r3", "y", None, ["p::b"], 0.1), ("r4", "y", "p::a", [], 0.1), ("r5", "y", "p::a", ["p::a"], None), (None, "y", "p::a", ["p::b"], 0.1)]
    nodes, edges, dropped = V.typed_graph(spark.createDataFrame(rows, "relation_id string, relation_type string, source_entity_id string, target_entity_ids array<string>, confidence double"))
    assert {(r["source"], r["target"], r["type"]): (r["relations"], r["confidence"]) for r in edges.collect()} == {("p::a", "p::b", "x"): (2, 0.9), ("p::a", "q::c", "x"): (1, 0.5)}
    assert {r["id"]: r["degree"] for r in nodes.collect()} == {"p::a": 2, "p::b": 1, "q::c": 1}
    assert {r["reason"]: r["n"] for r in dropped.collect()} == {"no id": 1, "no source": 1, "no target": 1, "to itself": 1}


def test_titles_exclude_and_resolve(spark):
    words = lambda t: t.split() if t is not None else None
    held = [("h1", "d1", "a b c d e", "Ann"), ("h2", None, "x y z", None), ("h3", "d3", "", "Bob")]
    cand = [("c1", "d1", "q", "Zed"), ("c2", None, "a b c d e", None), ("c3", "d9", "a b c f", "Ann"), ("c4", "d9", "a b c f", "Bob"), ("c5", None, "x y z", None), ("c6", None, "", "Bob"), ("c7", None, None, None)]
    schema = "key string, doi string, s array<string>, author string"
    frame = lambda rows: spark.createDataFrame([(k, d, words(t), a) for k, d, t, a in rows], schema)
    got = {r["key"]: r["reason"] for r in H.identity_reasons(frame(cand), frame(held), ["doi"]).collect()}
    assert got == {"c1": "identifier", "c2": "title", "c3": "title and author", "c4": None, "c5": "title", "c6": None, "c7": None}
    refs = frame(cand).select(F.col("key").alias("ref"), "doi", "s")
    targets = frame(held).select(F.col("key").alias("target"), "doi", "s")
    found = {r["ref"]: (r["target"], r["method"]) for r in H.resolve_by_title(refs, targets, ["doi"]).collect()}
    assert found == {"c1": ("h1", "doi"), "c2": ("h1", "title"), "c3": (None, None), "c4": (None, None), "c5": ("h2", "title"), "c6": (None, None), "c7": (None, None)}
    assert H.identity_reasons(frame([]), frame(held), ["doi"]).count() == 0
