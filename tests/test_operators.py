"""Golden values and small brute-force checks of the core's operators."""

import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosift.functions import text as X
from argosift.operators import graph as G
from argosift.operators import matching as H
from argosift.operators import ordering as O
from argosift.operators import procedural as P
from argosift.operators import retrieve as R
from argosift.operators import similarity as M
from argosift.operators import stats as S
from argosift.operators import temporal as D
from argosift.sources import files, markup
from argosift.streaming import ingest


def one(df):
    return df.first().asDict()


def test_sign_and_holm(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, 1.0, 1.0, 1.0, -1.0, 0.0)], "d double")
    assert one(S.sign_test(d, "d")) == {"up": 4, "down": 1, "p": 0.375}
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r["k"]: r["p_adjusted"] for r in S.holm(p, "p", "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_ranks_and_correlations(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "v double")
    assert sorted(r["rank"] for r in O.average_ranks(v, "v").collect()) == [1, 2.5, 2.5, 4]
    xy = spark.createDataFrame([("up", i, i, i) for i in range(5)] + [("down", i, i, -i) for i in range(5)] + [("flat", i, i, 1) for i in range(5)] + [("two", i, i, i) for i in range(2)], "g string, k int, x int, y int")
    assert {r["g"]: r["rho"] for r in S.spearman(xy, "x", "y", "g").collect()} == {"up": 1.0, "down": -1.0, "flat": None, "two": None}
    assert {r["g"]: r["tau"] for r in S.kendall_tau_a(xy, "k", "x", "y", "g").collect()} == {"up": 1.0, "down": -1.0, "flat": 0.0, "two": 1.0}
    assert one(S.spearman(xy.where("g = 'up'"), "x", "y"))["rho"] == 1.0


def test_numbers_by_range(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 500)
    got = O.numbered(spark.createDataFrame([(k,) for k in keys], "k int").repartition(7), ["k"])
    assert [r["k"] for r in got.orderBy("number").collect()] == sorted(keys)
    assert sorted(r["number"] for r in got.collect()) == list(range(500))


def test_agreement(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b")], "x string, y string")
    assert one(S.cohen_kappa(same, "x", "y"))["kappa"] == 1.0
    scores = spark.createDataFrame([(2.0, True), (3.0, True), (1.0, False), (2.0, False)], "s double, p boolean")
    assert one(S.auc(scores, "s", "p"))["auc"] == 0.875
    ratings = spark.createDataFrame([(u, i, float(u)) for u in range(4) for i in range(3)], "u int, i int, v double")
    assert one(S.icc1(ratings, "u", "i", "v"))["icc"] == 1.0


def test_bootstrap_binomial_pass(spark):
    d = spark.createDataFrame([(c, 1.0) for c in "abc"], "c string, v double")
    assert one(S.cluster_bootstrap(d, "c", "v", resamples=100)) == {"n_clusters": 3, "point": 1.0, "low": 1.0, "high": 1.0}
    b = spark.range(1).select(S.binomial_sum(F.lit(5), F.lit(0), F.lit(5), 1 / 3).alias("p"), S.pass_at_k(F.lit(4), F.lit(1), 2).alias("q"))
    assert one(b) == {"p": pytest.approx(1.0), "q": pytest.approx(0.5)}


def test_trend(spark):
    d = spark.createDataFrame([(f"p{i}", j, float(j)) for i in range(10) for j in range(4)], "c string, dose int, v double")
    got = one(S.permutation_trend(d, "c", "dose", "v", permutations=200))
    assert got["rho"] == 1.0 and got["p"] < 0.01


def test_text(spark):
    t = spark.createDataFrame([("see [3-6, 9] and [12–10] Straße",)], "t string")
    assert one(t.select(X.citation_numbers("t").alias("c")))["c"] == [3, 4, 5, 6, 9]
    assert one(t.select(X.tokens("t").alias("c")))["c"] == ["see", "and", "strasse"]
    n = spark.createDataFrame([(["a", "b", "c"],)], "w array<string>")
    assert one(n.select(X.ngrams(F.col("w"), 1, 2).alias("n")))["n"] == ["a", "b", "c", "a b", "b c"]
    w = spark.range(1).select(X.windows(F.sequence(F.lit(1), F.lit(10)), 4, 1).alias("w"))
    assert [(r["start"], len(r["items"])) for r in one(w)["w"]] == [(0, 4), (3, 4), (6, 4)]
    empty = spark.createDataFrame([(None,), ("",)], "t string")
    assert [r["s"] for r in empty.select(X.snippet("t").alias("s")).collect()] == [None, ""]


def test_greedy_pack_skips_and_prefix_stops(spark):
    d = spark.createDataFrame([("g", i, s) for i, s in enumerate([50, 80, 30, 10, 40])], "g string, k int, s int")
    got = R.greedy_pack(d, "g", ["k"], "k", "s", 100, 1000, 10, slack=0).orderBy("place").collect()
    assert [(r["k"], r["used"]) for r in got] == [(0, 50), (2, 80), (3, 90)]
    assert [r["k"] for r in R.prefix_pack(d, ["g"], [F.col("k")], "s", 135).orderBy("k").collect()] == [0, 1]


def test_bm25_forms_agree(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 20))), f"s{i % 3}", 0.5) for i in range(60)] + [(98, None, "s0", 1.0), (99, "", "s0", 1.0)], "d long, text string, s string, score double")
    items = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=5))) for i in range(9)] + [(50, None), (51, "")], "q long, text string")
    pairs = {(r["q"], r["d"]): round(r["score"], 6) for r in R.bm25(docs, items, "d", "q").collect()}
    for block in (2048, 2):
        best = R.bm25_best(docs, items, "d", "q", 4, 2, "s", block=block).collect() if block == 2048 else R.bm25_best(docs, items, "d", "q", 4, block=block).collect()
        for q in range(9):
            mine = sorted((r["place"], r["d"], r["score"]) for r in best if r["q"] == q)
            assert all(abs(pairs[q, d] - s) < 2e-6 for _, d, s in mine)
            if block == 2:
                want = sorted(((-s, d) for (i, d), s in pairs.items() if i == q))[:4]
                assert [d for _, d, _ in mine] == [d for _, d in want]


def test_similarity(spark):
    rng = random.Random(2)
    sets = {i: set(rng.sample("abcdefghij", rng.randrange(0, 8))) for i in range(80)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "k int, s array<string>")
    star = [(r["a"], r["b"], r["jaccard"]) for r in M.jaccard_pairs(df, "k", "s", 0.6).collect()]
    rep = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    want = {(a, b) for a in set(rep.values()) for b in set(rep.values()) if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(a, b) for a, b, j in star if j < 1} == want
    assert {(a, b) for a, b, j in star if j == 1} == {(rep[i], i) for i in sets if rep[i] != i and sets[i]}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (4, 1), (1, 2)], "src int, dst int")
    ranks = {r["id"]: r["rank"] for r in G.pagerank(e, rounds=8).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and max(ranks, key=ranks.get) in (1, 3)
    levels = {r["id"]: (r["level"], r["parent"]) for r in G.bfs_levels(e, spark.createDataFrame([(4,)], "id int"), 5).collect()}
    assert levels == {4: (0, None), 1: (1, 4), 2: (2, 1), 3: (2, 1)}
    assert G.pagerank(e.limit(0), rounds=2).count() == 0


def test_procedures():
    assert P.split_sentences("See Fig. 3 here. It was et al. Here. Done.") == ["See Fig. 3 here.", "It was et al. Here.", "Done."]
    chunks = P.paragraph_chunks("One two three. " * 300 + "\n\n" + "Two.")
    assert len(chunks) > 2 and all(len(c) <= 1800 for c in chunks)
    assert P.line_chunks("a\nb\nc\nd", 2, 0.0) == [(0, 2), (2, 4)]
    assert P.verify_quote("The Quick  fox", "the quick fox ran") == "exact" and P.verify_quote("quick brown fox jumps high", "fox high brown quick jumps") == "loose" and P.verify_quote("", "x") == "none"
    assert P.ready_order({"a": [], "b": ["a", "ghost"], "c": ["b"], "x": ["y"], "y": ["x"]}) == ([["a"], ["b"], ["c"]], ["x", "y"])
    assert P.beam_search([1], lambda x: [x + 1, x - 1], lambda x: -abs(x - 3), 2, 5) == 3
    assert P.critique_loop(0, lambda x: (x, x >= 2), lambda x: x + 1, 5) == (2, 2, "fine")
    assert P.critique_loop(0, lambda x: (0, False), lambda x: x + 1, 5) == (0, 1, "no improvement")
    assert P.lenient_json('so: {"a": [1]} ok') == {"a": [1]} and P.lenient_json("none") is None
    assert P.fuzzy_ratio("grain growth slowed", "the grain  growth slowed down") > 0.8 and P.fuzzy_ratio("", "x") == 0


def test_model_boundary(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad")], "k int, p string")

    def client():
        return lambda p: "no json" if p == "bad" else json.dumps({"p": p})

    got = {r["k"]: (r["answer"], r["error"]) for r in P.ask_model(df, "k", "p", client).collect()}
    assert got == {1: ('{"p": "a"}', None), 2: (None, "no prompt"), 3: (None, "no object")}


def test_files(spark, tmp_path):
    (tmp_path / "p1__broad__m.json").write_text('{"a": 1,\n "b": "x"}')
    r = one(files.read_json_documents(spark, str(tmp_path / "*.json"), "a int, b string"))
    assert (r["a"], r["key"], r["key_parts"]) == (1, "p1__broad__m", ["p1", "broad", "m"])
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": oops}\n{"a": 3}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    rows, bad = files.read_jsonl(spark, str(tmp_path / "l.jsonl"), schema)
    assert sorted(x["a"] for x in rows.collect()) == [1, 3] and bad.count() == 1
    with pytest.raises(Exception, match="bad line"):
        files.read_jsonl_strict(spark, str(tmp_path / "l.jsonl"), schema).collect()


def test_mentions(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,entity,source,ner,doi,preferred,year\n1,Hf,x,MAT,10.1/A,hafnium,2019\n2,Nb,x,MAT,10.1/A,,2019.0\n3,Ta,x,MAT,10.1/B,,\n4,W,x\n5,,x,MAT,10.1/C,,2000\n")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "m.csv", "m.csv")
    raw = files.read_tar_csv(spark, str(tmp_path / "a.tar.gz"), ["doi", "entity", "preferred", "ner", "year"])
    rows, rejects = files.load_mentions(raw)
    assert sorted((r["doi"], r["entity"], r["year"]) for r in rows.collect()) == [("10.1/a", "hafnium", 2019), ("10.1/a", "nb", 2019)]
    assert {r["reason"]: r["n"] for r in rejects.collect()} == {"no year": 1, "short row": 1, "no entity": 1}
    files.write_mentions(rows, str(tmp_path / "kg"))
    assert spark.read.parquet(str(tmp_path / "kg")).where("decade = 2010").count() == 2


def test_write_once_and_stream(spark, tmp_path):
    sink, source = str(tmp_path / "sink"), str(tmp_path / "in")
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    files.write_once(a, sink, ["k"])
    again = files.write_once(spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string"), sink, ["k"])
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "a"), (3, "b")]
    spark.createDataFrame([(3, "c"), (4, "c")], "k int, v string").write.parquet(source)
    for _ in range(2):
        ingest.ingest_once(spark, source, a.schema, sink, str(tmp_path / "cp"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [(1, "a"), (2, "a"), (3, "b"), (4, "c")]


def test_windows(spark):
    e = spark.createDataFrame([("2026-01-01 00:00:10", "u"), ("2026-01-01 00:00:50", "u"), ("2026-01-01 00:02:10", "u")], "t string, u string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in ingest.windowed_counts(e, "t", "1 minute", "5 minutes", "u").collect()) == [1, 2]
    assert sorted(r["n"] for r in ingest.session_counts(e, "t", "60 seconds", "5 minutes", "u").collect()) == [1, 2]


def test_markup(spark):
    html = "<html><nav><p>Navigation that is long enough to be a paragraph here</p></nav><h2>Title</h2><p>short</p><p>A paragraph of more than forty characters, with <b>bold</b> words.</p><script>x</script></html>"
    got = markup.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "k int, h string"), "k", "h").collect()
    assert [(r["tag"], r["text"][:5]) for r in sorted(got, key=lambda r: r["pos"])] == [("h2", "Title"), ("p", "A par")]
    xml = """<article><front><article-title>T</article-title><abstract><p>Abs.</p></abstract></front><body><sec><title>H</title><p>We cite <xref ref-type="bibr" rid="r1">1</xref>–<xref ref-type="bibr" rid="r3">3</xref>. Next one.</p>
    <table-wrap><table><tr><td>a</td><td>b</td></tr></table></table-wrap></sec></body><back><ref-list><ref id="r1">A</ref><ref id="r2">B</ref><ref id="r3">C</ref></ref-list></back></article>"""
    kinds = [r["kind"] for r in markup.jats_table(spark.createDataFrame([("p", xml)], "k string, x string"), "k", "x").orderBy("pos").collect()]
    assert kinds == ["title", "abstract", "heading", "paragraph", "row", "reference", "reference", "reference"]
    assert [(n, r) for n, r, _, _ in markup.jats_citations(xml)] == [(1, "r1"), (1, "r2"), (1, "r3")]
    assert markup.jats_table(spark.createDataFrame([("p", "<bad")], "k string, x string"), "k", "x").first()["kind"] == "error"


def test_fuzzy_grounding_takes_all_records_of_a_paper(spark):
    text = "the grain  growth slowed down"
    records = spark.createDataFrame([("p", text, 1), ("p", "no likeness", 2), ("q", "elsewhere", 1)], "paper_id string, text string, ingested_at int")
    spans = ["grain  growth", "grain growth slowed", "absent", ""]
    units = spark.createDataFrame([("u", "p", spans, 9), ("w", "none", ["absent"], 9)], "unit_id string, paper_id string, evidence_spans array<string>, ingested_at int")
    got = {(r["unit_id"], r["span"]): r["ratio"] for r in P.fuzzy_grounding(units, records).collect()}
    assert got == {("u", "grain  growth"): 1.0, ("u", "grain growth slowed"): round(P.fuzzy_ratio("grain growth slowed", text), 6), ("u", "absent"): 0.0, ("u", ""): 0.0, ("w", "absent"): None}
    assert got["u", "grain growth slowed"] > 0.8


def test_fuzzy_ratio_tries_every_place():
    span = "the alloy hardened fast"
    assert P.fuzzy_ratio(span, "hardened zz " * 300 + "the alloy hardened  fast") > 0.9
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choices("ab c", k=60))
        span = "".join(rng.choices("ab c", k=12))
        full = P.fuzzy_ratio(span, text)
        assert P.fuzzy_ratio(span, text, least=full / 2) == full and P.fuzzy_ratio(span, text, least=full) <= full


def test_best_match_each_is_best_match_of_all(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.sample("abcdefghij", rng.randrange(0, 5))) for i in range(120)], "k int, s array<string>")
    rows = lambda d: sorted(map(tuple, d.select("a", "b", "jaccard").collect()))
    want = rows(H.best_match(df, df, "k", "s"))
    assert rows(H.best_match_each(df, "k", "s")) == want and any(j < 1 for *_, j in want)


def test_eligible_counts_with_every_work_a_case(spark):
    rng = random.Random(7)
    works = [(i, f"2020-01-{rng.randrange(1, 29):02d}" if i % 9 else None, rng.choice(["a", "b", "", None])) for i in range(45)]
    df = spark.createDataFrame(works, "id int, date string, family string").withColumn("date", F.to_date("date"))
    want = {}
    for i, d, f in works:
        old = [e for j, e, g in works if d and e and e < d and j != i and not (f and g == f)]
        if old:
            want[i] = (len(old), max(old))
    assert {r["case_id"]: (r["n_eligible"], str(r["newest"])) for r in D.eligible_counts(df, df).collect()} == want


def test_html_blocks_of_unruly_pages():
    page = """<!DOCTYPE html><!-- <p>a comment that is longer than forty characters for sure</p> --><body class=main>
    <h3>A &amp; B<p>An open paragraph that is ended by the heading which follows it<h4>Next
    </h4><ul><li>An item of more than sixty characters, which holds a <sup>1</sup>note and <br>a line break, too.<li>short</ul>
    <div class="x navbox-y"><p>hidden paragraph in a navigation box, longer than forty characters</div>
    <table><tr><td><p>a cell that is longer than forty characters but in a table</p></td></tr></table><p>After the table <a href="x>y">comes</a> a paragraph of text.</p>
    <script>if (a < b) document.write("<p>script text that is longer than forty characters</p>")</script><footer><p>x"""
    got = markup.html_block_list(page)
    assert [t for t, _ in got] == ["h3", "p", "h4", "li", "p"]
    assert got[0][1] == "A & B" and got[3][1].endswith("holds a note and a line break, too.") and got[4][1] == "After the table comes a paragraph of text."
    assert markup.html_block_list("") == markup.html_block_list(None) == []


def test_jats_citations_with_long_ranges_and_the_sentence_before():
    refs = "".join(f'<ref id="r{i}">x</ref>' for i in range(300))
    xml = f'<article><p>First one. We cite <xref ref-type="bibr" rid="r0">1</xref>-<xref ref-type="bibr" rid="r250">251</xref>.</p><ref-list>{refs}</ref-list></article>'
    got = markup.jats_citations(xml)
    assert [r for _, r, _, _ in got] == [f"r{i}" for i in range(251)] and {b for _, _, _, b in got} == {"First one."}


def test_jats_dates(spark):
    pub = lambda kind, y, m, d: f'<pub-date{f" pub-type={chr(34)}{kind}{chr(34)}" if kind else ""}>' + "".join(f"<{t}>{v}</{t}>" for t, v in (("year", y), ("month", m), ("day", d)) if v) + "</pub-date>"
    wrap = lambda x: f"<article><front><article-meta>{x}</article-meta></front></article>"
    full = wrap(pub("epub", 2020, 3, 4) + pub("ppub", 2020, 5, None) + pub("collection", 2021, 1, 1) + '<pub-history><event event-type="pmc-release"><date><year>2022</year><month>2</month><day>3</day></date></event></pub-history>')
    rows = [(1, full), (2, wrap(pub("epub", 2020, 3, 4) + pub("epub", 2020, 3, 5))), (3, wrap(pub("", 2019, 12, 31))), (4, "<bad"), (5, None), (6, wrap(pub("epub", 2020, 2, 31)))]
    got = {r["k"]: r for r in markup.jats_date_table(spark.createDataFrame(rows, "k int, x string"), "k", "x").collect()}
    assert (got[1]["online"], got[1]["print"], got[1]["collection"], got[1]["release"], got[1]["error"]) == ("2020-03-04", None, "2021-01-01", "2022-02-03", None)
    assert "conflicting" in got[2]["error"] and got[2]["online"] is None and got[3]["online"] == "2019-12-31"
    assert all(got[k]["error"] for k in (4, 5, 6))


def test_sentences():
    assert P.split_sentences("See Fig. 3 of J. Doe et al. Here. It ended! (Why?) \"So.\" 12 more.") == ["See Fig. 3 of J. Doe et al. Here.", "It ended!", "(Why?)", '"So."', "12 more."]
    assert P.split_sentences("  ") == P.split_sentences(None) == []


def test_swiss(spark):
    from pyspark.sql import functions as F

    players = spark.createDataFrame([(f"p{i:02}", i) for i in range(21)], "player string, seed int")
    beats = lambda pairs: pairs.withColumn("got", (F.col("a") < F.col("b")).cast("double"))
    met = []

    def play(pairs):
        met.append([tuple(sorted(r)) for r in pairs.collect()])
        return beats(pairs)

    table = P.swiss(players, play, 5).orderBy(F.desc("points"), "player").collect()
    every = [p for r in met for p in r]
    assert len(every) == len(set(every)) and all(len({x for p in r for x in p}) == 2 * len(r) for r in met)
    assert all(len(r) >= 9 for r in met) and table[0]["player"] == "p00" and table[0]["points"] >= 4.0  # the last two of a round may have met
    assert P.swiss(players.limit(1), beats, 2).collect()[0]["points"] == 0.0 and P.swiss(players.limit(0), beats, 2).count() == 0


def test_keep_first_is_the_greedy_walk(spark):
    rng = random.Random(11)
    rows = [(i, [f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 9))]) for i in range(120)]
    kept, want = [], {}
    for k, s in rows:
        s = set(s)
        want[k] = not any(s and t and len(s & t) / len(s | t) >= 0.5 for t in kept)
        if not s:
            want[k] = True
        elif want[k]:
            kept.append(s)
    empty = [k for k, s in rows if not s]
    got = {r["k"]: r["kept"] for r in M.keep_first(spark.createDataFrame(rows, "k int, s array<string>"), "k", "s", 0.5).collect()}
    assert got == want and len(empty) > 1 and not all(want.values())
    assert M.keep_first(spark.createDataFrame([], "k int, s array<string>"), "k", "s", 0.5).count() == 0
