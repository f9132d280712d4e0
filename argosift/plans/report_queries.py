"""Queries of evaluation reports: means by paper, leaderboards, pair resolution, traces."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from argosift.plans.base import query
from argosift.runtime import table



def _li(spark, sf):
    return table(spark, sf, "lineitem")


@query("WITH o AS (SELECT l_suppkey, l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS n_levels, round(avg(m),6) AS score FROM o GROUP BY 1")
def macro_mean(spark, sf):
    """Mean over samples within (paper, level), then over levels."""
    o = _li(spark, sf).groupBy("l_suppkey", "l_orderkey").agg(F.avg("l_quantity").alias("m"))
    return o.groupBy("l_suppkey").agg(F.count("*").alias("n_levels"), F.round(F.avg("m"), 6).alias("score"))


@query("""SELECT l_returnflag, count(*) AS runs, count(*) FILTER (l_linestatus='F') AS failed, round(avg(l_quantity),6) AS quality, round(avg(CASE WHEN l_linestatus='O' THEN l_extendedprice END),4) AS price_ok,
 round(avg(CASE WHEN l_discount>0.05 THEN 1.0 ELSE 0 END),6) AS share, count(DISTINCT l_suppkey) AS papers FROM lineitem GROUP BY 1""")
def leaderboard(spark, sf):
    return _li(spark, sf).groupBy("l_returnflag").agg(
        F.count("*").alias("runs"), F.count_if(F.col("l_linestatus") == "F").alias("failed"), F.round(F.avg("l_quantity"), 6).alias("quality"),
        F.round(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))), 4).alias("price_ok"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("share"), F.count_distinct("l_suppkey").alias("papers"),
    )


@query("""SELECT l_returnflag AS arm, year(l_shipdate) AS level, CAST(grouping(l_returnflag)*2+grouping(year(l_shipdate)) AS BIGINT) AS grp, count(*) AS n, round(avg(l_quantity),6) AS mean FROM lineitem GROUP BY GROUPING SETS ((),(l_returnflag),(year(l_shipdate)),(l_returnflag,year(l_shipdate)))""")
def grouping_report(spark, sf):
    li = _li(spark, sf).select(F.col("l_returnflag").alias("arm"), F.year("l_shipdate").alias("level"), "l_quantity")
    return li.cube("arm", "level").agg(F.grouping_id().alias("grp"), F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("""SELECT l_returnflag AS arm, l_linestatus AS state, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def progress_rollup(spark, sf):
    """Runs by configuration with totals."""
    return _li(spark, sf).rollup(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("state")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT l_orderkey, max(l_quantity) AS best, avg(l_quantity) AS mean FROM lineitem GROUP BY 1), f AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(avg(best),6) AS best_of_k, round(avg(mean),6) AS mean, round((SELECT max(m) FROM f),6) AS best_single FROM u""")
def best_of_k(spark, sf):
    u = _li(spark, sf).groupBy("l_orderkey").agg(F.max("l_quantity").alias("best"), F.avg("l_quantity").alias("mean"))
    single = _li(spark, sf).groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m")).agg(F.round(F.max("m"), 6).alias("best_single"))
    return u.agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("best_of_k"), F.round(F.avg("mean"), 6).alias("mean")).crossJoin(F.broadcast(single))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS i FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE i=1""")
def argmax_within(spark, sf):
    best = _li(spark, sf).groupBy("l_suppkey").agg(F.max_by(F.struct("l_orderkey", "l_linenumber"), F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("a"), (-F.col("l_linenumber")).alias("b"))).alias("m"))
    return best.select("l_suppkey", "m.l_orderkey", "m.l_linenumber")


@query("""WITH x AS (SELECT l_suppkey AS k, avg(l_quantity) AS a FROM lineitem WHERE year(l_shipdate)=1997 GROUP BY 1), y AS (SELECT l_suppkey AS k, avg(l_quantity) AS b FROM lineitem WHERE year(l_shipdate)=1998 GROUP BY 1)
SELECT k AS l_suppkey, round(a,6) AS a, round(b,6) AS b, round(b-a,6) AS diff FROM x JOIN y USING (k)""")
def paired_scores(spark, sf):
    side = lambda y, c: _li(spark, sf).where(F.year("l_shipdate") == y).groupBy("l_suppkey").agg(F.avg("l_quantity").alias(c))
    return side(1997, "a").join(side(1998, "b"), "l_suppkey").select("l_suppkey", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("b") - F.col("a"), 6).alias("diff"))


@query("""SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag='A'),6) AS a, round(avg(l_quantity) FILTER (l_returnflag='N'),6) AS n, round(avg(l_quantity) FILTER (l_returnflag='R'),6) AS r FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag)=3""")
def complete_blocks(spark, sf):
    """Papers present in every cell, one column a cell."""
    p = _li(spark, sf).groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_quantity"), 6))
    return p.dropna().withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("SELECT event_type, count(*) AS n, round(count(*)/sum(count(*)) OVER (),6) AS share FROM events GROUP BY 1")
def histogram(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type='click') AS clicks, count(DISTINCT event_type) AS kinds, count(*)-count(DISTINCT event_type||'|'||props) AS repeated, min(CASE WHEN event_type='purchase' THEN step END) AS first_hit
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) GROUP BY 1""")
def trace_summary(spark, sf):
    """Per trace: steps, kinds, repeated calls and the first step that hits."""
    e = table(spark, sf, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_distinct("event_type").alias("kinds"),
        (F.count("*") - F.count_distinct(F.concat_ws("|", "event_type", "props"))).alias("repeated"), F.min(F.when(F.col("event_type") == "purchase", F.col("step"))).alias("first_hit"),
    )


@query("SELECT event_type, count(*) AS n, round(avg(json_extract_string(props,'$.k')::DOUBLE),6) AS mean_k, max(json_extract_string(props,'$.k')::BIGINT) AS max_k FROM events GROUP BY 1")
def json_props(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(k.cast("double")), 6).alias("mean_k"), F.max(k.cast("bigint")).alias("max_k"))


@query("""WITH d AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, count(d) AS n, round(avg(abs(d)),5) AS churn FROM d GROUP BY 1""")
def previous_difference(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf, "events").select("user_id", (F.col("value") - F.lag("value").over(w)).alias("d"))
    return d.groupBy("user_id").agg(F.count("d").alias("n"), F.round(F.avg(F.abs("d")), 5).alias("churn"))


_PAIRS = r"""v AS (SELECT lower(trim(new_method)) AS a, lower(trim(base_method)) AS b, unit, lower(trim(judge)) AS j, lower(trim(pair_order)) AS o, upper(trim(winner)) AS w FROM pairwise_votes),
s AS (SELECT DISTINCT a,b,unit,j, o='new_first' AS f, CASE w WHEN 'TIE' THEN 'tie' WHEN 'A' THEN CASE WHEN o='new_first' THEN 'new' ELSE 'base' END WHEN 'B' THEN CASE WHEN o='new_first' THEN 'base' ELSE 'new' END END AS r
 FROM v WHERE w IN ('A','B','TIE') AND o IN ('new_first','baseline_first','base_first') AND a IS NOT NULL AND b IS NOT NULL AND j IS NOT NULL)"""


def _resolved(spark, sf):
    low = lambda c: F.lower(F.trim(F.col(c)))
    v = table(spark, sf, "pairwise_votes").select(low("new_method").alias("a"), low("base_method").alias("b"), "unit", low("judge").alias("j"), low("pair_order").alias("o"), F.upper(F.trim("winner")).alias("w"))
    v = v.where("w in ('A','B','TIE') and o in ('new_first','baseline_first','base_first') and a is not null and b is not null and j is not null")
    first = F.col("o") == "new_first"
    r = F.when(F.col("w") == "TIE", "tie").when((F.col("w") == "A") == first, "new").otherwise("base")
    return v.select("a", "b", "unit", "j", first.alias("f"), r.alias("r")).distinct()


@query(f"""WITH {_PAIRS}, p AS (SELECT a,b,unit,j, count(DISTINCT f) AS n, min(r) AS lo, max(r) AS hi FROM s GROUP BY ALL HAVING count(DISTINCT f)=2)
SELECT a AS new_method, b AS base_method, count(*) AS pairs, count(*) FILTER (lo=hi AND lo='new') AS won, count(*) FILTER (lo=hi AND lo='base') AS lost, count(*) FILTER (lo<>hi OR lo='tie') AS tied FROM p GROUP BY ALL""")
def pair_resolution(spark, sf):
    """A pair is won only if both orders say so; pairs seen in one order are left out."""
    p = _resolved(spark, sf).groupBy("a", "b", "unit", "j").agg(F.count_distinct("f").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).where("n = 2")
    same = F.col("lo") == F.col("hi")
    return p.groupBy(F.col("a").alias("new_method"), F.col("b").alias("base_method")).agg(
        F.count("*").alias("pairs"), F.count_if(same & (F.col("lo") == "new")).alias("won"), F.count_if(same & (F.col("lo") == "base")).alias("lost"), F.count_if(~same | (F.col("lo") == "tie")).alias("tied")
    )


@query(f"""WITH {_PAIRS} SELECT j AS judge, count(*) AS n, round(avg(CASE WHEN r='tie' THEN 0.5 WHEN (r='new')=f THEN 1 ELSE 0 END),6) AS first_share FROM s GROUP BY 1""")
def position_bias(spark, sf):
    """Share of points that go to the candidate shown first, by judge."""
    points = F.when(F.col("r") == "tie", 0.5).when((F.col("r") == "new") == F.col("f"), 1.0).otherwise(0.0)
    return _resolved(spark, sf).groupBy(F.col("j").alias("judge")).agg(F.count("*").alias("n"), F.round(F.avg(points), 6).alias("first_share"))


_L = r"""l AS (SELECT run_id, lower(trim(labeller)) AS who, lower(replace(replace(trim(intervention_class),' ','_'),'-','_')) AS c, lever_match AS m, labelled_at FROM lever_labels WHERE run_id IS NOT NULL)"""


def _labels(spark, sf):
    return table(spark, sf, "lever_labels").where("run_id is not null").select(
        "run_id", F.lower(F.trim("labeller")).alias("who"), F.lower(F.translate(F.trim("intervention_class"), " -", "__")).alias("c"), F.col("lever_match").alias("m"), "labelled_at"
    )


@query(f"""WITH {_L}, n AS (SELECT run_id, c, count(DISTINCT who) AS n, min(labelled_at) AS f FROM l WHERE c IS NOT NULL AND c<>'' GROUP BY ALL)
SELECT run_id, c AS majority, n FROM n QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, f, c)=1""")
def majority_label(spark, sf):
    """Most frequent label a run; ties go to the one given first."""
    n = _labels(spark, sf).where("c is not null and c <> ''").groupBy("run_id", "c").agg(F.count_distinct("who").alias("n"), F.min("labelled_at").alias("f"))
    best = n.groupBy("run_id").agg(F.min_by(F.struct("c", "n"), F.struct((-F.col("n")).alias("x"), "f", "c")).alias("b"))
    return best.select("run_id", F.col("b.c").alias("majority"), "b.n")


@query(f"""WITH {_L}, n AS (SELECT split_part(run_id,'__',2) AS level, c, count(*) AS n FROM l WHERE c IS NOT NULL GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY level ORDER BY n DESC) AS k, sum(n) OVER (PARTITION BY level) AS t FROM n)
SELECT level, round(avg(n::DOUBLE/t),6) AS base_rate, count(*) AS n_modes, min(c) AS first_mode FROM r WHERE k=1 GROUP BY level""")
def modal_class(spark, sf):
    """The modal class of each level; tied modes share the hit."""
    n = _labels(spark, sf).where("c is not null").groupBy(F.element_at(F.split("run_id", "__"), 2).alias("level"), "c").agg(F.count("*").alias("n"))
    w = Window.partitionBy("level")
    r = n.select("level", "c", (F.col("n") / F.sum("n").over(w)).alias("s"), F.rank().over(w.orderBy(F.desc("n"))).alias("k")).where("k = 1")
    return r.groupBy("level").agg(F.round(F.avg("s"), 6).alias("base_rate"), F.count("*").alias("n_modes"), F.min("c").alias("first_mode"))


@query(f"""WITH {_L}, t AS (SELECT coalesce(c,'∅') AS c, coalesce(m::VARCHAR,'∅') AS m FROM l) SELECT c AS class, m AS match, count(*) AS n, round(count(*)::DOUBLE/sum(count(*)) OVER (PARTITION BY c),6) AS share FROM t GROUP BY c,m""")
def cross_tab(spark, sf):
    t = _labels(spark, sf).groupBy(F.coalesce("c", F.lit("∅")).alias("class"), F.coalesce(F.col("m").cast("string"), F.lit("∅")).alias("match")).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("class")), 6))


@query(f"""WITH {_L}, u AS (SELECT run_id, who, max(m) AS m FROM l WHERE m BETWEEN 0 AND 3 AND who<>'' GROUP BY ALL), g AS (SELECT run_id, count(*) AS n, count(*) FILTER (m>=2) AS good, count(DISTINCT m) AS k FROM u GROUP BY 1)
SELECT n AS n_labellers, count(*) AS runs, count(*) FILTER (good>=2) AS passed, count(*) FILTER (k=1) AS unanimous FROM g GROUP BY 1""")
def consistency(spark, sf):
    u = _labels(spark, sf).where("m between 0 and 3 and who <> ''").groupBy("run_id", "who").agg(F.max("m").alias("m"))
    g = u.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("m") >= 2).alias("good"), F.count_distinct("m").alias("k"))
    return g.groupBy(F.col("n").alias("n_labellers")).agg(F.count("*").alias("runs"), F.count_if(F.col("good") >= 2).alias("passed"), F.count_if(F.col("k") == 1).alias("unanimous"))


@query("""WITH t AS (SELECT n_nationkey, n_name FROM nation) SELECT n_name, count(c_custkey) AS n FROM t LEFT JOIN customer ON c_nationkey=n_nationkey AND c_acctbal<-900 GROUP BY n_name""")
def counts_with_zero(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal < -900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "nation").join(c, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT substr(sha256(lower(p_brand)||'|'||lower(p_type)||'|'||p_size),1,12) AS cluster, count(*) AS n, arg_min(p_name, {'a': length(p_name), 'b': p_name, 'c': p_partkey}) AS canonical, count(DISTINCT p_name)>1 AS several FROM part GROUP BY lower(p_brand), lower(p_type), p_size""")
def key_clusters(spark, sf):
    """Clusters by a canonical key, with the shortest name as the canonical one."""
    key = F.concat_ws("|", F.lower("p_brand"), F.lower("p_type"), F.col("p_size").cast("string"))
    g = table(spark, sf, "part").groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min_by("p_name", F.struct(F.length("p_name"), "p_name", "p_partkey")).alias("canonical"), (F.count_distinct("p_name") > 1).alias("several"))
    return g.select(F.substring(F.sha2("k", 256), 1, 12).alias("cluster"), "n", "canonical", "several")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE year(l_shipdate)=1997 AND l_quantity>45), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE year(l_shipdate)=1998 AND l_quantity>45)
SELECT 'both' AS part, count(*) AS n FROM a SEMI JOIN b USING (k) UNION ALL SELECT 'only_first', count(*) FROM a ANTI JOIN b USING (k) UNION ALL SELECT 'only_second', count(*) FROM b ANTI JOIN a USING (k)""")
def set_operations(spark, sf):
    """Intersection and both differences of two id sets, in one pass over a full view of both."""
    li = _li(spark, sf).where("l_quantity > 45 and year(l_shipdate) in (1997, 1998)")
    g = li.groupBy("l_suppkey").agg(F.max((F.year("l_shipdate") == 1997).cast("int")).alias("a"), F.max((F.year("l_shipdate") == 1998).cast("int")).alias("b"))
    n = g.agg(F.sum((F.col("a") * F.col("b")).cast("long")).alias("both"), F.sum((F.col("a") * (1 - F.col("b"))).cast("long")).alias("only_first"), F.sum((F.col("b") * (1 - F.col("a"))).cast("long")).alias("only_second"))
    return n.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in ("both", "only_first", "only_second"))), F.array(*(F.coalesce(c, F.lit(0)) for c in ("both", "only_first", "only_second"))))).alias("part", "n"))


@query("""SELECT l_orderkey, round(sum(l_quantity*l_discount)/sum(l_quantity),9) AS weighted, round(sum(l_quantity)/sum(l_quantity/(1+l_discount)),9) AS harmonic, CASE WHEN round(sum(l_quantity*l_discount)/sum(l_quantity),9)<0.04 THEN 'BCC' WHEN round(sum(l_quantity*l_discount)/sum(l_quantity),9)>=0.06 THEN 'FCC' ELSE 'mixed' END AS phase FROM lineitem GROUP BY 1""")
def mixture_rules(spark, sf):
    """Weighted and harmonic means of a composition, and a threshold rule on them."""
    w = F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 9)
    return _li(spark, sf).groupBy("l_orderkey").agg(
        w.alias("weighted"), F.round(F.sum("l_quantity") / F.sum(F.col("l_quantity") / (1 + F.col("l_discount"))), 9).alias("harmonic"), F.when(w < 0.04, "BCC").when(w >= 0.06, "FCC").otherwise("mixed").alias("phase")
    )


@query("""WITH u AS (SELECT DISTINCT unit_id, paper_id, evidence_type, source_section, confidence, len(coalesce(evidence_spans,[])) AS n_spans, material IS NOT NULL AND len(material)>0 AS has_material, intervention IS NOT NULL AND len(intervention)>0 AS has_intervention,
 structure IS NOT NULL AND len(structure)>0 AS has_structure, outcome IS NOT NULL AND len(outcome)>0 AS has_outcome FROM (SELECT *, cardinality(material) AS c1 FROM evidence_units) WHERE unit_id IS NOT NULL)
SELECT lower(trim(evidence_type)) AS evidence_type, count(*) AS units, count(*) FILTER (n_spans>0) AS with_spans, round(avg(least(1,greatest(0,confidence))),6) AS mean_confidence FROM u GROUP BY 1""".replace("len(material)", "cardinality(material)").replace("len(intervention)", "cardinality(intervention)").replace("len(structure)", "cardinality(structure)").replace("len(outcome)", "cardinality(outcome)"))
def facet_summary(spark, sf):
    u = table(spark, sf, "evidence_units").where("unit_id is not null")
    cols = ["unit_id", "paper_id", "evidence_type", "source_section", "confidence", F.size(F.coalesce("evidence_spans", F.array().cast("array<string>"))).alias("n_spans")]
    flags = [(F.col(c).isNotNull() & (F.size(c) > 0)).alias(f"has_{c}") for c in ("material", "intervention", "structure", "outcome")]
    d = u.select(*cols, *flags).distinct()
    return d.groupBy(F.lower(F.trim("evidence_type")).alias("evidence_type")).agg(F.count("*").alias("units"), F.count_if(F.col("n_spans") > 0).alias("with_spans"), F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence"))), 6).alias("mean_confidence"))


@query("""WITH e AS (SELECT paper_id, record_id, publication_date, row_number() OVER (PARTITION BY text ORDER BY publication_date NULLS FIRST, record_id) AS i FROM (SELECT DISTINCT paper_id, record_id, publication_date, text FROM retrieval_records WHERE text IS NOT NULL))
SELECT paper_id, record_id FROM e WHERE i=1""")
def exact_text_dedup(spark, sf):
    """The first record of each identical text."""
    e = table(spark, sf, "retrieval_records").where("text is not null")
    first = e.groupBy("text").agg(F.min(F.struct("publication_date", "record_id", "paper_id")).alias("f"))
    return first.select("f.paper_id", "f.record_id")


@query("""SELECT lower(trim(kind)) AS kind, count(*) AS n, count(DISTINCT paper_id) AS papers, min(publication_date)::VARCHAR AS oldest, max(publication_date)::VARCHAR AS newest, round(avg(length(text)),4) AS mean_chars, median(length(text)) AS median_chars FROM (SELECT DISTINCT record_id, paper_id, kind, publication_date, text FROM retrieval_records) GROUP BY 1""")
def corpus_summary(spark, sf):
    r = table(spark, sf, "retrieval_records").select("record_id", "paper_id", "kind", "publication_date", "text").distinct()
    return r.groupBy(F.lower(F.trim("kind")).alias("kind")).agg(
        F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"), F.min("publication_date").cast("string").alias("oldest"), F.max("publication_date").cast("string").alias("newest"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.percentile(F.length("text"), F.lit(0.5)).alias("median_chars")
    )


@query("""SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice),4) AS mean, count(*) FILTER (o_totalprice>=200000) AS high, bool_or(o_totalprice>=450000) AS any_top, bool_and(o_totalprice>0) AS all_valid FROM orders GROUP BY 1""")
def integrity_gate(spark, sf):
    """Counts and violation flags of a gate, a row a status."""
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean"), F.count_if(p >= 200000).alias("high"), F.bool_or(p >= 450000).alias("any_top"), F.bool_and(p > 0).alias("all_valid"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('11|'||c_custkey), c_custkey) AS i, c_custkey FROM customer) SELECT c_custkey, 'E'||i AS label FROM c""")
def blind_labels(spark, sf):
    """Neutral labels in a seeded order within each group."""
    w = Window.partitionBy("c_nationkey").orderBy(F.md5(F.concat(F.lit("11|"), F.col("c_custkey").cast("string"))), "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("E"), F.row_number().over(w).cast("string")).alias("label"))


@query("""WITH p AS (SELECT c_custkey, c_acctbal, abs(c_acctbal-m) AS d FROM customer, (SELECT median(c_acctbal) AS m FROM customer)),
lo AS (SELECT c_custkey FROM p ORDER BY c_acctbal, c_custkey LIMIT 20), hi AS (SELECT c_custkey FROM p WHERE c_custkey NOT IN (SELECT * FROM lo) ORDER BY c_acctbal DESC, c_custkey LIMIT 20),
mid AS (SELECT c_custkey FROM p WHERE c_custkey NOT IN (SELECT * FROM lo) AND c_custkey NOT IN (SELECT * FROM hi) ORDER BY d, c_custkey LIMIT 20)
SELECT 'low' AS stratum, c_custkey FROM lo UNION ALL SELECT 'high', c_custkey FROM hi UNION ALL SELECT 'middle', c_custkey FROM mid""")
def sequential_strata(spark, sf):
    """Low, high and middle strata of 20, each without those picked before."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    low = c.orderBy("c_acctbal", "c_custkey").limit(20)
    high = c.join(low, "c_custkey", "left_anti").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    median = c.agg(F.percentile("c_acctbal", F.lit(0.5)).alias("m"))
    rest = c.join(low, "c_custkey", "left_anti").join(high, "c_custkey", "left_anti").crossJoin(F.broadcast(median))
    middle = rest.orderBy(F.abs(F.col("c_acctbal") - F.col("m")), "c_custkey").limit(20)
    name = lambda df, s: df.select(F.lit(s).alias("stratum"), "c_custkey")
    return name(low, "low").unionByName(name(high, "high")).unionByName(name(middle, "middle"))
