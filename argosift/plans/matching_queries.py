"""Queries on matching: exclusion, leakage guards, reference resolution, anchoring, merges."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from argosift.functions import text as X
from argosift.operators import matching as H
from argosift.plans.base import query
from argosift.runtime import table

_PT = "list_distinct(list_filter(regexp_extract_all(lower(p_name),'[a-z0-9]+'), lambda t: length(t) > 2))"


@query("""SELECT d.doc_id, i.item_id FROM documents d JOIN heldout_items i ON contains(lower(d.text), lower(i.text)) WHERE length(i.text)>=40""")
def leak_guard(spark, sf):
    """Documents that hold the whole text of an item in any case; values of under 40 characters are not guarded. The items are a stated set,
    searched by one automaton."""
    i = table(spark, sf, "heldout_items").where("length(text) >= 40").select("item_id", F.lower("text").alias("needle"))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.lower("text").alias("text"))
    return H.contains_any(d, "doc_id", "text", i, "item_id", "needle")


@query("""WITH t AS (SELECT DISTINCT lower(material['name']) AS title FROM evidence_units WHERE length(material['name'])>=8), r AS (SELECT DISTINCT record_id, lower(text) AS text FROM retrieval_records WHERE text IS NOT NULL)
SELECT DISTINCT record_id, title FROM r, t WHERE contains(text, title)""")
def title_in_text(spark, sf):
    """Records that name a unit's material."""
    t = table(spark, sf, "evidence_units").select(F.lower(F.col("material")["name"]).alias("title")).where("length(title) >= 8").distinct()
    r = table(spark, sf, "retrieval_records").where("text is not null").select("record_id", F.lower("text").alias("text")).distinct()
    return H.contains_any(r, "record_id", "text", t.select("title", F.col("title").alias("needle")), "title", "needle").distinct()


@query("""WITH c AS (SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey%50<>0), h AS (SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey%50=0),
f AS (SELECT c.p_partkey, bool_or(c.p_name=h.p_name AND c.p_brand=h.p_brand) AS held, bool_or(c.p_name=h.p_name AND c.p_size=h.p_size) AS fam FROM c JOIN h ON c.p_name=h.p_name GROUP BY 1)
SELECT c.p_partkey, CASE WHEN held THEN 'held_out' WHEN fam THEN 'family' END AS reason FROM c LEFT JOIN f USING (p_partkey)""")
def identity_cascade(spark, sf):
    """The first identity rule that excludes a record."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    c, h = p.where("p_partkey % 50 <> 0"), p.where("p_partkey % 50 = 0").select("p_name", F.col("p_brand").alias("hb"), F.col("p_size").alias("hs")).distinct()
    flags = c.join(h, "p_name").groupBy("p_partkey").agg(F.bool_or(F.col("p_brand") == F.col("hb")).alias("held"), F.bool_or(F.col("p_size") == F.col("hs")).alias("fam"))
    return c.join(flags, "p_partkey", "left").select("p_partkey", F.when(F.col("held"), "held_out").when(F.col("fam"), "family").alias("reason"))


_TITLE = "list_distinct(string_split(lower(p_name||' '||p_type),' '))"


def _titles(spark, sf, keep: str):
    p = table(spark, sf, "part").where(keep)
    return p.select(F.col("p_partkey").alias("key"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("s"), F.col("p_brand").alias("author"), F.concat_ws("|", "p_name", "p_brand").alias("doi"))


@query(f"""WITH t AS (SELECT p_partkey AS key, {_TITLE} AS s, p_brand AS author, p_name||'|'||p_brand AS doi FROM part), c AS (SELECT * FROM t WHERE key%50<>0), h AS (SELECT * FROM t WHERE key%50=0),
j AS (SELECT c.key, c.author=h.author AS kin, len(list_intersect(c.s,h.s))::DOUBLE/len(list_distinct(list_concat(c.s,h.s))) AS j FROM c, h),
b AS (SELECT key, max(j) AS best, bool_or(kin AND j>=0.5-1e-9) AS author FROM j GROUP BY key)
SELECT c.key, CASE WHEN c.doi IN (SELECT doi FROM h) THEN 'identifier' WHEN best>=0.8-1e-9 THEN 'title' WHEN b.author THEN 'title and author' END AS reason FROM c JOIN b USING (key)""")
def title_exclusion(spark, sf):
    """Parts that are a held-out one (key divisible by 50) by identifier, by nearly the same title, or by a similar title of the same maker."""
    return H.identity_reasons(_titles(spark, sf, "p_partkey % 50 <> 0"), _titles(spark, sf, "p_partkey % 50 = 0"), ["doi"])


@query(f"""WITH t AS (SELECT p_partkey AS key, {_TITLE} AS s, p_name||'|'||p_brand||'|'||p_size AS doi FROM part), r AS (SELECT * FROM t WHERE key%50=0), g AS (SELECT * FROM t WHERE key%50<>0),
m AS (SELECT r.key AS ref, g.key AS target, 'doi' AS method, 1.0::DOUBLE AS score, 0 AS prio FROM r JOIN g USING (doi)
 UNION ALL SELECT r.key, g.key, 'title', round(len(list_intersect(r.s,g.s))::DOUBLE/len(list_distinct(list_concat(r.s,g.s))),6), 1 FROM r, g WHERE len(list_intersect(r.s,g.s))::DOUBLE/len(list_distinct(list_concat(r.s,g.s))) >= 0.6-1e-9)
SELECT r.key AS ref, target, method, score FROM r LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ref ORDER BY prio, score DESC, target)=1) x ON x.ref=r.key""")
def title_resolution(spark, sf):
    """The part each reference (a part whose key is divisible by 50) means: by identifier, else by the most similar title."""
    t = lambda keep, name: _titles(spark, sf, keep).join(table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size"), "key").select(F.col("key").alias(name), "s", F.concat_ws("|", "doi", F.col("p_size").cast("string")).alias("doi"))
    return H.resolve_by_title(t("p_partkey % 50 = 0", "ref"), t("p_partkey % 50 <> 0", "target"), ["doi"])


@query("""SELECT source, substr(text,1,2)='Q:' AS is_question, CASE WHEN contains(lower(text),'hypothesis') THEN 'hypothesis' WHEN contains(lower(text),'question') OR contains(text,'?') THEN 'question' ELSE 'statement' END AS use, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def question_triage(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    low = F.lower("text")
    use = F.when(low.contains("hypothesis"), "hypothesis").when(low.contains("question") | F.col("text").contains("?"), "question").otherwise("statement")
    return d.groupBy("source", (F.substring("text", 1, 2) == "Q:").alias("is_question"), use.alias("use")).agg(F.count("*").alias("n"))


@query(r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text,'([.!?])\s+','\1'||chr(10),'g'),'\n+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 20 AND 400)) AS s FROM documents)
SELECT count(*) FILTER (regexp_matches(lower(s),'we propose|hypothes')) AS claims, count(*) FILTER (regexp_matches(lower(s),'earlier work|reported')) AS background, count(*) FILTER (regexp_matches(lower(s),'measured|reached|lost')) AS results, count(*) AS sentences FROM s""")
def trigger_coverage(spark, sf):
    """Sentences of 20 to 400 characters with trigger phrases of each role."""
    s = table(spark, sf, "documents").select(F.explode(X.sentences("text")).alias("s")).where("length(s) between 20 and 400").select(F.lower("s").alias("s"))
    hit = lambda p, n: F.count_if(F.col("s").rlike(p)).alias(n)
    return s.agg(hit("we propose|hypothes", "claims"), hit("earlier work|reported", "background"), hit("measured|reached|lost", "results"), F.count("*").alias("sentences"))


@query("""WITH p AS (SELECT r.record_id, u.unit_id, u.span, position(u.span IN r.text) AS hit FROM (SELECT DISTINCT unit_id, paper_id, unnest(evidence_spans) AS span FROM evidence_units) u JOIN (SELECT DISTINCT record_id, paper_id, text FROM retrieval_records WHERE text IS NOT NULL) r ON r.paper_id=u.paper_id WHERE length(u.span)>0 AND contains(r.text,u.span))
SELECT unit_id, md5(span) AS span_hash, arg_min(record_id, {'a': record_id, 'b': hit}) AS record_id, CAST(arg_min(hit, {'a': record_id, 'b': hit})-1 AS BIGINT) AS char_at FROM p GROUP BY unit_id, span""")
def span_anchors(spark, sf):
    """The first record of the paper that holds a span, and where."""
    return H.anchor_spans(table(spark, sf, "evidence_units"), table(spark, sf, "retrieval_records")).withColumnRenamed("at", "char_at")


@query("""SELECT unit_id, md5(span) AS span_hash, greatest(0, hit-421) AS ctx_from, md5(substring(text, CAST(greatest(1, hit-420) AS INT), CAST(least(hit-1,420) + length(span) + 420 AS INT))) AS context_hash FROM (
 SELECT u.unit_id, u.span, r.text, position(u.span IN r.text) AS hit FROM (SELECT DISTINCT unit_id, paper_id, unnest(evidence_spans) AS span FROM evidence_units) u JOIN (SELECT DISTINCT record_id, paper_id, text FROM retrieval_records WHERE text IS NOT NULL) r ON r.paper_id=u.paper_id
 WHERE length(u.span)>0 AND contains(r.text,u.span) QUALIFY row_number() OVER (PARTITION BY u.unit_id,u.span ORDER BY r.record_id, hit)=1)""")
def span_context(spark, sf):
    """420 characters on both sides of a span in its record."""
    anchored = H.anchor_spans(table(spark, sf, "evidence_units"), table(spark, sf, "retrieval_records"), keep_text=True)
    at = F.col("at") + 1
    begin = F.greatest(F.lit(1), at - 420)
    size = F.least(at - 1, F.lit(420)) + F.length("span") + 420
    return anchored.select("unit_id", F.md5("span").alias("span_hash"), F.greatest(F.lit(0), at - 421).cast("long").alias("ctx_from"), F.md5(F.substring(F.col("text"), begin.cast("int"), size.cast("int"))).alias("context_hash"))


@query(f"""WITH q AS (SELECT p_partkey AS a, {_PT} AS k FROM part WHERE p_partkey%50=0), x AS (SELECT p_partkey AS b, {_PT} AS k FROM part)
SELECT a, b, round(j,6) AS jaccard FROM (SELECT a, b, len(list_intersect(q.k,x.k))::DOUBLE/len(list_distinct(list_concat(q.k,x.k))) AS j FROM q JOIN x ON a<>b AND len(list_intersect(q.k,x.k))>0) QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(j,9) DESC, b DESC)=1""")
def hard_negatives(spark, sf):
    """The most similar other part of each part whose key is divisible by 50; ties go to the larger key."""
    k = table(spark, sf, "part").select("p_partkey", F.array_distinct(X.tokens("p_name")).alias("k"))
    return H.best_match(k.where("p_partkey % 50 = 0"), k, "p_partkey", "k")


@query()
def hard_negatives_all(spark, sf):
    """The same for every part."""
    return H.best_match_each(table(spark, sf, "part").select("p_partkey", F.array_distinct(X.tokens("p_name")).alias("k")), "p_partkey", "k")


@query("""WITH o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), del AS (SELECT k FROM o WHERE k%11=0), upd AS (SELECT k, -v AS v FROM o WHERE k%7=0), ins AS (SELECT k+1000000 AS k, v FROM o WHERE k%13=0)
SELECT o.k, coalesce(u.v,o.v) AS v FROM o LEFT JOIN upd u USING (k) WHERE o.k NOT IN (SELECT k FROM del) UNION ALL SELECT k, v FROM ins WHERE k NOT IN (SELECT k FROM o)""")
def patch_merge(spark, sf):
    """Deletes, updates and inserts applied to a table."""
    o = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return H.apply_patch(o, o.where("k % 11 = 0").select("k"), o.where("k % 7 = 0").select("k", (-F.col("v")).alias("v")), o.where("k % 13 = 0").select((F.col("k") + 1_000_000).alias("k"), "v"), ["k"])


@query("""WITH d AS (SELECT DISTINCT paper_id, kind, text FROM retrieval_records WHERE text IS NOT NULL)
SELECT paper_id, lower(trim(kind)) AS kind, count(*) AS n_claims, md5(string_agg(md5(text), '|' ORDER BY md5(text))) AS claims_hash, bool_or(contains(text,'not')) AS conflicting FROM d GROUP BY ALL""")
def group_assembly(spark, sf):
    """Distinct claims of a paper and kind assembled to one row."""
    d = table(spark, sf, "retrieval_records").where("text is not null").select("paper_id", "kind", "text").distinct()
    return d.groupBy("paper_id", F.lower(F.trim("kind")).alias("kind")).agg(
        F.count("*").alias("n_claims"), F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("text"))), "|")).alias("claims_hash"), F.bool_or(F.col("text").contains("not")).alias("conflicting")
    )


@query("""SELECT o_orderkey, strftime(greatest(o_orderdate, max(l_shipdate)), '%Y-%m-%d') AS node_date, strftime(min(l_shipdate), '%Y-%m-%d') AS first_date FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_orderkey, o_orderdate""")
def node_dates(spark, sf):
    """A record's date is the latest of its own and its contributors'."""
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("hi"), F.min("l_shipdate").alias("lo"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf, "orders").join(l, "o_orderkey", "left").select("o_orderkey", day(F.greatest("o_orderdate", "hi")).alias("node_date"), day("lo").alias("first_date"))


@query("""WITH r AS (SELECT p_partkey AS ref, p_name, p_brand, p_size FROM part WHERE p_partkey%20=3), t AS (SELECT p_partkey AS target, p_name, p_brand, p_size FROM part WHERE p_partkey%20<>3),
m AS (SELECT ref, target, 1 AS prio FROM r JOIN t USING (p_name, p_brand, p_size) UNION ALL SELECT ref, target, 2 FROM r JOIN t USING (p_name, p_brand) UNION ALL SELECT ref, target, 3 FROM r JOIN t USING (p_name))
SELECT r.ref, m.target, m.prio FROM r LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ref ORDER BY prio, target)=1) m ON m.ref=r.ref""")
def reference_resolution(spark, sf):
    """Each reference's target by the first rule that finds one; null where none does."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return H.resolve(p.where("p_partkey % 20 = 3").withColumnRenamed("p_partkey", "ref"), p.where("p_partkey % 20 <> 3").withColumnRenamed("p_partkey", "target"), "ref", "target", [["p_name", "p_brand", "p_size"], ["p_name", "p_brand"], ["p_name"]])


@query("""SELECT CASE WHEN contains(reason,':') THEN split_part(reason,':',1) ELSE split_part(reason,' (',1) END AS category, count(*) AS n FROM (SELECT event_type || CASE WHEN event_id%3=0 THEN ': value '||event_id WHEN event_id%3=1 THEN ' ('||user_id||')' ELSE '' END AS reason FROM events) GROUP BY 1""")
def reject_categories(spark, sf):
    """Free-text reasons grouped by what stands before a colon or bracket."""
    e = F.col("event_id") % 3
    reason = F.concat("event_type", F.when(e == 0, F.concat(F.lit(": value "), F.col("event_id").cast("string"))).when(e == 1, F.concat(F.lit(" ("), F.col("user_id").cast("string"), F.lit(")"))).otherwise(""))
    r = table(spark, sf, "events").select(reason.alias("r"))
    return r.groupBy(F.when(F.col("r").contains(":"), F.substring_index("r", ":", 1)).otherwise(F.substring_index("r", " (", 1)).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN lo>0 AND second>0 THEN 'better' WHEN hi<0 AND second<0 THEN 'worse' ELSE 'none' END AS verdict FROM (
 SELECT o_orderkey, o_orderpriority, min(l_discount)-0.03 AS lo, max(l_discount)-0.06 AS hi, avg(l_tax)-0.04 AS second FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY ALL)""")
def verdicts(spark, sf):
    """Better or worse only if the interval and the second judge agree."""
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.min("l_discount") - 0.03).alias("lo"), (F.max("l_discount") - 0.06).alias("hi"), (F.avg("l_tax") - 0.04).alias("second"))
    v = F.when((F.col("lo") > 0) & (F.col("second") > 0), "better").when((F.col("hi") < 0) & (F.col("second") < 0), "worse").otherwise("none")
    return table(spark, sf, "orders").join(l, "o_orderkey").select("o_orderkey", "o_orderpriority", v.alias("verdict"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_totalprice) AS best, count(*) FILTER (o_orderkey IS NULL)>0 AS missing FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1""")
def optional_outputs(spark, sf):
    """Runs with what judgements there are; missing ones stay null."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("best"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "best", F.col("n_orders").isNull().alias("missing"))


_LOW = "list_distinct(list_filter(regexp_extract_all(lower({}),'[a-z0-9]+'), lambda t: length(t) > 2))"


@query(f"""WITH u AS (SELECT DISTINCT unit_id, mechanism, evidence_spans FROM evidence_units WHERE unit_id IS NOT NULL AND mechanism IS NOT NULL),
k AS (SELECT unit_id, mechanism, {_LOW.format('mechanism')} AS m, s, {_LOW.format('s')} AS w FROM (SELECT *, unnest(evidence_spans) AS s FROM u) WHERE s IS NOT NULL)
SELECT unit_id, md5(mechanism) AS claim, round(max(CASE WHEN len(m)>0 THEN len(list_intersect(m,w))::DOUBLE/len(m) ELSE 0 END),6) AS traced FROM k GROUP BY unit_id, mechanism""")
def traced_share(spark, sf):
    """How much of a unit's stated mechanism one of its own evidence spans holds, at most: the share that is copied from its evidence."""
    u = table(spark, sf, "evidence_units").where("unit_id is not null and mechanism is not null").select("unit_id", "mechanism", "evidence_spans").distinct()
    k = u.select("unit_id", "mechanism", F.array_distinct(X.tokens("mechanism")).alias("m"), F.explode("evidence_spans").alias("s")).where("s is not null")
    share = F.when(F.size("m") > 0, F.size(F.array_intersect("m", F.array_distinct(X.tokens("s")))) / F.size("m")).otherwise(0.0)
    return k.groupBy("unit_id", "mechanism").agg(F.round(F.max(share), 6).alias("traced")).select("unit_id", F.md5("mechanism").alias("claim"), "traced")


@query("""WITH c AS (SELECT unit_id, lower(k) AS k, lower(trim(v)) AS v FROM (SELECT DISTINCT unit_id, unnest(map_keys(conditions)) AS k, unnest(map_values(conditions)) AS v FROM evidence_units WHERE unit_id IS NOT NULL))
SELECT k AS facet, count(*) AS n, count(*) FILTER (v IS NULL OR v IN ('','n/a','none','-','unknown')) AS n_empty, count(DISTINCT v) AS n_values FROM c GROUP BY k""")
def condition_facets(spark, sf):
    """Keys of condition maps, how often they are filled and with how many values; filler counts as empty."""
    c = table(spark, sf, "evidence_units").where("unit_id is not null").select("unit_id", F.explode("conditions").alias("k", "v")).distinct()
    v = F.lower(F.trim("v"))
    return c.groupBy(F.lower("k").alias("facet")).agg(F.count("*").alias("n"), F.count_if(v.isNull() | v.isin("", "n/a", "none", "-", "unknown")).alias("n_empty"), F.count_distinct(v).alias("n_values"))


@query("""SELECT DISTINCT unit_id, array_to_string(list_filter([CASE WHEN coalesce(trim(mechanism),'')<>'' THEN trim(mechanism) END, CASE WHEN len(coalesce(evidence_spans,[]))>0 THEN evidence_spans[1] END, CASE WHEN coalesce(trim(source_section),'')<>'' THEN trim(source_section) END], lambda x: x IS NOT NULL),' | ') AS summary FROM evidence_units WHERE unit_id IS NOT NULL""")
def unit_summaries(spark, sf):
    """Non-empty parts of a unit in one line."""
    some = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.trim(c))
    parts = F.array(some("mechanism"), F.when(F.size(F.coalesce("evidence_spans", F.array().cast("array<string>"))) > 0, F.get("evidence_spans", F.lit(0))), some("source_section"))
    return table(spark, sf, "evidence_units").where("unit_id is not null").select("unit_id", F.array_join(F.filter(parts, lambda x: x.isNotNull()), " | ").alias("summary")).distinct()


@query("""WITH q AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('5|'||o_orderkey), o_orderkey)-1 AS i FROM orders) SELECT o_orderkey, ['ABC','ACB','BAC','BCA','CAB','CBA'][(i%6)+1] AS ordering FROM q""")
def latin_assignment(spark, sf):
    """Balanced permutations over a seeded order of all orders."""
    return _latin(table(spark, sf, "orders"))


def _latin(orders):
    from argosift.operators.ordering import numbered

    q = orders.select("o_orderkey", F.md5(F.concat(F.lit("5|"), F.col("o_orderkey").cast("string"))).alias("h"))
    perms = F.array(*(F.lit(p) for p in ("ABC", "ACB", "BAC", "BCA", "CAB", "CBA")))
    return numbered(q, ["h", "o_orderkey"]).select("o_orderkey", F.element_at(perms, (F.col("number") % 6 + 1).cast("int")).alias("ordering"))


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) SELECT user_id, arg_min(event_type, {'v': round(-value,6), 'p': pos}) AS best FROM e GROUP BY user_id""")
def draft_pool(spark, sf):
    """The best draft of each unit, the earliest among equals."""
    e = table(spark, sf, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg(F.min_by("event_type", F.struct(F.round(-F.col("value"), 6).alias("v"), "pos")).alias("best"))
