"""Queries on evidence around units, papers and questions, and on reports over runs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from argosift.functions import text as X
from argosift.operators import evidence as V
from argosift.operators import retrieve as R
from argosift.operators import stats as S
from argosift.plans.base import query
from argosift.plans.retrieval_queries import _BM25
from argosift.plans.text_queries import TOKENS
from argosift.runtime import table


def _tok(column: str) -> str:
    return TOKENS.replace("text", column)


_UNIT_TEXT = "concat_ws(' ', mechanism, array_to_string(evidence_spans, ' '))"
_FILLED = "len(list_filter(coalesce(map_values({0}), []), lambda v: v IS NOT NULL AND NOT lower(trim(v)) IN ('', 'n/a', 'none', '-', 'unknown'))) > 0"


def _units(spark, sf):
    """One row a unit: of repeats that differ the one with the smallest text of the row."""
    u = table(spark, sf, "evidence_units").where("unit_id is not null")
    return u.drop("ingested_at").dropDuplicates(["unit_id"])


_UNITS = "u AS (SELECT DISTINCT ON (unit_id) * FROM evidence_units WHERE unit_id IS NOT NULL ORDER BY unit_id)"


@query(f"""WITH {_BM25}, g AS (SELECT paper_id, count(*) AS n FROM documents WHERE paper_id IS NOT NULL GROUP BY 1),
w AS (SELECT item_id, s.doc_id, round(score*(1+ln(1+coalesce(g.n,0))),6) AS score FROM s JOIN documents x ON x.doc_id=s.doc_id LEFT JOIN g ON g.paper_id=x.paper_id)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM w) WHERE place<=5""")
def corroborated_topk(spark, sf):
    """BM25 weighed by one plus the logarithm of how many documents a paper has."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "paper_id")
    n = docs.where("paper_id is not null").groupBy("paper_id").agg(F.count("*").alias("n"))
    weighed = docs.join(n, "paper_id", "left").select("doc_id", "text", (1 + F.log1p(F.coalesce("n", F.lit(0)).cast("double"))).alias("weight"))
    return R.bm25_best(weighed, table(spark, sf, "heldout_items").select("item_id", "text"), "doc_id", "item_id", 5, factor="weight")


@query(f"""WITH {_UNITS}, k AS (SELECT unit_id, paper_id, coalesce(confidence,0) AS confidence, (({_FILLED.format('material')})::INT + ({_FILLED.format('intervention')})::INT + ({_FILLED.format('outcome')})::INT)/3.0::DOUBLE AS share,
 list_distinct({_tok(_UNIT_TEXT)}) AS t FROM u), q AS (SELECT item_id, list_distinct({TOKENS}) AS q FROM heldout_items WHERE text IS NOT NULL),
s AS (SELECT item_id, unit_id, paper_id, round(len(list_intersect(q,t)) + 3.0*share + confidence, 9) AS score FROM q, k WHERE len(list_intersect(q,t))>0 OR share>0),
c AS (SELECT *, row_number() OVER (PARTITION BY item_id, paper_id ORDER BY score DESC, unit_id) AS n FROM s)
SELECT item_id, unit_id, round(score,6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, unit_id) AS place FROM c WHERE n<=2) WHERE place<=6""")
def facet_retrieval(spark, sf):
    """Units for each question by shared words, required facets (material, intervention, outcome) and confidence, at most two a paper."""
    spans = F.array_join(F.coalesce("evidence_spans", F.array().cast("array<string>")), " ")
    u = _units(spark, sf).withColumn("t_tokens", F.array_distinct(X.tokens(F.concat_ws(" ", "mechanism", spans))))
    q = table(spark, sf, "heldout_items").where("text is not null").select("item_id", F.array_distinct(X.tokens("text")).alias("q_tokens"))
    return V.facet_retrieval(q, u, ("material", "intervention", "outcome"), 6, 2)


@query(f"""WITH r AS (SELECT DISTINCT record_id, paper_id, publication_date AS date, lower(trim(kind))='claim' AS current, {TOKENS} AS t FROM retrieval_records WHERE record_id IS NOT NULL AND text IS NOT NULL AND publication_date IS NOT NULL),
q AS (SELECT item_id, paper_id, make_date((2008 + item_id%12)::INT, 12, 31) AS cutoff, {TOKENS} AS q FROM heldout_items WHERE text IS NOT NULL),
a AS (SELECT item_id, tok, count(*) AS n FROM (SELECT item_id, unnest(q) AS tok FROM q) GROUP BY ALL), b AS (SELECT record_id, tok, count(*) AS m FROM (SELECT record_id, unnest(t) AS tok FROM r) GROUP BY ALL),
o AS (SELECT item_id, record_id, sum(least(n,m)) AS overlap FROM a JOIN b USING (tok) GROUP BY ALL),
s AS (SELECT item_id, record_id, date, round(CASE WHEN r.paper_id=q.paper_id THEN 1.5 ELSE 0 END + CASE WHEN current THEN 0.4 ELSE 0 END + overlap/greatest(len(q),1), 9) AS score FROM o JOIN q USING (item_id) JOIN r USING (record_id) WHERE date<=cutoff)
SELECT item_id, record_id, round(score,6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, date, record_id) AS place FROM s) WHERE place<=4""")
def boosted_candidates(spark, sf):
    """Four records for each question, not later than its cutoff (the end of a year from 2008 on); its own paper and claims come first."""
    r = table(spark, sf, "retrieval_records")
    cutoff = F.make_date((2008 + F.col("item_id") % 12).cast("int"), F.lit(12), F.lit(31))
    q = table(spark, sf, "heldout_items").where("text is not null").select("item_id", "paper_id", cutoff.alias("cutoff"), X.tokens("text").alias("q_tokens"))
    rows = r.where("record_id is not null and text is not null and publication_date is not null").select(
        "record_id", "paper_id", F.col("publication_date").alias("date"), (F.lower(F.trim("kind")) == "claim").alias("current"), X.tokens("text").alias("t_tokens")
    )
    return V.boosted_candidates(q, rows.distinct(), 4)


_REF = r"(?:fig(?:ure)?|table)\.?\s*[0-9]+"


@query(rf"""WITH {_UNITS}, q AS (SELECT unit_id, paper_id, lower(source_section) AS section, list_filter(coalesce(evidence_spans,[]), lambda s: s IS NOT NULL AND s<>'') AS spans, list_filter([lower(trim(material['name']))], lambda x: coalesce(x,'')<>'') AS terms,
 list_distinct(list_transform(regexp_extract_all(lower(array_to_string(coalesce(evidence_spans,[]),' ')), '{_REF}'), lambda x: replace(x,'.',''))) AS refs, {_tok(_UNIT_TEXT)} AS q FROM u),
c AS (SELECT DISTINCT chunk_id, paper_id, section, chunk_index, text, {TOKENS} AS t FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
a AS (SELECT unit_id, paper_id, tok, count(*) AS n FROM (SELECT unit_id, paper_id, unnest(q) AS tok FROM q) GROUP BY ALL), b AS (SELECT chunk_id, paper_id, tok, count(*) AS m FROM (SELECT chunk_id, paper_id, unnest(t) AS tok FROM c) GROUP BY ALL),
o AS (SELECT unit_id, chunk_id, sum(least(n,m)) AS overlap FROM a JOIN b USING (paper_id, tok) GROUP BY ALL),
x AS (SELECT q.*, c.chunk_id, c.section AS c_section, c.chunk_index, c.text, coalesce(overlap,0) AS overlap, len(list_filter(terms, lambda t: contains(lower(c.text), t))) AS n_terms,
 len(list_filter(refs, lambda t: contains(replace(lower(c.text),'.',''), t))) AS n_refs FROM q JOIN c ON q.paper_id=c.paper_id LEFT JOIN o ON o.unit_id=q.unit_id AND o.chunk_id=c.chunk_id),
s AS (SELECT unit_id, chunk_id, chunk_index, round(overlap/greatest(len(q),1) + 2.0*n_terms + 3.0*n_refs + 0.5*(coalesce(lower(c_section)<>section, true))::INT
 + 0.75*(coalesce(starts_with(section,'result') AND lower(c_section) IN ('methods','materials','materials and methods','experimental','discussion','results and discussion'), false))::INT, 9) AS score
 FROM x WHERE (overlap>0 OR n_terms>0) AND len(list_filter(spans, lambda s: contains(text, s)))=0)
SELECT unit_id, chunk_id, round(score,6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, chunk_index, chunk_id) AS place FROM s) WHERE place<=3""")
def cross_section_chunks(spark, sf):
    """Three chunks of a unit's paper from elsewhere in it that speak of the same."""
    spans = F.filter(F.coalesce("evidence_spans", F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))
    joined = F.array_join(F.coalesce("evidence_spans", F.array().cast("array<string>")), " ")
    name = F.lower(F.trim(F.col("material")["name"]))
    u = _units(spark, sf).select(
        "unit_id", "paper_id", F.col("source_section").alias("section"), spans.alias("spans"), F.filter(F.array(name), lambda x: F.coalesce(x, F.lit("")) != "").alias("terms"),
        F.array_distinct(F.transform(F.regexp_extract_all(F.lower(joined), F.lit(_REF), F.lit(0)), lambda x: F.replace(x, F.lit("."), F.lit("")))).alias("references"),
        X.tokens(F.concat_ws(" ", "mechanism", joined)).alias("q_tokens"),
    )
    c = table(spark, sf, "chunks").where("chunk_id is not null and text is not null").select("chunk_id", "paper_id", "section", "chunk_index", "text").distinct()
    return V.cross_section_chunks(u, c.withColumn("t_tokens", X.tokens("text")), 3)


@query()
def unit_excerpts(spark, sf):
    """For each unit and record that holds one of its spans, what to read: the spans' surroundings and the pieces that say most of the unit."""
    from argosift.operators.matching import anchor_spans

    u = _units(spark, sf)
    held = anchor_spans(u, table(spark, sf, "retrieval_records"), keep_text=True)
    pairs = held.groupBy("unit_id", "record_id").agg(F.first("text").alias("text"), F.collect_set("span").alias("spans"))  # spans of one unit
    q = u.select("unit_id", X.tokens(F.concat_ws(" ", "mechanism", F.array_join("evidence_spans", " "))).alias("q_tokens"))
    rows = pairs.join(q, "unit_id").withColumn("spans", F.array_sort("spans")).withColumn("key", F.struct("unit_id", "record_id"))
    found = V.excerpts(rows.withColumn("key", F.concat_ws("|", "unit_id", "record_id")), "key")
    return found.select("key", F.length("excerpt").alias("n_chars"), F.md5("excerpt").alias("excerpt_hash"))


@query()
def claim_anchors(spark, sf):
    """Each unit's spans with the record of its paper that holds it or is most like it."""
    claims = table(spark, sf, "evidence_units").where("unit_id is not null").select(F.col("unit_id").alias("claim_id"), "paper_id", F.explode("evidence_spans").alias("text")).distinct()
    passages = table(spark, sf, "retrieval_records").where("record_id is not null").select(F.col("record_id").alias("passage_id"), "paper_id", "text").distinct()
    return V.best_passages(claims, passages).select("claim_id", F.md5("claim").alias("claim_hash"), "passage_id", "score")


@query()
def expansion_order(spark, sf):
    """Three parts for each of the twenty largest orders: shared by most of them first, then dearest, then most ordered; no part twice."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seed"), F.col("l_partkey").alias("ref")).distinct()
    seeds = R.top_k(table(spark, sf, "orders").select(F.col("o_orderkey").alias("seed"), "o_totalprice"), 20, [F.desc("o_totalprice"), F.col("seed")], []).select("seed", F.col("place").alias("pos"))
    ordered = li.groupBy("ref").agg(F.count("*").alias("citations"))
    price = table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), F.col("p_retailprice").alias("relevance"))
    return V.expansion(seeds, li.join(F.broadcast(seeds.select("seed")), "seed").join(ordered, "ref").join(price, "ref"), 3)  # twenty seeds


_OWN = r"\b(?:we|our|in this (?:work|study|paper))\b"
_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text,'([.!?])\s+','\1'||chr(10),'g'),'\n+'), lambda x: trim(x)), lambda x: x<>'')"
_GAP = rf"""g AS (SELECT doc_id, array_to_string(s[greatest(1,i-6):i-1],' ') AS gap FROM (SELECT doc_id, s, list_position(list_transform(s, lambda x: regexp_matches(lower(x), '{_OWN}')), true) AS i FROM (SELECT doc_id, {_SENT} AS s FROM documents WHERE text IS NOT NULL)) WHERE i>=3)"""


@query(f"WITH {_GAP} SELECT doc_id, md5(gap) AS gap_hash, length(gap) AS n_chars FROM g")
def gap_statements(spark, sf):
    """Up to six sentences before a document's first sentence on its own work."""
    g = table(spark, sf, "documents").where("text is not null").select("doc_id", V.gap_before_own_work(F.col("text"), _OWN).alias("gap")).where("gap is not null")
    return g.select("doc_id", F.md5("gap").alias("gap_hash"), F.length("gap").cast("long").alias("n_chars"))


@query(f"""WITH {_GAP}, d AS (SELECT doc_id, {_tok('gap')} AS ts, len({_tok('gap')}) AS dl FROM g), n AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM d),
q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS tok FROM heldout_items), tf AS (SELECT doc_id, dl, tok, count(*) AS tf FROM (SELECT doc_id, dl, unnest(ts) AS tok FROM d) WHERE tok IN (SELECT tok FROM q) GROUP BY ALL),
f AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
s AS (SELECT item_id, doc_id, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*dl/avg_dl))),6) AS score FROM q JOIN tf USING (tok) JOIN f USING (tok), n GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place<=3""")
def analog_topk(spark, sf):
    """The documents whose gap statement is nearest to a question."""
    g = table(spark, sf, "documents").where("text is not null").select("doc_id", V.gap_before_own_work(F.col("text"), _OWN).alias("text")).where("text is not null")
    return R.bm25_best(g, table(spark, sf, "heldout_items").select("item_id", "text"), "doc_id", "item_id", 3)


_BACK = r"^(?:references|acknowledge?ments?|author contributions|funding|conflicts? of interest|supporting information)\b"


@query(rf"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1) AS i FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, coalesce(sum(length(line)+1) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pos FROM l),
c AS (SELECT doc_id, text, min(pos) FILTER (regexp_matches(lower(trim(line)), '{_BACK}') AND pos > length(text)*0.4) AS cut FROM p GROUP BY doc_id, text)
SELECT doc_id, cut IS NOT NULL AS stripped, md5(CASE WHEN cut IS NULL THEN text ELSE regexp_replace(substring(text, 1, cut::INT), '\s+$', '') END) AS text_hash FROM c""")
def back_matter_stripped(spark, sf):
    """Texts without back matter that starts in their last three fifths."""
    kept = V.strip_back_matter(F.col("text"), _BACK)
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text").distinct()
    return d.select("doc_id", (F.length(kept) < F.length("text")).alias("stripped"), F.md5(kept).alias("text_hash"))


@query(r"""WITH b AS (SELECT doc_id, section, unnest(regexp_split_to_array(text, '\n\s*\n')) AS block, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'),1)-1 AS pos FROM documents WHERE text IS NOT NULL)
SELECT substring(sha256(doc_id||chr(31)||pos||chr(31)||trim(block)),1,16) AS passage_id, doc_id, pos, len(list_filter(regexp_split_to_array(trim(block),'\s+'), lambda w: w<>'')) AS words,
 regexp_matches(lower(block),'\bfig(?:ure)?\s*\.?\s*[0-9]') AS has_figure, regexp_matches(lower(block),'\btable\s*\.?\s*[0-9]') AS has_table FROM b WHERE trim(block)<>''""")
def passages(spark, sf):
    """Blocks between blank lines with a stable id, their words and what they refer to."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "block")).where("trim(block) <> ''")
    low = F.lower("block")
    return d.select(
        X.stable_id("doc_id", "pos", F.trim("block")).alias("passage_id"), "doc_id", F.col("pos").cast("long").alias("pos"), F.size(X.words(F.trim("block"))).cast("long").alias("words"),
        low.rlike(r"\bfig(?:ure)?\s*\.?\s*[0-9]").alias("has_figure"), low.rlike(r"\btable\s*\.?\s*[0-9]").alias("has_table"),
    )


@query("""WITH c AS (SELECT DISTINCT paper_id, chunk_index, section, text FROM chunks WHERE paper_id IS NOT NULL AND text IS NOT NULL AND lower(trim(section)) IN ('abstract','conclusion','discussion')),
p AS (SELECT *, lag(section) OVER w IS DISTINCT FROM section AS fresh, coalesce(sum(length(text)+2) OVER (PARTITION BY paper_id ORDER BY chunk_index, section, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM c WINDOW w AS (PARTITION BY paper_id ORDER BY chunk_index, section, text))
SELECT paper_id, md5(substring(string_agg(CASE WHEN fresh THEN '## '||section||chr(10) ELSE '' END || text, chr(10)||chr(10) ORDER BY chunk_index, section, text), 1, 3200)) AS card_hash FROM p WHERE before < 3200 GROUP BY paper_id""")
def paper_cards(spark, sf):
    """Abstract, discussion and conclusion of each paper with a heading where the section changes, cut at 3,200 characters; later chunks are not gathered."""
    w = Window.partitionBy("paper_id").orderBy("chunk_index", "section", "text")
    c = table(spark, sf, "chunks").where("paper_id is not null and text is not null and lower(trim(section)) in ('abstract','conclusion','discussion')").select("paper_id", "chunk_index", "section", "text").distinct()
    before = F.coalesce(F.sum(F.length("text") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = c.withColumn("fresh", ~F.lag("section").over(w).eqNullSafe(F.col("section"))).withColumn("before", before).where("before < 3200")
    line = F.concat(F.when(F.col("fresh"), F.concat(F.lit("## "), "section", F.lit("\n"))).otherwise(F.lit("")), "text")
    cards = p.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "section", "text", line.alias("line")))).alias("xs"))
    return cards.select("paper_id", F.md5(F.substring(F.array_join("xs.line", "\n\n"), 1, 3200)).alias("card_hash"))


@query("""WITH e AS (SELECT user_id, event_type, min({'t': ts, 'i': event_id}) AS f FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, '>' ORDER BY f) AS path FROM e GROUP BY user_id""")
def first_seen_order(spark, sf):
    """Each user's event types, each once, in the order of their first events."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    order = F.array_sort(F.collect_list(F.struct("f", "event_type")))  # as many entries as there are types
    return e.groupBy("user_id").agg(F.array_join(order["event_type"], ">").alias("path"))


@query("""SELECT record_id, regexp_replace(lower(trim(d)), '^(https?://)?(dx\\.)?doi\\.org/|^doi:\\s*', '') AS doi, split_part(lower(trim(d)), '/', -1) AS last FROM
 (SELECT DISTINCT record_id, ['https://doi.org/10.5555/', 'DOI: 10.5555/', ' http://dx.doi.org/10.5555/'][1 + length(record_id)%3] || record_id AS d FROM retrieval_records WHERE record_id IS NOT NULL)""")
def normalised_identifiers(spark, sf):
    r = table(spark, sf, "retrieval_records").where("record_id is not null").select("record_id").distinct()
    lead = F.array(*map(F.lit, ("https://doi.org/10.5555/", "DOI: 10.5555/", " http://dx.doi.org/10.5555/")))[(F.length("record_id") % 3).cast("int")]
    d = r.select("record_id", F.concat(lead, "record_id").alias("d"))
    return d.select("record_id", X.doi("d").alias("doi"), F.substring_index(F.lower(F.trim("d")), "/", -1).alias("last"))


@query("""WITH d AS (SELECT doc_id, source, section, length(text) AS n, publication_date AS p FROM documents WHERE text IS NOT NULL),
o AS (SELECT 'newest' AS ordering, *, row_number() OVER (PARTITION BY source ORDER BY p DESC NULLS LAST, doc_id) AS i FROM d UNION ALL SELECT 'longest', *, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) FROM d UNION ALL SELECT 'by id', *, row_number() OVER (PARTITION BY source ORDER BY doc_id) FROM d),
k AS (SELECT *, sum(n) OVER (PARTITION BY ordering, source ORDER BY i ROWS UNBOUNDED PRECEDING) AS used FROM o),
s AS (SELECT ordering, source, count(*) AS packed, avg((coalesce(section,'')='Results')::INT) AS share, bool_or(coalesce(section,'')='Results') AS hit FROM k WHERE used<=100000 GROUP BY ALL)
SELECT s.ordering, count(*) AS packs, round(avg(s.share),6) AS density, round(avg(s.hit::INT),6) AS any_hit, round(avg(s.share-b.share),6) AS vs_base FROM s JOIN (SELECT source, share FROM s WHERE ordering='by id') b USING (source) GROUP BY 1""")
def pack_density(spark, sf):
    """How much of a pack of 100,000 characters are results, for three orders of the same documents, against the first."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "source", "section", F.length("text").cast("long").alias("n"), F.col("publication_date").alias("p"))
    orders = {"newest": [F.col("p").desc_nulls_last(), F.col("doc_id")], "longest": [F.desc("n"), F.col("doc_id")], "by id": [F.col("doc_id")]}
    packs = None
    for name, order in orders.items():
        one = R.prefix_pack(d, ["source"], order, "n", 100_000).withColumn("ordering", F.lit(name))
        packs = one if packs is None else packs.unionByName(one)
    hit = F.coalesce(F.col("section") == "Results", F.lit(False))
    s = packs.groupBy("ordering", "source").agg(F.avg(hit.cast("int")).alias("share"), F.bool_or(hit).alias("hit"))
    base = s.where("ordering = 'by id'").select("source", F.col("share").alias("base"))
    six = lambda c: F.round(F.avg(c), 6)
    return s.join(base, "source").groupBy("ordering").agg(F.count("*").alias("packs"), six("share").alias("density"), six(F.col("hit").cast("int")).alias("any_hit"), six(F.col("share") - F.col("base")).alias("vs_base"))


_LAB = "l AS (SELECT run_id, lower(trim(labeller)) AS who, max(lever_match) AS lever FROM lever_labels WHERE run_id IS NOT NULL AND trim(labeller)<>'' AND lever_match BETWEEN 0 AND 3 GROUP BY ALL)"


def _lab(spark, sf):
    t = table(spark, sf, "lever_labels").where("run_id is not null and trim(labeller) <> '' and lever_match between 0 and 3")
    return t.groupBy("run_id", F.lower(F.trim("labeller")).alias("who")).agg(F.max("lever_match").alias("lever"))


@query(f"""WITH {_LAB}, c AS (SELECT who FROM l GROUP BY who ORDER BY count(*) DESC, who LIMIT 1), k AS (SELECT run_id, lever FROM l SEMI JOIN c USING (who)),
m AS (SELECT who, count(*) AS runs, avg((l.lever=3)::INT) AS rate, avg((k.lever=3)::INT) AS control FROM l JOIN k USING (run_id) WHERE who NOT IN (SELECT who FROM c) GROUP BY who)
SELECT who, runs, round(rate,6) AS rate, round(control,6) AS control, round(rate-control,6) AS excess, rate-control>0.15 AS excluded FROM m""")
def excess_over_control(spark, sf):
    """How much oftener each labeller gives the top mark than the most frequent one does on the same runs."""
    l = _lab(spark, sf)
    c = l.groupBy("who").count().orderBy(F.desc("count"), "who").limit(1).select("who")
    k = l.join(F.broadcast(c), "who", "left_semi").select("run_id", F.col("lever").alias("base"))  # one row
    m = l.join(F.broadcast(c), "who", "left_anti").join(k, "run_id").groupBy("who").agg(F.count("*").alias("runs"), F.avg((F.col("lever") == 3).cast("int")).alias("rate"), F.avg((F.col("base") == 3).cast("int")).alias("control"))
    gap = F.col("rate") - F.col("control")
    return m.select("who", "runs", F.round("rate", 6).alias("rate"), F.round("control", 6).alias("control"), F.round(gap, 6).alias("excess"), (gap > 0.15).alias("excluded"))


@query(f"""WITH {_LAB}, h AS (SELECT run_id, avg(lever) FILTER (hash2) AS a, avg(lever) FILTER (NOT hash2) AS b FROM (SELECT *, substring(md5(who),1,1) IN ('0','1','2','3','4','5','6','7') AS hash2 FROM l) GROUP BY run_id)
SELECT count(*) AS runs, round(corr(a,b),6) AS half, round(2*corr(a,b)/(1+corr(a,b)),6) AS spearman_brown, round(avg(a)-avg(b),6) AS gap FROM h WHERE a IS NOT NULL AND b IS NOT NULL""")
def split_half_reliability(spark, sf):
    """Correlation of the run means of two halves of the labellers, and what it foretells for all of them."""
    l = _lab(spark, sf).withColumn("first", F.substring(F.md5("who"), 1, 1) < "8")
    h = l.groupBy("run_id").agg(F.avg(F.when(F.col("first"), F.col("lever"))).alias("a"), F.avg(F.when(~F.col("first"), F.col("lever"))).alias("b")).where("a is not null and b is not null")
    r = F.corr("a", "b")
    return h.agg(F.count("*").alias("runs"), F.round(r, 6).alias("half"), F.round(2 * r / (1 + r), 6).alias("spearman_brown"), F.round(F.avg("a") - F.avg("b"), 6).alias("gap"))


@query("""WITH d AS (SELECT l_orderkey, l_returnflag, avg(round(l_discount*10)) AS m FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, count(*) AS dimensions, round(4*avg(m),6) AS checklist FROM d GROUP BY 1),
c AS (SELECT l_orderkey, round(4*avg(round(l_discount*10)),6) AS core FROM lineitem WHERE l_linestatus='O' GROUP BY 1) SELECT l_orderkey, dimensions, checklist, core FROM s LEFT JOIN c USING (l_orderkey)""")
def checklist_scores(spark, sf):
    """Mean of the means of each dimension, times four; and of the core facts alone."""
    v = F.round(F.col("l_discount") * 10)
    li = table(spark, sf, "lineitem")
    s = li.groupBy("l_orderkey", "l_returnflag").agg(F.avg(v).alias("m")).groupBy("l_orderkey").agg(F.count("*").alias("dimensions"), F.round(4 * F.avg("m"), 6).alias("checklist"))
    core = li.where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.round(4 * F.avg(v), 6).alias("core"))
    return s.join(core, "l_orderkey", "left")


@query(f"""WITH d AS (SELECT DISTINCT doc_id, paper_id, unnest({TOKENS}) AS tok FROM documents WHERE text IS NOT NULL AND paper_id IS NOT NULL), n AS (SELECT count(DISTINCT doc_id) AS n FROM d),
f AS (SELECT tok, count(*) AS df FROM d GROUP BY tok), q AS (SELECT DISTINCT item_id, paper_id, unnest({TOKENS}) AS tok FROM heldout_items WHERE text IS NOT NULL), v AS (SELECT item_id, paper_id, tok FROM q JOIN f USING (tok), n WHERE df<=n*0.01),
h AS (SELECT DISTINCT v.item_id, v.paper_id AS own, d.doc_id, d.paper_id FROM v JOIN d USING (tok)), p AS (SELECT paper_id, count(DISTINCT doc_id) AS docs FROM d GROUP BY 1),
s AS (SELECT i.item_id, coalesce(count(h.doc_id) FILTER (h.paper_id=i.paper_id),0)/any_value(p.docs) AS own, coalesce(count(h.doc_id) FILTER (h.paper_id<>i.paper_id),0)/(any_value(n)-any_value(p.docs)) AS control
 FROM (SELECT DISTINCT item_id, paper_id FROM v) i JOIN p ON p.paper_id=i.paper_id LEFT JOIN h ON h.item_id=i.item_id, n GROUP BY i.item_id)
SELECT count(*) AS items, round(avg(own),6) AS own_share, round(avg(control),6) AS control_share, round(avg(own)/avg(control),4) AS ratio FROM s""")
def leakage_excess(spark, sf):
    """How much oftener the documents of an item's own paper hold a rare word of it than those of other papers."""
    d = table(spark, sf, "documents").where("text is not null and paper_id is not null").select("doc_id", "paper_id", F.explode(F.array_distinct(X.tokens("text"))).alias("tok")).distinct()
    docs = d.groupBy("paper_id").agg(F.count_distinct("doc_id").alias("docs"))
    n = docs.agg(F.sum("docs").alias("n"))  # one row
    q = table(spark, sf, "heldout_items").where("text is not null").select("item_id", "paper_id", F.explode(F.array_distinct(X.tokens("text"))).alias("tok"))
    asked = d.join(q.select("tok").distinct(), "tok", "left_semi")
    rare = asked.groupBy("tok").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where("df <= n * 0.01").select("tok")
    v = q.join(rare, "tok", "left_semi")
    h = v.select("item_id", F.col("paper_id").alias("own"), "tok").join(asked, "tok").select("item_id", "own", "doc_id", "paper_id").distinct()
    hits = h.groupBy("item_id").agg(F.count_if(F.col("paper_id") == F.col("own")).alias("mine"), F.count_if(F.col("paper_id") != F.col("own")).alias("others"))
    s = v.select("item_id", "paper_id").distinct().join(docs, "paper_id").join(hits, "item_id", "left").crossJoin(F.broadcast(n))
    own, control = F.coalesce("mine", F.lit(0)) / F.col("docs"), F.coalesce("others", F.lit(0)) / (F.col("n") - F.col("docs"))
    return s.select(own.alias("o"), control.alias("c")).agg(F.count("*").alias("items"), F.round(F.avg("o"), 6).alias("own_share"), F.round(F.avg("c"), 6).alias("control_share"), F.round(F.avg("o") / F.avg("c"), 4).alias("ratio"))


_GRAPH = """r AS (SELECT DISTINCT relation_id, lower(trim(relation_type)) AS type, source_entity_id AS source, t AS target, confidence FROM (SELECT *, unnest(CASE WHEN len(coalesce(target_entity_ids,[]))=0 THEN [NULL] ELSE target_entity_ids END) AS t FROM evidence_relations)),
m AS (SELECT *, CASE WHEN relation_id IS NULL THEN 'no id' WHEN source IS NULL THEN 'no source' WHEN target IS NULL THEN 'no target' WHEN source=target THEN 'to itself' WHEN coalesce(type,'')='' THEN 'no type' END AS reason FROM r),
e AS (SELECT source, target, type, count(DISTINCT relation_id) AS relations, max(confidence) AS confidence FROM m WHERE reason IS NULL GROUP BY ALL)"""


@query(f"WITH {_GRAPH} SELECT * FROM e")
def typed_edges(spark, sf):
    return V.typed_graph(table(spark, sf, "evidence_relations"))[1]


@query(f"WITH {_GRAPH} SELECT id, split_part(id,'::',1) AS paper, min(type) AS first_type, count(*) AS degree FROM (SELECT source AS id, type FROM e UNION ALL SELECT target, type FROM e) GROUP BY id")
def typed_nodes(spark, sf):
    return V.typed_graph(table(spark, sf, "evidence_relations"))[0]


@query(f"WITH {_GRAPH} SELECT reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY 1")
def typed_graph_drops(spark, sf):
    return V.typed_graph(table(spark, sf, "evidence_relations"))[2]


@query("""WITH s AS (SELECT DISTINCT unit_id, paper_id FROM evidence_units WHERE unit_id IS NOT NULL), r AS (SELECT DISTINCT relation_id, source_entity_id AS cited FROM evidence_relations WHERE relation_id IS NOT NULL AND source_entity_id IS NOT NULL)
SELECT CASE WHEN e.id IS NOT NULL THEN 'same record' WHEN p.paper_id IS NOT NULL THEN 'same paper' ELSE 'neither' END AS slip, count(*) AS n FROM r LEFT JOIN (SELECT DISTINCT target AS id FROM (SELECT unnest(target_entity_ids) AS target FROM evidence_relations)) e ON e.id=r.cited
 LEFT JOIN (SELECT DISTINCT paper_id FROM s) p ON p.paper_id=split_part(r.cited,'::',1) GROUP BY 1""")
def citation_slips(spark, sf):
    """Entities that relations cite: also a target, of a paper that has units, or neither."""
    rel = table(spark, sf, "evidence_relations")
    r = rel.where("relation_id is not null and source_entity_id is not null").select("relation_id", F.col("source_entity_id").alias("cited")).distinct()
    e = rel.select(F.explode("target_entity_ids").alias("cited")).distinct().withColumn("there", F.lit(True))
    p = table(spark, sf, "evidence_units").where("unit_id is not null").select(F.col("paper_id").alias("paper")).distinct().withColumn("known", F.lit(True))
    rows = r.withColumn("paper", F.substring_index("cited", "::", 1)).join(e, "cited", "left").join(p, "paper", "left")
    return rows.groupBy(F.when(F.col("there"), "same record").when(F.col("known"), "same paper").otherwise("neither").alias("slip")).agg(F.count("*").alias("n"))


@query(f"""WITH {_LAB}, p AS (SELECT a.who AS first, b.who AS second, a.lever AS x, b.lever AS y FROM l a JOIN l b ON a.run_id=b.run_id AND a.who<b.who)
SELECT first, second, count(*) AS runs, count(*) FILTER (x=3 AND y=3 OR greatest(x,y)=3 AND least(x,y)=0) AS flagged FROM p GROUP BY ALL""")
def auditor_flags(spark, sf):
    """Runs that two labellers both give the top mark, or one the top and the other the lowest; a run has at most nine labellers."""
    l = _lab(spark, sf)
    a, b = l.select("run_id", F.col("who").alias("first"), F.col("lever").alias("x")), l.select("run_id", F.col("who").alias("second"), F.col("lever").alias("y"))
    flag = ((F.col("x") == 3) & (F.col("y") == 3)) | ((F.greatest("x", "y") == 3) & (F.least("x", "y") == 0))
    return a.join(b, "run_id").where("first < second").groupBy("first", "second").agg(F.count("*").alias("runs"), F.count_if(flag).alias("flagged"))


@query(f"""WITH {_LAB}, r AS (SELECT run_id, who, lever, rank() OVER (PARTITION BY who ORDER BY lever DESC)+(count(*) OVER (PARTITION BY who, lever)-1)/2.0 AS rank, count(*) OVER (PARTITION BY who) AS n FROM l)
SELECT run_id, count(*) AS critics, round(avg(rank/n),6) AS mean_rank, round(avg(lever),6) AS mean_score FROM r GROUP BY run_id""")
def rank_aggregation(spark, sf):
    """Runs by their mean rank over their critics (as a share of what each critic ranked), with the mean score to break ties."""
    counts = _lab(spark, sf)
    # Average ranks from counts by critic and score, so that no critic's runs are sorted in one task.
    w = Window.partitionBy("who").orderBy(F.desc("lever"))
    cells = counts.groupBy("who", "lever").agg(F.count("*").alias("c"))
    ranks = cells.select("who", "lever", (F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c") + (F.col("c") + 1) / 2).alias("rank"), F.sum("c").over(Window.partitionBy("who")).alias("n"))
    r = counts.join(ranks, ["who", "lever"])
    return r.groupBy("run_id").agg(F.count("*").alias("critics"), F.round(F.avg(F.col("rank") / F.col("n")), 6).alias("mean_rank"), F.round(F.avg("lever"), 6).alias("mean_score"))


@query(f"""WITH {_LAB}, m AS (SELECT run_id, mode() WITHIN GROUP (ORDER BY lever) AS dummy, count(*) AS n, count(DISTINCT lever) AS kinds, max(c) AS top, count(*) FILTER (c>=2) AS shared FROM (SELECT *, count(*) OVER (PARTITION BY run_id, lever) AS c FROM l) GROUP BY run_id)
SELECT n AS drafts, count(*) AS runs, round(avg((kinds=1)::INT),6) AS unanimous, round(avg((top*2>n)::INT),6) AS majority, round(avg(shared/n),6) AS shared FROM m GROUP BY n""")
def draft_agreement(spark, sf):
    """For runs with as many labels: how often they are unanimous, have a majority, and the share of labels that another one repeats."""
    l = _lab(spark, sf)
    c = l.groupBy("run_id", "lever").agg(F.count("*").alias("c"))
    m = c.groupBy("run_id").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.max("c").alias("top"), F.sum(F.when(F.col("c") >= 2, F.col("c")).otherwise(0)).alias("shared"))
    six = lambda x: F.round(F.avg(x), 6)
    return m.groupBy(F.col("n").alias("drafts")).agg(F.count("*").alias("runs"), six((F.col("kinds") == 1).cast("int")).alias("unanimous"), six((F.col("top") * 2 > F.col("n")).cast("int")).alias("majority"), six(F.col("shared") / F.col("n")).alias("shared"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber AS choice, l_extendedprice AS gain FROM lineitem), v AS (SELECT o_orderkey, 1 + o_custkey%9 AS wanted FROM orders)
SELECT o_orderkey, coalesce(max(choice) FILTER (choice=wanted), min(choice)) AS chosen, count(*) FILTER (choice=wanted)>0 AS valid FROM v JOIN c ON l_orderkey=o_orderkey GROUP BY 1""")
def routed_choice(spark, sf):
    """The choice made outside where it is one of a unit's candidates, else its first candidate."""
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_custkey") % 9).alias("wanted"))
    c = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("choice")).join(v, "l_orderkey")
    right = F.col("choice") == F.col("wanted")
    return c.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.coalesce(F.max(F.when(right, F.col("choice"))), F.min("choice")).alias("chosen"), (F.count_if(right) > 0).alias("valid"))


@query("""WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity<10 THEN 'weak' WHEN l_discount>0.08 THEN 'off topic' END AS reason, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_discount) AS i FROM lineitem),
p AS (SELECT *, sum((reason IS NULL)::INT) OVER (PARTITION BY l_suppkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT l_suppkey, coalesce(reason,'selected') AS outcome, count(*) AS n FROM p WHERE coalesce(before,0)<20 GROUP BY ALL""")
def graded_selection(spark, sf):
    """Up to twenty accepted lines a supplier by quantity, and why those tried on the way were turned down."""
    reason = F.when(F.col("l_quantity") < 10, "weak").when(F.col("l_discount") > 0.08, "off topic")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    p = table(spark, sf, "lineitem").withColumn("reason", reason).withColumn("before", F.sum(F.col("reason").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return p.where("coalesce(before, 0) < 20").groupBy("l_suppkey", F.coalesce("reason", F.lit("selected")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT source_entity_id AS source, unnest(target_entity_ids) AS target, lower(trim(relation_type)) AS type FROM evidence_relations), e AS (SELECT * FROM r WHERE source IS NOT NULL AND target IS NOT NULL),
o AS (SELECT source AS id, target AS other, type, 'out' AS way FROM e UNION ALL SELECT target, source, type, 'in' FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY other, type NULLS FIRST) AS i FROM o)
SELECT id, way, count(*) AS shown, md5(string_agg(other, '|' ORDER BY i)) AS others_hash FROM k WHERE i<=10 GROUP BY ALL""")
def neighbours_of(spark, sf):
    """The first ten neighbours of every entity in either direction, in order; further ones are not shown."""
    r = table(spark, sf, "evidence_relations").select(F.col("source_entity_id").alias("source"), F.explode("target_entity_ids").alias("target"), F.lower(F.trim("relation_type")).alias("type")).distinct().where("source is not null and target is not null")
    o = r.select(F.col("source").alias("id"), F.col("target").alias("other"), "type", F.lit("out").alias("way")).unionByName(r.select(F.col("target").alias("id"), F.col("source").alias("other"), "type", F.lit("in").alias("way")))
    k = o.withColumn("i", F.row_number().over(Window.partitionBy("id", "way").orderBy("other", "type"))).where("i <= 10")
    return k.groupBy("id", "way").agg(F.count("*").alias("shown"), F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("i", "other")))["other"], "|")).alias("others_hash"))


@query("""WITH d AS (SELECT doc_id, publication_date, source FROM documents), k AS (SELECT source, least(8, greatest(1, count(*)%11)) AS k FROM d GROUP BY 1)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY publication_date NULLS FIRST, doc_id) AS place FROM d JOIN k USING (source) QUALIFY place<=k""")
def corpus_listing(spark, sf):
    """The first documents of each source by date, as many as are asked for, from one to eight."""
    d = table(spark, sf, "documents").select("doc_id", "publication_date", "source")
    k = d.groupBy("source").agg(F.least(F.lit(8), F.greatest(F.lit(1), F.count("*") % 11)).alias("k"))
    w = Window.partitionBy("source").orderBy("publication_date", "doc_id")
    return d.withColumn("place", F.row_number().over(w)).where("place <= 8").join(k, "source").where("place <= k").select("source", "doc_id", "place")


@query("""WITH u AS (SELECT DISTINCT unit_id, material, intervention, structure, outcome, conditions, comparison FROM evidence_units WHERE unit_id IS NOT NULL)
SELECT unit_id, md5(concat_ws(' ', array_to_string(map_values(material),' '), array_to_string(map_values(intervention),' '), array_to_string(map_values(structure),' '), array_to_string(map_values(outcome),' '), array_to_string(map_values(conditions),' '), array_to_string(map_values(comparison),' '))) AS flat_hash FROM u""")
def flattened_units(spark, sf):
    """All values of a unit's maps in one text."""
    maps = ["material", "intervention", "structure", "outcome", "conditions", "comparison"]
    u = table(spark, sf, "evidence_units").where("unit_id is not null").withColumn("key", F.concat_ws("\x1f", *(F.to_json(m) for m in maps)))
    flat = F.concat_ws(" ", *(F.array_join(F.map_values(m), " ") for m in maps))
    return u.select("unit_id", F.md5(flat).alias("flat_hash"), *(F.to_json(m).alias(f"_{m}") for m in maps)).distinct().select("unit_id", "flat_hash")


@query(f"""WITH {_UNITS} SELECT unit_id, ({_FILLED.format('material')}) AS has_material, ({_FILLED.format('conditions')}) AS has_conditions, ({_FILLED.format('comparison')}) AS has_comparison FROM u""")
def presence_flags(spark, sf):
    """Whether a unit's maps hold anything but fillers."""
    return _units(spark, sf).select("unit_id", *(V.filled(c).alias(f"has_{c}") for c in ("material", "conditions", "comparison")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round((coalesce(a,0)+coalesce(b,0)+coalesce(c,0))/nullif((a IS NOT NULL)::INT+(b IS NOT NULL)::INT+(c IS NOT NULL)::INT,0),6) AS score FROM
 (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag<>'N' THEN l_quantity END AS a, CASE WHEN l_discount>0 THEN l_discount*100 END AS b, CASE WHEN l_tax>0 THEN l_tax*100 END AS c FROM lineitem)""")
def row_means(spark, sf):
    """Mean of the scores a row has."""
    v = F.array(F.when(F.col("l_returnflag") != "N", F.col("l_quantity")), F.when(F.col("l_discount") > 0, F.col("l_discount") * 100), F.when(F.col("l_tax") > 0, F.col("l_tax") * 100))
    kept = F.filter(v, lambda x: x.isNotNull())
    mean = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.when(F.size(kept) > 0, F.size(kept))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(mean, 6).alias("score"))


@query("""WITH e AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity<5 THEN 'too few' WHEN l_discount>0.09 THEN 'too cheap' ELSE 'fine' END AS error FROM lineitem), t AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM e GROUP BY ALL)
SELECT l_returnflag, l_linestatus, error, round(count(*)/any_value(n),6) AS share FROM e JOIN t USING (l_returnflag, l_linestatus) GROUP BY ALL""")
def error_shares(spark, sf):
    """Shares of the kinds of error within each stratum."""
    error = F.when(F.col("l_quantity") < 5, "too few").when(F.col("l_discount") > 0.09, "too cheap").otherwise("fine")
    c = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", error.alias("error")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("l_returnflag", "l_linestatus"))
    return c.select("l_returnflag", "l_linestatus", "error", F.round(F.col("c") / total, 6).alias("share"))


@query("""WITH x AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) FILTER (year(l_shipdate)=1998) - avg(l_quantity) FILTER (year(l_shipdate)=1997) AS d FROM lineitem GROUP BY ALL),
c AS (SELECT l_returnflag, count(*) AS n, avg(d) AS mean, count(*) FILTER (d>0) AS up, count(*) FILTER (d<0) AS down FROM x WHERE d IS NOT NULL GROUP BY 1)
SELECT l_returnflag, n, round(mean,6) AS mean, up, down FROM c""")
def subgroup_contrasts(spark, sf):
    """The paired difference of two years over suppliers, by return flag, with how often it is up and down."""
    li = table(spark, sf, "lineitem").withColumn("arm", F.year("l_shipdate"))
    side = lambda y: F.avg(F.when(F.col("arm") == y, F.col("l_quantity")))
    d = li.groupBy("l_returnflag", "l_suppkey").agg((side(1998) - side(1997)).alias("d")).where("d is not null")
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))


@query("""WITH d AS (SELECT doc_id, source, length(text) AS x, len(regexp_extract_all(text,'[.!?]')) AS y FROM documents WHERE text IS NOT NULL), r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY x)+(count(*) OVER (PARTITION BY source,x)-1)/2.0 AS rx, rank() OVER (PARTITION BY source ORDER BY y)+(count(*) OVER (PARTITION BY source,y)-1)/2.0 AS ry FROM d),
w AS (SELECT source, CASE WHEN count(*)>=3 AND NOT isnan(corr(rx,ry)) THEN corr(rx,ry) END AS rho FROM r GROUP BY source)
SELECT count(rho) AS sources, round(median(rho),6) AS median_rho, round(min(rho),6) AS lowest, round(max(rho),6) AS highest FROM w""")
def style_bias(spark, sf):
    """Rank correlation of length and stops within each source, and its median over sources."""
    d = table(spark, sf, "documents").where("text is not null").select("source", F.length("text").alias("x"), F.size(F.regexp_extract_all("text", F.lit("[.!?]"), F.lit(0))).alias("y"))
    w = S.spearman(d, "x", "y", "source")
    return w.agg(F.count("rho").alias("sources"), F.round(F.percentile("rho", F.lit(0.5)), 6).alias("median_rho"), F.round(F.min("rho"), 6).alias("lowest"), F.round(F.max("rho"), 6).alias("highest"))


@query("""WITH a AS (SELECT l_orderkey, count(*) AS budget, avg(l_discount) AS score, avg((l_returnflag='R')::INT) AS returned FROM lineitem GROUP BY 1), p AS (SELECT budget, count(*) AS n, avg(score) AS score, avg(returned) AS returned FROM a GROUP BY 1)
SELECT budget, n, round(score,6) AS score, round(returned,6) AS returned, round(score - first_value(score) OVER (ORDER BY budget),6) AS vs_base FROM p""")
def budget_profile(spark, sf):
    """Means along an ordered list of budgets (lines an order), each against the smallest."""
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("budget"), F.avg("l_discount").alias("score"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    p = a.groupBy("budget").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("returned").alias("r"))
    base = F.first("s").over(Window.partitionBy(F.lit(0)).orderBy("budget"))  # one row a budget
    return p.select("budget", "n", F.round("s", 6).alias("score"), F.round("r", 6).alias("returned"), F.round(F.col("s") - base, 6).alias("vs_base"))


@query("""WITH a AS (SELECT l_suppkey AS paper, l_linenumber AS sample, avg(l_quantity) AS v, max(l_discount)>=0.09 AS rich FROM lineitem WHERE l_linestatus='O' GROUP BY ALL), b AS (SELECT l_suppkey AS paper, l_linenumber AS sample, avg(l_quantity) AS v FROM lineitem WHERE l_linestatus='F' GROUP BY ALL)
SELECT rich, count(*) AS pairs, round(avg(a.v-b.v),6) AS uptake FROM a JOIN b USING (paper, sample) GROUP BY rich""")
def uptake_contrasts(spark, sf):
    """The difference to the control run of the same paper and sample, split by what the run was given."""
    li = table(spark, sf, "lineitem")
    key = [F.col("l_suppkey").alias("paper"), F.col("l_linenumber").alias("sample")]
    a = li.where("l_linestatus = 'O'").groupBy(*key).agg(F.avg("l_quantity").alias("v"), (F.max("l_discount") >= 0.09).alias("rich"))
    b = li.where("l_linestatus = 'F'").groupBy(*key).agg(F.avg("l_quantity").alias("w"))
    return a.join(b, ["paper", "sample"]).groupBy("rich").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("v") - F.col("w")), 6).alias("uptake"))


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS round FROM events), f AS (SELECT user_id, event_type, min(round) FILTER (value>15) AS accepted, max(value)=min(value) AS tied FROM e GROUP BY ALL)
SELECT event_type, count(*) AS loops, count(*) FILTER (accepted=1) AS at_once, count(accepted) AS ever, round(avg(accepted),6) AS mean_rounds, round(avg(tied::INT),6) AS tied FROM f GROUP BY 1""")
def loop_diagnostics(spark, sf):
    """How many rounds loops take to be accepted, how many at once, and how many never rise."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("round", F.row_number().over(w))
    f = e.groupBy("user_id", "event_type").agg(F.min(F.when(F.col("value") > 15, F.col("round"))).alias("accepted"), (F.max("value") == F.min("value")).alias("tied"))
    return f.groupBy("event_type").agg(F.count("*").alias("loops"), F.count_if(F.col("accepted") == 1).alias("at_once"), F.count("accepted").alias("ever"), F.round(F.avg("accepted"), 6).alias("mean_rounds"), F.round(F.avg(F.col("tied").cast("int")), 6).alias("tied"))


@query("""WITH v AS (SELECT lower(trim(judge)) AS judge, CASE WHEN new_won AND NOT baseline_won THEN 1.0 WHEN baseline_won AND NOT new_won THEN 0.0 WHEN NOT new_won AND NOT baseline_won THEN 0.5 END AS p, new_method, base_method, unit, lower(trim(pair_order))='new_first' AS first FROM pairwise_votes WHERE trim(judge)<>'' AND new_won IS NOT NULL AND baseline_won IS NOT NULL AND pair_order IS NOT NULL),
b AS (SELECT judge, new_method, base_method, unit, avg(p) FILTER (first) AS x, avg(p) FILTER (NOT first) AS y FROM v WHERE p IS NOT NULL GROUP BY ALL)
SELECT judge, count(*) AS pairs, round(avg(x),6) AS new_first, round(avg(y),6) AS base_first, count(*) FILTER (x<>0.5 AND y<>0.5) AS decided, count(*) FILTER (x<>0.5 AND y<>0.5 AND (x>0.5)=(y>0.5)) AS agree FROM b WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY judge""")
def rater_orders(spark, sf):
    """Each judge's mean vote in either order, and how often both orders, where neither is a tie, say the same."""
    p = F.when(F.col("new_won") & ~F.col("baseline_won"), 1.0).when(F.col("baseline_won") & ~F.col("new_won"), 0.0).when(~F.col("new_won") & ~F.col("baseline_won"), 0.5)
    v = table(spark, sf, "pairwise_votes").where("trim(judge) <> '' and new_won is not null and baseline_won is not null and pair_order is not null")
    v = v.select(F.lower(F.trim("judge")).alias("judge"), "new_method", "base_method", "unit", p.alias("p"), (F.lower(F.trim("pair_order")) == "new_first").alias("first")).where("p is not null")
    b = v.groupBy("judge", "new_method", "base_method", "unit").agg(F.avg(F.when(F.col("first"), F.col("p"))).alias("x"), F.avg(F.when(~F.col("first"), F.col("p"))).alias("y")).where("x is not null and y is not null")
    decided = (F.col("x") != 0.5) & (F.col("y") != 0.5)
    return b.groupBy("judge").agg(F.count("*").alias("pairs"), F.round(F.avg("x"), 6).alias("new_first"), F.round(F.avg("y"), 6).alias("base_first"), F.count_if(decided).alias("decided"), F.count_if(decided & ((F.col("x") > 0.5) == (F.col("y") > 0.5))).alias("agree"))


@query(r"""WITH q AS (SELECT item_id, regexp_replace(lower(text),'\s+',' ','g') AS text, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text),'\s+',' ','g'),'[,;.?!:]\s*'), lambda x: len(string_split(trim(x),' '))>=4)) AS quote FROM heldout_items WHERE text IS NOT NULL),
k AS (SELECT item_id, trim(quote) AS quote, min(position(trim(quote) IN text)) AS pos FROM q WHERE contains(text, trim(quote)) GROUP BY ALL)
SELECT item_id, count(*) AS niches, md5(string_agg(quote, '|' ORDER BY pos, quote)) AS niches_hash FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos, quote) AS i FROM k) WHERE i<=8 GROUP BY item_id""")
def verbatim_niches(spark, sf):
    """Up to eight phrases of four words or more that stand verbatim in a question, each once."""
    q = table(spark, sf, "heldout_items").where("text is not null").select("item_id", F.regexp_replace(F.lower("text"), r"\s+", " ").alias("text"))
    k = q.select("item_id", "text", F.explode(F.split("text", r"[,;.?!:]\s*")).alias("raw")).where(F.size(F.split(F.trim("raw"), " ")) >= 4).withColumn("quote", F.trim("raw")).where(F.contains("text", "quote"))
    k = k.groupBy("item_id", "quote").agg(F.min(F.expr("position(quote in text)")).alias("at"))
    i = k.withColumn("i", F.row_number().over(Window.partitionBy("item_id").orderBy("at", "quote"))).where("i <= 8")
    return i.groupBy("item_id").agg(F.count("*").alias("niches"), F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("i", "quote")))["quote"], "|")).alias("niches_hash"))


@query(f"""WITH c AS (SELECT relation_id, any_value(source_paper_id) AS paper, list_distinct({_tok('evidence_span')}) AS q FROM evidence_relations WHERE relation_id IS NOT NULL AND evidence_span IS NOT NULL GROUP BY relation_id, evidence_span, source_paper_id),
r AS (SELECT DISTINCT record_id, paper_id, text FROM retrieval_records WHERE record_id IS NOT NULL AND text IS NOT NULL), p AS (SELECT record_id, paper_id, list_distinct({TOKENS}) AS t FROM r),
s AS (SELECT relation_id, record_id, len(list_intersect(q,t)) AS overlap FROM c JOIN p ON c.paper=p.paper_id WHERE len(list_intersect(q,t))>0)
SELECT relation_id, record_id, overlap FROM s QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY overlap DESC, record_id)=1""")
def caption_passages(spark, sf):
    """The record of its paper that each relation's evidence shares most words with."""
    c = table(spark, sf, "evidence_relations").where("relation_id is not null and evidence_span is not null").select(F.col("relation_id").alias("caption_id"), F.col("source_paper_id").alias("paper_id"), "evidence_span").distinct()
    p = table(spark, sf, "retrieval_records").where("record_id is not null and text is not null").select(F.col("record_id").alias("passage_id"), "paper_id", "text").distinct()
    found = V.best_overlap(c.withColumn("q_tokens", X.tokens("evidence_span")), p.withColumn("t_tokens", X.tokens("text")))
    return found.select(F.col("caption_id").alias("relation_id"), F.col("passage_id").alias("record_id"), F.col("overlap").cast("long").alias("overlap"))


@query(f"""WITH b AS (SELECT item_id, ('0x'||substring(md5(tok),1,2))::INT AS b, count(*) AS c FROM (SELECT item_id, unnest({TOKENS}) AS tok FROM heldout_items) GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(c*c)) AS norm FROM b GROUP BY 1) SELECT item_id, count(*) AS buckets, arg_min(b, {{'c': -c, 'b': b}}) AS top, round(max(c)/any_value(norm),6) AS weight FROM b JOIN n USING (item_id) GROUP BY item_id""")
def hashed_vectors(spark, sf):
    """The 256 hashed token counts of each item, as their number of buckets and the heaviest one."""
    v = V.hashed_vectors(table(spark, sf, "heldout_items").select("item_id", "text"), "item_id", "text")
    top = F.min_by("bucket", F.struct(-F.col("weight"), "bucket"))
    return v.groupBy("item_id").agg(F.count("*").alias("buckets"), top.alias("top"), F.round(F.max("weight"), 6).alias("weight"))


@query()
def swiss_standings(spark, sf):
    """Five Swiss rounds of all suppliers; the larger balance wins a pairing."""
    from argosift.operators.procedural import swiss

    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player"), "s_acctbal")
    bal = s.select(F.col("player").alias("p"), "s_acctbal")

    def beats(pairs):
        x, y = bal.withColumnsRenamed({"p": "a", "s_acctbal": "x"}), bal.withColumnsRenamed({"p": "b", "s_acctbal": "y"})
        return pairs.join(x, "a").join(y, "b").select("a", "b", F.when(F.col("x") > F.col("y"), 1.0).when(F.col("x") < F.col("y"), 0.0).otherwise(0.5).alias("got"))

    return swiss(s.select("player", F.xxhash64("player").alias("seed")), beats, 5)
