"""Queries on dates, eligibility, exclusion and leakage. Works are orders (o_custkey is the family), records are documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from argosift.operators import temporal as P
from argosift.plans.base import query
from argosift.runtime import table


def _works(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("string")).alias("family")
    )


_WORKS = "w AS (SELECT o_orderkey AS id, o_orderdate::DATE AS date, CASE WHEN o_custkey%7=0 THEN NULL ELSE o_custkey::VARCHAR END AS family FROM orders)"


@query(f"""WITH {_WORKS}, c AS (SELECT id, date AS cutoff, family FROM w)
SELECT c.id AS case_id, count(*) AS n_eligible, max(w.date)::VARCHAR AS newest FROM c JOIN w ON w.id<>c.id AND w.date<c.cutoff AND NOT (coalesce(c.family,'')<>'' AND coalesce(w.family,'')=c.family) GROUP BY c.id""")
def eligible_records(spark, sf):
    """For every order as a case: records before its date, not itself and not of its family; counted from ordered days, not from pairs."""
    w = _works(spark, sf)
    return P.eligible_counts(w, w).withColumn("newest", F.col("newest").cast("string"))


@query("SELECT CASE WHEN o_orderdate IS NULL THEN 'excluded_missing_date' WHEN year(o_orderdate)<=1995 THEN 'train' WHEN year(o_orderdate)=1997 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1")
def chrono_split(spark, sf):
    return table(spark, sf, "orders").groupBy(P.chronological_split(F.col("o_orderdate"), 1995, 1997).alias("split")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN publication_date IS NULL THEN 'unknown' WHEN publication_date<=DATE '2015-06-30' THEN 'eligible' ELSE 'ineligible' END AS status,
 CASE WHEN coalesce(publication_date, ingested_at::DATE) IS NULL THEN NULL ELSE least(coalesce(publication_date,ingested_at::DATE), coalesce(ingested_at::DATE,publication_date))::VARCHAR END AS earliest,
 CASE WHEN publication_date IS NULL AND ingested_at IS NULL THEN NULL WHEN ingested_at IS NULL OR publication_date<=ingested_at::DATE THEN 'publication' ELSE 'ingested' END AS earliest_source FROM documents""")
def cutoff_status(spark, sf):
    """Eligibility at a cutoff with an explicit unknown, and the earliest date with its source."""
    pub, got = F.col("publication_date"), F.to_date("ingested_at")
    status = F.when(pub.isNull(), "unknown").when(pub <= F.lit("2015-06-30").cast("date"), "eligible").otherwise("ineligible")
    source = F.when(pub.isNull() & got.isNull(), None).when(got.isNull() | (pub <= got), "publication").otherwise("ingested")
    return table(spark, sf, "documents").select("doc_id", status.alias("status"), F.least(pub, got).cast("string").alias("earliest"), source.alias("earliest_source"))


@query("SELECT doc_id, coalesce(paper_id, 'doc:'||doc_id) AS family, CASE WHEN paper_id IS NOT NULL THEN 'paper' ELSE 'fallback' END AS basis FROM documents")
def work_family(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.coalesce("paper_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("family"), F.when(F.col("paper_id").isNotNull(), "paper").otherwise("fallback").alias("basis"))


_REASON = """CASE WHEN paper_id IS NULL THEN 'no identifier' WHEN publication_date IS NULL THEN 'no date' WHEN publication_date>DATE '2018-01-01' THEN 'after cutoff'
 WHEN source IN ('web_capture','forum_thread') THEN 'source type' WHEN coalesce(length(text),0)<300 THEN 'too short' END"""


def _reason():
    return F.coalesce(
        F.when(F.col("paper_id").isNull(), "no identifier"),
        F.when(F.col("publication_date").isNull(), "no date"),
        F.when(F.col("publication_date") > F.lit("2018-01-01").cast("date"), "after cutoff"),
        F.when(F.col("source").isin("web_capture", "forum_thread"), "source type"),
        F.when(F.coalesce(F.length("text"), F.lit(0)) < 300, "too short"),
    )


@query(f"SELECT doc_id, {_REASON} AS reason FROM documents")
def admission_reasons(spark, sf):
    """The first rule that rejects a document; null where it is admitted."""
    return table(spark, sf, "documents").select("doc_id", _reason().alias("reason"))


@query(f"SELECT source, coalesce({_REASON},'admitted') AS outcome, count(*) AS n FROM documents GROUP BY ALL")
def screening_funnel(spark, sf):
    return table(spark, sf, "documents").groupBy("source", F.coalesce(_reason(), F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(length(text),0)<300 THEN 'short' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN n_chars IS NULL OR n_chars<>length(text) THEN 'stale length' END,
 CASE WHEN section IS NULL THEN 'no section' END], lambda x: x IS NOT NULL),'|') AS problems FROM documents""")
def problem_lists(spark, sf):
    """All rules that a document breaks."""
    rules = [
        F.when(F.coalesce(F.length("text"), F.lit(0)) < 300, "short"),
        F.when(F.col("lang").isNull(), "no language"),
        F.when(F.col("n_chars").isNull() | F.coalesce(F.col("n_chars") != F.length("text"), F.lit(False)), "stale length"),
        F.when(F.col("section").isNull(), "no section"),
    ]
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.filter(F.array(*rules), lambda x: x.isNotNull()), "|").alias("problems"))


@query("""SELECT o_orderkey, (o_orderdate::DATE - 1)::DATE::VARCHAR AS day_before, last_day(o_orderdate::DATE)::DATE::VARCHAR AS month_end, make_date(year(o_orderdate),12,31)::VARCHAR AS year_end,
 date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS gap, make_date(year(o_orderdate::DATE - INTERVAL 1 MONTH), month(o_orderdate::DATE - INTERVAL 1 MONTH), least(day(o_orderdate),28))::VARCHAR AS month_back FROM orders""")
def date_helpers(spark, sf):
    d = F.to_date("o_orderdate")
    back = F.add_months(d, -1)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_sub(d, 1).cast("string").alias("day_before"), F.last_day(d).cast("string").alias("month_end"), F.make_date(F.year(d), F.lit(12), F.lit(31)).cast("string").alias("year_end"),
        F.datediff(F.lit("1999-01-01").cast("date"), d).cast("long").alias("gap"), F.make_date(F.year(back), F.month(back), F.least(F.day(d), F.lit(28))).cast("string").alias("month_back"),
    )


@query("""SELECT s.l_orderkey AS run_id, count(*) AS n_seen, count(*) FILTER (o.o_orderdate IS NULL) AS n_unknown, count(*) FILTER (o.o_orderdate>=c.o_orderdate) AS n_late,
 count(*) FILTER (o.o_orderkey=c.o_orderkey) AS n_self, count(*) FILTER (o.o_custkey=c.o_custkey) AS n_family
 FROM lineitem s JOIN orders c ON c.o_orderkey=s.l_orderkey LEFT JOIN orders o ON o.o_orderkey=s.l_partkey GROUP BY 1""")
def leak_counters(spark, sf):
    """Per run: accessed records that are unknown, not before the cutoff, the case itself or of its family."""
    o = table(spark, sf, "orders")
    case = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("cutoff"), F.col("o_custkey").alias("family"))
    seen = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("o_orderkey")).join(case, "run_id")
    rows = seen.join(o.select("o_orderkey", "o_orderdate", "o_custkey"), "o_orderkey", "left")
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n_seen"), F.count_if(F.col("o_orderdate").isNull()).alias("n_unknown"), F.count_if(F.col("o_orderdate") >= F.col("cutoff")).alias("n_late"),
        F.count_if((F.col("o_orderkey") == F.col("run_id")) & F.col("o_orderdate").isNotNull()).alias("n_self"), F.count_if(F.col("o_custkey") == F.col("family")).alias("n_family"),
    )


@query("SELECT o.o_orderkey FROM orders o ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_linestatus='F') l ON l.l_orderkey=o.o_orderkey")
def pending_jobs(spark, sf):
    """Orders without a finished line: what a resumed run still has to do."""
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""WITH e AS (SELECT c_custkey AS k FROM customer), a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice>100000)
SELECT 'missing' AS kind, k FROM e WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT 'unexpected', k FROM a WHERE k NOT IN (SELECT k FROM e)""")
def missing_unexpected(spark, sf):
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    actual = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")).distinct()
    return expected.join(actual, "k", "left_anti").select(F.lit("missing").alias("kind"), "k").unionByName(actual.join(expected, "k", "left_anti").select(F.lit("unexpected").alias("kind"), "k"))


@query("""SELECT r.r_regionkey, n.n_nationkey, p.prio FROM region r, nation n, (SELECT DISTINCT o_orderpriority AS prio FROM orders) p
 WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN customer c ON c.c_custkey=o.o_custkey JOIN nation x ON x.n_nationkey=c.c_nationkey WHERE x.n_nationkey=n.n_nationkey AND x.n_regionkey=r.r_regionkey AND o.o_orderpriority=p.prio)""")
def matrix_completeness(spark, sf):
    """Cells of the full product of three dimensions that have no row (the dimensions are small tables)."""
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    there = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", F.col("o_orderpriority").alias("prio")).distinct()
    dims = table(spark, sf, "region").select("r_regionkey").crossJoin(n.select("n_nationkey")).crossJoin(o.select(F.col("o_orderpriority").alias("prio")).distinct())
    return dims.join(there, ["r_regionkey", "n_nationkey", "prio"], "left_anti")


@query("""SELECT event_type, md5(min(event_id)::VARCHAR) AS first_hash, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events) WHERE i=1 GROUP BY event_type""")
def write_once_first(spark, sf):
    """First writer wins for each (user, type)."""
    e = table(spark, sf, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.groupBy("event_type").agg(F.md5(F.min("f.event_id").cast("string")).alias("first_hash"), F.count("*").alias("n"))


@query("""SELECT split_part(source_entity_id,'::',1) AS paper, CASE WHEN source_entity_id IS NULL THEN 'no source' WHEN len(coalesce(target_entity_ids,[]))=0 THEN 'no target' WHEN confidence IS NULL THEN 'no confidence'
 WHEN confidence<0 OR confidence>1 THEN 'confidence out of range' WHEN coalesce(trim(evidence_span),'')='' THEN 'no span' END AS reason, count(*) AS n FROM evidence_relations GROUP BY ALL""")
def relation_validation(spark, sf):
    """Relations by paper and the first check they fail."""
    reason = F.coalesce(
        F.when(F.col("source_entity_id").isNull(), "no source"), F.when(F.size(F.coalesce("target_entity_ids", F.array().cast("array<string>"))) == 0, "no target"), F.when(F.col("confidence").isNull(), "no confidence"),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range"), F.when(F.coalesce(F.trim("evidence_span"), F.lit("")) == "", "no span"),
    )
    return table(spark, sf, "evidence_relations").groupBy(F.substring_index("source_entity_id", "::", 1).alias("paper"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT unit_id, paper_id, unnest(evidence_spans) AS span FROM evidence_units WHERE unit_id IS NOT NULL),
r AS (SELECT DISTINCT paper_id, text FROM retrieval_records WHERE text IS NOT NULL),
h AS (SELECT u.unit_id, u.span, bool_or(contains(r.text,u.span)) AS grounded FROM u LEFT JOIN r ON r.paper_id=u.paper_id WHERE u.span IS NOT NULL GROUP BY ALL)
SELECT unit_id, count(*) AS n_spans, count(*) FILTER (coalesce(grounded,false)) AS n_grounded FROM h GROUP BY unit_id""")
def span_grounding(spark, sf):
    """Spans of each unit that stand verbatim in a record of the same paper."""
    return P.grounded_spans(table(spark, sf, "evidence_units"), table(spark, sf, "retrieval_records"))
