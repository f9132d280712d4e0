"""Queries on retrieval, capped top-k, packing and similarity."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from argosift.functions import text as X
from argosift.operators import retrieve as R
from argosift.operators import similarity as M
from argosift.operators.ordering import numbered
from argosift.plans.base import query
from argosift.plans.text_queries import TOKENS
from argosift.runtime import table

_BM25 = f"""d AS (SELECT doc_id, source, publication_date, {TOKENS} AS ts, len({TOKENS}) AS dl FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM d),
q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS tok FROM heldout_items),
tf AS (SELECT doc_id, dl, tok, count(*) AS tf FROM (SELECT doc_id, dl, unnest(ts) AS tok FROM d) WHERE tok IN (SELECT tok FROM q) GROUP BY ALL),
f AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
s AS (SELECT item_id, doc_id, sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*dl/avg_dl))) AS score FROM q JOIN tf USING (tok) JOIN f USING (tok), n GROUP BY ALL)"""


def _bm25(spark, sf):
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "heldout_items").select("item_id", "text")
    return R.bm25(docs, items, "doc_id", "item_id")




@query(f"""WITH {_BM25}, c AS (SELECT item_id, doc_id, round(score,6) AS score, row_number() OVER (PARTITION BY item_id, source ORDER BY round(score,6) DESC, doc_id) AS i FROM s JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM c WHERE i<=2) SELECT item_id, doc_id, score, place FROM r WHERE place<=5""")
def bm25_topk(spark, sf):
    """Five best documents an item, at most two a source."""
    docs, items = table(spark, sf, "documents").select("doc_id", "text", "source"), table(spark, sf, "heldout_items").select("item_id", "text")
    return R.bm25_best(docs, items, "doc_id", "item_id", 5, 2, "source")


@query(f"""WITH dt AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS tok FROM documents) GROUP BY ALL),
qt AS (SELECT item_id, tok, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS tok FROM heldout_items) GROUP BY ALL),
m AS (SELECT item_id, doc_id, sum(least(tf,qtf)) AS m FROM dt JOIN qt USING (tok) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(2*m/ql+m/sqrt(dl),6) AS score FROM m JOIN (SELECT doc_id, sum(tf) AS dl FROM dt GROUP BY 1) USING (doc_id) JOIN (SELECT item_id, sum(qtf) AS ql FROM qt GROUP BY 1) USING (item_id))
SELECT * FROM (SELECT item_id, s.doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, publication_date NULLS FIRST, s.doc_id) AS place FROM s JOIN documents d ON d.doc_id=s.doc_id) WHERE place<=5""")
def coverage_density_topk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "publication_date")
    return R.coverage_best(docs, table(spark, sf, "heldout_items").select("item_id", "text"), "doc_id", "item_id", 5, tie="publication_date")


@query(rf"""WITH {_BM25}, w AS (SELECT item_id, s.doc_id, round(score*CASE WHEN section IN ('Results','Discussion','Conclusion') THEN 1.2 WHEN section IN ('Supporting Information') THEN 0.8 ELSE 1.0 END
 * CASE WHEN regexp_matches(lower(text),'\b(?:reported|repeated|measured|revealed|propose)\b') THEN 1.5 ELSE 1.0 END,6) AS score FROM s JOIN documents x ON x.doc_id=s.doc_id)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM w) WHERE place<=3""")
def salience_topk(spark, sf):
    """BM25 weighed by section and by words of action."""
    place = F.when(F.col("section").isin("Results", "Discussion", "Conclusion"), 1.2).when(F.col("section") == "Supporting Information", 0.8).otherwise(1.0)
    action = F.when(F.lower("text").rlike(r"(?U)\b(?:reported|repeated|measured|revealed|propose)\b"), 1.5).otherwise(1.0)
    docs = table(spark, sf, "documents").select("doc_id", "text", (place * action).alias("weight"))
    return R.bm25_best(docs, table(spark, sf, "heldout_items").select("item_id", "text"), "doc_id", "item_id", 3, factor="weight")


@query(f"""WITH {_BM25}, c AS (SELECT item_id, source, count(*) AS n_hits, round(max(score),6) AS best, round(avg(score),6) AS mean FROM s JOIN d USING (doc_id) GROUP BY ALL)
SELECT * FROM c""")
def support_features(spark, sf):
    """How much support each item finds in each source."""
    s = _bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return s.groupBy("item_id", "source").agg(F.count("*").alias("n_hits"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS i, length(text) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, doc_id) AS place FROM r WHERE i<=2) SELECT doc_id, source, n, place FROM k WHERE place<=10""")
def topk_per_source_cap(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return R.top_k(d, 10, [F.desc("n"), F.col("doc_id")], [], 2, "source")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, least(length(text),1600) AS s, row_number() OVER (PARTITION BY source ORDER BY publication_date DESC NULLS LAST, doc_id) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT source, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS doc_id FROM (SELECT DISTINCT source FROM o)
 UNION ALL SELECT f.source, o.i, CASE WHEN ok THEN used+s ELSE used END, CASE WHEN ok THEN n+1 ELSE n END, CASE WHEN ok THEN o.doc_id END
 FROM (SELECT f.source, f.used, f.n, f.i+1 AS i2, (n<24 AND used<15800 AND used+o.s<=16000) AS ok FROM f JOIN o ON o.source=f.source AND o.i=f.i+1) f JOIN o ON o.source=f.source AND o.i=f.i2)
SELECT source, doc_id, n AS place, used FROM f WHERE doc_id IS NOT NULL""")
def greedy_budget_pack(spark, sf):
    """Newest documents of each source, each cut to 1,600 characters, into 16,000."""
    d = table(spark, sf, "documents").where("text is not null").select("source", "doc_id", F.length("text").alias("n"), (-F.coalesce(F.unix_date("publication_date"), F.lit(-10**8))).alias("o"))
    return R.greedy_pack(d, "source", ["o", "doc_id"], "doc_id", "n", 16_000, 1_600, 24).withColumn("place", F.col("place").cast("long"))


@query("""WITH o AS (SELECT paper_id, doc_id, sum(length(text)) OVER (PARTITION BY paper_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE text IS NOT NULL AND paper_id IS NOT NULL)
SELECT paper_id, doc_id, CAST(used AS BIGINT) AS used FROM o WHERE used<=20000""")
def prefix_budget_pack(spark, sf):
    d = table(spark, sf, "documents").where("text is not null and paper_id is not null").select("paper_id", "doc_id", F.length("text").cast("long").alias("n"))
    return R.prefix_pack(d, ["paper_id"], [F.col("doc_id")], "n", 20_000).select("paper_id", "doc_id", "used")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS round FROM orders)
SELECT o_custkey, o_orderkey, round, row_number() OVER (ORDER BY round, o_custkey, o_orderkey) AS place FROM r QUALIFY place<=500""")
def round_robin_take(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.round_robin(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey", 500).select("o_custkey", "o_orderkey", "round", "place")


@query("""WITH u AS (SELECT doc_id, 1 AS stage, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS pos FROM documents WHERE text IS NOT NULL QUALIFY pos<=50
 UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY publication_date DESC NULLS LAST, doc_id) AS pos FROM documents WHERE text IS NOT NULL QUALIFY pos<=50)
SELECT doc_id, stage, pos FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stage,pos)=1""")
def interleaved_pools(spark, sf):
    """Two ranked pools, the first occurrence of a document wins."""
    d = table(spark, sf, "documents").where("text is not null")
    one = R.top_k(d.select("doc_id", F.length("text").alias("n")), 50, [F.desc("n"), F.col("doc_id")], []).select("doc_id", F.lit(1).alias("stage"), F.col("place").alias("pos"))
    two = R.top_k(d.select("doc_id", "publication_date"), 50, [F.col("publication_date").desc_nulls_last(), F.col("doc_id")], []).select("doc_id", F.lit(2).alias("stage"), F.col("place").alias("pos"))
    return R.first_wins(one.unionByName(two), "doc_id", [F.col("stage"), F.col("pos")])


@query("""SELECT lang, source, doc_id FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7|'||doc_id), doc_id) AS i FROM documents) WHERE i<=3""")
def stratified_sample(spark, sf):
    """Three documents of every language and source, by seeded hash."""
    d = table(spark, sf, "documents").select("lang", "source", "doc_id")
    w = Window.partitionBy("lang", "source").orderBy(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), "doc_id")
    return d.withColumn("i", F.row_number().over(w)).where("i <= 3").drop("i")


@query("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT DISTINCT source, (j*n)//60 AS i FROM (SELECT DISTINCT source,n FROM n), range(60) r(j) WHERE n>60)
SELECT source, doc_id FROM n SEMI JOIN k USING (source,i) UNION ALL SELECT source, doc_id FROM n WHERE n<=60""")
def evenly_spaced(spark, sf):
    """At most 60 documents a source at even distances."""
    w = Window.partitionBy("source")
    n = table(spark, sf, "documents").select("source", "doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    slot = F.ceil(F.col("i") * 60 / F.col("n"))  # the j whose place this could be
    keep = (F.col("n") <= 60) | (F.floor(slot * F.col("n") / 60) == F.col("i")) & (slot < 60)
    return n.where(keep).select("source", "doc_id")


@query("""SELECT doc_id, (row_number() OVER (ORDER BY doc_id)-1)//40 AS batch FROM documents""")
def fixed_batches(spark, sf):
    """Batches of 40 in key order; numbered by sorted range, not in one task."""
    d = table(spark, sf, "documents").select("doc_id")
    return numbered(d, ["doc_id"]).select("doc_id", F.floor(F.col("number") / 40).alias("batch"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE WHEN l_returnflag=lag(l_returnflag) OVER w THEN 0 ELSE 1 END AS ch FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey ROWS UNBOUNDED PRECEDING) AS grp FROM c)
SELECT l_orderkey, CAST(grp AS BIGINT) AS grp, any_value(l_returnflag) AS flag, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM g GROUP BY l_orderkey, grp""")
def gaps_and_islands(spark, sf):
    """Consecutive lines with the same flag merged to one run."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    c = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.when(F.col("l_returnflag") == F.lag("l_returnflag").over(w), 0).otherwise(1).alias("ch"))
    g = c.withColumn("grp", F.sum("ch").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("l_orderkey", "grp").agg(F.first("l_returnflag").alias("flag"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))


_KW = "list_distinct(regexp_extract_all(lower(text),'[a-z][a-z\\-]{3,}'))"


@query(f"""WITH s AS (SELECT record_id, list_sort({_KW}) AS k FROM (SELECT DISTINCT record_id, text FROM retrieval_records WHERE text IS NOT NULL)),
g AS (SELECT k, min(record_id) AS rep, len(k) AS n FROM s WHERE len(k)>0 GROUP BY k), e AS (SELECT rep, n, unnest(k) AS t FROM g),
i AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.t=b.t AND a.rep<b.rep GROUP BY ALL)
SELECT a, b, round(c::DOUBLE/(na+nb-c),6) AS jaccard FROM i WHERE c::DOUBLE/(na+nb-c) >= 0.12-1e-9
UNION ALL SELECT rep, record_id, 1.0::DOUBLE FROM s JOIN g USING (k) WHERE record_id<>rep""")
def jaccard_edges(spark, sf):
    """The keyword graph over all records: links of 0.12 and more between class representatives, and each equal set's link to its own."""
    star = M.jaccard_pairs(_keyword_sets(spark, sf), "record_id", "k", 0.12, apart="text")
    # Half up, as round; that of Spark goes by way of decimals.
    return star.select("a", "b", (F.floor(F.col("jaccard") * 1_000_000 + 0.5) / 1_000_000).alias("jaccard"))


def _keyword_sets(spark, sf):
    """``(record_id, text, k)``: the keywords of a record, and a digest that stands for its text; repeated records are repeated."""
    r = table(spark, sf, "retrieval_records").where("text is not null")
    return r.select("record_id", F.unhex(F.sha2("text", 256)).alias("text"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z\-]{3,}"), F.lit(0))).alias("k"))


@query(f"""WITH sh AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w)-10), lambda i: array_to_string(w[i:i+11],' ')))) AS s FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text),'[^a-z0-9]+',' ','g')),' ') AS w FROM heldout_items)),
d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)-10), lambda i: array_to_string(w[i:i+11],' ')))) AS s FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text),'[^a-z0-9]+',' ','g')),' ') AS w FROM documents WHERE text IS NOT NULL)),
n AS (SELECT item_id, count(*) AS n FROM sh GROUP BY 1)
SELECT doc_id, item_id, round(count(*)::DOUBLE/any_value(n),6) AS containment FROM sh JOIN d USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING count(*)::DOUBLE/any_value(n)>=0.05""")
def shingle_containment(spark, sf):
    """Documents with at least a twentieth of an item's runs of twelve words."""
    def hashes(df, key):
        words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
        return df.select(key, words.alias("w")).select(key, F.array_distinct(F.transform(X.runs(F.col("w"), 12), lambda r: F.xxhash64(r))).alias("hs"))

    items = hashes(table(spark, sf, "heldout_items").where("text is not null").select("item_id", "text"), "item_id")
    docs = hashes(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"), "doc_id")
    return M.shared_hashes(docs, items, "doc_id", "item_id", 0.05)


_LINE = "['f'||l_returnflag, 's'||l_linestatus, 'd'||round(l_discount*100)::INT, 't'||round(l_tax*100)::INT, 'q'||(l_quantity::INT//10)]"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_LINE} AS k FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber, sum(len(list_intersect(a.k,b.k))::DOUBLE/len(list_distinct(list_concat(a.k,b.k)))) AS t FROM s a JOIN s b ON a.l_orderkey=b.l_orderkey AND a.l_linenumber<>b.l_linenumber GROUP BY ALL)
SELECT l_orderkey, l_linenumber, round(t,6) AS total FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(t,9) DESC, l_linenumber)=1""")
def medoid_of_drafts(spark, sf):
    """The line of each order (a unit with a few drafts) that is most like its other lines."""
    li = table(spark, sf, "lineitem")
    word = lambda c, v: F.concat(F.lit(c), v)
    whole = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    k = F.array(word("f", F.col("l_returnflag")), word("s", F.col("l_linestatus")), word("d", whole("l_discount")), word("t", whole("l_tax")), word("q", F.floor(F.col("l_quantity") / 10).cast("string")))
    return M.medoids(li.select("l_orderkey", "l_linenumber", k.alias("k")), "l_orderkey", "l_linenumber", "k")


@query()
def near_duplicates_first(spark, sf):
    """Documents whose five-word shingles are alike to 0.8 or more: in key order the first is kept, and what is alike to a kept one is not."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split(F.trim(F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{N}]+", " ")), " ").alias("w"))
    shingles = F.when(F.size("w") >= 5, F.transform(X.runs(F.col("w"), 5), lambda r: F.xxhash64(r))).otherwise(F.array(F.xxhash64("w")))
    return M.keep_first(d.select("doc_id", F.array_distinct(shingles).alias("k")), "doc_id", "k", 0.8)


_COS = "list_dot_product(a.e,b.e)/(sqrt(list_dot_product(a.e,a.e))*sqrt(list_dot_product(b.e,b.e)))"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id, {_COS} AS c FROM v a JOIN v b ON a.vec_id%50=0 AND a.vec_id<>b.vec_id)
SELECT query, vec_id, round(c,6) AS cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c,9) DESC, vec_id) AS place FROM p) WHERE place<=5""")
def cosine_topk(spark, sf):
    """Five nearest vectors of every vector whose id is divisible by 50."""
    v = table(spark, sf, "embeddings")
    return M.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 5)


@query(f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT vec_id, label, round(1-list_dot_product(e,p)/(sqrt(list_dot_product(e,e))*sqrt(list_dot_product(p,p))),5) AS novelty FROM v WHERE p IS NOT NULL""")
def search_novelty(spark, sf):
    """Cosine distance to the vector before in the same label."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")).alias("p"))
    return v.where("p is not null").select("vec_id", "label", F.round(1 - M.cosine("embedding", "p"), 5).alias("novelty"))
