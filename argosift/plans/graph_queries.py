"""Queries on graphs and on the mention graph: doi = order, entity = part, year = order year; citations go from order to supplier."""

from pyspark.sql import functions as F

from argosift.functions import text as X
from argosift.operators import graph as G
from argosift.operators import kg as K
from argosift.plans.base import query
from argosift.runtime import table

_MENTIONS = "m AS (SELECT l_orderkey AS doi, l_partkey AS entity, year(o_orderdate) AS year FROM lineitem JOIN orders ON o_orderkey=l_orderkey)"


def _mentions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doi"), F.year("o_orderdate").alias("year"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doi"), F.col("l_partkey").alias("entity")).join(o, "doi")


def _anchors(spark, sf):
    return table(spark, sf, "part").where("p_size = 7 and p_brand like 'Brand#1%'").select(F.col("p_partkey").alias("entity"))


_ANCHORS = "a AS (SELECT p_partkey AS entity FROM part WHERE p_size=7 AND p_brand LIKE 'Brand#1%')"


@query(f"""WITH {_MENTIONS} SELECT entity, least(count(DISTINCT doi),200000) AS df FROM m WHERE year<1997 GROUP BY entity""")
def kg_document_frequency(spark, sf):
    return K.document_frequency(_mentions(spark, sf), 1997)


@query(f"""WITH {_MENTIONS}, {_ANCHORS}, d AS (SELECT * FROM m WHERE year<1997), x AS (SELECT DISTINCT doi FROM d SEMI JOIN a USING (entity)),
c AS (SELECT entity, count(DISTINCT doi) AS papers, max(year) AS latest FROM d SEMI JOIN x USING (doi) WHERE entity NOT IN (SELECT entity FROM a) GROUP BY entity ORDER BY papers DESC, entity LIMIT 40),
s AS (SELECT c.*, round(papers::DOUBLE/greatest(1,least(df,200000)),4) AS association FROM c JOIN (SELECT entity, count(DISTINCT doi) AS df FROM d GROUP BY 1) USING (entity))
SELECT *, row_number() OVER (ORDER BY association DESC, papers DESC, entity) AS place FROM s QUALIFY place<=8""")
def kg_cooccurrence(spark, sf):
    return K.cooccurrences(_mentions(spark, sf), _anchors(spark, sf), 1997)


@query(f"""WITH {_MENTIONS}, {_ANCHORS}, d AS (SELECT DISTINCT * FROM m WHERE year<1997),
r AS (SELECT entity AS anchor, doi, row_number() OVER (PARTITION BY entity ORDER BY year DESC, doi) AS i FROM d SEMI JOIN a USING (entity)),
n AS (SELECT anchor, count(*) AS n FROM r WHERE i<=3000 GROUP BY 1),
c AS (SELECT anchor, entity, count(DISTINCT doi) AS papers FROM r JOIN d USING (doi) WHERE i<=3000 AND anchor<>entity GROUP BY ALL)
SELECT anchor, c.entity, papers, round(papers::DOUBLE/n*ln(5e6/least(df,200000)),6) AS score FROM c JOIN n USING (anchor) JOIN (SELECT entity, count(DISTINCT doi) AS df FROM d GROUP BY 1) f ON f.entity=c.entity WHERE papers>=2 AND papers<=n/2.0""")
def kg_share_idf(spark, sf):
    return K.share_idf(_mentions(spark, sf), _anchors(spark, sf), 1997, least=2)


@query("""WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name),'\\s+'), lambda x: x<>'') AS w FROM part),
p AS (SELECT DISTINCT p_partkey, array_to_string(w[a:a+k-1],' ') AS phrase FROM (SELECT *, unnest(range(1,len(w)-k+2)) AS a FROM (SELECT *, unnest([1,2]) AS k FROM t))),
q AS (SELECT DISTINCT phrase FROM p WHERE p_partkey%50=0)
SELECT phrase, count(DISTINCT l_orderkey) AS n_docs FROM p SEMI JOIN q USING (phrase) JOIN lineitem ON l_partkey=p_partkey GROUP BY phrase ORDER BY n_docs, length(phrase) DESC, phrase LIMIT 6""")
def kg_anchor_match(spark, sf):
    """The six rarest phrases among the mentions of a topic (the names of parts whose key is divisible by 50)."""
    words = X.words(F.lower("p_name"))
    phrases = table(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(X.ngrams(words, 1, 2))).alias("phrase"))
    topic = phrases.where("p_partkey % 50 = 0").select("phrase").distinct()
    hits = phrases.join(topic, "phrase", "left_semi").join(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey"), "p_partkey")
    return hits.groupBy("phrase").agg(F.count_distinct("l_orderkey").alias("n_docs")).orderBy("n_docs", F.length("phrase").desc(), "phrase").limit(6)


@query(f"""WITH {_MENTIONS}, {_ANCHORS} SELECT entity, 'Entity '||entity||' is mentioned in '||count(DISTINCT doi)||' records up to '||max(year)||'.' AS fact, make_date(CAST(max(year) AS INT),12,31)::VARCHAR AS fact_date FROM m SEMI JOIN a USING (entity) WHERE year<1997 GROUP BY entity""")
def kg_facts(spark, sf):
    """Mentions as dated records."""
    m = _mentions(spark, sf).where("year < 1997").join(_anchors(spark, sf), "entity", "left_semi")
    g = m.groupBy("entity").agg(F.count_distinct("doi").alias("n"), F.max("year").alias("y"))
    return g.select("entity", F.format_string("Entity %d is mentioned in %d records up to %d.", "entity", "n", "y").alias("fact"), F.make_date("y", F.lit(12), F.lit(31)).cast("string").alias("fact_date"))


def _edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10**7).alias("dst"))


_EDGES = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey+10000000 AS dst FROM lineitem)"


@query()
def pagerank(spark, sf):
    """100 rounds; the test solves the same system directly."""
    return G.pagerank(_edges(spark, sf)).withColumn("rank", F.round("rank", 9))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src,dst FROM e UNION SELECT dst,src FROM e),
l1 AS (SELECT dst AS id, min(src) AS parent FROM b WHERE src IN (1,2) AND dst NOT IN (1,2) GROUP BY 1), l2 AS (SELECT dst AS id, min(src) AS parent FROM b WHERE src IN (SELECT id FROM l1) AND dst NOT IN (1,2) AND dst NOT IN (SELECT id FROM l1) GROUP BY 1),
l3 AS (SELECT dst AS id, min(src) AS parent FROM b WHERE src IN (SELECT id FROM l2) AND dst NOT IN (1,2) AND dst NOT IN (SELECT id FROM l1) AND dst NOT IN (SELECT id FROM l2) GROUP BY 1)
SELECT p_partkey AS id, 0 AS level, NULL::BIGINT AS parent FROM part WHERE p_partkey IN (1,2) UNION ALL SELECT id,1,parent FROM l1 UNION ALL SELECT id,2,parent FROM l2 UNION ALL SELECT id,3,parent FROM l3""")
def bfs_levels(spark, sf):
    seeds = table(spark, sf, "part").where("p_partkey in (1, 2)").select(F.col("p_partkey").alias("id"))
    return G.bfs_levels(_edges(spark, sf), seeds, 3)


@query(f"WITH {_EDGES} SELECT dst, count(*) AS n_src FROM e GROUP BY dst HAVING count(*)>=2")
def cocitation(spark, sf):
    return G.cocitation(_edges(spark, sf))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), p AS (SELECT DISTINCT dst FROM e WHERE src%50=0), s AS (SELECT src, count(*) AS n_shared FROM e WHERE dst IN (SELECT dst FROM p) AND src<>dst GROUP BY 1), i AS (SELECT dst AS src, count(*) AS in_degree FROM e GROUP BY 1)
SELECT src, count(*) AS n_refs, coalesce(any_value(n_shared),0) AS n_shared, round(coalesce(any_value(n_shared),0)::DOUBLE/greatest(1,count(*)),6) AS coupling, coalesce(any_value(in_degree),0) AS in_degree FROM e LEFT JOIN s USING (src) LEFT JOIN i USING (src) GROUP BY src""")
def coupling(spark, sf):
    """Every record against the pool of those whose key is divisible by 50."""
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return G.coupling(e, e.where("src % 50 = 0"))


@query("""WITH e AS (SELECT l_orderkey AS src, l_partkey+10000000 AS dst, max(l_quantity) AS weight FROM lineitem GROUP BY ALL), s AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos<=20),
r AS (SELECT dst AS id, src AS seed, weight, pos, row_number() OVER (PARTITION BY dst ORDER BY pos, weight DESC) AS i FROM e JOIN s ON s.id=e.src)
SELECT id, seed, weight, row_number() OVER (ORDER BY pos, weight DESC, id) AS place FROM r WHERE i=1 QUALIFY place<=50""")
def neighbor_expand(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10**7).alias("dst")).agg(F.max("l_quantity").alias("weight"))
    from argosift.operators.retrieve import top_k

    seeds = top_k(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), 20, [F.desc("o_totalprice"), F.col("id")], []).select("id", F.col("place").alias("pos"))
    return G.expand_neighbours(e, seeds, 50)


@query("""WITH r AS (SELECT DISTINCT relation_id, relation_type, source_paper_id, source_entity_id, target_entity_ids FROM evidence_relations WHERE relation_id IS NOT NULL),
x AS (SELECT relation_id, lower(trim(relation_type)) AS t, source_paper_id AS paper, unnest(list_distinct(list_concat([source_entity_id], coalesce(target_entity_ids,[])))) AS entity FROM r)
SELECT entity, count(DISTINCT relation_id) AS n_relations, count(DISTINCT t) AS n_types, count(DISTINCT paper) AS n_papers FROM x WHERE entity IS NOT NULL GROUP BY entity""")
def relation_index(spark, sf):
    """Every entity with the relations it takes part in, as source or as one of the targets."""
    r = table(spark, sf, "evidence_relations").where("relation_id is not null").select("relation_id", F.trim(F.lower("relation_type")).alias("t"), F.col("source_paper_id").alias("paper"), F.array_distinct(F.concat(F.array("source_entity_id"), F.coalesce("target_entity_ids", F.array().cast("array<string>")))).alias("es"))
    x = r.select("relation_id", "t", "paper", F.explode("es").alias("entity")).where("entity is not null")
    return x.groupBy("entity").agg(F.count_distinct("relation_id").alias("n_relations"), F.count_distinct("t").alias("n_types"), F.count_distinct("paper").alias("n_papers"))


@query("""WITH r AS (SELECT DISTINCT relation_id, source_entity_id AS src, unnest(target_entity_ids) AS dst FROM evidence_relations WHERE relation_id IS NOT NULL),
d AS (SELECT id, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM r UNION ALL SELECT dst, 0, 1 FROM r) WHERE id IS NOT NULL GROUP BY id)
SELECT split_part(id,'::',1) AS paper, count(*) AS nodes, CAST(sum(out_degree) AS BIGINT) AS edges, CAST(max(in_degree) AS BIGINT) AS max_in, CAST(max(out_degree) AS BIGINT) AS max_out FROM d GROUP BY 1""")
def graph_stats(spark, sf):
    r = table(spark, sf, "evidence_relations").where("relation_id is not null").select("relation_id", F.col("source_entity_id").alias("src"), F.explode("target_entity_ids").alias("dst")).distinct()
    ends = r.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    d = ends.where("id is not null").groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return d.groupBy(F.substring_index("id", "::", 1).alias("paper")).agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"))
