"""Queries on statistics; scores are lineitem measures, papers are suppliers, levels are return flags and years."""

from pyspark.sql import functions as F

from argosift.operators import stats as S
from argosift.operators.ordering import average_ranks
from argosift.plans.base import query
from argosift.runtime import table


def _li(spark, sf):
    return table(spark, sf, "lineitem")


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice)-1)/2.0 AS rank FROM (SELECT o_orderkey, round(o_totalprice/1000) AS o_totalprice FROM orders)")
def avg_ranks(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1000).alias("p"))
    return average_ranks(o, "p").select("o_orderkey", "rank")


_RANKED = """r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x)+(count(*) OVER (PARTITION BY g,x)-1)/2.0 AS rx,
 rank() OVER (PARTITION BY g ORDER BY y)+(count(*) OVER (PARTITION BY g,y)-1)/2.0 AS ry FROM b)"""


@query(f"""WITH b AS (SELECT l_suppkey AS g, l_quantity AS x, l_discount AS y FROM lineitem), {_RANKED}
SELECT g AS l_suppkey, count(*) AS n, round(CASE WHEN count(*)>=3 AND NOT isnan(corr(rx,ry)) THEN corr(rx,ry) END,6) AS rho FROM r GROUP BY g""")
def spearman_by_paper(spark, sf):
    return S.spearman(_li(spark, sf), "l_quantity", "l_discount", "l_suppkey")


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) AS x, sum(round(c_acctbal)) AS y FROM customer GROUP BY 1)
SELECT count(*) AS pairs, round(sum(sign(a.x-b.x)*sign(a.y-b.y))/count(*),6) AS tau FROM n a JOIN n b ON a.k<b.k""")
def kendall_tau_a(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("x"), F.sum(F.round("c_acctbal")).alias("y"))
    return S.kendall_tau_a(n, "k", "x", "y")


@query("""WITH v AS (SELECT DISTINCT new_method, base_method, unit, lower(judge) AS judge, upper(winner) AS w FROM pairwise_votes WHERE upper(winner) IN ('A','B','TIE') AND lower(pair_order)='new_first'),
p AS (SELECT a.w AS x, b.w AS y FROM v a JOIN v b USING (new_method, base_method, unit) WHERE a.judge='arb_lark' AND b.judge='arb_ibis'),
t AS (SELECT count(*) AS n, sum(CASE WHEN x=y THEN 1 ELSE 0 END) AS hit FROM p),
m AS (SELECT sum(na*nb) AS ch FROM (SELECT v, sum(ca) AS na, sum(cb) AS nb FROM (SELECT x AS v,1 AS ca,0 AS cb FROM p UNION ALL SELECT y,0,1 FROM p) GROUP BY v))
SELECT n, round(CASE WHEN ch/(n*n)<1 THEN (hit/n-ch/(n*n))/(1-ch/(n*n)) END,6) AS kappa FROM t,m""")
def kappa_of_judges(spark, sf):
    v = table(spark, sf, "pairwise_votes").where("upper(winner) in ('A','B','TIE') and lower(pair_order) = 'new_first'")
    v = v.select("new_method", "base_method", "unit", F.lower("judge").alias("judge"), F.upper("winner").alias("w")).distinct()
    keys = ["new_method", "base_method", "unit"]
    p = v.where("judge = 'arb_lark'").select(*keys, F.col("w").alias("x")).join(v.where("judge = 'arb_ibis'").select(*keys, F.col("w").alias("y")), keys)
    return S.cohen_kappa(p, "x", "y")


@query("""WITH b AS (SELECT lang, length(text) AS x, source='fulltext_pull' AS p FROM documents WHERE text IS NOT NULL),
r AS (SELECT lang,p, rank() OVER (PARTITION BY lang ORDER BY x)+(count(*) OVER (PARTITION BY lang,x)-1)/2.0 AS r FROM b),
s AS (SELECT lang, count(*) FILTER (p) AS n_pos, count(*) FILTER (NOT p) AS n_neg, sum(r) FILTER (p) AS s FROM r GROUP BY lang)
SELECT lang, n_pos, n_neg, round(CASE WHEN n_pos>0 AND n_neg>0 THEN (s-n_pos*(n_pos+1)/2.0)/(n_pos*n_neg) END,6) AS auc FROM s""")
def auc_of_length(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("lang", F.length("text").alias("x"), (F.col("source") == "fulltext_pull").alias("p"))
    return S.auc(d, "x", "p", "lang")


@query("""WITH a AS (SELECT l_orderkey AS u, l_returnflag AS g, l_quantity AS v, count(*) OVER (PARTITION BY l_returnflag,l_orderkey) AS m, row_number() OVER (PARTITION BY l_returnflag,l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
b AS (SELECT *, min(m) OVER (PARTITION BY g) AS k FROM a WHERE m>=2), c AS (SELECT g,u,avg(v) AS mean,sum(v*v) AS sq,max(k) AS k FROM b WHERE i<=k GROUP BY g,u),
d AS (SELECT g, count(*) AS n_units, max(k) AS k, var_samp(mean) AS vm, sum(sq-k*mean*mean) AS w FROM c GROUP BY g)
SELECT g AS l_returnflag, n_units, k, round(CASE WHEN n_units>1 THEN (k*vm-w/(n_units*(k-1)))/(k*vm+(k-1)*w/(n_units*(k-1))) END,6) AS icc FROM d""")
def icc_oneway(spark, sf):
    return S.icc1(_li(spark, sf), "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_quantity", "l_returnflag")


_DIFFS = """x AS (SELECT l_suppkey, avg(CASE WHEN year(l_shipdate)=1998 THEN l_quantity END) - avg(CASE WHEN year(l_shipdate)=1997 THEN l_quantity END) AS diff FROM lineitem GROUP BY 1)"""


def _diffs(spark, sf):
    li = _li(spark, sf).withColumn("arm", F.year("l_shipdate").cast("string"))
    return S.paired_differences(li, "l_suppkey", "arm", "l_quantity", "1998", "1997")


@query(f"""WITH {_DIFFS}, c AS (SELECT count(*) FILTER (diff>0) AS up, count(*) FILTER (diff<0) AS down FROM x WHERE diff IS NOT NULL)
SELECT up, down, round(CASE WHEN up+down=0 THEN 1 ELSE least(1, 2*list_sum(list_transform(range(0, least(up,down)+1), lambda i: exp(lgamma(up+down+1)-lgamma(i+1)-lgamma(up+down-i+1)-(up+down)*ln(2)))))  END,6) AS p FROM c""")
def sign_test(spark, sf):
    return S.sign_test(_diffs(spark, sf), "diff")


@query("""WITH b AS (SELECT n_nationkey AS k, least(1.0, (n_nationkey*37 % 101)/100.0) AS p FROM nation),
s AS (SELECT k,p,least(1.0,(count(*) OVER () - row_number() OVER (ORDER BY p,k)+1)*p) AS st FROM b)
SELECT k, round(p,6) AS p, round(max(st) OVER (ORDER BY p,k ROWS UNBOUNDED PRECEDING),6) AS p_adjusted FROM s""")
def holm(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.least(F.lit(1.0), F.col("n_nationkey") * 37 % 101 / 100).alias("p"))
    return S.holm(n, "p", "k").withColumn("p", F.round("p", 6))


def _draw_sql(n):
    return f"(('0x' || substr(md5('20260421|' || rep || '|' || j),1,8))::BIGINT % {n})"


@query(f"""WITH m AS (SELECT l_returnflag AS g, l_suppkey AS c, avg(l_quantity) AS m FROM lineitem GROUP BY ALL),
u AS (SELECT g, m, row_number() OVER (PARTITION BY g ORDER BY c)-1 AS i, count(*) OVER (PARTITION BY g) AS n FROM m),
d AS (SELECT g, rep, {_draw_sql('n')} AS i FROM (SELECT g, n, i AS j FROM u), range(10000) r(rep)),
v AS (SELECT g, rep, avg(m) AS mean FROM d JOIN u USING (g,i) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mean,rep)-1 AS r FROM v)
SELECT g AS l_returnflag, n_clusters, round(point,6) AS point, round(low,6) AS low, round(high,6) AS high FROM
 (SELECT g, count(*) AS n_clusters, avg(m) AS point FROM u GROUP BY g) JOIN (SELECT g, max(CASE WHEN r=250 THEN mean END) AS low, max(CASE WHEN r=9749 THEN mean END) AS high FROM k GROUP BY g) USING (g)""")
def cluster_bootstrap(spark, sf):
    return S.cluster_bootstrap(_li(spark, sf), "l_suppkey", "l_quantity", "l_returnflag", resamples=10_000)


@query(f"""WITH {_DIFFS}, u AS (SELECT diff AS m, row_number() OVER (ORDER BY l_suppkey)-1 AS i, count(*) OVER () AS n FROM x WHERE diff IS NOT NULL),
d AS (SELECT rep, {_draw_sql('n')} AS i FROM (SELECT n, i AS j FROM u), range(10000) r(rep)), v AS (SELECT rep, avg(m) AS mean FROM d JOIN u USING (i) GROUP BY ALL),
k AS (SELECT mean, row_number() OVER (ORDER BY mean,rep)-1 AS r FROM v)
SELECT n_clusters, round(point,6) AS point, round(low,6) AS low, round(high,6) AS high FROM (SELECT count(*) AS n_clusters, avg(m) AS point FROM u), (SELECT max(CASE WHEN r=250 THEN mean END) AS low, max(CASE WHEN r=9749 THEN mean END) AS high FROM k)""")
def paired_bootstrap(spark, sf):
    return S.cluster_bootstrap(_diffs(spark, sf), "l_suppkey", "diff", resamples=10_000)


@query("""WITH c AS (SELECT l_suppkey AS g, year(l_shipdate) AS dose, avg(l_discount) AS v FROM lineitem GROUP BY ALL),
r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY v)+(count(*) OVER (PARTITION BY g,v)-1)/2.0 AS rv, row_number() OVER (PARTITION BY g ORDER BY dose) AS rd, count(*) OVER (PARTITION BY g) AS m FROM c),
o AS (SELECT count(*) AS n_clusters, avg(coalesce(CASE WHEN isnan(q) THEN 0 ELSE q END,0)) AS rho FROM (SELECT g, corr(rv,rd) AS q FROM r WHERE m>=3 GROUP BY g)),
s AS (SELECT g, rv, rep, row_number() OVER (PARTITION BY rep,g ORDER BY md5('20260421|'||rep||'|'||g||'|'||rd)) AS ps FROM r, range(10000) t(rep) WHERE m>=3),
n AS (SELECT rep, avg(coalesce(CASE WHEN isnan(q) THEN 0 ELSE q END,0)) AS rho0 FROM (SELECT rep,g,corr(rv,ps) AS q FROM s GROUP BY ALL) GROUP BY rep)
SELECT n_clusters, round(rho,6) AS rho, round((count(*) FILTER (rho0>=rho-1e-12)+1)/10001.0,6) AS p FROM o,n GROUP BY n_clusters,rho""")
def permutation_trend(spark, sf):
    li = _li(spark, sf).withColumn("dose", F.year("l_shipdate"))
    return S.permutation_trend(li, "l_suppkey", "dose", "l_discount", permutations=10_000)


@query("""WITH c AS (SELECT l_suppkey, avg(l_quantity) FILTER (a AND b) AS tt, avg(l_quantity) FILTER (a AND NOT b) AS tf, avg(l_quantity) FILTER (NOT a AND b) AS ft, avg(l_quantity) FILTER (NOT a AND NOT b) AS ff
 FROM (SELECT *, l_linestatus='O' AS a, l_discount>=0.05 AS b FROM lineitem) GROUP BY 1), k AS (SELECT * FROM c WHERE tt+tf+ft+ff IS NOT NULL)
SELECT 'a' AS effect, count(*) AS n, round(avg((tt+tf-ft-ff)/2),6) AS mean FROM k UNION ALL SELECT 'b', count(*), round(avg((tt+ft-tf-ff)/2),6) FROM k UNION ALL SELECT 'a:b', count(*), round(avg(tt-tf-ft+ff),6) FROM k""")
def factorial_effects(spark, sf):
    li = _li(spark, sf).select("l_suppkey", "l_quantity", (F.col("l_linestatus") == "O").alias("a"), (F.col("l_discount") >= 0.05).alias("b"))
    return S.factorial_2x2(li, "l_suppkey", "a", "b", "l_quantity")


@query("""SELECT l_orderkey, n, c, round(CASE WHEN n<2 THEN NULL WHEN n-c<2 THEN 1 ELSE 1-((n-c)*(n-c-1))::DOUBLE/(n*(n-1)) END,6) AS pass_at_2 FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount>0.06) AS c FROM lineitem GROUP BY 1)""")
def pass_at_k(spark, sf):
    o = _li(spark, sf).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.06).alias("c"))
    return o.withColumn("pass_at_2", F.round(S.pass_at_k(F.col("n"), F.col("c"), 2), 6))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity-avg(l_quantity) OVER w)/(CASE WHEN stddev_pop(l_quantity) OVER w=0 THEN 1 ELSE stddev_pop(l_quantity) OVER w END),5) AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def zscore_within(spark, sf):
    return _li(spark, sf).select("l_orderkey", "l_linenumber", F.round(S.z_within("l_quantity", "l_orderkey"), 5).alias("z"))


@query("""SELECT k, n, round(list_sum(list_transform(range(k,n+1), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln(1/3.0)+(n-i)*ln(2/3.0)))),6) AS p FROM (SELECT n_regionkey AS k, count(*)+5 AS n FROM nation GROUP BY 1)""")
def binomial_tail(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg((F.count("*") + 5).alias("n"))
    return n.withColumn("p", F.round(S.binomial_sum(F.col("n"), F.col("k"), F.col("n"), 1 / 3), 6))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, round(CASE WHEN len(q)>=3 THEN list_avg(q[2:len(q)-1]) ELSE list_avg(q) END,6) AS trimmed FROM s""")
def trimmed_mean(spark, sf):
    """Mean of an order's quantities without the smallest and the largest where there are three or more."""
    g = _li(spark, sf).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("s"), F.count("*").alias("n"), F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"))
    return g.select("l_orderkey", F.round(F.when(F.col("n") >= 3, (F.col("s") - F.col("a") - F.col("b")) / (F.col("n") - 2)).otherwise(F.col("s") / F.col("n")), 6).alias("trimmed"))


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber)-1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, max(CASE WHEN i=(n*99-99)//100 THEN v END) AS p99, max(CASE WHEN i=(n-1)//2 THEN v END) AS low_median FROM r GROUP BY 1""")
def order_statistics(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey")
    r = _li(spark, sf).select("l_suppkey", F.col("l_extendedprice").alias("v"), (F.row_number().over(w.orderBy("l_extendedprice", "l_orderkey", "l_linenumber")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    pick = lambda c: F.max(F.when(F.col("i") == c, F.col("v")))
    return r.groupBy("l_suppkey").agg(pick(F.floor((F.col("n") * 99 - 99) / 100)).alias("p99"), pick(F.floor((F.col("n") - 1) / 2)).alias("low_median"))
