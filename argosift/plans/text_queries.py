"""Queries on text expressions."""

from pyspark.sql import functions as F

from argosift.functions import text as X
from argosift.plans.base import query
from argosift.runtime import table

TOKENS = "list_filter(regexp_extract_all(replace(lower(text),'ß','ss'),'[a-z0-9]+'), lambda t: length(t) > 2)"
STOP = "[" + ",".join(f"'{w}'" for w in X.STOPWORDS) + "]"
NORM = r"trim(regexp_replace(lower(regexp_replace(text,'([A-Za-z])-\s*\n\s*([a-z])','\1\2','g')),'[^a-z0-9]+',' ','g'))"


def _docs(spark, sf, *extra):
    return table(spark, sf, "documents").select("doc_id", "text", *extra)


@query(f"""SELECT tok AS token, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM (
  SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS tok FROM documents) GROUP BY ALL) GROUP BY tok""")
def token_df(spark, sf):
    """Document and collection frequency of every token."""
    one = _docs(spark, sf).select("doc_id", F.explode(X.tokens("text")).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return one.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@query(rf"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text),'[a-z][a-z\-]{{3,}}'))) AS kw FROM documents)
SELECT doc_id, count(*) AS n_keywords, md5(string_agg(kw, ' ' ORDER BY kw)) AS kw_hash FROM w WHERE NOT list_contains({STOP}, kw) GROUP BY doc_id""")
def keyword_sets(spark, sf):
    k = X.keywords("text")
    return _docs(spark, sf).where(F.size(k) > 0).select("doc_id", F.size(k).cast("long").alias("n_keywords"), F.md5(F.array_join(F.array_sort(k), " ")).alias("kw_hash"))


@query(f"""SELECT doc_id, len(list_filter(list_distinct({TOKENS}), lambda t: NOT list_contains({STOP}, t))) AS n_terms FROM documents WHERE text IS NOT NULL""")
def content_term_counts(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", F.size(X.content_terms("text")).cast("long").alias("n_terms"))


_STEM = "CASE " + " ".join(f"WHEN ends_with(w,'{s}') AND length(w)-{len(s)}>=4 THEN left(w,length(w)-{len(s)})" for s in X.SUFFIXES) + " ELSE w END"


@query(f"SELECT stem, count(*) AS df FROM (SELECT DISTINCT doc_id, {_STEM} AS stem FROM (SELECT doc_id, unnest({TOKENS}) AS w FROM documents)) GROUP BY stem")
def stem_df(spark, sf):
    one = _docs(spark, sf).select("doc_id", F.explode(F.array_distinct(X.tokens("text"))).alias("w"))
    return one.select("doc_id", X.stem(F.col("w")).alias("stem")).distinct().groupBy("stem").agg(F.count("*").alias("df"))


@query(f"SELECT doc_id, md5({NORM}) AS norm_hash, length({NORM}) AS n FROM documents WHERE text IS NOT NULL")
def normalised_text(spark, sf):
    n = X.normalise("text")
    return _docs(spark, sf).where("text is not null").select("doc_id", F.md5(n).alias("norm_hash"), F.length(n).cast("long").alias("n"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text,'\s+',' ','g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t)<=280 THEN t ELSE regexp_replace(substring(t,1,280),' [^ ]*$','') || ' ...' END AS snippet FROM f""")
def snippets(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", X.snippet("text").alias("snippet"))


@query("""WITH p AS (SELECT doc_id, text, unnest(range(0, length(text), 2400)) AS page_start FROM documents WHERE length(text)>0)
SELECT doc_id, page_start, md5(substring(text, page_start+1, 2400)) AS page_hash,
 CASE WHEN page_start+2400 < length(text) THEN page_start+2400 END AS next_offset FROM p""")
def paged_text(spark, sf):
    p = _docs(spark, sf).where("length(text) > 0").select("doc_id", F.explode(X.pages("text")).alias("p"))
    return p.select("doc_id", F.col("p.offset").cast("long").alias("page_start"), F.md5("p.page").alias("page_hash"), F.col("p.next_offset").cast("long").alias("next_offset"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text,'\s+'), lambda x: x<>'') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, CAST(greatest(0, ceil((len(ws)-900)/800.0)) AS BIGINT)*800+1, 800)) AS start FROM w WHERE len(ws)>0)
SELECT doc_id, start AS word_start, len(ws[start+1:start+900]) AS n_words, md5(array_to_string(ws[start+1:start+900],' ')) AS window_hash FROM s""")
def word_windows(spark, sf):
    """Windows of 900 words that overlap by 100."""
    w = _docs(spark, sf).select("doc_id", F.explode(X.windows(X.words("text"), 900, 100)).alias("w"))
    return w.select("doc_id", F.col("w.start").cast("long").alias("word_start"), F.size("w.items").cast("long").alias("n_words"), F.md5(F.array_join("w.items", " ")).alias("window_hash"))


@query("SELECT doc_id, substr(sha256(coalesce(source,'') || chr(31) || coalesce(doc_id::VARCHAR,'') || chr(31) || coalesce(section,'')),1,16) AS stable_id FROM documents")
def stable_ids(spark, sf):
    return _docs(spark, sf, "source", "section").select("doc_id", X.stable_id("source", "doc_id", "section").alias("stable_id"))


@query("""SELECT p_partkey, CASE WHEN s='' THEN 'item' ELSE s END AS slug FROM (
 SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name),'[^a-z0-9]+','_','g'),'^_+|_+$','','g') AS s FROM part)""")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.slug("p_name").alias("slug"))


@query(r"""WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name),'\s+'), lambda x: x<>'') AS w FROM part),
n AS (SELECT p_partkey, w, unnest(range(1,5)) AS k FROM t), i AS (SELECT *, unnest(range(1, len(w)-k+2)) AS a FROM n)
SELECT phrase, count(*) AS n_parts FROM (SELECT DISTINCT p_partkey, array_to_string(w[a:a+k-1],' ') AS phrase FROM i) GROUP BY phrase""")
def ngram_phrases(spark, sf):
    """Phrases of one to four words in part names, and how many parts have them."""
    p = table(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(X.ngrams(X.words(F.lower("p_name")), 1, 4))).alias("phrase"))
    return p.groupBy("phrase").agg(F.count("*").alias("n_parts"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text,'[0-9]+(?:\.[0-9]+)?'))) AS n_numbers,
 len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?\s?(?:MPa m\^1/2|MPa|GPa|HV|nm|µm|mm|K|°C|%|h|s|kJ/mol|eV)\b')) AS n_marked FROM documents WHERE text IS NOT NULL""")
def number_counts(spark, sf):
    raw = F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    marked = F.regexp_extract_all("text", F.lit(X.QUANTITY + r"\b"), F.lit(0))
    return _docs(spark, sf).where("text is not null").select("doc_id", F.size(F.array_distinct(raw)).cast("long").alias("n_numbers"), F.size(marked).cast("long").alias("n_marked"))


@query(r"""WITH n AS (SELECT doc_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(text,'[0-9]+(?:\.[0-9]+)?'), lambda x: length(x)>1),
  lambda x: CASE WHEN contains(x,'.') THEN regexp_replace(regexp_replace(x,'0+$',''),'\.$','') ELSE x END))) AS num FROM documents)
SELECT num AS number, count(*) AS n_docs FROM n GROUP BY num""")
def number_df(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(X.numbers("text")).alias("number")).groupBy("number").agg(F.count("*").alias("n_docs"))


@query(r"""WITH g AS (SELECT doc_id, unnest(regexp_extract_all(text,'\[([0-9]+(?:\s*[,;–-]\s*[0-9]+)*)\]',1)) AS g FROM documents),
p AS (SELECT doc_id, unnest(regexp_split_to_array(g,'\s*[,;]\s*')) AS p FROM g),
e AS (SELECT doc_id, try_cast(regexp_extract(p,'^[0-9]+') AS INT) AS lo, try_cast(regexp_extract(p,'[0-9]+$') AS INT) AS hi FROM p)
SELECT doc_id, count(*) AS n_cited, CAST(sum(c) AS BIGINT) AS sum_cited FROM (SELECT DISTINCT doc_id, unnest(range(lo,hi+1)) AS c FROM e WHERE lo<=hi AND hi-lo<=100) GROUP BY doc_id""")
def citation_numbers(spark, sf):
    c = _docs(spark, sf).select("doc_id", F.explode(X.citation_numbers("text")).alias("c"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_cited"), F.sum("c").alias("sum_cited"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text,'\s*\[[0-9]+(?:\s*[,;–-]\s*[0-9]+)*\]','','g'),' +([.,;])','\1','g'))) AS h FROM documents WHERE text IS NOT NULL""")
def citations_stripped(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", F.md5(X.strip_citations("text")).alias("h"))


@query("SELECT doc_id, CAST(floor(length(text)/4) AS BIGINT) AS est FROM documents WHERE text IS NOT NULL")
def token_estimates(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", X.token_estimate("text").alias("est"))


@query(r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text,'([.!?])\s+','\1'||chr(10),'g'),'\n+'), lambda x: trim(x)), lambda x: x<>'')) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest, count(*) FILTER (length(s) BETWEEN 20 AND 400) AS n_scannable FROM s GROUP BY doc_id""")
def sentence_profile(spark, sf):
    s = _docs(spark, sf).select("doc_id", F.explode(X.sentences("text")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("s")).cast("long").alias("longest"), F.count_if(F.length("s").between(20, 400)).alias("n_scannable"))


#: A rule table: the first rule with a keyword in the text decides.
TOPICS = [("hardness", ["hardness", "härte"]), ("creep", ["creep", "kriech", "rupture"]), ("oxidation", ["oxid", "scale"]), ("thermal", ["thermal", "wärme"]), ("strength", ["strength", "festigkeit"])]


@query("SELECT topic, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text),{chr(39)}{k}{chr(39)})' for k in ks)} THEN '{t}'" for t, ks in TOPICS) + " ELSE 'general' END AS topic FROM documents) GROUP BY topic")
def topic_rules(spark, sf):
    """First matching keyword rule, else 'general'; the rules are data."""
    low, out = F.lower("text"), F.lit("general")
    for topic, keys in reversed(TOPICS):
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        out = F.when(hit, topic).otherwise(out)
    return _docs(spark, sf).groupBy(out.alias("topic")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text),'\b(?:may|might|could|possibly|perhaps|likely|suggests?|appears?|apparently)\b')) AS n_hedges FROM documents WHERE text IS NOT NULL""")
def hedge_counts(spark, sf):
    hedges = r"(?U)\b(?:may|might|could|possibly|perhaps|likely|suggests?|appears?|apparently)\b"
    return _docs(spark, sf).where("text is not null").select("doc_id", F.regexp_count(F.lower("text"), F.lit(hedges)).cast("long").alias("n_hedges"))


@query(f"""WITH t AS (SELECT doc_id, source, {TOKENS} AS w FROM documents),
f AS (SELECT doc_id, unnest(list_distinct(w)) AS tok FROM t), d AS (SELECT tok, count(*) AS df FROM f GROUP BY tok), n AS (SELECT count(*) AS n FROM documents)
SELECT tok AS token, df FROM d, n WHERE df <= 0.2*n AND df >= 2""")
def vocabulary_without_common(spark, sf):
    """Tokens of at least two and at most a fifth of all documents."""
    docs = _docs(spark, sf)
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(X.tokens("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).where("df >= 2 and df <= 0.2 * n").select("token", "df")  # n is one row


@query(f"""SELECT i.item_id, b.item_id AS other_id, round(len(list_intersect(i.k,b.k))::DOUBLE/len(list_distinct(list_concat(i.k,b.k))),6) AS jaccard
FROM (SELECT item_id, paper_id, list_distinct({TOKENS}) AS k FROM heldout_items) i JOIN (SELECT item_id, paper_id, list_distinct({TOKENS}) AS k FROM heldout_items) b
ON i.paper_id=b.paper_id AND i.item_id<b.item_id""")
def item_jaccard(spark, sf):
    """Token similarity of the items of a paper."""
    i = table(spark, sf, "heldout_items").select("item_id", "paper_id", F.array_distinct(X.tokens("text")).alias("k"))
    a, b = i.alias("a"), i.alias("b")
    return a.join(b, (F.col("a.paper_id") == F.col("b.paper_id")) & (F.col("a.item_id") < F.col("b.item_id"))).select(
        F.col("a.item_id"), F.col("b.item_id").alias("other_id"), F.round(X.jaccard(F.col("a.k"), F.col("b.k")), 6).alias("jaccard")
    )


@query("SELECT doc_id, greatest(3, least(16, n // 35)) AS low, greatest(greatest(3, least(16, n // 35)) + 4, least(30, n // 18)) AS high FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>'')) AS n FROM documents WHERE text IS NOT NULL)")
def question_range(spark, sf):
    """How many questions a text of so many words should give."""
    n = F.size(X.words("text")).cast("long")
    low = F.greatest(F.lit(3), F.least(F.lit(16), F.floor(n / 35)))
    return _docs(spark, sf).where("text is not null").select("doc_id", low.alias("low"), F.greatest(low + 4, F.least(F.lit(30), F.floor(n / 18))).alias("high"))


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text,'\n')) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line,'^\s*([0-9]+(\.[0-9]+)*\.?\s+)?[A-Z][A-Za-z ]{2,60}\s*$')) AS n_headings FROM l GROUP BY doc_id""")
def heading_lines(spark, sf):
    line = _docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return line.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike(r"^\s*([0-9]+(\.[0-9]+)*\.?\s+)?[A-Z][A-Za-z ]{2,60}\s*$")).alias("n_headings"))


@query(r"""WITH l AS (SELECT chunk_id, generate_subscripts(ls,1) AS i, unnest(ls) AS line FROM (SELECT DISTINCT chunk_id, regexp_split_to_array(text,'\n') AS ls FROM chunks WHERE text IS NOT NULL)),
h AS (SELECT *, sum(CASE WHEN regexp_matches(line,'^[0-9]+(\.[0-9]+)+ [A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM l)
SELECT chunk_id, CAST(sec AS BIGINT) AS sec, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS section_hash FROM h GROUP BY chunk_id, sec""")
def section_split(spark, sf):
    """Sections of chunks at numbered headings; section 0 is what stands before the first."""
    from pyspark.sql import Window

    c = table(spark, sf, "chunks").where("text is not null").select("chunk_id", "text").distinct()
    line = c.select("chunk_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("chunk_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sec = line.withColumn("sec", F.sum(F.col("line").rlike(r"^[0-9]+(\.[0-9]+)+ [A-Z]").cast("long")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")
    return sec.groupBy("chunk_id", "sec").agg(F.count("*").alias("n_lines"), F.md5(joined).alias("section_hash"))
