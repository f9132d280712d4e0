"""The ``pN_`` queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosift.llm import abuse, consensus, leakage, packing, ranking, spans, splitting
from argosift.runtime import table

CLASSES = (
    "composition_change",
    "processing_route",
    "heat_treatment",
    "microstructure_design",
    "surface_treatment",
    "testing_condition",
    "other",
)
LABEL_FIELDS = {"intervention_class": CLASSES, "lever_match": ("0", "1", "2", "3")}
OUTCOMES = ("new", "base", "tie")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.long_labels(table(spark, sf, "lever_labels"), "run_id", "labeller", LABEL_FIELDS, "labelled_at")


def _judgements(spark: SparkSession, sf: str) -> DataFrame:
    points = ranking.votes_as_points(table(spark, sf, "pairwise_votes")).where("judge <> ''")
    outcome = F.when(F.col("points") == 1, "new").when(F.col("points") == 0, "base").otherwise("tie")
    return points.select(
        F.concat_ws("|", "new", "base", "unit").alias("item"), F.lit("outcome").alias("field"), F.col("judge").alias("annotator"), outcome.alias("label")
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = consensus.minimax_consensus(_labels(spark, sf), LABEL_FIELDS)
    return found.where("n_annotators >= 3").select(F.col("item").alias("run_id"), "field", "consensus")


def p1_consensus(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = consensus.minimax_consensus(_labels(spark, sf), LABEL_FIELDS)
    return found.withColumnRenamed("item", "run_id").withColumns({c: F.round(c, 4) for c in ("probability", "agreement")})


def p1_reliability(spark: SparkSession, sf: str) -> DataFrame:
    _, labellers = consensus.minimax_consensus(_labels(spark, sf), LABEL_FIELDS)
    _, judges = consensus.minimax_consensus(_judgements(spark, sf), {"outcome": OUTCOMES})
    return labellers.unionByName(judges).withColumn("reliability", F.round("reliability", 4))


def p1_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.krippendorff_alpha(_labels(spark, sf).unionByName(_judgements(spark, sf)))


def p3_ranking(spark: SparkSession, sf: str) -> DataFrame:
    cells = ranking.win_matrix(ranking.votes_as_points(table(spark, sf, "pairwise_votes")))
    found = ranking.offence_defence(cells)
    return found.withColumns({c: F.round(c, 6) for c in ("strength", "offence", "defence")})


def p3_fixed_point(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking put back into the matrix: names ranked, names whose scaled row or column is off by more than a millionth, convergence."""
    cells = ranking.win_matrix(ranking.votes_as_points(table(spark, sf, "pairwise_votes"))).select("winner", "loser", (F.col("points") + 0.5).alias("w"))
    found = ranking.offence_defence(ranking.win_matrix(ranking.votes_as_points(table(spark, sf, "pairwise_votes"))))
    itself = found.select(F.col("name").alias("winner"), F.col("name").alias("loser"), F.lit(0.5).alias("w"))
    scaled = (
        cells.unionByName(itself)
        .join(found.select(F.col("name").alias("winner"), "offence"), "winner")
        .join(found.select(F.col("name").alias("loser"), "defence"), "loser")
        .withColumn("x", F.col("w") / (F.col("offence") * F.col("defence")))
    )
    rows = scaled.groupBy(F.col("winner").alias("name")).agg(F.sum("x").alias("row"))
    columns = scaled.groupBy(F.col("loser").alias("name")).agg(F.sum("x").alias("column"))
    both = rows.join(columns, "name").crossJoin(rows.agg(F.avg("row").alias("mean")))  # one row
    off = (F.abs(F.col("row") / F.col("mean") - 1) > 1e-6) | (F.abs(F.col("column") / F.col("mean") - 1) > 1e-6)
    return both.join(found.select("name", "converged"), "name").agg(
        F.count("*").alias("names"), F.count_if(off).alias("unbalanced"), F.bool_and("converged").alias("converged")
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_ranking(spark, sf).where("place <= 8").select(F.col("name").alias("method_name"))


def p3_win_matrix(spark: SparkSession, sf: str) -> DataFrame:
    cells = ranking.win_matrix(ranking.votes_as_points(table(spark, sf, "pairwise_votes")))
    return cells.withColumn("points", F.round("points", 6))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spans.gather_texts(
        (table(spark, sf, "retrieval_records"), "record_id", "text"), (table(spark, sf, "evidence_units"), "unit_id", "evidence_spans")
    ).distinct()  # repeated rows say nothing new


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    members, sets, _ = spans.shared_spans(_texts(spark, sf))
    return spans.pairs_of_ids(members, spans.links(sets))


def p4_shared_share(spark: SparkSession, sf: str) -> DataFrame:
    texts = _texts(spark, sf)
    members, _, found = spans.shared_spans(texts)
    return spans.shared_share(texts, members, found)


def p4_memberships(spark: SparkSession, sf: str) -> DataFrame:
    members, sets, _ = spans.shared_spans(_texts(spark, sf))
    return spans.memberships(members, sets)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "chunks")).where("piece = 0").select("chunk_id", "cut").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "chunks"), carry=("paper_id", "section", "chunk_index"))


def p5_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each oversized chunk: whether its pieces tile the text, keep the limit, overlap by 0 to 200 characters and hold the text they name."""
    from pyspark.sql import Window

    chunks = table(spark, sf, "chunks").select("chunk_id", F.col("text").alias("whole")).where("length(whole) > 4000").distinct()
    pieces = splitting.split_oversized(table(spark, sf, "chunks"))
    w = Window.partitionBy("chunk_id").orderBy("piece")
    rows = pieces.withColumns({"before": F.lag("end").over(w), "lead": F.col("core_start") - F.col("start")}).join(chunks, "chunk_id")
    tiled = (F.col("core_start") == F.coalesce("before", F.lit(0))) & ((F.col("piece") < F.col("n_pieces") - 1) | (F.col("end") == F.length("whole")))
    same = F.substring(F.col("whole"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return rows.groupBy("chunk_id").agg(
        F.bool_and(tiled).alias("tiled"), F.bool_and(F.length("text") <= 4000).alias("within"), F.bool_and(F.col("lead").between(0, 200)).alias("overlap_kept"),
        F.bool_and(same).alias("same"), F.bool_and((F.col("piece") == 0) | (F.col("lead") > 0) | (F.length("text") == 4000)).alias("overlapping"),
    )


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any packing: documents placed, containers over 2,048 tokens, texts cut that fit, gaps or repeats in a text's tokens."""
    counts = packing.token_counts(table(spark, sf, "documents"))
    placed = packing.pack_documents(counts)
    over = placed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("over_capacity"))
    texts = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max(F.col("token_start") + F.col("n_tokens")).alias("last"))
    both = counts.where("n_tokens > 0").join(texts, "doc_id", "full")
    return both.agg(
        F.count("pieces").alias("documents"), F.count_if((F.col("n_tokens") <= 2048) & (F.col("pieces") > 1)).alias("needless_cuts"),
        F.count_if(~F.coalesce((F.col("n") == F.col("n_tokens")) & (F.col("last") == F.col("n_tokens")), F.lit(False))).alias("tokens_lost"),
    ).crossJoin(over)  # one row each


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(packing.token_counts(table(spark, sf, "documents")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "heldout_items"))
    return found.select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "heldout_items"))
    return found.groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.round(F.max("coverage"), 4).alias("coverage"), F.max("longest").alias("longest")
    )


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf, "documents")).where("remarks > 0").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf, "documents")).withColumn("score", F.round("score", 4))


def p8_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates_by_source(abuse.score_documents(table(spark, sf, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_consensus, p1_reliability, p1_agreement, p3_found, p3_ranking, p3_win_matrix, p3_fixed_point, p4_found, p4_shared_share, p4_memberships,
        p5_found, p5_pieces, p5_invariants, p6_pack, p6_invariants, p7_found, p7_items, p8_found, p8_scores, p8_source_rates,
    )
    return {f.__name__: f for f in every}


_VOTES = r"""
votes AS (
  SELECT nullif(regexp_replace(regexp_replace(lower(new_method), '^\s+|\s+$', '', 'g'), '[\s-]+', '_', 'g'), '') AS new,
         nullif(regexp_replace(regexp_replace(lower(base_method), '^\s+|\s+$', '', 'g'), '[\s-]+', '_', 'g'), '') AS base,
         coalesce(unit, '') AS unit,
         coalesce(nullif(regexp_replace(regexp_replace(lower(judge), '^\s+|\s+$', '', 'g'), '[\s-]+', '_', 'g'), ''), '') AS judge,
         CASE regexp_replace(lower(trim(pair_order)), '[\s-]+', '_', 'g') WHEN 'new_first' THEN true
              WHEN 'baseline_first' THEN false WHEN 'base_first' THEN false END AS new_first,
         upper(trim(winner)) AS w, new_won, baseline_won, judged_at
  FROM pairwise_votes),
scored AS (
  SELECT *, coalesce(
    CASE WHEN new_won AND NOT baseline_won THEN 1.0 WHEN NOT new_won AND baseline_won THEN 0.0
         WHEN NOT new_won AND NOT baseline_won THEN 0.5 END,
    CASE WHEN w = 'TIE' THEN 0.5 WHEN w IN ('A', 'B') AND new_first IS NOT NULL
         THEN CASE WHEN (w = 'A') = new_first THEN 1.0 ELSE 0.0 END END)::DOUBLE AS points
  FROM votes),
last AS (
  SELECT * FROM scored WHERE new IS NOT NULL AND base IS NOT NULL AND new <> base AND points IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY new, base, unit, judge, new_first ORDER BY judged_at DESC NULLS LAST, points DESC) = 1)
"""


_WINDOWS = """
t AS (SELECT record_id AS id, text FROM retrieval_records WHERE record_id IS NOT NULL
      UNION SELECT unit_id, unnest(evidence_spans) FROM evidence_units WHERE unit_id IS NOT NULL),
w AS (SELECT id, text, i, md5(substring(text, i, 200)) AS h FROM (SELECT id, text, unnest(range(1, length(text) - 198)) AS i FROM t WHERE length(text) >= 200))
"""


def oracle_sql() -> dict[str, str]:
    classes = ", ".join(f"'{c}'" for c in CLASSES)
    return {
        "p3_fixed_point": f"""WITH {_VOTES} SELECT count(DISTINCT name) AS names, CAST(0 AS BIGINT) AS unbalanced, true AS converged
FROM (SELECT new AS name FROM last UNION ALL SELECT base FROM last)""",
        "p4_found": f"""WITH {_WINDOWS}, k AS (SELECT DISTINCT id, h FROM w)
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.h = b.h AND a.id < b.id""",
        "p4_shared_share": f"""WITH {_WINDOWS}, s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT id) > 1),
p AS (SELECT id, text, i, lead(i) OVER (PARTITION BY id, text ORDER BY i) AS n FROM w SEMI JOIN s USING (h)),
c AS (SELECT id, sum(least(200, coalesce(n - i, 200))) AS shared FROM p GROUP BY id),
a AS (SELECT id, count(text) AS n_texts, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM t GROUP BY id)
SELECT id, n_texts, n_chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars,
       CASE WHEN n_chars > 0 THEN round(coalesce(shared, 0)::DOUBLE / n_chars, 6) END AS share FROM a LEFT JOIN c USING (id)""",
        "p3_win_matrix": f"""WITH {_VOTES},
flat AS (SELECT least(new, base) AS a, greatest(new, base) AS b, CASE WHEN new < base THEN points ELSE 1 - points END AS p,
                new_first = (new < base) AS a_first FROM last),
orders AS (SELECT a, b, a_first, count(*) AS n, sum(p) AS s FROM flat GROUP BY ALL),
pairs AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS n,
                 coalesce(avg(CASE WHEN a_first IS NOT NULL THEN s / n END), sum(s) / sum(n)) AS mean FROM orders GROUP BY a, b)
SELECT a AS winner, b AS loser, round(mean * n, 6) AS points, n FROM pairs
UNION ALL SELECT b, a, round((1 - mean) * n, 6), n FROM pairs""",
        "p1_agreement": rf"""WITH {_VOTES},
raw AS (
  SELECT run_id AS item, nullif(regexp_replace(lower(labeller), '^\s+|\s+$', '', 'g'), '') AS annotator, labelled_at,
         unnest([{{'field': 'intervention_class', 'label': regexp_replace(regexp_replace(lower(intervention_class), '^\s+|\s+$', '', 'g'), '[\s-]', '_', 'g')}},
                 {{'field': 'lever_match', 'label': lever_match::VARCHAR}}]) AS v FROM lever_labels),
given AS (
  SELECT item, v.field AS field, v.label AS label FROM raw
  WHERE item IS NOT NULL AND annotator IS NOT NULL
    AND (v.field = 'lever_match' AND v.label IN ('0', '1', '2', '3') OR v.field = 'intervention_class' AND v.label IN ({classes}))
  QUALIFY row_number() OVER (PARTITION BY item, v.field, annotator ORDER BY labelled_at DESC NULLS LAST, v.label DESC) = 1
  UNION ALL
  SELECT concat_ws('|', new, base, unit), 'outcome', CASE points WHEN 1 THEN 'new' WHEN 0 THEN 'base' ELSE 'tie' END
  FROM last WHERE judge <> ''),
cells AS (SELECT item, field, label, count(*) AS n FROM given GROUP BY ALL),
items AS (SELECT item, field, sum(n) AS m, sum(n * n) AS same FROM cells GROUP BY ALL HAVING sum(n) >= 2),
totals AS (SELECT field, sum(n * n) AS squares FROM
             (SELECT field, label, sum(n) AS n FROM cells SEMI JOIN items USING (item, field) GROUP BY ALL) GROUP BY field),
seen AS (SELECT field, count(*) AS n_items, sum(m) AS n_labels, sum((m * m - same) / (m - 1)) AS differ FROM items GROUP BY field)
SELECT field, n_items, CAST(n_labels AS BIGINT) AS n_labels,
       round(CASE WHEN n_labels * n_labels - squares > 0
             THEN 1 - (n_labels - 1) * differ / (n_labels * n_labels - squares) END, 6) AS alpha
FROM seen JOIN totals USING (field)""",
        "p5_invariants": "SELECT DISTINCT chunk_id, true AS tiled, true AS within, true AS overlap_kept, true AS same, true AS overlapping FROM chunks WHERE length(text) > 4000",
        "p6_invariants": """SELECT count(*) FILTER (length(text) > 0 AND doc_id IS NOT NULL) AS documents, CAST(0 AS BIGINT) AS needless_cuts,
CAST(0 AS BIGINT) AS tokens_lost, CAST(0 AS BIGINT) AS over_capacity FROM documents""",
        "p5_found": r"""WITH long AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE length(text) > 4000),
parts AS (SELECT chunk_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\s*[\n\r\x0b\x0c]\s*')) AS part FROM long)
SELECT chunk_id, CASE WHEN max(length(part)) > 4000 THEN 'forced' ELSE 'natural' END AS cut FROM parts GROUP BY chunk_id""",
    }
