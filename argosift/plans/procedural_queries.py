"""Queries on operators that SQL cannot say; tested against small fixtures."""

from pyspark.sql import functions as F

from argosift.operators import procedural as P
from argosift.plans.base import query
from argosift.runtime import table


@query()
def chunk_paragraphs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return P.map_texts(d, "doc_id", "text", P.paragraph_chunks, "chunk string")


@query()
def line_chunks(spark, sf):
    c = table(spark, sf, "chunks").where("chunk_id is not null").select("chunk_id", "text").distinct()
    return P.map_texts(c, "chunk_id", "text", lambda t: P.line_chunks(t, 500), "first_line int, end_line int")


@query()
def sentence_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return P.map_texts(d, "doc_id", "text", P.split_sentences, "sentence string")


_BARE = "md5(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g'))"


def _bare(parts):
    return F.md5(F.regexp_replace(parts, r"[ \t\n\r\x0b\x0c]+", ""))


def _joined(rows, key, value):
    """The parts of each text put together again in order."""
    return rows.groupBy(key).agg(F.count("*").alias("parts"), _bare(F.array_join(F.array_sort(F.collect_list(F.struct("pos", value)))[value], "")).alias("joined"))


@query(f"SELECT doc_id, {_BARE} AS joined FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^ \\t\\n\\r\\x0b\\x0c]')")
def sentences_rejoined(spark, sf):
    """Sentences put together again are the text, but for white space."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return _joined(P.map_texts(d, "doc_id", "text", P.split_sentences, "sentence string"), "doc_id", "sentence").select("doc_id", "joined")


@query(f"SELECT doc_id, {_BARE} AS joined FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^ \\t\\n\\r\\x0b\\x0c]')")
def chunks_rejoined(spark, sf):
    """Paragraph chunks put together again are the text, but for white space."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return _joined(P.map_texts(d, "doc_id", "text", P.paragraph_chunks, "chunk string"), "doc_id", "chunk").select("doc_id", "joined")


@query("""SELECT DISTINCT chunk_id, CAST(0 AS INT) AS first_line, len(string_split(text, chr(10)))::INT AS end_line, true AS gapless FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL""")
def line_chunks_cover(spark, sf):
    """Line chunks begin with the first line, end with the last and leave none out."""
    from pyspark.sql import Window

    c = table(spark, sf, "chunks").where("chunk_id is not null").select("chunk_id", "text").distinct()
    rows = P.map_texts(c, "chunk_id", "text", lambda t: P.line_chunks(t, 500), "first_line int, end_line int")
    before = F.lag("end_line").over(Window.partitionBy("chunk_id").orderBy("pos"))
    rows = rows.withColumn("fine", F.coalesce(F.col("first_line") <= before, F.col("first_line") == 0))
    return rows.groupBy("chunk_id").agg(F.min("first_line").alias("first_line"), F.max("end_line").alias("end_line"), F.bool_and("fine").alias("gapless"))


@query()
def fuzzy_grounding(spark, sf):
    """Best ratio of every unit's spans over all records of its paper."""
    return P.fuzzy_grounding(table(spark, sf, "evidence_units").where("unit_id is not null"), table(spark, sf, "retrieval_records"))


@query()
def ridge_leave_one_out(spark, sf):
    """Ridge coefficients of price on quantity, discount and tax, leaving out one supplier each."""
    li = table(spark, sf, "lineitem").select("l_suppkey", *((F.col(c) / s).alias(c) for c, s in (("l_quantity", 50), ("l_discount", 0.1), ("l_tax", 0.08))), (F.col("l_extendedprice") / 1000).alias("y"))
    return P.ridge_without_group(li, "l_suppkey", ["l_quantity", "l_discount", "l_tax"], "y")


@query()
def model_answers(spark, sf):
    """The model boundary with a stub that answers with the prompt's length."""
    items = table(spark, sf, "heldout_items").select("item_id", "text")
    return P.ask_model(items, "item_id", "text", _stub)


def _stub():
    return lambda prompt: 'Answer: {"length": %d}' % len(prompt)
