"""Readers of documents, lines and archives, and the sinks that go with them."""

from __future__ import annotations

import io
import itertools
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_documents(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One JSON document a file; ``key`` is the file's name without folder and ending, ``key_parts`` its parts between double underscores."""
    rows = spark.read.option("multiLine", True).schema(schema).json(paths).withColumn("_file", F.col("_metadata.file_name"))
    key = F.regexp_replace(F.url_decode("_file"), r"\.[^.]*$", "")
    return rows.withColumn("key", key).withColumn("key_parts", F.split("key", "__")).drop("_file")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of JSON lines; blank lines are skipped, a rejected line comes with its file and text."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = text.withColumn("row", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("row").isNull() | F.col("row._corrupt_record").isNotNull()
    return parsed.where(~bad).select("row.*").drop("_corrupt_record"), parsed.where(bad).select("file", F.col("value").alias("line"))


def read_jsonl_strict(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines; a bad line ends the job that reads it, naming the file and the line's text."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = text.withColumn("row", row)
    checked = F.when(F.col("row").isNotNull() & F.col("row._corrupt_record").isNull(), F.col("row")).otherwise(
        F.raise_error(F.concat(F.lit("bad line in "), "file", F.lit(": "), F.substring("value", 1, 200)))
    )
    return parsed.select(checked.alias("row")).select("row.*").drop("_corrupt_record")


class _Forward(io.RawIOBase):
    """A member of a streamed archive as a plain stream that is only read on."""

    def __init__(self, member):
        self.member = member

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.member.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def read_tar_csv(spark: SparkSession, path: str, columns: list[str], chunk: int = 50_000) -> DataFrame:
    """Rows of the CSV members of tar (also compressed) archives, as strings; a row shorter than its header has ``short`` set.

    Only the paths are listed; a task opens its archive by path and reads it as a stream, so an archive may be of any size, and what a task holds is
    ``chunk`` rows. An archive is one compressed stream and is read by one task; several are read in parallel.
    """
    import csv

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("short", T.BooleanType())])

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for uri in pdf["path"]:
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(place, compression=None, buffer_size=1 << 20) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
                    for member in archive:
                        stream = archive.extractfile(member) if member.isfile() and member.name.endswith(".csv") else None
                        if stream is None:
                            continue
                        lines = csv.reader(io.TextIOWrapper(io.BufferedReader(_Forward(stream), 1 << 20), "utf-8", errors="replace", newline=""))
                        header = next(lines, [])
                        at = [header.index(c) if c in header else -1 for c in columns]
                        while rows := list(itertools.islice(lines, chunk)):
                            whole = [len(r) >= len(header) for r in rows]
                            out = {c: [r[i] if 0 <= i < len(r) else None for r in rows] for c, i in zip(columns, at, strict=True)}
                            yield pd.DataFrame({**out, "short": [not w for w in whole]})

    paths = spark.read.format("binaryFile").load(path).select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInPandas(unpack, schema)


def load_mentions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(mentions, rejects)`` from strings doi, entity, preferred, ner, year, short.

    The preferred entity falls back to the raw one. Rows are rejected, with counts by reason, when they are short, lack doi or entity, or
    have no positive year.
    """
    year = F.try_to_number(F.trim("year"), F.lit("99999.9")).cast("int")
    year = F.coalesce(F.expr("try_cast(try_cast(trim(year) as double) as int)"), year)
    doi = F.lower(F.trim(F.coalesce("doi", F.lit(""))))
    entity = F.lower(F.trim(F.coalesce(F.when(F.trim("preferred") != "", F.col("preferred")), F.col("entity"), F.lit(""))))
    rows = raw.select(doi.alias("doi"), entity.alias("entity"), "ner", year.alias("year"), F.coalesce("short", F.lit(False)).alias("short"))
    reason = F.coalesce(
        F.when(F.col("short"), "short row"), F.when(F.col("doi") == "", "no doi"), F.when(F.col("entity") == "", "no entity"), F.when(F.coalesce("year", F.lit(0)) <= 0, "no year")
    )
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").select("doi", "year", "entity", "ner"), marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def write_mentions(mentions: DataFrame, path: str) -> None:
    """Mentions as Parquet by decade, sorted by entity within files, so that lookups by entity and year skip files and row groups."""
    bucket = (F.floor(F.col("year") / 10) * 10).cast("int")
    rows = mentions.withColumn("decade", bucket).repartition("decade", F.pmod(F.xxhash64("entity"), F.lit(16)))
    rows.sortWithinPartitions("decade", "entity").write.mode("overwrite").partitionBy("decade").parquet(path)


def write_once(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys are not at ``path`` yet (the first writer wins) and return all that is there."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def export_tables(bundles: DataFrame, key: str, arrays: list[str], path: str) -> DataFrame:
    """Each array of structs as its own JSON-lines table under ``path``; returns ``(table, n)`` counts."""
    counts = None
    for name in arrays:
        rows = bundles.select(key, F.explode(name).alias("r")).select(key, "r.*")
        rows.write.mode("overwrite").json(f"{path}/{name}")
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without an output yet."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
