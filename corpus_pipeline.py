"""A corpus pipeline: the stages, in order, from raw documents to token ids.

Each stage works on all that its predecessor kept, and is written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, lines, piece_dropout, quality
from tessera.llm.common import scratch, table
from tessera.llm.queries import PIECE_BPE, vocabulary
from tessera.sources.storage import Storage


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go. Null and empty texts are scored like others."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, out="__score").where(F.col("__score") >= quality.THRESHOLD).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines that are similar to an earlier one go, and with them documents that have nothing else; n_chars follows the text."""
    kept = lines.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _shingle_set(text: Column) -> Column:
    """The distinct runs of five lower-case words of a text, ascending; all its words are one if they are fewer."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 5)), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, 5), " ")))
    return F.array_sort(F.array_distinct(F.transform(F.array(words), runs)[0]))  # so that words are split once, not for each run


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the least doc_id stays (and of its texts that with the least hash); of equal rows one.

    Rows without doc_id are compared with each other only, by their sets of shingles; those that have no words either all stay.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    firsts = jaccard.jaccard_classes(docs, first=True).where("is_first and doc_id is not null").select(F.col("doc_id").alias("id"), "sub").distinct()
    named = rows.where("id is not null").select("row", "id", F.xxhash64("t").alias("sub")).join(firsts, ["id", "sub"], "left_semi")
    kept = named.groupBy("id", "sub").agg(F.min("row").alias("row")).select("row.*")
    nameless = rows.where("id is null")
    bare = ~F.col("t").rlike(r"\S")
    # Copies meet before the shuffle, so that no task holds a large group of them.
    once = nameless.where(~bare).groupBy(F.sha2(F.array_join(_shingle_set(F.col("t")).cast("array<string>"), ","), 256)).agg(F.min("row").alias("row"))
    return kept.unionByName(once.select("row.*")).unionByName(nameless.where(bare).select("row.*")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with merge-dropout."""
    return piece_dropout.encode_pieces(docs, vocabulary(PIECE_BPE), rate=0.1, seed=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's files go as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            Storage(spark, before).delete()
        before = path
    return docs
