"""The registered queries of the corpus operators; each covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import binary_ids, decontaminate, jaccard, lines, media, piece_dropout, pii, quality, suffix, toxicity
from tessera.llm.common import table

#: Where the public vocabulary files are; a path of one's own may be given to the operators.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.strip_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.train(docs, labels)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), index).drop("text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs.select("doc_id", "text"), quality.train(docs, labels)).drop("text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "max_score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures of all vectors; the queries are edited copies of every one whose id is divisible by 20.

    A row for each query that has any: query_id, n_classes, n_images, and copies, a list of (class_id, n_images, n_inliers).
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = media.find_copies(media.pictures(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", edited=True), media.pictures(vectors, "vec_id", "embedding"))
    copies = F.array_sort(F.collect_list(F.struct("class_id", "n_images", "n_inliers")))
    return found.groupBy("query_id").agg(F.count("*").alias("n_classes"), F.sum("n_images").alias("n_images"), copies.alias("copies"))


def op8_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_ids.encode_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=2)


def op9_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.encode_pieces(table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE), rate=0.1, seed=0, with_ids=False)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_suffix_dedup, op4_toxicity, op5_quality, op6_pii, op7_media, op8_binary_ids, op9_piece_dropout, op10_jaccard_join)}
