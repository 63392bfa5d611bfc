"""The queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import digest_rows

    return digest_rows(table(spark, sf_dir, "documents"), length=200)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand as files source/lang/doc_id.txt."""
    from .licenses import scan

    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op5_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    read = archive_pages(table(spark, sf_dir, "pages"), min_revisit=1000)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embedding_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .descent import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("kept"), "votes", "posterior")


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import Limits, pack, whole_texts

    pieces = pack(table(spark, sf_dir, "documents"), whole_texts(tokenizer("word_bpe_49k.json"), last=1), Limits(tokens=2048, segments=256, loss_tokens=2048))
    return pieces.withColumnRenamed("id", "doc_id")


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), digest=True).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op11_sketch_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import digest_rows

    return digest_rows(table(spark, sf_dir, "documents"), words=13)


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256).withColumnRenamed("id", "vec_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved by one, as if wrong."""
    from .mining import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), every=50, positives=5, negatives=3, low=50, high=95, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pivot_topk, op2_suffix_dedup, op3_license_scan, op4_ngram_jaccard, op5_warc_normalise, op6_embedding_descent, op7_weak_quality, op8_vector_packing, op9_piece_encoding, op10_toxicity, op11_sketch_substrings, op12_jacobi_whitening, op13_hard_negatives)
}

ORACLES: dict[str, str] = {
    "op1_pivot_topk": oracles.TOP_K, "op4_ngram_jaccard": oracles.JACCARD, "op5_warc_normalise": oracles.ARCHIVES, "op6_embedding_descent": oracles.NEAR_VECTORS, "op11_sketch_substrings": oracles.WINDOWS, "op13_hard_negatives": oracles.NEGATIVES,
}
