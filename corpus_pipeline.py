"""Five stages from raw documents to packed training sequences; each keeps what the next one works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmoments.llm.common import Scratch
from gridmoments.llm.jaccard import jaccard_components
from gridmoments.llm.packing import Limits, pack, whole_texts
from gridmoments.llm.quality import quality
from gridmoments.llm.queries import table, tokenizer
from gridmoments.llm.suffix import remove_repeats
from gridmoments.llm.toxicity import score, train

#: Words whose ids a worker keeps (some 80 MB): executors have other stages' data to hold as well, and their workers stay.
WORDS = 400_000
#: Scores at which a document is toxic, and below which it is of poor quality.
TOXIC, POOR = 0.7, 0.5


def free(docs: DataFrame, name: str) -> str:
    """A column's name that the documents do not have."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


def numbered(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """The documents with a column that numbers the rows, written so that every read finds the same numbers."""
    return Scratch(spark, "numbered").write(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is at least TOXIC.

    A null text scores as an empty one, rows with a null id are scored too, equal texts stay or go together. Without
    labelled examples of both kinds all documents have one score, the share of toxic labels.
    """
    own = free(docs, "_toxicity")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), score_col=own)
    return scored.where(F.col(own) < TOXIC).select(docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is below POOR. Null texts count as empty, rows with a null id are scored too, equal texts stay or go together."""
    own = "_quality_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    return quality(docs, prefix=own).where(F.col(f"{own}score") >= POOR).select(docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join (at least 80 % of their five-word shingles shared), the one with the smallest id stays; those without an id stay too.

    Rows of one id and text are one document, of which one row stays, whichever its other columns; rows of one id with
    different texts are different documents, of which, if they are near copies, the one that was read first stays.
    """
    row = free(docs, "_row")
    rows = numbered(spark, docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]), row)
    groups = jaccard_components(rows.select(row, "text"), words=5, percent=80, id_col=row)
    groups = groups.select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, F.col("doc_id").alias("_id")), row)
    kept = groups.groupBy("component_id").agg(F.min(F.struct("_id", row)).alias("first")).select(f"first.{row}")
    return rows.join(kept, row, "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes that 200-byte strings cover which also start elsewhere; characters cut in two go, n_chars follows. A text may end up empty.

    Null texts become empty ones, equal rows lose what they share, rows with a null id pass unchanged.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    changed = free(docs, "_changed")
    cut = remove_repeats(docs.where("doc_id is not null"), carry=rest, as_text=True)  # rows of one id are told apart there
    rows = cut.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), *(F.col(f"carried.{c}").alias(c) for c in rest), (F.size("spans") > 0).alias(changed))
    if "n_chars" in rest:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col(changed), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns).unionByName(docs.where("doc_id is null"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; ids holds the tokens of each piece, all of which bear loss.

    A null text is an empty one, which has its end token alone; rows with a null id and repeated rows are packed like others.
    """
    pieces = pack(docs, whole_texts(tokenizer("word_bpe_49k.json"), last=1, most=WORDS), Limits(), with_ids=True)
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", keep_one_of_group),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: No SQL expresses the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the result of each is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
