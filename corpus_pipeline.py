"""The corpus pipeline: documents in, packed training sequences out. Each stage is a function of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import decontaminate, language, pii, simhash
from pagelore.llm.pack import pack, token_pieces
from pagelore.llm.store import stage, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned stay; those that the operator rejects go.

    Null and empty texts and texts without a letter go. Repeated rows are judged alike and stay repeated; null ids don't train, but
    are judged. Without labelled rows nothing is learned and everything goes; an empty table stays empty.
    """
    with stage(docs):
        found = language.identify(docs, language.learned(docs))
        return found.where("not rejected").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles, one stays, that with the smallest id; of repeated rows of it, one.

    Documents with a null id stay. Rows that share an id but not a text are judged apart. Null, empty and wordless texts are one
    text that links with no other. An empty table stays empty.
    """
    with stage(docs):
        return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a close paraphrase of one, go.

    Rows go by id and text, so a null or shared id takes no other text along; repeated rows go or stay together. Null and empty texts
    hold nothing and stay. An empty benchmark removes nothing; an empty table stays empty.
    """
    with stage(docs):
        rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))  # ids can be null or shared by different texts
        found = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__row").select(F.col("doc_id").alias("__row")).distinct()
        return rows.join(found, "__row", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind, and n_chars follows.

    A null text stays null, with a null n_chars. Repeated rows and null ids are treated like any row; an empty table stays empty.
    """
    with stage(docs):
        out = pii.redact(docs, pii.train(docs))
        return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with their ids and their places in sequences.

    A null or empty text is one piece, the end id. Repeated rows are packed as often as they come; ties between pieces of one length
    go either way; an empty table has no pieces.
    """
    with stage(docs):
        return pack(token_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Fingerprints, trained models and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again as the next one's documents; the last one's is returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
