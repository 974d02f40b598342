"""From raw documents to token ids: five stages over the documents table, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontamination, near_duplicates, pii, toxicity
from tidemill.llm.storage import discard, store


# Each stage takes rows of documents with any further columns and returns them all. Texts of any length are judged whole.
# Null and empty texts pass the filters, and an empty table gives an empty one, unless a docstring says otherwise.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, rejects go; each row is judged by its text alone."""
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays, with all its different rows; of rows equal in every column one stays.

    Rows without doc_id are in no group and all stay.
    """
    gone = near_duplicates.near_duplicate_classes(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    named = docs.filter("doc_id is not null").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").dropDuplicates()
    return named.unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with all rows of their doc_id; rows without doc_id are judged together."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced; n_chars follows the text. A null text stays null, as its n_chars becomes."""
    out = pii.pseudonymised(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the token ids, their number and the digests of ids and decoded text; a null text has no tokens."""
    return bpe.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("bpe", tokenise),
]

#: Toxicity scores and tokens are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        after = store(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = after
    return docs
