"""The corpus pipeline: quality classifier, near-dedup, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of docs. run() applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import bpe, minhash, mixing, pii, quality
from isobar.llm.base import bounded_batches, screened, table, written


def rated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is fitted on the labelled documents of docs."""
    bounded_batches(spark)
    return quality.select(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles: the least id, and of its texts one.

    Texts of one id are documents of their own, unless they are equal. Rows with a null id stay unless they are near-duplicates
    of others; blank ones are no duplicates and stay. Only rows that may have to go are shuffled.
    """
    bounded_batches(spark)
    found = written(minhash.near_duplicates(docs, k=5).select("doc_id", "n_shingles", F.col("rep").alias("__rep"), F.col("key").alias("__key"), "first"), "groups")
    gone = found.where("not first").select("__rep", "__key").distinct()
    again = found.where("first and (n_shingles > 0 or doc_id is not null)").groupBy("__rep", "__key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rep, key = minhash.name_of("doc_id", "text")
    rows = docs.select("*", rep.alias("__rep"), key.alias("__key"))
    rows = screened(rows, gone.unionByName(again), ["__rep", "__key"])
    blank = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    suspect = rows.where(F.col("__maybe") & ~blank).dropDuplicates(["__rep", "__key"]).join(gone, ["__rep", "__key"], "left_anti")
    return rows.where(~F.col("__maybe") | blank).unionByName(suspect).select(*(F.col(f"`{c}`") for c in docs.columns))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    bounded_batches(spark)
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its ids' number and digest, and the digest of the decoded text."""
    bounded_batches(spark)
    return bpe.digests(docs)


STAGES = [("quality", rated), ("near_dedup", deduplicated), ("personal_data", masked), ("mixing", mixed), ("tokens", tokens)]

#: The fitted classifier and the sketches have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage keeps is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
