"""A corpus pipeline of the operators in docwarden.llm.

Quality classifier, near-duplicates, benchmark decontamination, pseudonyms and mixing, in this order. Each stage works on all that the one before
it kept; run() writes each stage's rows to the shared folder as Parquet and hands them on. Removals are anti-joins with the keys to remove, which
are broadcast only if they are counted to be few, so texts that stay aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.llm.common import Scratch, small, table
from docwarden.llm.decontamination import decontaminated
from docwarden.llm.mixing import mixed
from docwarden.llm.neardup import near_duplicates
from docwarden.llm.pii import pseudonymised
from docwarden.llm.quality import scored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """The documents whose (doc_id, text) isn't among keys (doc_id, text_key), or with left_semi, is."""
    keys = small(keys.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    found = scored(docs, table(spark, sf_dir, "labels"), keep=tuple(c for c in docs.columns if c != "doc_id"))
    return found.where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one whose doc_id names the group, once. Documents without words have no group."""
    scratch = Scratch(spark)
    found = near_duplicates(docs).groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max("kept").alias("kept"), F.min("component_id").alias("group"), F.max("n_shingles").alias("size"))
    # Of several texts under the group's doc_id, the one with the least hash.
    first = F.min(F.when(F.col("kept"), F.col("text_key")))
    heads = found.where("kept and size > 0").groupBy(F.col("group").alias("g")).agg(first.alias("first"))
    found = scratch.cut(found.join(heads, F.col("group").eqNullSafe(F.col("g")) & (F.col("size") > 0), "left").withColumn("stays", F.col("kept") & ((F.col("size") == 0) | (F.col("text_key") == F.col("first")))), "found")
    rest = _without(docs, found.where("not stays or n > 1"))
    twice = _without(docs, found.where("stays and n > 1"), "left_semi")
    return rest.union(twice.dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    # Written before it is counted, so that the search runs once.
    found = Scratch(spark).cut(decontaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_key"), "found")
    return _without(docs, found)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows the text."""
    done = pseudonymised(docs).drop("n_replaced", "kinds")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents, and what it takes of each. Documents of which it takes nothing are left out."""
    return mixed(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "source"))).where("taken > 0")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("mixing", mixing)]
#: A trained model and iterated components are beyond SQL; tests/llm holds the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
