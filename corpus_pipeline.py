"""From documents to token ids: quality, near duplicates, repeated lines, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
documents. All stages take nulls in any column, empty texts, repeated rows, an empty table and further columns, which are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progdf.llm.bpe import encoded
from progdf.llm.common import forget, saved, table
from progdf.llm.minhash import one_of_each
from progdf.llm.mixing import mix_sources
from progdf.llm.quality import quality_scores
from progdf.llm.substring import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labels of sf_dir, accepts. Null and empty texts are scored like others; repeated rows are judged alike."""
    return quality_scores(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on 5-word shingles with a similarity of 0.8 or more.

    Documents without words or without doc_id all stay; of rows that repeat doc_id and text one stays.
    """
    return one_of_each(docs.select(*COLUMNS), words=5, percent=80).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines and passages; n_chars is that of what is left. A null text stays null and has null n_chars."""
    return remove_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each once if it has no words. A null source is one of its own."""
    mixed = mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids. A null or empty text has none."""
    return encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The quality model and the tokenizer have no SQL form; tests compare every stage with brute force or the tokenizer's library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written as Parquet and read again by the next."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
