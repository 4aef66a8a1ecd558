"""A text corpus from raw documents: rules, near-duplicates, benchmark leaks, personal data, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which run() writes as Parquet and reads again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupsight.llm import near_copies, op3_packing, op6_host_rules, op7_decontaminate, op8_pii
from groupsight.llm.common import BROADCAST_ROWS, with_row
from groupsight.sources.store import cut, scratch

#: The packing stage's order and the pseudonyms are outside SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or come from a blocked host, go; null and empty texts have no words and fail. Each row is judged by itself, whatever its id; other columns stay, whatever their names."""
    return op6_host_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) one row stays: that with the smallest id.

    Null ids come after all others; of rows with the same id or none, the first stays. Texts without words are copies of each other.
    """
    keyed, row = with_row(docs)
    with scratch(spark) as tables:
        found = near_copies.near_copies(keyed, row_col=row)
        gone, path = cut(found.where("row <> first_row").select(F.col("row").alias(row)), "gone", with_path=True)
        tables.remove(path)
    few = gone.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(gone) if few else gone, row, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts hold none and stay. Each row is judged by itself, whatever its id; other columns stay, whatever their names."""
    return op7_decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms of the same format; every row and column stays, whatever its name, null and empty texts as they are; very long texts are read whole."""
    return op8_pii.pseudonymize(docs, op8_pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences; null texts are empty, repeated rows and ids are packed each; other columns are not read, so their names do not matter."""
    return op3_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("private_data", private_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
