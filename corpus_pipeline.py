"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; the
runner writes each result as Parquet and reads it again as the next stage's docs. All
stages but the last return the columns of `documents`, with n_chars brought up to date.

Defined results of every stage. A null or wordless text fails the quality rules, so it goes
first; a stage that gets one treats it as an empty text. Rows are rows: null and repeated ids
are kept apart, and decided by their texts and, among equal ones, by a row's own key. Equal
rows are one document to line dedup and lose no line to each other; near dedup keeps one of
them. Columns that `documents` doesn't have are dropped. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.llm import linededup, packing, pii, quality, shingledup
from verispan.llm.common import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go from the texts; a document with no line left goes."""
    return _counted(linededup.dedup_lines(docs.select(*COLUMNS))).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked by 0.8 or more of their five-word shingles, one row stays.

    SimHash's BK-trees over five-word fingerprints give the first pairs and a prefix index all others; shingle sets decide.

    That is the one with the smallest id, null ids last; among rows of one id the text's hash and the row's own key decide.
    """
    rows = docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id())
    # near_groups writes the rows with their keys before anything is told from them, so the keys stay the same.
    groups = shingledup.near_groups(rows)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row")).alias("first")
    keep = groups.groupBy("root").agg(first).select(F.col("first.row").alias("row"))
    return groups.join(keep, "row", "left_semi").select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind's name."""
    return _counted(pii.redact(docs.select(*COLUMNS)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the fingerprints' components, the tagger or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
