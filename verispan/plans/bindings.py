"""The engine's concepts bound to the driver's tables: chunks, questions, graph edges, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions.vectors import hash_embedding
from verispan.operators.ingest import analysed
from verispan.session import stored

DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, dealt out anew where the scan has fewer parts than there are cores: what is done to a text costs far more than moving it."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores else docs


def groups_of(number):  # noqa: ANN001, ANN201
    """Every fifth source is for one group only, another fifth for the other, the rest for both."""
    return (
        F.when(number % 5 == 0, F.array(F.lit("commercial")))
        .when(number % 5 == 1, F.array(F.lit("quality")))
        .otherwise(F.array(F.lit("commercial"), F.lit("quality")))
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks; of equal texts the one with the largest id is current.

    Currency is told by a digest's largest id, pre-aggregated, so that a much copied text
    is not one task's.
    """
    docs = texts(spark, sf_dir).select("doc_id", "text", "lang", "source", F.md5("text").alias("_d"))
    newest = docs.groupBy("_d").agg(F.max("doc_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    # Only the older rows of repeated texts, ids without their texts, are marked: what occurs once is never moved for this.
    again = newest.filter("_n > 1").drop("_n")
    older = docs.select("doc_id", "_d").join(again, "_d").filter("doc_id != _top").select("doc_id", F.lit(True).alias("_old"))
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    cols = [
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("chunk_id"),
        F.col("source").alias("document_id"),
        F.concat("source", F.lit("#"), F.col("doc_id").cast("string")).alias("ref"),
        "text",
        groups_of(number).alias("groups"),
        F.col("source").alias("title"),
        F.col("lang").alias("section"),
        F.lit("upload").alias("doc_type"),
        F.when(F.col("_old"), "superseded").otherwise("current").alias("status"),
        F.contains("text", F.lit("|")).alias("is_table_row"),
        F.lit("").alias("context"),
        F.col("doc_id"),
    ]
    return docs.join(older, "doc_id", "left").select(*cols)


def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_chunks with `toks`, their content tokens, and embeddings: written once, as an ingest would, and read by all searches."""

    def build() -> DataFrame:
        return analysed(document_chunks(spark, sf_dir), F.col("text"), DIM)

    return stored(spark, f"chunks of {sf_dir}", build)


def benchmark_questions(spark: SparkSession, sf_dir: str, embed: bool = False) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), "text", F.array(F.when(F.col("item_id") % 2 == 0, "commercial").otherwise("quality")).alias("groups")
    )
    return q.withColumn("embedding", hash_embedding(F.col("text"), DIM)) if embed else q


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks; access by label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        groups_of(F.col("label")).alias("groups"),
        F.lit("current").alias("status"),
        F.lit(False).alias("is_table_row"),
        "embedding",
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a question, of one group or the other in turn."""
    asker = F.when(F.floor(F.col("vec_id") / 100) % 2 == 0, "commercial").otherwise("quality")
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.array(asker).alias("groups"), "embedding")


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks that mention their parts and suppliers; access by order number."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    both = F.explode(F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))))
    edges = li.select(F.col("l_orderkey").alias("chunk_id"), both.alias("entity")).distinct()
    return edges.select("chunk_id", groups_of(F.col("chunk_id")).alias("groups"), "entity")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as results of runs: pipelines by type of event, question types by user."""
    kinds = F.array(*map(F.lit, ("lookup", "superseded", "numeric", "forbidden", "out_of_scope", "table")))
    e = table(spark, sf_dir, "events")
    pipes = F.array(*map(F.lit, ("naive", "hybrid", "graph", "sql")))
    n = F.col("event_id")
    kind = F.get(kinds, (F.col("user_id") % 6).cast("int"))
    return e.select(
        n.alias("qid"),
        F.get(pipes, (n % 4).cast("int")).alias("pipeline"),
        kind.alias("type"),
        F.when(n % 7 < 4, "correct").when(n % 7 < 5, "partial").otherwise("wrong").alias("grade"),
        (n % 9 != 0).alias("verdict_ok"),
        F.when(kind == "forbidden", "access_denied").when(kind == "out_of_scope", "insufficient_evidence").otherwise("answered").alias("verdict"),
        F.when(n % 5 != 0, (n % 3).cast("double") / 2).alias("recall"),
        F.lit(False).alias("leaked"),
        (n % 11 == 0).alias("verifier_changed"),
        (n % 13 == 0).alias("execution_failed"),
        (n % 10).cast("double").alias("cost_usd"),
        F.col("value").alias("ms"),
        F.when(kind == "table", "all").when(kind == "numeric", "sql").when(kind == "lookup", "agentic").otherwise("hybrid").alias("hypothesis"),
    )
