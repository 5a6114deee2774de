"""Writers: chunk upsert, run files, the result matrix, and traces split by audience."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with the rows of new put in whole by key; of several new rows with one key the last by all columns stays."""
    order = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in new.columns if c != key and not new.schema[c].dataType.typeName() == "map"])
    fresh = new.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def save_run(results: DataFrame, path: str, run_id: str) -> None:
    """A run's results as JSON lines under its id."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id").json(path)


def read_run(results_path: str, like: DataFrame) -> DataFrame:
    """A saved run as a baseline."""
    return like.sparkSession.read.schema(like.schema).json(results_path)


def matrix(summary: DataFrame, value: str = "correct") -> DataFrame:
    """One row per pipeline, one column per question type."""
    return summary.groupBy("pipeline").pivot("type").agg(F.first(value)).orderBy("pipeline")


def format_matrix(summary: DataFrame) -> str:
    """The matrix as text, correct of questions, for people."""
    cells = summary.select("pipeline", "type", F.concat(F.col("correct").cast("string"), F.lit("/"), F.col("questions").cast("string")).alias("cell"))
    rows = matrix(cells, "cell").collect()
    types = [c for c in rows[0].__fields__ if c != "pipeline"] if rows else []
    lines = [f"{'pipeline':<14}" + "".join(f"{t[:12]:>14}" for t in types)]
    lines += [f"{r['pipeline']:<14}" + "".join(f"{r[t] or '-':>14}" for t in types) for r in rows]
    return "\n".join(lines)


def write_trace(events: DataFrame, public_path: str, admin_path: str) -> None:
    """Public events and administrators' payloads into two places; the public one never has the latter."""
    events.drop("admin").write.mode("append").parquet(public_path)
    events.filter("admin IS NOT NULL").select("bundle_id", "sequence", "admin").write.mode("append").parquet(admin_path)
