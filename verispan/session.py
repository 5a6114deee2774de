"""Session helpers: a local session for tests, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A small local session; on a cluster the submitter configures its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; in local mode a local one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="verispan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per application into the shared folder, such as chunks with their tokens and embeddings: the ingest step."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
        build().write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def settled(df: DataFrame, name: str) -> DataFrame:
    """Rows of a step that several later ones read, such as hits or drafts: written into the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Workers need the modules that a function refers to; a cluster that got them
    by --py-files already has them, and a second copy does no harm.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "verispan_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
