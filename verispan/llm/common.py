"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.session import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly value once: body sees a lambda variable, not the expression again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, set as the checkpoint folder too."""
    found = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose DataFrames are gone; they stay until garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them again. options: of the writer."""
    spark = df.sparkSession
    release(spark)
    path = fresh_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_path"] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing refers to any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["_path"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of text that a Python step takes at a time.
SLICE_BYTES = 4 << 20


def slices(batch, column: int, size: int = SLICE_BYTES):
    """(start, number) of runs of rows that hold about `size` bytes of the column, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right"))
        j = max(j, i + 1)
        yield i, j - i
        i = j


def with_python_columns(df: DataFrame, load: Callable[[], Callable], column: str, fields: str, kind: str = "string", size: int = SLICE_BYTES) -> DataFrame:
    """Add columns computed in Python from one string (or binary) column, a slice of rows of about `size` bytes at a time.

    load() runs once per task and returns a function from a list of texts (None for null)
    to a list of Arrow arrays, one for each of `fields` (a DDL string). Other columns
    pass through; one that has the name of a new column gives way to it.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from verispan.session import ship

    ship(df.sparkSession)
    new = StructType.fromDDL(fields)
    names = {f.name.lower() for f in new}
    kept = [c for c in df.columns if c.lower() not in names]
    source = df.select(F.col(f"`{column}`").cast(kind).alias("__text"), *[F.col(f"`{c}`") for c in kept])
    schema = StructType([*source.schema.fields[1:], *new.fields])

    def run(batches):
        work = load()
        for b in batches:
            for i, step in slices(b, 0, size):
                part = b.slice(i, step)
                out = work(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *out], names=schema.names)

    return source.mapInArrow(run, schema)
