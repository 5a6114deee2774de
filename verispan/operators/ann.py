"""Approximate vector search: an inverted file of cells around centroids.

Centroids are fitted on a bounded sample; every row is indexed. How many cells a question
looks into is found at fitting, on questions of the sample against the whole sample, so that
at least `recall` of the true neighbours are among the candidates. Exact search stays in
search.vector_search; this is for tables where that is too much.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from verispan.operators.search import BLOCK, Found, _task_best, best, eligible
from verispan.session import settled, ship

#: The bounded sample that centroids are fitted on: the rows with the least id hashes.
SAMPLE = 10_000
CELLS, ROUNDS, RECALL, ASKED = 64, 8, 0.95, 200


@dataclass
class CellIndex:
    rows: DataFrame  # the chunks' columns and `cell`
    centroids: np.ndarray
    probes: int


def _sample(chunks: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors, the same ones whatever the partitioning."""
    got = chunks.select(F.xxhash64(F.col("chunk_id").cast("string")).alias("h"), F.col("embedding").cast("array<double>").alias("e")).orderBy("h").limit(most).toArrow()
    return np.array(got.column("e").to_pylist(), np.float64) if got.num_rows else np.zeros((0, 1))


def _fit(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(0)
    return c


def _cells(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def _probes(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells in which `recall` of the sample's own neighbours are."""
    q = x[:: max(1, len(x) // ASKED)]
    top = np.argsort(-(q @ x.T), axis=1)[:, :k]
    order = np.argsort(-(q @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None].repeat(len(q), 0), 1)
    found = np.take_along_axis(place, _cells(x, c)[top], 1)
    return next(p for p in range(1, len(c) + 1) if (found < p).mean() >= recall)


def build(chunks: DataFrame, k: int = 30, cells: int = CELLS, recall: float = RECALL, sample: int = SAMPLE) -> CellIndex:
    spark = chunks.sparkSession
    ship(spark)
    x = _sample(chunks, sample)
    if not len(x):
        return CellIndex(chunks.withColumn("cell", F.lit(0)), np.zeros((1, 0)), 1)
    c = _fit(x, cells, ROUNDS)
    held, at = spark.sparkContext.broadcast(c), chunks.columns.index("embedding")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            v = np.array(b.column(at).to_pylist(), np.float64).reshape(b.num_rows, -1)
            cell = _cells(v, held.value) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    return CellIndex(settled(chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField("cell", IntegerType())])), "cells"), c, _probes(x, c, min(k, len(x)), recall))


class _CellDots:
    """Scores by dot product of a batch's chunks, cell by cell, with the questions that look into the cell."""

    def __init__(self, vectors: np.ndarray, looks: np.ndarray) -> None:
        self.matrix, self.looks = vectors.T, looks  # looks: (cells, questions)

    def __call__(self, held):  # noqa: ANN001, ANN204
        v, cell = np.array(held.field("embedding").to_pylist(), np.float64).reshape(len(held), -1), np.asarray(held.field("cell").to_pylist(), np.int64)
        out = np.full((len(held), self.matrix.shape[1]), -np.inf)
        for c in np.unique(cell):
            rows, asks = np.flatnonzero(cell == c), np.flatnonzero(self.looks[c])
            out[np.ix_(rows, asks)] = v[rows] @ self.matrix[:, asks]
        return out


def search(index: CellIndex, questions: DataFrame, k: int = 30, current_only: bool = False, table_rows: bool = False) -> Found:
    """Hidden chunks never rank; a question meets the chunks of its `probes` best cells only, so it may get fewer than k."""
    c, n = index.centroids, index.probes

    def scorer(rows):  # noqa: ANN001, ANN202
        v = np.array(rows.column("e").to_pylist(), np.float64).reshape(rows.num_rows, -1)
        near = v @ c.T if c.size else np.zeros((len(v), 1))  # an index of nothing has one empty cell
        looks = np.zeros(near.T.shape, bool)
        np.put_along_axis(looks, np.argsort(-near, axis=1)[:, :n].T, True, 0)
        return _CellDots(v, looks), 1024

    asked = questions.select("qid", "groups", F.col("embedding").cast("array<double>").alias("e"))
    rows = index.rows.filter(eligible(current_only, table_rows)).select("chunk_id", "groups", F.struct("embedding", "cell").alias("held"))
    hits = best(_task_best(rows, "held", asked, k, True, scorer, BLOCK), k).select("qid", "chunk_id", "score", F.lit("vector").alias("source"), "rank")
    return Found(hits, questions.select("qid", F.lit(0).cast("long").alias("removed")))
