"""Packing of tokenized documents into sequences of a fixed length.

The plan is made over the counts of piece lengths, of which there are at most `capacity`,
so its size does not follow the corpus. Exact-complement hashing comes first: the sums of
one, two and three lengths are indexed; with the longest pieces as anchors, each
combination that fills the anchor's gap exactly is looked up there and taken as often as
the counts allow, until the anchor's pieces or the combinations are used up. What remains is placed best-fit decreasing, again in whole groups of equal
sequences. Each piece then takes the place of its rank among the pieces of its length;
ranks are counted in salted groups, so a length that a third of all pieces have is not one
task's.

Defined results. A null text counts as an empty one and is its end id alone. Rows with null
or repeated ids are packed like others; equal rows are interchangeable. Extra columns of
the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verispan.llm import bpe
from verispan.llm.common import slices, written
from verispan.session import ship

CAPACITY = 4096
END_ID = 1
#: Runs in each of the encoder's two tables: a task has one Python worker here, so its tables can be larger.
KEPT_RUNS = 600_000

#: (number of equal sequences, [(length, how many of it in each)])
Pattern = tuple[int, list[tuple[int, int]]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, file: str | None = None, end_id: int = END_ID, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token ids with an end, cut where longer than capacity."""
    ship(docs.sparkSession)
    file = file or bpe.path()
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(file, KEPT_RUNS)
        for b in batches:
            for i, step in slices(b, 1, bpe.SLICE):
                part = b.slice(i, step)
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(enc.encode_all(part.column(1).to_pylist())):
                    ids += end
                    for j, at in enumerate(range(0, len(ids), 4 * capacity)):
                        x = ids[at : at + 4 * capacity]
                        row.append(k)
                        piece.append(j)
                        start.append(at // 4)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class _Sums:
    """How many pieces of each length are left, and an index of the sums of one, two and three lengths.

    The index hashes a sum to the larger parts of its pairs and to the largest parts of its
    triples. It is built once for the lengths that occur; what has run out is passed over.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for k, v in counts.items():
            self.n[k] = v
        lengths = np.flatnonzero(self.n)[::-1].astype(np.int32)
        #: Of each sum the smallest larger part of its pairs, that is of the most even one.
        even = np.full(capacity + 1, capacity + 1, np.int32)
        # Larger parts come in descending order; a stable sort by the sums keeps that order.
        pairs = [(a, (s := lengths[lengths <= min(a, capacity - a)] + a)) for a in lengths.tolist()]
        for a, s in pairs:
            even[s] = a
        self.pairs = self._by_sum(pairs)
        sums = np.flatnonzero(even <= capacity).astype(np.int32)
        self.triples = self._by_sum([(a, sums[(even[sums] <= a) & (sums + a <= capacity)] + a) for a in lengths.tolist()])

    @staticmethod
    def _by_sum(found: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
        """From (part, its sums) to the parts of each sum."""
        if not found:
            return {}
        total = np.concatenate([s for _, s in found])
        part = np.repeat(np.array([a for a, _ in found], np.int32), [len(s) for _, s in found])
        order = np.argsort(total, kind="stable")
        total, part = total[order], part[order]
        cuts = np.flatnonzero(np.diff(total)) + 1
        return {int(total[i]): x for i, x in zip([0, *cuts.tolist()], np.split(part, cuts), strict=True)} if len(total) else {}

    def _left(self, parts: dict[int, np.ndarray], total: int) -> np.ndarray:
        found = parts.get(total)
        return found[self.n[found] > 0] if found is not None else np.zeros(0, np.int32)

    def _pairs(self, total: int) -> np.ndarray:
        found = self._left(self.pairs, total)
        return found[self.n[total - found] > 0]

    def fillers(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Combinations of lengths that are left and fill the gap exactly: single, then pairs, then triples."""
        if not gap:
            yield ()
            return
        if self.n[gap]:
            yield (gap,)
        for a in self._pairs(gap).tolist():
            yield (a, gap - a)
        for a in self._left(self.triples, gap).tolist():
            found = self._pairs(gap - a)
            for b in found[found <= a].tolist():
                yield (a, b, gap - a - b)

    def take(self, parts: tuple[int, ...]) -> int:
        """Use the combination up: as often as the counts allow."""
        what = Counter(parts)
        times = min(int(self.n[k]) // m for k, m in what.items())
        for k, m in what.items():
            self.n[k] -= m * times
        return times


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Sequences for so many pieces of each length."""
    left, out = _Sums(counts, capacity), []
    for anchor in sorted(counts, reverse=True):
        # Each combination that is taken uses up a length or the anchor, so there are few; of others a count refuses each once.
        for found in left.fillers(capacity - anchor):
            if not left.n[anchor]:
                break
            if times := left.take((anchor, *found)):
                out.append((times, sorted(Counter((anchor, *found)).items(), reverse=True)))
    # Best-fit decreasing: gap -> [(how many, contents)].
    open_: dict[int, list[Pattern]] = defaultdict(list)
    gaps: list[int] = []
    done: list[Pattern] = []

    def put(n: int, content: list[tuple[int, int]], gap: int) -> None:
        if not gap:
            done.append((n, content))
            return
        if not open_[gap]:
            bisect.insort(gaps, gap)
        open_[gap].append((n, content))

    for length in np.flatnonzero(left.n)[::-1].tolist():
        k = int(left.n[length])
        while k:
            i = bisect.bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                n, content = open_[gap].pop()
                if not open_[gap]:
                    gaps.pop(i)
            else:
                gap, n, content = capacity, k, []
            fit = gap // length
            full = min(n, k // fit)
            if full:
                put(full, [*content, (length, fit)], gap - fit * length)
                k -= full * fit
                n -= full
            elif k:
                put(1, [*content, (length, k)], gap - k * length)
                k, n = 0, n - 1
            if n and content:
                put(n, content, gap)
    out += done
    for gap in gaps:
        out += open_[gap]
    return out


def _tables(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, in order of rank: first rank, how many in a sequence, first sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for n, content in patterns:
        at = 0
        for length, m in content:
            rows[length].append((used[length], m, first, at))
            used[length] += n * m
            at += length * m
        first += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a column `length` (1 to capacity) get sequence_id and offset.

    found should be a written table: it is read for the counts and for the ranks.
    """
    spark = found.sparkSession
    ship(spark)
    # At most `capacity` rows come to the driver.
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    if any(k is None or k < 1 or k > capacity for k in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    tables = spark.sparkContext.broadcast(_tables(plan(counts, capacity)))
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in found.columns]
    salted = found.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = sums.withColumn(
        "__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")
    ).drop("__n")
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*keys))
    ranked = salted.withColumn("__in", within - 1).join(before, ["length", "__salt"])
    ranked = ranked.select(*found.columns, (F.col("__before") + F.col("__in")).cast("long").alias("__rank"))
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tables.value
        for b in batches:
            length = b.column(names.index("length")).to_numpy()
            rank = b.column(len(names)).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                k = int(length[part[0]])
                lo, many, first, at = held[k]
                i = np.searchsorted(lo, rank[part], "right") - 1
                x = rank[part] - lo[i]
                seq[part] = first[i] + x // many[i]
                off[part] = at[i] + x % many[i] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*found.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(written(pieces(docs, capacity, **options), "pieces"), capacity)
