"""Near-duplicate groups by word shingles: all pairs of Jaccard similarity 0.8 or more, exactly.

A text's set is that of the XXH64 values of its word shingles (five words). Two texts are
linked when their sets have a Jaccard similarity of 0.8 or more; groups are the linked
texts' components.

1. Texts of equal sets are one class, named by a 64-bit digest of the set; one text of each
   class goes on.
2. Prefix index: the shingles of a set stand in one global order, and of n the first
   n - ceil(0.8 n) + 1 are its keys. Linked sets share a key. The order is by the counts of
   hash buckets over the shingles of all classes, frequent ones last; any order is exact, a
   good one is fast.
3. Each class is compared with the least class of each of its keys, and with those that SimHash
   links to it: BK-trees over five-word fingerprints (simhash.py). That is linear, and joins
   nearly all of a large group of near copies.
4. All other pairs of classes that share a key and are in different components so far are
   compared too, so nothing is left undecided. Keys whose classes are all joined go first.
5. A pair needs enough common keys: where one of two prefixes ends first, all common shingles
   up to there are common keys, and those after it are at most the rest of that set. Texts
   that share a passage only end here, before any text is moved. In step 3, which counts
   the keys of one least class only, the same bound merely puts pairs off until step 4.
6. Candidates are verified on the shingle sets of their texts.

Defined results. A null text, or one without words, has the empty set; those are one class.
Fewer words than a shingle form one shingle. Case matters only beyond ASCII. An empty table
gives an empty result.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.llm import simhash
from verispan.llm.common import discard, slices, with_python_columns, written
from verispan.llm.components import components
from verispan.llm.simhash import shingles
from verispan.session import ship

#: The similarity as a fraction, so that bounds are exact in whole numbers.
NUM, DEN = 4, 5
WIDTH = 5
#: Buckets of the table of levels, the parts in which it is summed, and levels for each doubling of a count.
BUCKETS, PARTS, STEPS = 1 << 20, 64, 8
#: Up to this many classes are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return np.unique(shingles(text, width))


def _tidy(run: Callable) -> Callable:
    """run, handing what its task's Python worker has freed back to the system: idle workers stay beside the JVM for a minute."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
            if trim:
                trim(0)

    return tidied


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _hashed(docs: DataFrame, text: str, width: int) -> DataFrame:
    """docs with c, the class, n, the size of the set, and fp, the SimHash fingerprint."""

    def load():
        def work(texts):
            names, sizes, fps = [], [], []
            for t in texts:
                hashes = shingles(t, width)
                s = np.unique(hashes)
                names.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                fps.append(simhash.majority(hashes))
            return [pa.array(np.array(names, np.uint64).astype(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).astype(np.int64))]

        return work

    return with_python_columns(docs, load, text, "c long, n int, fp long")


def _levels(texts: DataFrame, width: int) -> np.ndarray:
    """STEPS log2 of the number of classes' shingles in each hash bucket, all of them counted. A table of BUCKETS bytes, whatever the corpus."""
    size = BUCKETS // PARTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.uint32)
        for b in batches:
            for i, step in slices(b, 0):
                sets = [shingle_set(t, width) for t in b.column(0).slice(i, step).to_pylist()]
                seen += np.bincount(_buckets(np.concatenate(sets)), minlength=BUCKETS).astype(np.uint32)
        if seen.any():
            # Byte planes, as the upper bytes of counts are mostly zero.
            packed = [zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in seen.reshape(PARTS, size)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(packed, pa.binary())], ["part", "packed"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                planes = np.frombuffer(zlib.decompress(x.as_py()), np.uint8).reshape(4, size)
                total[p] = total.get(p, 0) + np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)
        if total:
            levels = [np.minimum(np.log2(np.maximum(v, 1)) * STEPS, 255).astype(np.uint8).tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    parts = texts.select("text").mapInArrow(_tidy(counted), "part int, packed binary").repartition(PARTS, "part").mapInArrow(_tidy(summed), "part int, levels binary")
    out = np.zeros((PARTS, size), np.uint8)
    for r in parts.collect():
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def _index(texts: DataFrame, levels: np.ndarray, width: int) -> DataFrame:
    """(k, c, n, p): the keys of every class with their place in the order, from 1."""
    table = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, step in slices(b, 1):
                part = b.slice(i, step)
                ks, cs, ns, ps = [], [], [], []
                for c, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle_set(t, width)
                    n = len(s)
                    u = n - -(-n * NUM // DEN) + 1 if n else 0
                    level = table.value[_buckets(s)]
                    ks.append(s[np.argsort(level, kind="stable")[:u]])
                    cs.append(np.full(u, c, np.int64))
                    ns.append(np.full(u, n, np.int32))
                    ps.append(np.arange(1, u + 1, dtype=np.int32))
                cols = [np.concatenate(ks).astype(np.int64), *map(np.concatenate, (cs, ns, ps))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["k", "c", "n", "p"])

    return texts.select("c", "text").mapInArrow(_tidy(run), "k long, c long, n int, p int")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(maxsize=64)(lambda t: shingle_set(t, width))
        for b in batches:
            a, c, x, y = b.columns
            ok = []
            for s, t in zip(x, y, strict=True):
                s, t = held(s.as_py()), held(t.as_py())
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(common * (NUM + DEN) >= (len(s) + len(t)) * NUM)
            yield pa.RecordBatch.from_arrays([a, c], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "pair-ends")
    some = texts.join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends, "c", "left_semi")
    side = lambda name: some.select(F.col("c").alias(name), F.col("text").alias(f"t{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    out = written(both.select("a", "b", "ta", "tb").mapInArrow(_tidy(run), "a long, b long"), "verified-pairs")
    discard(ends)
    return out


def _enough(n: Column, m: Column, common: Column) -> Column:
    """Whether two sets of n and m shingles with so many common keys can be linked."""
    least = lambda x: F.ceil(x * NUM / DEN)
    lengths = (n * NUM <= m * DEN) & (m * NUM <= n * DEN)
    return lengths & ((common + F.greatest(least(n), least(m)) - 1) * (NUM + DEN) >= (n + m) * NUM)


def _hints(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, a < b, whose SimHash fingerprints are equal or linked: each class of a fingerprint with its least one."""
    least = written(fps.groupBy("fp").agg(F.min("c").alias("c")), "fingerprint-classes")
    linked = simhash.links(least.select("fp"))
    side = lambda fp, c: least.select(F.col("fp").alias(fp), F.col("c").alias(c))
    across = linked.withColumnsRenamed({"a": "fa", "b": "fb"}).join(side("fa", "x"), "fa").join(side("fb", "y"), "fb").select("x", "y")
    within = fps.join(side("fp", "x"), "fp").select("x", F.col("c").alias("y"))
    out = written(across.union(within).filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "simhash-pairs")
    discard(least)
    return out


def _labels(edges: DataFrame) -> DataFrame:
    return components(edges).select(F.col("node").alias("c"), "root")


def near_groups(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with `root`: rows of one near-duplicate group, and no others, have equal ones."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.withColumnRenamed(text, "text")
    rows = written(_hashed(own, "text", width), "shingle-classes")
    one = rows.groupBy("c").agg(F.min(F.xxhash64("text")).alias("h"))
    # Rows of one class and one text hash are equal texts, bar a collision; any of them will do.
    texts = written(rows.select("c", "fp", "text", F.xxhash64("text").alias("h")).join(one, ["c", "h"], "left_semi").dropDuplicates(["c"]).select("c", "fp", "text"), "class-texts")
    index = written(_index(texts, _levels(texts, width), width), "shingle-index")
    pivots = index.groupBy("k").agg(F.min("c").alias("pivot"), F.min_by("n", "c").alias("pn"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    # Most keys are one class's; where the others are few, the index is neither shuffled nor sorted to meet them.
    pivots = written(pivots, "pivots")
    shared = written(index.join(F.broadcast(pivots) if pivots.count() <= BROADCAST_ROWS else pivots, "k"), "shared-keys")
    discard(index)
    discard(pivots)
    first = shared.filter("c != pivot").groupBy(F.col("pivot").alias("a"), F.col("c").alias("b")).agg(F.min("n").alias("n"), F.min("pn").alias("m"), F.count(F.lit(1)).alias("r"))
    hints = _hints(texts.select("c", "fp"))
    first = written(first.filter(_enough(F.col("n"), F.col("m"), F.col("r"))).select("a", "b").union(hints).distinct(), "pivot-pairs")
    discard(hints)
    linked = _verified(first, texts, width)

    labelled = shared.drop("pivot", "pn").join(_labels(linked), "c", "left").withColumn("root", F.coalesce("root", "c"))
    open_keys = labelled.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("k")
    left = written(labelled.join(open_keys, "k", "left_semi"), "open-keys")
    x, y = left.alias("x"), left.alias("y")
    n, m, p, q = F.col("x.n"), F.col("y.n"), F.col("x.p"), F.col("y.p")
    lengths = (n * NUM <= m * DEN) & (m * NUM <= n * DEN)
    # Common shingles are 1 and those after the first common key in either at most; only that key needs to pass, but all keys of a pair
    # that can be linked are counted: of such a pair the first one passes for certain.
    places = (1 + F.least(n - p, m - q)) * (NUM + DEN) >= (n + m) * NUM
    apart = (F.col("x.c") < F.col("y.c")) & (F.col("x.root") != F.col("y.root"))
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & apart & lengths)
    met = met.groupBy(F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(F.min(n).alias("n"), F.min(m).alias("m"), F.count(F.lit(1)).alias("r"), F.bool_or(places).alias("placed"))
    more = met.filter(F.col("placed") & _enough(F.col("n"), F.col("m"), F.col("r"))).select("a", "b")
    more = written(more.join(first, ["a", "b"], "left_anti"), "further-pairs")
    roots = _labels(linked.union(_verified(more, texts, width)))
    for t in (texts, shared, left, first, more):
        discard(t)
    return rows.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")).drop("c", "n", "fp").withColumnRenamed("text", text).select(*[f"`{c}`" for c in docs.columns], "root")
