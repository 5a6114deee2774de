"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. Each symbol of a level has a name; runs of
one name become single symbols, and deterministic coin tossing (the lowest bit in which a
name differs from the name before it, with that bit) is repeated until labels are small.
Local minima of the labels begin phrases of two or more symbols, and a phrase's name is a
hash of its names in order. Whether a place begins a phrase depends on a few symbols
around it only, so equal substrings are cut alike and get equal names inside, wherever
they stand; only phrases at their two ends can differ.

The fingerprint of a text is the exact hash of the whole parse together with a signature:
for each of SLOTS slots the least of the hashes of the text's phrases (one permutation
hashing over the phrase names of the middle levels, empty slots filled from their
neighbours). Likeness is the share of equal slots, and 1 for equal fingerprints.

All texts of a slice are parsed together as one array of symbols; phrases never cross a
text's end. Memory follows the slice, or the longest text.

Defined results. A null text counts as an empty one; empty texts share one fingerprint and
likeness 1 among themselves, 0 against any other. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.llm.common import slices
from verispan.session import ship

SLOTS = 64
#: Bytes of text parsed at a time: some ten arrays of 8 bytes a character are held.
SLICE = 512 << 10
#: Hexadecimal digits of the whole text's name and of each slot.
WHOLE, SLOT = 16, 4
#: Levels whose phrases enter the signature (1: phrases of characters).
FIRST, LAST = 2, 4
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: the lowest bit in which a label differs from the one before, and that bit."""
    before = np.empty_like(label)
    before[1:] = label[:-1]
    before[0] = ~label[0] if len(label) else 0
    before[first] = ~label[first]
    diff = label ^ before
    low = diff & (~diff + np.uint64(1))
    at = (low.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)  # the exponent of a power of two
    return (at << np.uint64(1)) | ((label >> at) & np.uint64(1))


def _level(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and texts of the phrases of one level; each text keeps one symbol at least."""
    n = len(name)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    if len(at) < n:  # runs of one name
        count = np.diff(np.append(at, n)).astype(np.uint64)
        name, doc = name[at], doc[at]
        run = count > 1
        name = name.copy()
        name[run] = _mix(name[run] ^ _mix(count[run] * _M3))
        # Named runs can equal a neighbour only by a clash of hashes; labels below treat that as a boundary.
    n = len(name)
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    label = name
    clash = np.zeros(n, bool)
    clash[1:] = ~first[1:] & (name[1:] == name[:-1])
    if clash.any():
        label = np.where(clash, ~name, name)
    for _ in range(3):  # 64-bit names, then under 128, under 14, under 8
        label = _toss(label, first)
    label = label.astype(np.int8)
    low = np.zeros(n, bool)
    if n > 2:
        low[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] <= label[2:])
    low[1:] &= ~first[:-1]  # a phrase has two symbols at least, at either end of a text too
    low[:-1] &= ~first[1:]
    low[-1] = False
    low &= ~first
    begin = np.flatnonzero(first | low)
    size = np.diff(np.append(begin, n))
    place = np.arange(n) - np.repeat(begin, size)
    # Order within the phrase enters by an odd factor for each place; sums wrap, which keeps them exact.
    term = _mix(name + _M3) * (np.uint64(2) * _mix(place.astype(np.uint64) + np.uint64(1)) + np.uint64(1))
    named = _mix(np.add.reduceat(term, begin) ^ size.astype(np.uint64))
    return named, doc[begin]


def signatures(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    if not texts:
        return []
    n = len(texts)
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(x) for x in raw])
    doc = np.repeat(np.arange(n), sizes)
    name = _mix(np.concatenate(raw).astype(np.uint64) * _M3 + np.uint64(1))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    slots = np.full((n, SLOTS), top, np.uint64)
    whole = np.zeros(n, np.uint64)
    level = 0
    while len(name):
        level += 1
        alone = np.ones(len(name), bool)
        alone[1:] &= doc[1:] != doc[:-1]
        alone[:-1] &= doc[1:] != doc[:-1]
        if FIRST <= level <= LAST + 1 or alone.any():
            # Phrases of the middle levels; of a short text its last symbol too.
            use = np.ones(len(name), bool) if FIRST <= level - 1 <= LAST else alone
            h = _mix(name[use] + np.uint64(level))
            at = doc[use] * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64)
            np.minimum.at(slots.reshape(-1), at, h // np.uint64(SLOTS))
        if alone.any():
            whole[doc[alone]] = _mix(name[alone] + sizes[doc[alone]].astype(np.uint64))
            name, doc = name[~alone], doc[~alone]
            if not len(name):
                break
        name, doc = _level(name, doc)
    return [
        f"{int(w):0{WHOLE}x}" + "".join(f"{x:0{SLOT}x}" for x in row)
        for w, row in zip(whole, _densify(slots).tolist(), strict=True)
    ]


def _densify(slots: np.ndarray) -> np.ndarray:
    """Empty slots take the value of the next filled one, marked by the distance; 16 bits of each."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = slots.copy()
    for d in range(1, SLOTS):
        empty = out == top
        if not empty.any():
            break
        moved = np.roll(slots, -d, axis=1)
        fill = empty & (moved != top)
        out[fill] = _mix(moved[fill] + np.uint64(d))
    return np.where(out == top, np.uint64(0), _mix(out)) & np.uint64(0xFFFF)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots of two fingerprints, from 0 to 1; a Column without user functions."""
    slot = lambda x, i: F.substring(x, i * SLOT + (WHOLE + 1), SLOT)
    same = sum((slot(a, i) == slot(b, i)).cast("int") for i in range(SLOTS))
    empty = F.lit("0" * WHOLE)
    one_empty = (F.substring(a, 1, WHOLE) == empty) != (F.substring(b, 1, WHOLE) == empty)
    return F.when(a == b, F.lit(1.0)).when(one_empty, F.lit(0.0)).otherwise(same / F.lit(float(SLOTS)))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint of each text."""
    from verispan.llm.common import with_python_columns

    def load():
        return lambda texts: [pa.array(signatures([t or "" for t in texts]), pa.string())]

    return with_python_columns(docs, load, text, f"`{out}` string", size=SLICE)


def in_turn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    mark: Callable[[list[str]], list[str]] | None = None,
    then: Callable[[list[tuple]], list[tuple]] | None = None,
    fields: str = "text string, mark string, next_text string, next_mark string",
) -> DataFrame:
    """doc_id and `fields`: each document with the next by descending id, the first after the last.

    mark gives each text a string that goes along, such as its fingerprint; it sees each text
    once, a slice of them at a time. Without it marks are null. then turns such slices of
    (text, mark, next_text, next_mark) into the values of `fields`, for what needs both texts.
    Both run inside the two passes that there are, so a task has one Python worker.

    Rows of one id stand by a 64-bit hash of their texts, then the texts; null ids last. Ranges
    of ids are cut at quantiles, several to a shuffle partition, and an id that fills some of
    them (or null) is cut by the hash. A range gets a copy of the first row of the range that
    follows, so each partition knows its last row's follower and every text is shuffled about
    once. Other rows than that first one are copied only where a slice can't tell: one of each.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    seen = rows.select(
        F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q"), F.count(F.lit(1)).alias("all"), F.count("doc_id").alias("known")
    ).first()
    found = Counter(seen["q"] or [])
    cuts = np.array(sorted(found), np.int64)
    # How many parts an id has of its own: as many as the quantiles that it is, if more than one; null by its share.
    own = np.array([m if m > 1 else 0 for m in map(found.get, cuts.tolist())], np.int64)
    nulls = max(1, n * (seen["all"] - seen["known"]) // max(1, seen["all"]))
    # Ranges are numbered from the largest ids down: above all cuts, then for each cut its own parts and what is below it.
    under = 1 + np.cumsum(own[::-1] + 1)[::-1] - 1 if len(cuts) else np.zeros(0, np.int64)
    last = int(under[0]) + 1 if len(cuts) else 1

    def ranges(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        """Which range each row falls in."""
        none = ids.is_null().to_numpy(zero_copy_only=False)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        share = (hashes.to_numpy(zero_copy_only=False).astype(np.float64) + 2.0**63) / 2.0**64
        out = np.where(none, last + np.minimum((share * nulls).astype(np.int64), nulls - 1), 0)
        j = np.searchsorted(cuts, known, "left")
        below = ~none & (j < len(cuts))
        if below.any():
            k = j[below]
            m = own[k]
            at = np.where((cuts[k] == known[below]) & (m > 0), under[k] - m + np.minimum((share[below] * m).astype(np.int64), m - 1), under[k])
            out[below] = at
        return out

    hashed = rows.withColumn("hash", F.xxhash64("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: set[int] = set()
        for b in batches:
            got |= set(np.unique(ranges(b.column(0), b.column(1))).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.int32())], ["r"])

    # One row for each range that has rows: as many as a few per shuffle partition at most.
    filled = [x.r for x in hashed.select("doc_id", "hash").mapInArrow(tally, "r int").distinct().orderBy("r").collect()]
    before = {r: filled[i - 1] for i, r in enumerate(filled)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, step in slices(b, 1, SLICE):
                part = b.slice(start, step)
                texts = part.column(1).to_pylist()
                marks = pa.array(mark(texts) if mark else [None] * step, pa.string())
                r = ranges(part.column(0), part.column(2))
                own = pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(np.zeros(step), pa.int32()), *part.columns, marks], ["at", "copy", "doc_id", "text", "hash", "mark"])
                yield own
                place = list(zip((-(x or 0) for x in part.column(0).to_pylist()), part.column(2).to_pylist(), texts, strict=True))
                first: dict[int, int] = {}
                for i, k in enumerate(r.tolist()):
                    if k not in first or place[i] < place[first[k]]:
                        first[k] = i
                led = own.take(pa.array(list(first.values()), pa.int64()))
                to = pa.array([before[k] for k in first], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(first)), pa.int32()), *led.columns[2:]], own.schema.names)

    dealt = (
        hashed.mapInArrow(deal, "at int, copy int, doc_id long, text string, hash long, mark string")
        .repartition(parts, "at")
        .sortWithinPartitions(F.col("at"), F.col("copy"), F.desc_nulls_last("doc_id"), F.col("hash"), F.col("text"))
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"doc_id long, {fields}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its follower
        for b in batches:
            for i, step in slices(b, 3, SLICE):
                ids, out = [], []
                for at, copy, doc, t, _, m in zip(*(c.to_pylist() for c in b.slice(i, step).columns), strict=True):
                    if held is not None and held[0] == at:
                        ids.append(held[1])
                        out.append((*held[2:], t, m))
                    held = None if copy else (at, doc, t, m)
                cols = list(zip(*(then(out) if then else out), strict=True)) or [()] * (len(schema) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x, y.type) for x, y in zip([ids, *cols], schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, f"doc_id long, {fields}")
