"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, components.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles.
Distinct fingerprints are dealt to shards by exact block values: cut into `blocks` runs
of bits, two fingerprints at most `radius` bits apart agree on some blocks - radius of
them wholly, so every linked pair meets in the shard of those blocks. A shard's tree is
a BK-tree: children are keyed by their integer Hamming distance to the parent, and a
search follows only edges within the radius of the probe's distance. A shard holding
more than `tree_size` fingerprints becomes several trees of bounded size; its probes are
delivered to each of them, so no task holds an unbounded group and no pair is lost.

Trees and probes meet by a shuffle rather than by a broadcast of all trees: all trees
together grow with the corpus, so they have no proven size bound.

Defined results. A null text, or one without words, has fingerprint zero and links like
any other. Fewer words than a shingle form one shingle. A null doc_id keeps its row; it
takes no part in the minimum, so a class of null ids only has a null component_id.
Repeated rows and equal ids stay as rows. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.llm.common import written
from verispan.llm.components import components
from verispan.session import ship

BITS = 64
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingle hashes whose bits are counted at a time.
_STEP = 1 << 16


def shingles(text: str | None, width: int) -> np.ndarray:
    """The XXH64 values of a text's word shingles in their order; none without words."""
    ws = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    h64 = xxhash.xxh64_intdigest
    if len(ws) <= width:
        return np.array([h64(b" ".join(ws), SEED)], np.uint64)
    whole, at, starts = b" ".join(ws), 0, []
    for w in ws:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    return np.fromiter((h64(whole[starts[i] : starts[i + width] - 1], SEED) for i in range(len(ws) - width + 1)), np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of one text as an unsigned 64-bit integer."""
    return majority(shingles(text, width))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle values: the bits set in over half of them."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i : i + _STEP].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.astype(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(
        run, f"doc_id {kind}, fp long"
    )


class BKTree:
    """A BK-tree over 64-bit integers under the Hamming distance."""

    __slots__ = ("children", "items")

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        if not self.items:
            self.items, self.children = [x], [{}]
            return
        at = 0
        while True:
            d = (self.items[at] ^ x).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.items)
                self.items.append(x)
                self.children.append({})
                return
            at = below

    def near(self, x: int, radius: int) -> list[int]:
        """Positions of the items within the radius."""
        found, todo = [], [0] if self.items else []
        while todo:
            at = todo.pop()
            d = (self.items[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                todo += [v for k, v in kids.items() if d - radius <= k <= d + radius]
        return found


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, mask) of n runs of bits that cover 64 bits."""
    sizes = [BITS // n + (i < BITS % n) for i in range(n)]
    out, at = [], 0
    for s in sizes:
        out.append((at, (1 << s) - 1))
        at += s
    return out


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """All keys of a fingerprint: an array of (which blocks, their bits) packed in a long."""
    cut = _blocks(blocks)
    picks = list(combinations(range(blocks), blocks - radius))
    keys = []
    for i, pick in enumerate(picks):
        mask = 0
        for p in pick:
            mask |= cut[p][1] << cut[p][0]
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(i).cast("short").alias("k"), fp.bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*keys)


def blocks_for(n: int, radius: int, occupancy: int = 16) -> int:
    """The fewest blocks that leave about `occupancy` of n random fingerprints in a shard."""
    b = radius + 1
    while b < 12 and n > occupancy * 2 ** (BITS * (b - radius) / b):
        b += 1
    return max(b, radius + 2)


class _Shard:
    """One shard's tree under way. Trees come first, then probes; only the tree is held."""

    def __init__(self, radius: int) -> None:
        self.radius, self.tree, self.up = radius, BKTree(), {}

    def _root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def take(self, x: int, probe: bool) -> list[tuple[int, int]]:
        """Edges that join x to what it is near, one for each part of the tree not yet joined."""
        out, mine = [], None if probe else x
        self.up.update({} if probe else {x: x})
        for at in self.tree.near(x, self.radius):
            y = self.tree.items[at]
            r = self._root(y)
            if mine is None or self._root(mine) != r:
                out.append((x, y))
                if mine is not None:
                    self.up[self._root(mine)] = r
                mine = y if mine is None else mine
        if not probe:
            self.tree.add(x)
        return out


def _link(radius: int):
    """From rows sorted by shard: a spanning set of the linked pairs of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, _Shard(radius)
        for b in batches:
            k, v, s, probe, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(k):
                continue
            new = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])) + 1
            cuts = np.concatenate([[0], new, [len(k)]])
            pairs: list[tuple[int, int]] = []
            # A shard of one row that neither begins nor ends the batch has nothing to link.
            for i in np.flatnonzero((np.diff(cuts) > 1) | (cuts[:-1] == 0) | (cuts[1:] == len(k))).tolist():
                lo, hi = int(cuts[i]), int(cuts[i + 1])
                if (now := (k[lo], v[lo], s[lo])) != key:
                    key, shard = now, _Shard(radius)
                for x, p in zip(fp[lo:hi].astype(np.uint64).tolist(), probe[lo:hi].tolist(), strict=True):
                    pairs += shard.take(x, bool(p))
            a = np.array(pairs, np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = 4, tree_size: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that are within the radius."""
    spark = fps.sparkSession
    ship(spark)
    n = fps.count()
    blocks = blocks_for(n, radius)
    rows = fps.select("fp", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("key")).select(
        F.col("key.k").alias("k"), F.col("key.v").alias("v"), "fp"
    )
    hot = rows.groupBy("k", "v").count().filter(F.col("count") > tree_size)
    hot = written(hot.select("k", "v", F.ceil(F.col("count") / tree_size).cast("int").alias("trees")), "hot-shards")
    few = hot.count()
    if few:
        # Hot shards are a table of a few numbers each; broadcast only while it is small.
        side = F.broadcast(hot) if few <= 100_000 else hot
        rows = rows.join(side, ["k", "v"], "left")
    else:
        rows = rows.withColumn("trees", F.lit(None).cast("int"))
    # Each fingerprint is built into the tree of its own part and probes the later parts.
    home = F.pmod(F.xxhash64("fp"), F.coalesce("trees", F.lit(1))).cast("int")
    rows = (
        rows.withColumn("home", home)
        .withColumn("s", F.explode(F.sequence(F.col("home"), F.coalesce("trees", F.lit(1)) - 1)))
        .select("k", "v", "s", (F.col("s") != F.col("home")).cast("int").alias("probe"), "fp")
    )
    dealt = rows.repartition("k", "v", "s").sortWithinPartitions("k", "v", "s", "probe")
    return dealt.mapInArrow(_link(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, radius: int = 4, width: int = 4, text: str = "text", id_col: str = "doc_id", tree_size: int = 2048
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    fps = written(fingerprints(docs, width, text, id_col), "fingerprints")
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(firsts.select("fp"), radius, tree_size))
    classes = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
