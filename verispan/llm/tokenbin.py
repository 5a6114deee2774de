"""Token ids in compressed binary files: an adaptive context-mixing range coder.

A file holds the ids of its documents as one stream, cut into blocks of BLOCK ids (the last
one may be shorter). Each block starts from an empty model and carries checksums of its bytes
and of its ids, so any block can be read, verified or lost without the others.

The model of a block predicts each id at three orders. Order 0 is a distribution over all
ids: adaptive frequencies of the upper part of an id, and of its lowest byte given the upper
part. Orders 1 and 2 each predict one id, the one last seen after the last one or two ids, by
hashed tables with a confidence. The prediction is a mixture: each order's weight depends
on its confidence and on whether both agree, and is learned as the share of ids that the
order explains against the others (its posterior). The mixture's interval of an id drives a
64-bit carryless range coder, first for the upper part, then for the lowest byte. Weights are
doubles under + - * / only, which are the same on every machine; all else is whole numbers.
Blocks don't depend on each other, so a group of them is coded in step, one lane a block.

Files are written by tasks that hold ascending ranges of ids; the index, a written table,
has one row per file and names only files of attempts that succeeded.

Defined results. A null text counts as an empty one: its end id alone. Null ids stand
first; rows of one id stand by a hash of their texts, equal rows are interchangeable. Extra
columns are not read. An empty table gives an empty index and an empty read. Ids must be
below `size`, that of the vocabulary, else the write fails. Memory: one group of blocks with
its tables, and the longest document.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verispan.llm import bpe
from verispan.llm.common import fresh_path, slices, written
from verispan.session import ship

#: Ids in a block, and blocks coded in step.
BLOCK, LANES = 4096, 1024
#: How many ids there are, unless the vocabulary tells.
SIZE = 1 << 16
END_ID = 1
MAGIC = b"VTID\x02"
_START = struct.Struct("<5sI")  # magic, size
_HEAD = struct.Struct("<IIII")  # ids, bytes, crc32 of the bytes, crc32 of the ids
_FOOT = struct.Struct("<QQQQI5s")  # offset and size of the document table, documents, ids, crc32 of the table, magic

_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_S16, _S48 = np.uint64(16), np.uint64(48)
#: All intervals of a symbol are parts of 2**SCALE.
SCALE = 24
#: Bits of the hashed tables of orders 1 and 2.
_T1, _T2 = 11, 13
#: What an id adds to its frequencies, and where these are halved.
_ADD_UP, _ADD_LOW, _MOST_UP, _MOST_LOW = 32, 64, 1 << 19, 65_000
#: How fast weights follow, and how much of a prediction orders 1 and 2 can make.
_RATE, _MOST_WEIGHT = 1.0 / 48, 0.95


def _whole(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x // y for x from 0 to below 2**52 and y from 1: a double's error is below 1 / y, what parts x / y from the next whole number at least."""
    return (x / y).astype(np.int64)


class _Coder:
    """A range coder for many lanes; with words it decodes them."""

    def __init__(self, n: int, words: np.ndarray | None = None):
        self.low = np.zeros(n, np.uint64)
        self.range = np.full(n, (1 << 64) - 1, np.uint64)
        self.words, self.decodes = words, words is not None
        self.at = np.zeros(n, np.int64)
        if words is None:
            self.words = np.zeros((n, 1 << 12), np.uint16)
        else:
            w = words[:, :4].astype(np.uint64)
            self.code = (w[:, 0] << _S48) | (w[:, 1] << np.uint64(32)) | (w[:, 2] << _S16) | w[:, 3]
            self.at += 4

    def target(self, k: int) -> np.ndarray:
        """Where the code of the first k lanes points to, as parts of the whole."""
        r = self.range[:k] >> np.uint64(SCALE)
        return np.minimum((self.code[:k] - self.low[:k]) // r, np.uint64((1 << SCALE) - 1)).astype(np.int64)

    def narrow(self, lo: np.ndarray, width: np.ndarray) -> None:
        """Take an interval of the whole in the first len(lo) lanes; move settled upper words out, or in."""
        k = len(lo)
        low, rng = self.low[:k], self.range[:k]
        r = rng >> np.uint64(SCALE)
        low += lo.astype(np.uint64) * r
        np.multiply(width.astype(np.uint64), r, out=rng)
        todo = np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOT))
        while len(todo):
            x, y = self.low[todo], self.range[todo]
            # A range grown small gives up what would carry.
            y = np.where((x ^ (x + y)) < _TOP, y, (~x + np.uint64(1)) & _LOW)
            k = self.at[todo]
            if self.decodes:
                self.code[todo] = (self.code[todo] << _S16) | self.words[todo, np.minimum(k, self.words.shape[1] - 1)]
            else:
                if k.max() + 8 > self.words.shape[1]:
                    self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
                self.words[todo, k] = x >> _S48
            self.at[todo] = k + 1
            x, y = x << _S16, y << _S16
            self.low[todo], self.range[todo] = x, y
            todo = todo[((x ^ (x + y)) < _TOP) | (y < _BOT)]

    def finish(self) -> list[bytes]:
        last = [(self.low >> np.uint64(s)).astype(np.uint16)[:, None] for s in (48, 32, 16, 0)]
        tails = np.concatenate(last, axis=1).astype("<u2")
        return [self.words[i, :k].astype("<u2").tobytes() + tails[i].tobytes() for i, k in enumerate(self.at.tolist())]


class _Frequencies:
    """Adaptive frequencies of symbols in many contexts, as running sums over groups of 16 and within each group.

    A symbol's sums are read by single places; learning adds to the rest of its two rows.
    """

    def __init__(self, contexts: int, symbols: int, add: int, most: int, kind: type):
        self.groups = -(-symbols // 16)
        self.inner = np.tile(np.arange(17, dtype=kind), (contexts * self.groups, 1))
        self.outer = np.tile(np.arange(self.groups + 1, dtype=kind) * kind(16), (contexts, 1))
        rest = lambda n: add * (np.arange(n + 1) > np.arange(n)[:, None])
        self.after_symbol, self.after_group = rest(16).astype(kind), rest(self.groups).astype(kind)
        self.add, self.most = add, most

        self.inner_flat, self.outer_flat = self.inner.reshape(-1), self.outer.reshape(-1)

    def total(self, ctx: np.ndarray) -> np.ndarray:
        return self.outer_flat.take(ctx * (self.groups + 1) + self.groups).astype(np.int64)

    def of(self, ctx: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum before, frequency, row) of a symbol of each context."""
        g = sym >> 4
        row = ctx * self.groups + g
        at = row * 17 + (sym & 15)
        before = self.inner_flat.take(at).astype(np.int64)
        # ctx * (groups + 1) + g, as row + ctx.
        return self.outer_flat.take(row + ctx) + before, self.inner_flat.take(at + 1) - before, row

    def end(self, ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """The sum before a symbol of each context and its frequency."""
        row = ctx * self.groups + (sym >> 4)
        return self.inner_flat.take(row * 17 + (sym & 15) + 1).astype(np.int64) + self.outer_flat.take(row + ctx)

    def find(self, ctx: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The symbol whose sums enclose the value."""
        want = value.astype(self.inner.dtype)
        outer = self.outer.take(ctx, axis=0)
        g = (outer[:, 1:] <= want[:, None]).sum(1, dtype=np.int64)
        want -= outer[np.arange(len(g)), g]
        return (g << 4) + (self.inner.take(ctx * self.groups + g, axis=0)[:, 1:] <= want[:, None]).sum(1, dtype=np.int64)

    def learn(self, ctx: np.ndarray, sym: np.ndarray, row: np.ndarray) -> None:
        self.inner[row] = self.inner.take(row, axis=0) + self.after_symbol.take(sym & 15, axis=0)
        outer = self.outer.take(ctx, axis=0) + self.after_group.take(sym >> 4, axis=0)
        self.outer[ctx] = outer
        full = np.flatnonzero(outer[:, self.groups] > self.most)
        if len(full):
            c = ctx[full]
            rows = (c * self.groups)[:, None] + np.arange(self.groups)
            half = (np.diff(self.inner[rows].astype(np.int64), axis=2) + 1) >> 1
            self.inner[rows, 1:] = np.cumsum(half, axis=2)
            self.outer[c, 1:] = np.cumsum(half.sum(2), axis=1)


class _Model:
    """The mixture of orders 0 to 2 for n lanes."""

    def __init__(self, n: int, size: int):
        self.upper = -(-size // 256)
        self.f0 = _Frequencies(n, self.upper, _ADD_UP, _MOST_UP, np.int32)
        self.f1 = _Frequencies(n * self.upper, 256, _ADD_LOW, _MOST_LOW, np.uint16)
        self.t1, self.t2 = (np.zeros(n << k, np.int32) for k in (_T1, _T2))
        # Weights of orders 1 and 2 by lane, by the order's confidence and whether both agree.
        self.w1, self.w2 = np.full(n * 8, 0.1), np.full(n * 8, 0.1)
        self.base = np.arange(n, dtype=np.int64)

    @staticmethod
    def remember(table: np.ndarray, at: np.ndarray, was: np.ndarray, ids: np.ndarray) -> None:
        """An id seen again gains confidence; another one takes it off, and then the place."""
        conf, want = was & 3, ids + 1
        same = (was >> 2) == want
        more = was + (same & (conf < 3)) - (~same & (conf > 1))
        table[at] = np.where(same | (conf > 1), more, (want << 2) | 1)

    @staticmethod
    def _symbol(coder: _Coder, f: _Frequencies, ctx: np.ndarray, predicted: list[np.ndarray], weights: list[np.ndarray], sym: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code a symbol under order 0's frequencies and two predicted symbols; (symbol, order 0's probability, row)."""
        (q1, q2), (w1, w2) = predicted, [(w * (1 << SCALE)).astype(np.int64) for w in weights]
        part, total = (1 << SCALE) - w1 - w2, f.total(ctx)
        if sym is None:
            t = coder.target(len(ctx))
            # Of a predicted symbol's interval order 0's part comes first, its weight then, and before it the weight of a lesser one.
            at1 = _whole(f.end(ctx, q1) * part, total) + w2 * (q2 < q1)
            at2 = _whole(f.end(ctx, q2) * part, total) + w1 * (q1 <= q2)
            in1, in2 = t - at1, t - at2
            past1, past2 = in1 >= w1, in2 >= w2
            in1, in2 = (in1 >= 0) & ~past1, (in2 >= 0) & ~past2
            # Where a predicted symbol is met, what order 0 finds is not used.
            rest = np.minimum(t - w1 * past1 - w2 * past2, part - 1)
            sym = np.where(in1, q1, np.where(in2, q2, f.find(ctx, _whole((rest + 1) * total - 1, part))))
        c, n, row = f.of(ctx, sym)
        lo = _whole(c * part, total)
        width = _whole((c + n) * part, total) - lo + w1 * (q1 == sym) + w2 * (q2 == sym)
        coder.narrow(lo + w1 * (q1 < sym) + w2 * (q2 < sym), width)
        return sym, n / total, row

    def code(self, coder: _Coder, k: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first k lanes, after the ids a and before it b."""
        lanes = self.base[:k]
        mixed = a * 40503
        i1 = (lanes << _T1) + ((mixed >> 3) & ((1 << _T1) - 1))
        i2 = (lanes << _T2) + ((mixed ^ (b * 30011 + (b >> 5))) & ((1 << _T2) - 1))
        v1, v2 = self.t1[i1], self.t2[i2]
        p1, p2 = np.maximum((v1 >> 2) - 1, 0).astype(np.int64), np.maximum((v2 >> 2) - 1, 0).astype(np.int64)
        place = lanes * 8 + (p1 == p2)
        c1, c2 = place + ((v1 & 3) << 1), place + ((v2 & 3) << 1)
        w1, w2 = self.w1[c1] * (v1 > 0), self.w2[c2] * (v2 > 0)
        most = np.minimum(1.0, _MOST_WEIGHT / (w1 + w2 + 1e-9))
        w1, w2 = w1 * most, w2 * most
        up1, up2 = p1 >> 8, p2 >> 8
        up, of0, row0 = self._symbol(coder, self.f0, lanes, [up1, up2], [w1, w2], None if ids is None else ids.astype(np.int64) >> 8)
        # What is left of each order's weight now that the upper part is known.
        x1, x2 = w1 * (up1 == up), w2 * (up2 == up)
        whole = x1 + x2 + (1.0 - w1 - w2) * of0
        y1, y2 = x1 / whole, x2 / whole
        most = np.minimum(1.0, _MOST_WEIGHT / (y1 + y2 + 1e-9))
        ctx = lanes * self.upper + up
        low, of1, row1 = self._symbol(coder, self.f1, ctx, [p1 & 255, p2 & 255], [y1 * most, y2 * most], None if ids is None else ids.astype(np.int64) & 255)
        out = (up << 8) + low
        m1, m2 = x1 * (p1 == out), x2 * (p2 == out)
        whole = m1 + m2 + (1.0 - w1 - w2) * of0 * of1
        for w, c, m in ((self.w1, c1, m1), (self.w2, c2, m2)):
            was = w[c]
            w[c] = was + (m / whole - was) * _RATE
        self.f0.learn(lanes, up, row0)
        self.f1.learn(ctx, low, row1)
        self.remember(self.t1, i1, v1, out.astype(np.int32))
        self.remember(self.t2, i2, v2, out.astype(np.int32))
        return out


def _run(coder: _Coder, lengths: np.ndarray, size: int, ids: np.ndarray | None) -> np.ndarray:
    """Code lanes whose lengths descend; ids: (lanes, most), None to decode. Returns the ids."""
    n = len(lengths)
    model = _Model(n, size)
    most = int(lengths[0]) if n else 0
    out = np.zeros((most, n), np.int32) if ids is None else np.ascontiguousarray(ids.T)
    none = np.zeros(n, np.int64)
    alive = n - np.searchsorted(lengths[::-1], np.arange(most), "right")
    for t in range(most):
        k = int(alive[t])
        a = out[t - 1, :k].astype(np.int64) if t else none[:k]
        b = out[t - 2, :k].astype(np.int64) if t > 1 else none[:k]
        got = model.code(coder, k, a, b, None if ids is None else out[t, :k])
        if ids is None:
            out[t, :k] = got
    return out.T


def encode_blocks(blocks: list[np.ndarray], size: int = SIZE) -> list[bytes]:
    """The code of each block of ids, coded in step."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((len(order), int(lengths[0])), np.int32)
    for row, i in enumerate(order):
        ids[row, : lengths[row]] = blocks[i]
    if max(int(np.max(b, initial=0)) for b in blocks) >= size:
        raise ValueError(f"ids must be below {size}")
    coder = _Coder(len(order))
    _run(coder, lengths, size, ids)
    out: list[bytes] = [b""] * len(blocks)
    for i, code in zip(order, coder.finish(), strict=True):
        out[i] = code
    return out


def decode_blocks(codes: list[bytes], lengths: list[int], size: int = SIZE) -> list[np.ndarray]:
    """The ids of each code; lengths: how many each holds."""
    if not codes:
        return []
    order = sorted(range(len(codes)), key=lambda i: -lengths[i])
    words = np.zeros((len(order), max(len(c) for c in codes) // 2 + 4), np.uint16)
    for row, i in enumerate(order):
        w = np.frombuffer(codes[i], "<u2")
        words[row, : len(w)] = w
    n = np.array([lengths[i] for i in order])
    found = _run(_Coder(len(order), words), n, size, None)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(codes)
    for row, i in enumerate(order):
        out[i] = found[row, : lengths[i]].astype("<u4")
    return out


class Writer:
    """One file: ids of documents in the order in which they come."""

    def __init__(self, stream, size: int = SIZE, block: int = BLOCK, lanes: int = LANES):  # noqa: ANN001
        self.stream, self.ids_below, self.block, self.lanes = stream, size, block, lanes
        self.parts: list[np.ndarray] = []
        self.held, self.docs, self.sizes, self.nulls = 0, [], [], []
        self.stream.write(_START.pack(MAGIC, size))
        self.size = _START.size

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids) // 4)
        self.parts.append(np.frombuffer(ids, "<u4"))
        self.held += len(ids) // 4
        if self.held >= self.block * self.lanes:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        stream = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        end = len(stream) if last else len(stream) - len(stream) % self.block
        blocks = [stream[i : min(i + self.block, end)] for i in range(0, end, self.block)]
        for i in range(0, len(blocks), self.lanes):
            part = blocks[i : i + self.lanes]
            for ids, code in zip(part, encode_blocks(part, self.ids_below), strict=True):
                head = _HEAD.pack(len(ids), len(code), zlib.crc32(code), zlib.crc32(ids.astype("<u4").tobytes()))
                self.stream.write(head + code)
                self.size += len(head) + len(code)
        self.parts = [stream[end:]]
        self.held = len(stream) - end

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        self._flush(True)
        columns = (np.array(self.docs, "<i8"), np.array(self.sizes, "<u8"), np.array(self.nulls, "u1"))
        table = zlib.compress(b"".join(c.tobytes() for c in columns))
        total = sum(self.sizes)
        self.stream.write(table + _FOOT.pack(self.size, len(table), len(self.docs), total, zlib.crc32(table), MAGIC))
        return len(self.docs), total


def read_file(f, lanes: int = LANES) -> Iterator[tuple[int | None, int, np.ndarray]]:  # noqa: ANN001
    """(doc_id, ids of the file before it, ids) of each document. f: a seekable binary file. Bad checksums raise ValueError."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(end - _FOOT.size)
    offset, size, n, _, crc, magic = _FOOT.unpack(f.read(_FOOT.size))
    f.seek(0)
    first, below = _START.unpack(f.read(_START.size))
    if magic != MAGIC or first != MAGIC:
        raise ValueError("not a token file")
    f.seek(offset)
    table = f.read(size)
    if zlib.crc32(table) != crc:
        raise ValueError("the document table is damaged")
    raw = zlib.decompress(table)
    docs, sizes, nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n), np.frombuffer(raw, "u1", n, 16 * n)
    f.seek(_START.size)
    left, at, k, before = np.zeros(0, np.uint32), _START.size, 0, 0
    while at < offset or k < n:
        heads, codes = [], []
        while at < offset and len(codes) < lanes:
            heads.append(h := _HEAD.unpack(f.read(_HEAD.size)))
            codes.append(f.read(h[1]))
            at += _HEAD.size + h[1]
            if zlib.crc32(codes[-1]) != h[2]:
                raise ValueError("a block is damaged")
        found = decode_blocks(codes, [h[0] for h in heads], below)
        if any(zlib.crc32(x.tobytes()) != h[3] for x, h in zip(found, heads, strict=True)):
            raise ValueError("a block's ids don't match their checksum")
        left, i = np.concatenate([left, *found]), 0
        while k < n and i + (m := int(sizes[k])) <= len(left):
            yield None if nulls[k] else int(docs[k]), before, left[i : i + m]
            i, k, before = i + m, k + 1, before + m
        left = left[i:]
        if at >= offset and not found and k < n:
            raise ValueError("the file ends before its documents")


INDEX = "file string, part int, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str | None = None, file: str | None = None, end_id: int = END_ID, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and write the documents in ascending order of ids; returns the index, a written table."""
    from pyarrow import fs

    spark = docs.sparkSession
    ship(spark)
    folder, file = folder or fresh_path(spark, "token-ids"), file or bpe.path()
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("t").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        task, out, name = TaskContext.get(), None, ""
        enc = bpe.encoder(file)
        for b in batches:
            for i, step in slices(b, 1, bpe.SLICE):
                part = b.slice(i, step)
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}.vtid"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                    writer = Writer(out, max(len(bpe.names(file)), end_id + 1))
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode_all(part.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
        if out is not None:
            n, total = writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([task.partitionId()], pa.int32()), pa.array([n]), pa.array([total])], ["file", "part", "n_docs", "n_ids"])

    return written(dealt.mapInArrow(run, INDEX).select("*", F.lit(folder).alias("folder")), "token-index")


def read(index: DataFrame) -> DataFrame:
    """(doc_id, start, ids): every document of the indexed files; start counts the ids of all documents before it."""
    spark = index.sparkSession
    ship(spark)
    # A row per file, of which there is one per writing task.
    before = index.withColumn("base", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).cast("long"))
    n = max(1, index.count())
    dealt = before.select("folder", "file", "base").repartitionByRange(n, "folder", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def rows(held: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["doc_id", "start", "ids"])

        for b in batches:
            for folder, file, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, at = fs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{at}/{file}") as f:
                    held, size = [], 0
                    for doc_id, start, ids in read_file(f):
                        held.append((doc_id, base + start, ids.tobytes()))
                        size += len(held[-1][2])
                        if size > 4 << 20:
                            yield rows(held)
                            held, size = [], 0
                    if held:
                        yield rows(held)

    return dealt.mapInArrow(run, "doc_id long, start long, ids binary")
