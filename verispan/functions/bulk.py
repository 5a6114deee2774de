"""content_tokens and hash_embedding over Arrow batches, for ingesting whole tables.

The expressions in text.py and vectors.py take some milliseconds a document, as each token
and feature goes through many interpreted steps. Here a word is cut, filtered and stemmed
when it is first seen, and features are counted with numpy for many texts at once. Texts
come in lower case, as Spark has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import md5
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from verispan.functions.text import STOP_WORDS, SUFFIXES, TOKEN

#: Bytes of texts that are counted at a time, and words and grams that are remembered at most between times.
STEP, MOST = 1 << 20, 400_000
_STOP = frozenset(STOP_WORDS)


def stem_word(token: str) -> str:
    if token.isdigit() or "-" in token:
        return token
    cut = next((token[: len(token) - len(s)] + new for s, new in SUFFIXES if token.endswith(s) and len(token) - len(s) >= 3), token)
    return cut[:-1] if cut.endswith("e") and len(cut) > 4 else cut


def _content(found: str) -> list[str]:
    """The content tokens of one match of TOKEN."""
    every = [found, *filter(None, re.split("[-.]", found))] if "-" in found or "." in found else [found]
    return [stem_word(t) for t in every if t not in _STOP and (len(t) > 1 or t.isdigit())]


class _Words(dict):
    """Numbers of a match's content tokens. Of tokens and grams the signed buckets are found for many at a time."""

    def __init__(self, dim: int) -> None:
        self.dim, self.place, self.tokens, self.grams = dim, {}, [], {}
        self.of: list[list[int]] = []  # numbers of the token's grams
        self.own = self.gram = np.zeros(0, np.int64)

    def __missing__(self, found: str) -> tuple[int, ...]:
        got = self[found] = tuple([self.number(t) for t in _content(found)])
        return got

    def number(self, token: str) -> int:
        n = self.place.get(token)
        if n is None:
            n = self.place[token] = len(self.tokens)
            self.tokens.append(token)
        return n

    def settle(self) -> None:
        """Grams and buckets of the tokens that came since the last time."""
        fresh, grams = self.tokens[len(self.of) :], self.grams
        for token in fresh:
            self.of.append([grams.setdefault("#" + token[i : i + 4], len(grams)) for i in range(len(token) - 3)])
        self.own = np.append(self.own, _signed(fresh, self.dim))
        self.gram = np.append(self.gram, _signed(islice(grams, len(self.gram), None), self.dim))


def _signed(features: Iterable[str], dim: int) -> np.ndarray:
    """Twice each feature's bucket, and one more where its sign is minus."""
    digests = np.frombuffer(b"".join([md5(f.encode()).digest() for f in features]), np.uint8).reshape(-1, 16)
    return (np.ascontiguousarray(digests[:, :4]).view(">u4")[:, 0].astype(np.int64) % dim) * 2 + (1 - (digests[:, 4] >> 4 & 1))


def _counted(text: np.ndarray, feature: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of each text's distinct features."""
    key, n = np.unique(text * width + feature, return_counts=True)
    return key // max(width, 1), key % max(width, 1), n


def _vectors(ids: np.ndarray, sizes: np.ndarray, words: _Words) -> np.ndarray:
    """The texts' vectors, one a row, from their token numbers."""
    words.settle()
    dim, n = words.dim, len(sizes)
    text = np.repeat(np.arange(n), sizes)
    out = np.zeros(n * dim)

    def add(text: np.ndarray, signed: np.ndarray, count: np.ndarray) -> None:
        weight = np.where(signed & 1, -1.0, 1.0) * (1 + np.log(count))
        out[:] += np.bincount(text * dim + (signed >> 1), weight, n * dim)

    t, f, c = _counted(text, ids, len(words.tokens))
    add(t, words.own[f], c)
    # A text's grams: those of its distinct tokens, as often as the tokens come.
    known, at = np.unique(f, return_inverse=True)
    grams = [words.of[i] for i in known.tolist()]
    many = np.array(list(map(len, grams)), np.int64)
    start, flat = np.cumsum(many) - many, np.fromiter(chain.from_iterable(grams), np.int64, int(many.sum()))
    each = many[at]
    place = np.repeat(start[at] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    width = max(1, len(words.gram))
    key, back = np.unique(np.repeat(t, each) * width + flat[place], return_inverse=True)
    add(key // width, words.gram[key % width], np.bincount(back, np.repeat(c, each), len(key)))
    # Neighbours within a text.
    near = text[1:] == text[:-1]
    width = max(1, len(words.tokens))
    pairs, which = np.unique(ids[:-1][near] * width + ids[1:][near], return_inverse=True)
    toks = words.tokens
    signed = _signed([f"{toks[a]}_{toks[b]}" for a, b in zip((pairs // width).tolist(), (pairs % width).tolist(), strict=True)], dim)
    t, f, c = _counted(text[1:][near], which, len(pairs))
    add(t, signed[f], c)
    out = out.reshape(n, dim)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def analysed(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Batches whose last column, texts in lower case, gives way to `toks` and `embedding`; a null text has no list of tokens and a vector of zeros."""
    words, find = _Words(dim), re.compile(TOKEN).findall
    for batch in batches:
        at, upto_bytes = 0, np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(upto_bytes, (upto_bytes[at - 1] if at else 0) + STEP, "right")))
            part = batch.slice(at, upto - at)
            texts, at = part.column(part.num_columns - 1).to_pylist(), upto
            if len(words.tokens) > MOST or len(words.gram) > MOST or len(words) > MOST:
                words = _Words(dim)
            numbers = [list(chain.from_iterable(map(words.__getitem__, find(x)))) if x else [] for x in texts]
            sizes = np.array(list(map(len, numbers)), np.int64)
            ids = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
            missing = pa.array([x is None for x in texts])
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            known, which = np.unique(ids, return_inverse=True)
            strings = pa.array([words.tokens[i] for i in known.tolist()], pa.string()).take(pa.array(which))
            toks = pa.ListArray.from_arrays(ends, strings, mask=missing)
            flat = pa.array(_vectors(ids, sizes, words).ravel(), pa.float64())
            embedding = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], toks, embedding], [*part.schema.names[:-1], "toks", "embedding"])
