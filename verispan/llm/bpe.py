"""Byte-pair encoding and decoding of whole texts with a public vocabulary file.

The library encodes each distinct run of non-space characters once; a bounded table
keeps the ids of runs already seen, as little-endian 32-bit integers, so that a text's
ids are a join of byte strings. White space separates pre-tokens and has no token in
this vocabulary, so the runs' ids in order are the text's ids.

Long text is encoded by tree concatenation. A text of over LONG_TEXT characters is cut into
leaves wherever their length ends, not at spaces; the leaves' new runs are encoded together by
the library's batch call in several threads, and neighbours are joined pairwise up a tree: at
each join a window around the seam is read again and widened until it agrees with both sides
on where the run at the seam begins and ends; that run is encoded anew.
A run itself of over LONG characters has no place where its encoding is known to part. Its
leaves' tokens are joined likewise: the window is encoded again and widened until it shares a
whole token with either side. A sequence is the encoding of its text when each adjacent
pair of its tokens is, and each pair of the joined sequence comes from one of the three
encodings, so the result is exact.
What the run table takes for granted of a vocabulary is checked when it is loaded; for one
that doesn't have it, texts go to the library whole.

Defined results. A null text counts as an empty one: no ids, empty decoded text. Special
strings inside a text become their special ids, as the library's default. Rows are
independent: null or repeated ids, ties and repeated rows pass through; extra columns
pass through, and one named as the output column gives way to it. An empty table gives an
empty result. Memory: one slice of rows, the table of runs and the longest single text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verispan.llm.common import with_python_columns

VOCABULARY = "word_bpe_49k.json"
#: Characters of a text, and of a run of non-space characters, beyond which halves are encoded apart, and of their leaves.
LONG_TEXT, LEAF_TEXT = 16_384, 8_192
LONG, LEAF = 2048, 1024
#: Characters on either side of a seam that are encoded again at first.
WINDOW = 64
#: Runs kept with their ids in each of a worker's two tables; about 200 bytes each.
KEPT_RUNS = 200_000
_MARKS = ".,;:!?"
#: Bytes of text that are encoded at a time, and the library's threads for leaves.
SLICE, THREADS = 1 << 20, 2
#: New runs that go to the library as one text.
_GROUP = 64

# Python's split() also splits on these, which are not white space in Unicode's table.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")

#: The pre-tokens of the vocabulary that the run table is made for: a fixed value.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

Token = tuple[int, int, int]


@contextmanager
def threads(many: bool) -> Iterator[None]:
    """Let the library's batch calls inside run in several threads or in one; it asks the environment at each call."""
    was = os.environ.get("TOKENIZERS_PARALLELISM")
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if many else "false"
    try:
        yield
    finally:
        os.environ["TOKENIZERS_PARALLELISM"] = was if was is not None else "false"


def path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    def __init__(self, file: str, kept: int = KEPT_RUNS, long: int = LONG, leaf: int = LEAF, window: int = WINDOW, long_text: int = LONG_TEXT, leaf_text: int = LEAF_TEXT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.file = file
        self.kept, self.long, self.leaf, self.window = kept, long, leaf, window
        self.long_text, self.leaf_text = long_text, leaf_text
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

        self.provable = self._has_facts()

    def _has_facts(self) -> bool:
        """Whether white space parts pre-tokens and has no token, letters and marks are pre-tokens of their own, and case doesn't count."""
        spec = json.loads(self.tok.to_str())
        self.suffix: str | None = spec["model"].get("end_of_word_suffix")
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        split = [p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split"]
        steps = [n["type"] for n in norm.get("normalizers", [norm]) if n]
        return (
            model["type"] == "BPE"
            and not model.get("dropout")
            and spec.get("post_processor") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
            and [p["pattern"].get("Regex") for p in split] == [_PATTERN]
            and split[0]["behavior"] == "Removed"
            and split[0]["invert"]
            and steps == ["NFC", "Replace", "Lowercase"]
        )

    @cached_property
    def raw(self):  # noqa: ANN201
        """The tokenizer without its normalizer, for text that is normalized already."""
        from tokenizers import Tokenizer

        raw = Tokenizer.from_file(self.file)
        raw.no_truncation()
        raw.no_padding()
        raw.normalizer = None
        return raw

    def _runs(self, text: str) -> list[str]:
        if _SEPARATORS.search(text):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """encode() of each text; runs not yet seen are encoded together."""
        if not self.provable:
            found = self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        trees = {i: t for i, t in enumerate(texts) if t and len(t) > self.long_text}
        lists = [(self._halved(t) if i in trees else self._runs(t)) if t else [] for i, t in enumerate(texts)]
        new: set[str] = set()
        for runs in lists:
            new |= set(runs).difference(self.seen)
        if len(self.seen) + len(new) > self.kept:
            # The table becomes the older one; what is met again comes back from there, the rest goes with the next change.
            self.older, self.seen = self.seen, {}
            new = set().union(*lists)
        if self.older:
            again = new & self.older.keys()
            self.seen.update(zip(again, map(self.older.__getitem__, again), strict=True))
            new -= again
        long = [x for x in new if len(x) > self.long]
        with threads(bool(trees)):
            self._learn_all(new.difference(long))
        for x in long:
            self.seen[x] = self._long_run(x)
        out = [b"".join(map(self.seen.__getitem__, runs)) for runs in lists]
        for x in long:
            del self.seen[x]
        return out

    def _halved(self, text: str) -> list[str]:
        """The runs of a long text from those of its leaves."""
        cuts = [*range(0, len(text), self.leaf_text), len(text)]
        parts = [(a, b, self._runs(text[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        while len(parts) > 1:
            joined = [self._join_runs(text, *parts[i], *parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0][2]

    def _join_runs(self, text, a, m, left, m2, b, right):  # noqa: ANN001
        """The runs of text[a:b] from those of text[a:m] and text[m:b]."""
        w = self.window
        while True:
            lo, hi = max(a, m - w), min(b, m + w)
            p, q = (a if lo == a else None), (b if hi == b else None)
            for x in _SPACE.finditer(text, lo, m):
                p = x.end()
            if x := _SPACE.search(text, m, hi):
                q = x.start()
            if p is not None and q is not None:
                if p == m or q == m:  # the seam parts no run
                    return a, b, left + right
                if left[-1] == text[p:m] and right[0] == text[m:q]:
                    return a, b, [*left[:-1], text[p:q], *right[1:]]
                if lo == a and hi == b:
                    return a, b, self._runs(text[a:b])
            w *= 2

    def _learn_all(self, new: set[str]) -> None:
        """Ids of new runs. A word with a capital or with marks after it is a known word and known marks.

        Letters, and marks other than apostrophes, are pre-tokens of their own, and below
        U+0250 lower case goes letter by letter, so the parts' ids in order are the run's.
        """
        parts: dict[str, tuple[str, str]] = {}
        need: set[str] = set()
        plain: set[str] = set()
        for x in new:
            word = x.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word)):
                low = word.lower()
                plain.add(low)
                if low != x:
                    marks = x[len(word) :]
                    parts[x] = (low, marks)
                    if marks:
                        need.add(marks)
            else:
                need.add(x)
        self._learn(sorted(need.difference(self.seen)))
        self._learn_words(sorted(plain.difference(self.seen)))
        for x, (low, marks) in parts.items():
            self.seen[x] = self.seen[low] + self.seen[marks] if marks else self.seen[low]

    def _learn(self, runs: list[str]) -> None:
        """Encode runs in groups joined by spaces, which have no token, and part the ids by their offsets."""
        groups = [runs[i : i + _GROUP] for i in range(0, len(runs), _GROUP)]
        for i in range(0, len(groups), 256):
            part = groups[i : i + 256]
            for group, e in zip(part, self.tok.encode_batch([" ".join(g) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4").tobytes()
                at = np.cumsum([0, *(len(x) + 1 for x in group)])
                cuts = (4 * np.searchsorted(np.fromiter((o[0] for o in e.offsets), np.int64, len(e.offsets)), at)).tolist()
                for x, lo, hi in zip(group, cuts[:-1], cuts[1:], strict=True):
                    self.seen[x] = ids[lo:hi]

    def _learn_words(self, words: list[str]) -> None:
        """Encode words of small letters, each one pre-token whose last token alone carries the end-of-word mark; that parts the ids."""
        if not self.suffix:
            return self._learn(words)
        groups = [words[i : i + _GROUP] for i in range(0, len(words), _GROUP)]
        for i in range(0, len(groups), 256):
            part = groups[i : i + 256]
            for group, e in zip(part, self.words.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False), strict=True):
                found = np.array(e.ids, "<u4")
                cuts = (4 * np.flatnonzero(self.ends[found]) + 4).tolist()
                ids, lo = found.tobytes(), 0
                for x, hi in zip(group, cuts, strict=True):
                    self.seen[x] = ids[lo:hi]
                    lo = hi

    @cached_property
    def words(self):  # noqa: ANN201
        """The tokenizer for words of small letters, which need no normalizer and no pattern, only their bytes' signs."""
        from tokenizers import Tokenizer, pre_tokenizers

        plain = Tokenizer(self.tok.model)  # the same model, not a copy
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    @cached_property
    def ends(self) -> np.ndarray:
        """By id, whether a token ends a word."""
        return np.array([bool(x) and x.endswith(self.suffix) for x in names(self.file)])

    def _long_run(self, run: str) -> bytes:
        ids = array("I")
        for i, part in enumerate(self.special.split(run) if self.special else [run]):
            if i % 2:
                ids.append(self.tok.token_to_id(part))
            elif part:
                text = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                ids.extend(t[0] for t in self._tree(text))
        return ids.tobytes()

    def _plain(self, text: str, at: int = 0) -> list[Token]:
        e = self.raw.encode(text, add_special_tokens=False)
        return [(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def _tree(self, text: str) -> list[Token]:
        """The tokens of a normalized text with no special strings, by joining halves."""
        cuts = [*range(0, len(text), self.leaf), len(text)]
        with threads(len(cuts) > 2):
            leaves = self.raw.encode_batch([text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)
        parts = [
            (a, b, [(i, x + a, y + a) for i, (x, y) in zip(e.ids, e.offsets, strict=True)])
            for a, b, e in zip(cuts[:-1], cuts[1:], leaves, strict=True)
        ]
        while len(parts) > 1:
            joined = [self._join(text, *parts[i], *parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0][2]

    def _join(self, text, a, m, left, m2, b, right):  # noqa: ANN001
        """One sequence for text[a:b] from those of text[a:m] and text[m:b]."""
        w = self.window
        while True:
            lo, hi = max(a, m - w), min(b, m + w)
            mid = self._plain(text[lo:hi], lo)
            clean = _clean(mid)
            i = j = None  # where the window agrees with either side
            if lo == a:
                i = (0, 0)
            else:
                where = {t: k for k, t in _tail(left, lo)}
                for k in clean:
                    if mid[k][2] > m:
                        break
                    if (x := where.get(mid[k])) is not None:
                        i = (x, k)
            if hi == b:
                j = (len(mid), len(right))
            else:
                where = {t: k for k, t in _head(right, hi)}
                for k in reversed(clean):
                    if mid[k][1] < m:
                        break
                    if (x := where.get(mid[k])) is not None:
                        j = (k, x)
            if i is not None and j is not None:
                return a, b, left[: i[0]] + mid[i[1] : j[0]] + right[j[1] :]
            w *= 2


def _clean(tokens: list[Token]) -> list[int]:
    """Positions of tokens that begin and end between characters, told by their neighbours' offsets."""
    n = len(tokens)
    return [
        k
        for k, (_, a, b) in enumerate(tokens)
        if a < b and (k == 0 or tokens[k - 1][2] == a) and (k == n - 1 or tokens[k + 1][1] == b)
    ]


def _tail(tokens: list[Token], lo: int):
    k = len(tokens)
    while k and tokens[k - 1][1] >= lo:
        k -= 1
    part = tokens[max(0, k - 1) :]
    base = max(0, k - 1)
    return [(base + x, part[x]) for x in _clean(part) if x or base == 0]


def _head(tokens: list[Token], hi: int):
    k = 0
    while k < len(tokens) and tokens[k][2] <= hi:
        k += 1
    part = tokens[: k + 1]
    return [(x, part[x]) for x in _clean(part) if x < len(part) - 1 or k >= len(tokens) - 1]


@lru_cache(maxsize=4)
def encoder(file: str, kept: int = KEPT_RUNS) -> WordBpe:
    return WordBpe(file, kept)


def encode(docs: DataFrame, file: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of each text's ids (little-endian unsigned 32-bit)."""
    file = file or path()

    def load():
        enc = encoder(file)
        return lambda texts: [pa.array(enc.encode_all(texts), pa.binary())]

    return with_python_columns(docs, load, text, f"`{ids}` binary", size=SLICE)


@lru_cache(maxsize=4)
def names(file: str) -> list[str | None]:
    """The vocabulary by id."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(file)
    return [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]


def decode_ids(names: list[str | None], ids: bytes) -> str:
    """The text of some ids, special ones included: the vocabulary has no decoder, so names joined by spaces."""
    found = [names[i] for i in memoryview(ids).cast("I")]
    return " ".join(x for x in found if x is not None) if None in found else " ".join(found)


def decode(df: DataFrame, file: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text that its ids decode to; null ids count as none."""
    file = file or path()

    def load():
        known = names(file)
        return lambda found: [pa.array([decode_ids(known, x or b"") for x in found], pa.string())]

    return with_python_columns(df, load, ids, f"`{decoded}` string", "binary", SLICE)
