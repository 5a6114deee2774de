"""Token counts of whole texts under a public tokenizer.

Texts up to CHUNK bytes go to the library whole. A longer one is encoded in overlapping
chunks with offsets, so that memory follows the chunk and not the document; neighbouring
chunks are spliced at a boundary that both have and that is proven stable: a space after
something else than a space. No piece of the vocabulary holds a word mark after another
character (checked when the model is loaded), so no merge crosses such a place and what
stands on either side of it is encoded alike in any text. Where an overlap holds no such
place, it is widened, at last to the whole of both chunks.

Defined results. A null text counts as an empty one: 0 tokens. Special strings in a text
are handled as the library does by default; nothing is truncated or padded. Rows are
independent: null or repeated ids, ties and repeated rows pass through, as do extra
columns; one named as the new column gives way to it. An empty table gives an empty
result.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verispan.llm.common import with_python_columns

#: UTF-8 bytes of a chunk, and by how much chunks overlap at first.
CHUNK = 16 << 10
OVERLAP = 512

_MARK = "▁".encode()


class PieceCounter:
    """Counts by a sentencepiece model."""

    def __init__(self, file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=file)
        self.chunk, self.overlap = max(chunk, 8), max(overlap, 4)
        model = pb.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        #: Whether the proof of stable boundaries holds for this model.
        self.provable = (
            not spec.precompiled_charsmap
            and not spec.remove_extra_whitespaces
            and spec.escape_whitespaces
            and model.trainer_spec.model_type == 2  # BPE
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not any("▁" in p.piece.lstrip("▁") for p in model.pieces)
            and not any(p.type == 4 for p in model.pieces)  # user-defined symbols
        )

    def counts(self, texts: list[str | None]) -> list[int]:
        out, short, at = [0] * len(texts), [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.provable and len(t) * 4 > self.chunk and len(data := t.encode()) > self.chunk:
                out[i] = self.huge(data)
            else:
                short.append(t)
                at.append(i)
        for i, ids in zip(at, self.sp.encode(short, num_threads=1) if short else [], strict=True):
            out[i] = len(ids)
        return out

    def _starts(self, data: bytes, lo: int, hi: int) -> np.ndarray:
        """Where the tokens of data[lo:hi] begin in data."""
        found = self.sp.encode(data[lo:hi].decode(), return_type="proto")
        return np.fromiter((p.begin for p in found.pieces), np.int64, len(found.pieces)) + lo

    def huge(self, data: bytes) -> int:
        """Tokens of a long text, chunk by chunk."""
        n = len(data)

        def edge(p: int) -> int:
            """The next character boundary at or after p."""
            while p < n and data[p] & 0xC0 == 0x80:
                p += 1
            return min(p, n)

        lo, hi = 0, edge(self.chunk)
        starts = self._starts(data, lo, hi)
        done, total = 0, 0  # tokens before byte `done` are counted
        while hi < n:
            overlap, p = self.overlap, None
            while p is None and overlap < hi - lo:
                lo2 = edge(hi - overlap)
                hi2 = edge(lo2 + overlap + self.chunk)
                starts2 = self._starts(data, lo2, hi2)
                p = self._splice(data, max(lo2, done), hi, starts, starts2)
                overlap *= 2
            if p is None:  # the chunk has no stable place: take it and the next as one
                hi = edge(hi + (hi - lo) + self.chunk)
                starts = self._starts(data, lo, hi)
                continue
            total += int(np.searchsorted(starts, p) - np.searchsorted(starts, done))
            done, lo, hi, starts = p, lo2, hi2, starts2
        return total + int(len(starts) - np.searchsorted(starts, done))

    @staticmethod
    def _splice(data: bytes, lo: int, hi: int, a: np.ndarray, b: np.ndarray) -> int | None:
        """The first stable place inside (lo, hi) where a token of both chunks begins."""
        p = data.find(b" ", lo + 1, hi)
        while p != -1:
            if data[p - 1] != 0x20 and data[max(0, p - 3) : p] != _MARK:
                i, j = np.searchsorted(a, p), np.searchsorted(b, p)
                if i < len(a) and j < len(b) and a[i] == p and b[j] == p:
                    return p
            p = data.find(b" ", p + 1, hi)
        return None


class JsonCounter:
    """Counts by a tokenizers file."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.tok.no_truncation()
        self.tok.no_padding()

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@lru_cache(maxsize=4)
def counter(file: str) -> PieceCounter | JsonCounter:
    return JsonCounter(file) if file.endswith(".json") else PieceCounter(file)


def path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, file: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text."""
    file = file or path()

    def load():
        c = counter(file)
        return lambda texts: [pa.array(c.counts(texts), pa.int64())]

    return with_python_columns(docs, load, text, f"`{out}` long")
