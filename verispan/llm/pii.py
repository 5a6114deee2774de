"""Personal data: exact base patterns, and a character-level BiLSTM with a CRF on top.

The base finds emails, IPv4 addresses, card numbers and phone numbers by fixed patterns and
checks; it scans in linear time. The model adds what the patterns miss, such as phone
numbers without a plus sign or addresses with bracketed dots. It is trained here, in numpy
alone, from labelled spans that a seeded generator writes (no corpus text enters), so its
weights are the same on every machine and run. It scores overlapping windows of the whole
text; where windows overlap their scores are averaged, a place counting the more the
further it is from its window's edge, and the CRF decodes each run of windows once over all
its length. So a span of any length is found whole, wherever it stands. A span that reaches
the end of such a run takes the windows beyond it in, until it ends inside or the text does.
Spans must pass their kind's own check and touch no base span.

A window without a digit or an @ is not tagged: no kind's check passes without one, so
nothing is lost by that.

Defined results. A null text counts as an empty one. Offsets are code points, ends are
exclusive. Rows are independent; null or repeated ids, repeated rows and extra columns
pass through, and a column named as a new one gives way. An empty table gives an empty
result. Memory: one slice of rows, the scores
of its windows, and one batch of windows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verispan.llm.common import with_python_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, from each @ leftwards, so that a long run costs no more than its length."""
    out, end = [], 0
    at = text.find("@")
    while at != -1:
        if at >= end:
            s = at
            while s > end and text[s - 1] in _LOCAL_CHARS:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((s, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# --- the model -------------------------------------------------------------------------

N_TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
N_CHARS = 98  # printable ASCII, other letters, everything else, padding
EMBED, HIDDEN = 12, 24
WINDOW, STRIDE = 96, 48
_BATCH = 1024
_NEVER = -1e4


def _codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((x >= 32) & (x < 127), x - 32, np.where(x >= 0xC0, 95, 96)).astype(np.int16)


def _forbidden() -> np.ndarray:
    """Transitions that no tagging may have: into I from anything but the same kind."""
    t = np.zeros((N_TAGS, N_TAGS))
    for k in range(len(KINDS)):
        t[:, 2 + 2 * k] = _NEVER
        t[1 + 2 * k, 2 + 2 * k] = t[2 + 2 * k, 2 + 2 * k] = 0
    return t


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """A character BiLSTM with CRF transitions."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": w(N_CHARS, EMBED) * 3, "O": w(2 * HIDDEN, N_TAGS), "o": np.zeros(N_TAGS, np.float32), "T": np.zeros((N_TAGS, N_TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"{d}X": w(EMBED, 4 * HIDDEN), f"{d}H": w(HIDDEN, 4 * HIDDEN), f"{d}b": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"{d}b"][HIDDEN : 2 * HIDDEN] = 1
        self.mask = _forbidden().astype(np.float32)

    def _lstm(self, d: str, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, rows, HIDDEN) of one direction."""
        p, (n, steps) = self.p, codes.shape
        table = p["E"] @ p[f"{d}X"] + p[f"{d}b"]
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out, kept = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[codes[:, t]] + h @ p[f"{d}H"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                kept.append((t, i, f, o, g, before, tc, last))
        return out, kept

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores (steps, rows, tags)."""
        h = np.concatenate([self._lstm(d, codes, False)[0] for d in "fb"], axis=2)
        return h @ self.p["O"] + self.p["o"]

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of the CRF for each run of scores (steps, tags); runs are decoded side by side, longest first."""
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        sizes = np.array([len(scores[i]) for i in order])
        most, n, t = int(sizes[0]) if len(sizes) else 0, len(order), self.p["T"] + self.mask
        e = np.zeros((most, n, N_TAGS), np.float32)
        for row, i in enumerate(order):
            e[: sizes[row], row] = scores[i]
        alive = n - np.searchsorted(sizes[::-1], np.arange(most), "right")
        score = e[0].copy() if n else np.zeros((0, N_TAGS), np.float32)
        score[:, 2::2] += _NEVER
        back = np.empty((most, n, N_TAGS), np.int8)
        for k in range(1, most):
            m = alive[k]
            x = score[:m, :, None] + t[None]
            back[k, :m] = x.argmax(1)
            score[:m] = x.max(1) + e[k, :m]
        tags = np.zeros((n, most), np.int8)
        now = score.argmax(1).astype(np.int8)
        for k in range(most - 1, -1, -1):
            m = alive[k]
            tags[:m, k] = now[:m]
            if k:
                now[:m] = back[k, np.arange(m), now[:m]]
        out: list[np.ndarray] = [tags[0:0]] * n
        for row, i in enumerate(order):
            out[i] = tags[row, : sizes[row]]
        return out

    def step(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The CRF's negative log-likelihood per row, and its gradients."""
        p = self.p
        hf, kf = self._lstm("f", codes, True)
        hb, kb = self._lstm("b", codes, True)
        h = np.concatenate([hf, hb], axis=2)
        e = (h @ p["O"] + p["o"]).astype(np.float64)
        t = (p["T"] + self.mask).astype(np.float64)
        steps, n, _ = e.shape
        start = np.zeros(N_TAGS)
        start[2::2] = _NEVER

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            m = x.max(axis, keepdims=True)
            return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

        a = np.empty_like(e)
        b = np.zeros_like(e)
        a[0] = e[0] + start
        for k in range(1, steps):
            a[k] = lse(a[k - 1][:, :, None] + t[None], 1) + e[k]
        for k in range(steps - 2, -1, -1):
            b[k] = lse(t[None] + (e[k + 1] + b[k + 1])[:, None, :], 2)
        z = lse(a[-1], 1)
        de = np.exp(a + b - z[None, :, None])
        dt = np.zeros_like(t)
        for k in range(1, steps):
            dt += np.exp(a[k - 1][:, :, None] + t[None] + (e[k] + b[k])[:, None, :] - z[:, None, None]).sum(0)
        rows = np.arange(n)
        gold_score = np.zeros(n)
        for k in range(steps):
            gold_score += e[k][rows, gold[:, k]]
            de[k][rows, gold[:, k]] -= 1
            if k:
                gold_score += t[gold[:, k - 1], gold[:, k]]
                np.add.at(dt, (gold[:, k - 1], gold[:, k]), -1)
        de = (de / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["T"] = (dt / n).astype(np.float32) * (self.mask == 0)
        g["O"] = np.einsum("tnh,tnk->hk", h, de)
        g["o"] = de.sum((0, 1))
        dh = de @ p["O"].T
        for d, kept, part in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[:, :, HIDDEN:])):
            nh = np.zeros((n, HIDDEN), np.float32)
            nc = np.zeros((n, HIDDEN), np.float32)
            for t_, i, f, o, gg, before, tc, last in reversed(kept):
                x = part[t_] + nh
                dc = nc + x * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), x * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                nc, nh = dc * f, dz @ p[f"{d}H"].T
                g[f"{d}H"] += last.T @ dz
                g[f"{d}b"] += dz.sum(0)
                emb = p["E"][codes[:, t_]]
                g[f"{d}X"] += emb.T @ dz
                np.add.at(g["E"], codes[:, t_], dz @ p[f"{d}X"].T)
        return float((z - gold_score).mean()), g


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Invented lines with their labelled spans."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(str(int(x)) for x in r.integers(0, 10, k))
    syll = "an en er in th re ou on at ed st le la de que ción sch ung ein keit é eau ment ado mente und".split()
    word = lambda: "".join(pick(syll) for _ in range(int(r.integers(1, 4))))

    def card(sep: str) -> str:
        d = num(int(pick([15, 15, 15, 18])))
        d += next(str(x) for x in range(10) if luhn(d + str(x)))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def sign(c: str) -> str:
        """A sign as it is, or hidden in brackets or between spaces."""
        if r.random() < 0.4:
            return c
        pad = pick(["", " "])
        return pad + pick(["{}", "[{}]", "({})", "<{}>", "{{{}}}"]).format(c) + pad

    def email() -> str:
        at, dot = sign("@"), sign(".")
        name = pick(["{}", "{}.{}", "{}_{}", "{}{}9", "{}-{}"]).format(word(), word())
        if r.random() < 0.3:
            name += num(int(pick([1, 2, 4])))
        return f"{name}{at}{word()}{dot}{pick(['com', 'org', 'net', 'example', 'de'])}"

    def ip() -> str:
        return pick([sign("."), sign("."), ". "]).join(str(int(x)) for x in r.integers(0, 256, 4))

    def phone() -> str:
        if r.random() < 0.7:  # groups of digits after a prefix or none, with one separator or a second one at the end
            while True:
                sep = pick([" ", " ", " ", "-", ".", "/"])
                end = sep if r.random() < 0.7 else pick(["-", " "])
                lead = pick(["", "", "", f"00{num(2)}{sep}", f"0{num(2)}{sep}", f"({num(3)}) ", f"({num(3)})", f"{num(1)}{sep}", f"{num(2)} "])
                groups = [num(int(pick([2, 3, 3, 4, 4]))) for _ in range(int(pick([2, 3, 3, 4])))]
                s = lead + sep.join(groups[:-1]) + end + groups[-1]
                if plausible("phone", s):
                    return s
        a, b, c = num(3), num(3), num(4)
        form = ["+1 ({}) {}-{}", "+1 {} {} {}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "1 ({}) {}-{}", "00{} {} {}", "+44 {} {} {}"]
        return pick(form).format(a, b, c)

    def other() -> str:
        return pick(
            [
                lambda: num(4),
                lambda: f"${num(1)},{num(3)}.{num(2)}",
                lambda: f"{num(4)}-{num(2)}-{num(2)}",
                lambda: f"v{num(1)}.{num(1)}.{num(2)}",
                lambda: f"{num(2)}:{num(2)}:{num(2)}",
                lambda: f"#{num(8)}",
                lambda: f"{num(2)}%",
                lambda: f"{num(1)}.{num(2)}",
                lambda: f"{word()}{num(3)}",
                lambda: f"@{word()}",
                lambda: f"{num(4)}–{num(4)}",
                lambda: f"{num(10)}",
                lambda: f"{num(3)} {word()} {num(4)}",
                lambda: f"http://{word()}.com/{num(5)}",
            ]
        )()

    makers = {"email": email, "ip": ip, "card": lambda: card(pick([" ", "-", "", ".", " - "])), "phone": phone}
    out = []
    for _ in range(n):
        parts: list[tuple[str, str | None]] = []
        for _ in range(int(r.integers(2, 9))):
            x = r.random()
            kind = pick(KINDS)
            parts.append((makers[kind](), kind) if x < 0.3 else (other(), None) if x < 0.5 else (word() + pick(["", ",", ".", ""]), None))
        text, spans = "", []
        for s, kind in parts:
            if text:
                text += pick([" ", " ", " ", "\n", ": "])
            before, after = pick([("", "")] * 4 + [("(", ")"), ("<", ">"), ('"', '"'), ("", ","), ("", "."), ("", ";"), ("=", "")]) if kind else ("", "")
            text += before
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + after
        out.append((text, spans))
    return out


def windows_of(batch: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.full((len(batch), WINDOW), N_CHARS - 1, np.int16)
    tags = np.zeros((len(batch), WINDOW), np.int64)
    for i, (text, spans) in enumerate(batch):
        c = _codes(text)[:WINDOW]
        codes[i, : len(c)] = c
        for kind, a, b in spans:
            k = KINDS.index(kind)
            tags[i, a:b] = 2 + 2 * k
            if a < WINDOW:
                tags[i, a] = 1 + 2 * k
    return codes, tags


#: Training: fixed numbers of invented lines, whatever the corpus.
STEPS, ROWS, RATE = 560, 80, 0.015


def train(steps: int = STEPS, rows: int = ROWS, seed: int = 7) -> Tagger:
    """A tagger fitted by Adam on labelled lines; the same for the same arguments."""
    model = Tagger(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for s in range(1, steps + 1):
        _, g = model.step(*windows_of(examples(rows, seed * 100_003 + s)))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * min(1.0, 2.0 * (1 - s / (steps + 1)) + 0.02)
        for k, x in g.items():
            x = x * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.98 * v[k] + 0.02 * x * x
            model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.98**s)) + 1e-8)).astype(np.float32)
    return model


@lru_cache(maxsize=1)
def trained() -> Tagger:
    return train()


def _spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of one row of tags."""
    out, n, i = [], len(tags), 0
    while i < n:
        if tags[i] and tags[i] % 2:
            j = i + 1
            while j < n and tags[j] == tags[i] + 1:
                j += 1
            out.append(((int(tags[i]) - 1) // 2, i, j))
            i = j
        else:
            i += 1
    return out


def plausible(kind: str, s: str) -> bool:
    """The check of a kind for a span that the model found."""
    d = _digits(s)
    if kind == "email":
        head, _, tail = s.partition("@")
        return "@" in s and bool(re.search(r"[A-Za-z0-9]\W{0,2}\Z", head)) and bool(re.search(r"[A-Za-z0-9][\s\[({<]{0,2}\.[\s\])}>]{0,2}[A-Za-z]{2,}\Z", tail))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(x) < 4 and int(x) <= 255 for x in parts) and s.count(".") == 3
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d) and s[0].isdigit() and s[-1].isdigit()
    groups = re.findall(r"[0-9]+", s)
    return 8 <= len(d) <= 15 and len(groups) >= 3 and s[-1].isdigit() and not re.search(r"[A-Za-z]", s) and not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", s)


#: How much a place in a window counts, by its distance from the nearer edge.
_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _scored(model: Tagger, places: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """The scores (places, tags) of windows: (codes of the text, first place) each."""
    out: list[np.ndarray] = []
    for at in range(0, len(places), _BATCH):
        some = places[at : at + _BATCH]
        rows = np.full((len(some), WINDOW), N_CHARS - 1, np.int16)
        for row, (c, lo) in zip(rows, some, strict=True):
            part = c[lo : lo + WINDOW]
            row[: len(part)] = part
        out += list(model.emissions(rows).transpose(1, 0, 2))
    return out


def _runs_of(windows: list[int]) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for w in windows:
        if out and w == out[-1][1] + 1:
            out[-1] = (out[-1][0], w)
        else:
            out.append((w, w))
    return out


def model_spans(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """What the model finds in whole texts; windows of all texts are scored in batches, runs of windows decoded once each."""
    codes: dict[int, np.ndarray] = {}
    held: dict[int, dict[int, np.ndarray]] = {}  # scores of a text's windows; window w begins at w * STRIDE
    todo: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        if not re.search(r"[0-9@]", text):
            continue
        c = codes[i] = _codes(text)
        signs = np.flatnonzero(((c >= 16) & (c < 26)) | (c == 32))
        last = -1
        for s in signs.tolist():
            # Windows that hold this sign and are not taken yet.
            todo += [(i, w) for w in range(max(0, (s - WINDOW) // STRIDE + 1, last + 1), s // STRIDE + 1)]
            last = s // STRIDE
        held[i] = {}
    found: dict[int, list[Span]] = {i: [] for i in codes}
    while todo:
        for (i, w), e in zip(todo, _scored(model, [(codes[i], w * STRIDE) for i, w in todo]), strict=True):
            held[i][w] = e
        changed = sorted({i for i, _ in todo})
        todo = []
        where, scores = [], []
        for i in changed:
            found[i] = []
            for first, last in _runs_of(sorted(held[i])):
                lo, hi = first * STRIDE, min(last * STRIDE + WINDOW, len(codes[i]))
                total, weight = np.zeros((hi - lo, N_TAGS), np.float32), np.zeros((hi - lo, 1), np.float32)
                for w in range(first, last + 1):
                    at = w * STRIDE - lo
                    n = min(WINDOW, hi - lo - at)
                    total[at : at + n] += held[i][w][:n] * _WEIGHT[:n, None]
                    weight[at : at + n, 0] += _WEIGHT[:n]
                where.append((i, first, last, lo, hi))
                scores.append(total / weight)
        for (i, first, last, lo, hi), tags in zip(where, model.decode(scores), strict=True):
            for k, a, b in _spans_of(tags) if tags.any() else []:
                found[i].append((KINDS[k], lo + a, lo + b))
                if a == 0 and lo > 0 and first - 1 not in held[i]:
                    todo.append((i, first - 1))
                if lo + b == hi < len(codes[i]) and last + 1 not in held[i]:
                    todo.append((i, last + 1))
        todo = sorted(set(todo))
    out: list[list[Span]] = [[] for _ in texts]
    for i, spans in found.items():
        text = texts[i]
        for kind, a, b in spans:
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            if plausible(kind, text[a:b]):
                out[i].append((kind, a, b))
    return out


def all_spans(model: Tagger, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """(base, added) of each text; what is added touches no base span."""
    whole = [t or "" for t in texts]
    out = []
    for text, more in zip(whole, model_spans(model, whole), strict=True):
        base = base_spans(text)
        out.append((base, [s for s in more if not any(x < s[2] and s[1] < y for _, x, y in base)]))
    return out


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans and spans: strings of kind:start:end, comma-joined."""
    model = docs.sparkSession.sparkContext.broadcast(trained())  # a few thousand weights

    def load():
        def work(texts):
            found = all_spans(model.value, texts)
            return [pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(b + a) for b, a in found], pa.string())]

        return work

    return with_python_columns(docs, load, text, "base_spans string, spans string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span in the text replaced by its kind in angle brackets; other columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    cols = docs.columns

    def clean(t: str | None, base: list[Span], added: list[Span]) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [t[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def load():
        return lambda texts: [pa.array([clean(t, *s) for t, s in zip(texts, all_spans(model.value, texts), strict=True)], pa.string())]

    return with_python_columns(docs, load, text, f"`{text}` string").select(*[f"`{c}`" for c in cols])
