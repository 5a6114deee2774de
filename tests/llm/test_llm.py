"""The ten operators against brute force, round trips and held-out accuracy, with odd rows of every kind."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import corpus_pipeline
from verispan.llm import bpe, components, fingerprint, linededup, packing, pii, quality, queries, shingledup, simhash, tokenbin, tokencount, warc

ODD = StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"), ("ids", "string"), ("n_words", "string"))]})
LONG = "word " * 20_000
PROSE = "the quick brown fox and the lazy dog went to a market in town where people of all kinds were "
TEXTS = [None, "", " \n\t", "a", "b\nb\nb", PROSE * 3, PROSE * 3, PROSE * 3 + "today", LONG, "x" * 9000, "mail joe.doe@example.com or +1 (555) 123-4567", "été Ünïcode ſ İ 漢字 😀 <|endoftext|> \x1c end"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, texts=TEXTS, nulls=True):
    rows = [(i, t, "en", "s", None, "clash", "clash") for i, t in enumerate(texts)]
    if nulls:
        rows += [(None, "null id", None, None, None, None, None), rows[5], rows[5]]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return rows_of(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_against_brute_force(docs, none):
    got = by_id(quality.quality_report(docs))
    for i, t in enumerate(TEXTS):
        t = t or ""
        ws = WORD.findall(t)
        wins = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        seen = {w for w in wins if wins.count(w) > 1} if len(wins) < 1000 else set(wins)
        repeat = len({k + j for k, w in enumerate(wins) if w in seen for j in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(ws), sum(map(len, ws)), repeat, len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(ws) < 50 or 100 * repeat > 50 * len(ws))
    assert quality.quality_report(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_simhash_against_brute_force(spark, docs, none):
    import xxhash

    def brute(t):
        ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        if not ws:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = by_id(simhash.near_duplicates(docs))
    for i, t in enumerate(TEXTS):
        assert got[i]["fingerprint"] == f"{brute(t):016x}"
    assert got[0]["component_id"] == got[2]["component_id"] == 0 and got[6]["component_id"] == 5
    assert simhash.near_duplicates(none).count() == 0


def test_links_join_all_within_the_radius(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(8)}
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    roots = {x["node"]: x["root"] for x in components.components(simhash.links(df, 4, 16)).collect()}
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 4:
                up[find(x)] = find(y)
    same = lambda x, y: roots.get(signed[x], signed[x]) == roots.get(signed[y], signed[y])
    assert all(same(x, y) == (find(x) == find(y)) for x in fps for y in fps)


def test_line_dedup_against_brute_force(spark, docs, none):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    lines = []
    for _ in range(120):
        line = r.sample(vocab, r.randint(1, 14))
        lines += [line, line[: r.randint(1, len(line))] + r.sample(vocab, 1)]
    texts = ["\n".join(" ".join(x) for x in lines[i : i + 6]) for i in range(0, len(lines), 6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for line in t.split("\n"):
            s = set(line.split())
            if not any(9 * len(s & x) >= 4 * (len(s) + len(x)) for x in seen):
                kept.append(line)
            seen.append(s)
        want[i] = "\n".join(kept)
    assert {k: v["text"] for k, v in by_id(linededup.dedup_lines(df)).items()} == want
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_of_frequent_tokens_against_brute_force(spark, monkeypatch):
    """Both indexes of frequent tokens, by pairs for short lines and by single tokens for longer ones, with all tokens frequent."""
    monkeypatch.setattr(linededup, "FREQUENT", 2)
    monkeypatch.setattr(linededup, "TIMES", 0)
    monkeypatch.setattr(linededup, "SECOND", 1)
    r = random.Random(31)
    pool = [f"w{i}" for i in range(60)]
    lines = []
    for _ in range(60):
        line = r.sample(pool, r.choice([4, 6, 9, 18, 20, 22, 24, 26, 30, 40]))
        lines.append(line)
        for _ in range(3):
            other = [x for x in line if r.random() > 0.1] + r.sample(pool, r.randint(0, 2))
            lines.append(other)
    r.shuffle(lines)
    texts = {}
    for i, line in enumerate(lines):
        texts.setdefault(i // 5, []).append(r.choice([" ", "\t", "  "]).join(line))
    rows = [(k, "\n".join(v)) for k, v in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, want = [], {}
    for k, t in rows:
        kept = []
        for line in t.split("\n"):
            x = frozenset(WORD.findall(line))
            if x and not any(9 * len(x & y) >= 4 * (len(x) + len(y)) for y in seen):
                kept.append(line)
            seen.append(x)
        want[k] = "\n".join(kept)
    assert {x["doc_id"]: x["text"] for x in linededup.dedup_lines(df).collect()} == want


def test_line_dedup_takes_pivots_in_crowds_only(spark, monkeypatch):
    """Against brute force, with lines on both sides of WIDE: rows that the two rounds of pivots look at, with a large group and without."""
    probes = []

    def pairs(probe, index, was=linededup._pairs):
        probes.append(probe.count())
        return was(probe, index)

    monkeypatch.setattr(linededup, "_pairs", pairs)
    r = random.Random(8)
    pool = [f"w{i}" for i in range(400)]
    single = [r.sample(pool, r.randint(50, 80)) for _ in range(60)]
    single += [x[: r.randint(len(x) * 7 // 10, len(x) - 1)] for x in single]
    base = [f"b{i}" for i in range(72)]
    group = [[w for w in base if r.random() > 0.08] + r.sample(pool, r.randint(0, 3)) for _ in range(90)]
    for lines, crowd in ((single, False), (single + group, True)):
        r.shuffle(lines)
        seen, want = [], {}
        for k, line in enumerate(lines):
            x = set(line)
            want[k] = "" if any(9 * len(x & y) >= 4 * (len(x) + len(y)) for y in seen) else " ".join(line)
            seen.append(x)
        df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string").repartition(3)
        probes.clear()
        assert {x["doc_id"]: x["text"] for x in linededup.dedup_lines(df).collect()} == want
        assert "" in want.values() and (probes[0] > len(group) if crowd else probes[:2] == [0, 0]), probes


def test_line_dedup_of_a_document_of_many_lines(spark):
    text = "\n".join(f"line number {i} of so many {i * 7919}" if i % 3 else "" for i in range(60_000))
    out = linededup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), counts=True).first()
    assert out["text"] == text and (out["n_lines"], out["n_removed"]) == (60_000, 0)


def test_token_files_round_trip(spark, docs, none):
    tok = library()
    index = tokenbin.write(docs)
    got = tokenbin.read(index).orderBy("start").collect()
    assert len(got) == docs.count() and [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 4, 5, 5, 5, *range(6, len(TEXTS))]
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        text = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["start"] == at and ids == [*tok.encode(text, add_special_tokens=False).ids, 1]
        at += len(ids)
    assert tokenbin.read(tokenbin.write(none)).count() == 0


def test_range_coder_blocks_and_checksums():
    r = np.random.default_rng(1)
    blocks = [r.integers(0, 65536, 700), r.zipf(1.5, 900) % 3000, np.zeros(1, int), np.tile([5, 6, 7], 400), np.full(300, 65535)]
    codes = tokenbin.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, tokenbin.decode_blocks(codes, [len(b) for b in blocks]), strict=True))
    assert len(codes[3]) < 1200 / 2
    for size in (300, 70_000):
        b = [r.integers(0, size, 50), np.array([size - 1] * 9)]
        assert all((x == y).all() for x, y in zip(b, tokenbin.decode_blocks(tokenbin.encode_blocks(b, size), [50, 9], size), strict=True))
    with pytest.raises(ValueError):
        tokenbin.encode_blocks([np.array([1 << 16])])
    f = io.BytesIO()
    w = tokenbin.Writer(f, block=64, lanes=3)
    docs = [r.integers(0, 500, n).astype("<u4") for n in (0, 5, 300, 64, 1)]
    for i, x in enumerate(docs):
        w.add(i, x.tobytes())
    w.close()
    assert [x[2].tolist() for x in tokenbin.read_file(f, 3)] == [x.tolist() for x in docs]
    data = bytearray(f.getvalue())
    data[40] ^= 1
    with pytest.raises(ValueError):
        list(tokenbin.read_file(io.BytesIO(bytes(data))))


def test_range_coder_divides_exactly():
    """Quotients by doubles at and just below whole numbers, over the coder's range."""
    r = np.random.default_rng(6)
    y = np.concatenate([np.arange(1, 2000), (1 << 24) - np.arange(2000), r.integers(1, 1 << 24, 20_000)])
    for most in (1, 1 << 12, 1 << 24):
        k = np.minimum(r.integers(1, most + 1, len(y)), ((1 << 52) - 1) // y)
        for x in (k * y, k * y - 1, k * y + r.integers(0, y)):
            assert (tokenbin._whole(x, y) == x // y).all()


def test_range_coder_is_below_an_adaptive_order_0_model(spark):
    """The same blocks and resets: counts so far, and for an id not seen yet an escape and 16 bits."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").limit(120).collect()]
    ids = np.frombuffer(b"".join(bpe.encoder(bpe.path()).encode_all(texts)), "<u4").astype(np.int64)
    blocks = [ids[i : i + tokenbin.BLOCK] for i in range(0, len(ids), tokenbin.BLOCK)]
    plain = 0.0
    for block in blocks:
        seen: dict[int, int] = {}
        for n, x in enumerate(block.tolist()):
            k, total = seen.get(x, 0), n + len(seen) + 1
            plain += np.log2(total / k) if k else np.log2(total / (len(seen) + 1)) + 16
            seen[x] = k + 1
    coded = 8 * sum(map(len, tokenbin.encode_blocks(blocks, len(bpe.names(bpe.path())))))
    assert len(blocks) > 2 and coded < 0.97 * plain, (coded / len(ids), plain / len(ids))


def test_token_file_query_against_the_library(spark, tmp_path):
    texts = ["a b", None, "", PROSE, "été <|endoftext|>"]
    spark.createDataFrame([(3 * i % 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    tok, at, want = library(), 0, []
    for i, t in sorted((3 * i % 7, t) for i, t in enumerate(texts)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op4_token_files(spark, str(tmp_path)).collect())) == want


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.path())


def test_token_counts_against_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokencount.path())
    got = by_id(tokencount.count_tokens(docs))
    assert {i: got[i]["n_tokens"] for i in range(len(TEXTS))} == {i: len(sp.encode(t or "")) for i, t in enumerate(TEXTS)}
    c = tokencount.PieceCounter(tokencount.path(), chunk=64, overlap=8)
    r = random.Random(2)
    for _ in range(60):
        t = "".join(r.choice(["a", "the", " ", "  ", "é", "漢", "▁", "\n", "x" * 40, "<s>", "zzz"]) for _ in range(200))
        assert c.counts([t]) == [len(sp.encode(t))]
    assert tokencount.count_tokens(none).count() == 0


def test_token_count_query_against_the_library(spark, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokencount.path())
    r = random.Random(51)
    words = ["the", "of", "été", "x" * 30, "漢字", "  ", "\n", "▁", "12,5"]
    texts = [None, "", *(" ".join(r.choice(words) for _ in range(n)) for n in (3, 900, 6000, 12_000)), "y" * 40_000]
    assert sum(len((t or "").encode()) > tokencount.CHUNK for t in texts) >= 3
    spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in enumerate(texts)]
    assert sorted(map(tuple, queries.op5_token_counts(spark, str(tmp_path)).collect())) == want


def test_bpe_query_against_the_library(spark, tmp_path):
    tok, r = library(), random.Random(52)
    texts = [None, "", "One, two; THREE's <|endoftext|>", " ".join(r.choice(["word", "Über", "don't", "...", "漢字"]) for _ in range(5000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op9_bpe_round_trip(spark, str(tmp_path)).collect())) == want


def test_bpe_against_the_library(docs, none):
    tok = library()
    enc = bpe.WordBpe(bpe.path(), kept=50, long=40, leaf=16, window=4)
    r = random.Random(4)
    parts = ["word", "Über", "don't", "x1", "...", "!!", "😀", "漢字", "ſ", "İ", " ", "\n", "\x1c", "　", "<|endoftext|>", "abcdefgh" * 6, "é" * 50, "'s", "ﬁ"]
    for _ in range(150):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    tree = bpe.WordBpe(bpe.path(), long=40, leaf=16, window=2, long_text=50, leaf_text=17)
    real = bpe.WordBpe(bpe.path())
    assert tree.provable
    for _ in range(80):
        t = "".join(r.choice(parts) for _ in range(r.randint(20, 90)))
        assert np.frombuffer(tree.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    # At the default thresholds: a text of several leaves, and a run of several leaves.
    for t in ("".join(r.choice(parts) for _ in range(9000)), "".join(r.choice("abcdefghé") for _ in range(9000)) + "! and " + "Ab" * 3000):
        assert len(t) > bpe.LONG_TEXT or max(map(len, t.split())) > bpe.LONG
        assert np.frombuffer(real.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    got = by_id(bpe.decode(bpe.encode(docs)))
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none).count() == 0


def test_fingerprints(docs, none):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint(docs).collect()}
    assert got[0] == got[1] and got[5] == got[6] and len(set(got.values())) == len(set(map(str, [t or "" for t in TEXTS]))) + 1
    r = random.Random(6)
    words = [" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)) for _ in range(3)]
    near, far = words[0][:1200] + words[1][:1200], words[2]
    a, b, c = fingerprint.signatures([words[0], near, far])
    same = lambda x, y: sum(x[i : i + 4] == y[i : i + 4] for i in range(16, len(x), 4)) / 64
    assert same(a, b) > 0.15 > same(a, c)
    assert fingerprint.fingerprint(none).count() == 0 and fingerprint.signatures([]) == []


def test_fingerprint_query_against_brute_force(spark, tmp_path):
    r = random.Random(61)
    rows = [(i, None if i == 3 else "" if i == 4 else "".join(r.choice("abc déß ") for _ in range(r.randint(0, 90)))) for i in range(40)]
    rows += [(7, f"again {i} " * i) for i in range(25)] + [(None, f"no id {i % 9}") for i in range(20)] + [(7, rows[7][1]), rows[9]]
    for some in (rows, rows[:1], rows[40:65], rows[65:85]):
        path = str(tmp_path / f"t{len(some)}-{some[0][0]}")
        spark.createDataFrame(some, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).repartition(3).write.parquet(f"{path}/documents.parquet")
        texts = spark.createDataFrame(some, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
        texts.sort(key=lambda x: (x["doc_id"] is None, -(x["doc_id"] or 0), x["h"], x["text"]))
        want = []
        for x, y in zip(texts, texts[1:] + texts[:1], strict=True):
            t, u, half = x["text"], y["text"], len(x["text"]) // 2
            edited = t[: len(t) - half] + u[:half]
            a, b, c = fingerprint.signatures([t, edited, u])
            empty = lambda z: z[:16] == "0" * 16
            like = lambda v, w: 1.0 if v == w else 0.0 if empty(v) != empty(w) else sum(v[i : i + 4] == w[i : i + 4] for i in range(16, len(v), 4)) / 64
            want.append((x["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
        got = [tuple(x) for x in queries.op6_fingerprints(spark, path).collect()]
        key = lambda x: tuple(map(repr, x))
        assert sorted(got, key=key) == sorted(want, key=key)


def test_warc_round_trip(spark, monkeypatch):
    big = "<p>" + "é" * 900
    pages = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", None), (4, "u", "small"), (5, "u", "small"), (None, "u", big), (9, "u", big + "!")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    index = warc.write(df)
    got = {r["page_id"]: r for r in warc.read(index).collect()}
    assert len(got) == len(pages) and got[1]["refers_to"] == 2 and got[None]["record_type"] == "revisit"
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert got[i]["record_type"] == "revisit" or bytes(got[i]["payload"]) == data
    assert [r["page_id"] for r in warc.read(index.filter("page_id = 4")).collect()] == [4]
    assert warc.read(warc.write(df.limit(0))).count() == 0
    # Repeated rows, two rows of the largest id, and pages of one payload joined by the salted shuffle.
    twice = spark.createDataFrame([(7, "u", big), (7, "v", big), (3, "u", big), (3, "u", big), (None, None, None)], df.drop("payload").schema)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    for _ in range(2):
        got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in warc.read(warc.write(twice)).collect())
        assert got == [(0, "response", 0), (3, "revisit", 7), (3, "revisit", 7), (7, "response", 0), (7, "response", 0)]
        monkeypatch.undo()


def test_packing(docs, none):
    tok = library()
    got = packing.pack_documents(docs, 64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    ids = [*tok.encode(TEXTS[8], add_special_tokens=False).ids, 1]
    mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 8)
    assert mine == [(k, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64)) for x in [ids[a : a + 64]]]
    assert packing.pack_documents(none).count() == 0


def test_packing_query_against_the_library(spark, tmp_path):
    tok, r = library(), random.Random(81)
    texts = [None, "", *(" ".join(r.choice(["a", "of", "word", "und"]) for _ in range(r.choice([3, 800, 2000, 2095, 9000]))) for _ in range(25))]
    spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got, want, total = queries.op8_best_fit_packing(spark, str(tmp_path)).collect(), [], 0
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want += [(i % 20, k, a, len(x), zlib.crc32(x.tobytes())) for k, a in enumerate(range(0, len(ids), 4096)) for x in [ids[a : a + 4096]]]
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == sorted(want)
    places: dict[int, list] = {}
    for x in got:
        places.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 4096
    assert len(places) <= -(-total // 4096) + 1


def test_packing_plan_tries_all_combinations():
    # 1400's gap of 2696 is filled by 1400 + 1296 or 1396 + 1300; only one piece of 1400 is there.
    plan = packing.plan({1400: 1, 1396: 1, 1300: 1, 1296: 1})
    assert (1, [(1400, 1), (1396, 1), (1300, 1)]) in plan
    # A triple is found where neither one length nor two fill the gap.
    assert packing.plan({4000: 2, 32: 6}) == [(2, [(4000, 1), (32, 3)])]
    r = random.Random(82)
    for _ in range(40):
        counts = {r.randint(1, 60): r.randint(1, 4) for _ in range(r.randint(1, 12))}
        used: dict[int, int] = {}
        for n, content in packing.plan(counts, 60):
            assert sum(k * m for k, m in content) <= 60
            for k, m in content:
                used[k] = used.get(k, 0) + n * m
        assert used == counts


def test_packing_plan_is_close_to_the_bound():
    r = random.Random(8)
    counts = {}
    for _ in range(5000):
        k = min(4096, int(r.lognormvariate(5.5, 1.2)) + 1)
        counts[k] = counts.get(k, 0) + 1
    plan = packing.plan(counts)
    used = {}
    for n, content in plan:
        assert sum(k * m for k, m in content) <= 4096
        for k, m in content:
            used[k] = used.get(k, 0) + n * m
    assert used == counts
    assert sum(n for n, _ in plan) <= -(-sum(k * c for k, c in counts.items()) // 4096) + 1


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_against_brute_force():
    r = random.Random(9)
    for _ in range(3000):
        t = "".join(r.choice("ab@.-+ 0123456789()4" + "1é") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t), repr(t)


def test_tagger_on_held_out_lines():
    model, hit, want, got_n = pii.trained(), 0, 0, 0
    lines = pii.examples(300, 999_331)
    for (text, spans), found in zip(lines, pii.model_spans(model, [t for t, _ in lines]), strict=True):
        gold = {s for s in spans if s[2] <= len(text)}
        hit += len(gold & set(found))
        want += len(gold)
        got_n += len(found)
    assert hit / want > 0.9 and hit / got_n > 0.95, (hit / want, hit / got_n)


def test_tagger_on_forms_that_its_generator_does_not_write():
    r = random.Random(77)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    octet = lambda: str(r.randint(0, 255))
    forms = [
        ("phone", lambda: f"{num(3)}.{num(3)} {num(4)}"),
        ("phone", lambda: f"020/{num(4)}.{num(4)}"),
        ("phone", lambda: f"({num(3)}){num(3)}-{num(4)}"),
        ("phone", lambda: f"0044 20 {num(4)} {num(4)}"),
        ("phone", lambda: f"555 {num(3)} {num(4)}"),
        ("phone", lambda: f"0044-20-{num(4)} {num(4)}"),
        ("ip", lambda: " [.] ".join(octet() for _ in range(4))),
        ("ip", lambda: " (.) ".join(octet() for _ in range(4))),
        ("email", lambda: f"anna.berg{num(2)} (@) mail [.] org"),
        ("email", lambda: f"joe{num(1)} @ shop[.]net"),
        ("email", lambda: f"karl_vogt{num(3)}[@]firma(.)de"),
    ]
    frames = ["ring {} now", "tel {}", "please write to {} or wait", "the box at {} was seen", "call: {}, then go"]
    hit = want = 0
    for kind, form in forms:
        texts = []
        for _ in range(60):
            span = form()
            text = r.choice(frames).format(span)
            texts.append((text, (kind, text.index(span), text.index(span) + len(span))))
        for (text, gold), found in zip(texts, pii.model_spans(pii.trained(), [t for t, _ in texts]), strict=True):
            hit += gold in found
            want += 1
    assert hit / want >= 0.9, hit / want


def test_pii_query_against_brute_force(spark, tmp_path):
    texts = [None, "", "a@b.c and +1 (555) 123-4567, 10.0.0.300 or 10.0.0.30", "4465758382889437 x", "é😀 joe@x.org é " * 9]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, n_email int").write.parquet(f"{tmp_path}/documents.parquet")
    for row in queries.op10_pii(spark, str(tmp_path)).collect():
        base = brute_spans([*texts, texts[2]][row["doc_id"]] or "")
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert row["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(row["spans"].split(","))


def test_pii_columns(docs, none):
    got = by_id(pii.find(docs))
    assert got[10]["base_spans"] == "email:5:24,phone:28:45" and got[0]["base_spans"] == ""
    clean = by_id(pii.redact(docs))
    assert clean[10]["text"] == "mail <EMAIL> or <PHONE>" and clean[0]["text"] is None and clean[5]["text"] == TEXTS[5]
    assert pii.find(none).count() == 0 and pii.redact(docs).columns == docs.columns


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(11)
    stop = "the of and to in is that for it was".split()
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    text = lambda: "\n".join(" ".join(r.choice(stop) if r.random() < 0.3 else word() for _ in range(20)) for _ in range(5))
    texts = [text() for _ in range(8)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*texts, texts[0], texts[1].replace(texts[1].split()[3], "zq", 1), "too short", None, texts[2] + "\n" + text() + " call joe@example.com"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    held = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held.append(stage(spark, held[-1], str(tmp_path)).cache())
        assert held[-1].columns == docs.columns
    ids = [{x["doc_id"] for x in h.collect()} for h in held]
    assert ids[1] == ids[0] - {10, 11}
    # Document 8 repeats document 0's lines, so line dedup leaves nothing of it.
    assert 8 not in ids[2] and set(range(8)) <= ids[2]
    assert ids[4] == ids[3] and set(range(8)) <= ids[3]
    assert "<EMAIL>" in {x["doc_id"]: x["text"] for x in held[4].collect()}[12]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in packed.collect()} == ids[4]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def jaccard(a, b):
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_dedup_links_all_pairs_of_jaccard_08(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    common = " ".join(word() for _ in range(30))
    rows, want = [], set()
    for i in range(60):
        ws = [word() for _ in range(r.choice([12, 60, 200, 500]))]
        copies = [list(ws)]
        for _ in range(3):
            at, k = r.randrange(len(ws)), max(1, int(len(ws) * r.choice([0.01, 0.03, 0.06, 0.09, 0.12])))
            copies.append(ws[:at] + [word() for _ in range(min(k, len(ws) - at))] + ws[at + k :])
        rows += [(4 * i + j, common + " " + " ".join(c)) for j, c in enumerate(copies)]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    near = [(a, b, j) for a, s in rows for b, t in rows if a < b and a // 4 == b // 4 for j in [jaccard(s, t)]]
    for a, b, j in near:
        if j >= 0.8:
            up[find(b)] = find(a)
    assert sum(0.8 <= j < 0.9 for _, _, j in near) > 20 and sum(0.7 < j < 0.8 for _, _, j in near) > 20
    for i in up:
        want.add(min(x for x in up if find(x) == find(i)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_pipeline_stages_with_odd_rows(spark):
    """Null and repeated ids, null and empty texts, repeated rows and an extra column with a clashing name in every stage."""
    r = random.Random(23)
    stop = "the of and to in is that for it was".split()
    text = lambda: "\n".join(" ".join(r.choice(stop) if r.random() < 0.3 else "".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20)) for _ in range(5))
    a, b = text(), text()
    rows = [(None, a, "en", "s", 1, "x"), (None, a, "en", "s", 1, "x"), (None, b, None, None, None, None), (5, text(), "en", "s", 1, "x"), (5, text(), "en", "s", 1, "x"), (6, None, "en", "s", 1, "x"), (7, "", "en", "s", 1, "x"), (8, " \n ", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
    got = sorted((x["doc_id"] or 0, x["text"]) for x in docs.collect())
    assert got == sorted([(0, a), (0, b), (5, rows[3][1]), (5, rows[4][1])])
    assert corpus_pipeline.best_fit_packing(spark, docs, "").count() == 4


def test_near_dedup_leaves_no_table_but_its_rows(spark, monkeypatch):
    made, gone = [], []
    monkeypatch.setattr(shingledup, "written", lambda df, name, f=shingledup.written: made.append((name, f(df, name))) or made[-1][1])
    monkeypatch.setattr(shingledup, "discard", lambda df, f=shingledup.discard: gone.append(df) or f(df))
    docs = spark.createDataFrame([(i, PROSE * 3 + f"today {i}") for i in range(6)], "doc_id long, text string")
    assert len({r["root"] for r in shingledup.near_groups(docs).collect()}) == 1
    names = [name for name, _ in made]
    # The index meets a table of the shared keys alone, and the classes' pass gives the fingerprints.
    assert "pivots" in names and "class-fingerprints" not in names
    assert {n for n, df in made if not any(df is x for x in gone)} <= {"shingle-classes", "verified-pairs"}


def test_near_dedup_orders_by_counts_of_all_shingles(spark):
    texts = [(c, f"the same five words here and then w{c} of its own v{c} to u{c}") for c in range(-20, 21)]
    got = shingledup._levels(spark.createDataFrame(texts, "c long, text string").repartition(5), 5)
    counts = np.zeros(shingledup.BUCKETS, int)
    for _, t in texts:
        np.add.at(counts, shingledup._buckets(shingledup.shingle_set(t)), 1)
    assert counts.max() >= 41
    assert got.tolist() == [int(np.log2(max(n, 1)) * shingledup.STEPS) for n in counts.tolist()]
    assert not shingledup._levels(spark.createDataFrame([], "c long, text string"), 5).any()


def test_near_dedup_is_the_same_under_any_order(spark, monkeypatch):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)] for _ in range(6)]
    texts = [" ".join(w if rng.random() > p else "new" for w in ws) for ws in base for p in (0, 0.01, 0.02, 0.04, 0.3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def groups():
        found = {}
        for r in shingledup.near_groups(docs).collect():
            found.setdefault(r["root"], set()).add(r["doc_id"])
        return sorted(map(sorted, found.values()))

    want = groups()
    assert 6 <= len(want) < 30
    monkeypatch.setattr(shingledup, "_levels", lambda *_: np.random.default_rng(1).integers(0, 256, shingledup.BUCKETS).astype(np.uint8))
    assert groups() == want


def test_near_dedup_keeps_one_row_of_each_group(spark):
    r = random.Random(22)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(7, a), (None, a), (None, b), (None, b + " more"), (None, c), (3, c), (4, d), (4, d), (4, d + " more"), (3, e), (9, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"][:20]) for x in corpus_pipeline.near_dedup(spark, docs.repartition(3), "").collect())
    assert got == sorted([(False, 7, a[:20]), (True, 0, b[:20]), (False, 3, c[:20]), (False, 4, d[:20]), (False, 3, e[:20])])


def test_long_spans_are_found_at_every_offset():
    mails = ["margarethe_unterkeit [@] wordationmentschungkeit [.] example", "anteration" * 5 + "[@]" + "schungkeitmento" * 4 + "[.]example"]
    for mail in mails:
        texts = [("the word and " * 20)[k:] + mail + " and then the rest of it all " * 6 for k in range(48)]
        for text, found in zip(texts, pii.model_spans(pii.trained(), texts), strict=True):
            at = text.index(mail)
            assert found == [("email", at, at + len(mail))]


def test_line_dedup_tells_texts_of_one_id_with_equal_32_bit_hashes(spark):
    for i in (5, None):
        rows = [(i, "word70213"), (i, "word251767"), (-1 if i else None, "word70213")]
        df = spark.createDataFrame(rows[:2] + ([rows[2]] if i else []), "doc_id long, text string")
        assert df.filter("text != ''").select(F.hash("text")).distinct().count() == 1
        got = sorted((r["doc_id"] or 0, r["text"]) for r in linededup.dedup_lines(df).collect())
        want = [(-1, "word70213"), (5, ""), (5, "word251767")] if i else [(0, "word251767"), (0, "word70213")]
        assert got == want
