"""The text functions as DuckDB macros written out, for the queries' SQL."""

from __future__ import annotations

from verispan.functions.text import STOP_WORDS, SUFFIXES

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens(t: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all(lower({t}), '[a-z0-9]+(?:[-.][a-z0-9]+)*'), lambda x: "
        "CASE WHEN regexp_matches(x, '[-.]') THEN list_concat([x], list_filter(regexp_split_to_array(x, '[-.]'), lambda p: p <> '')) ELSE [x] END))"
    )


def stem(x: str) -> str:
    cases = " ".join(
        f"WHEN {x} LIKE '%{s}' AND length({x}) - {len(s)} >= 3 THEN substr({x}, 1, length({x}) - {len(s)}) || '{n}'" for s, n in SUFFIXES
    )
    cut = f"(CASE {cases} ELSE {x} END)"
    return (
        f"(CASE WHEN regexp_full_match({x}, '[0-9]+') OR {x} LIKE '%-%' THEN {x} "
        f"WHEN {cut} LIKE '%e' AND length({cut}) > 4 THEN substr({cut}, 1, length({cut}) - 1) ELSE {cut} END)"
    )


def raw_content(t: str) -> str:
    return f"list_filter({tokens(t)}, lambda y: y NOT IN ({STOP}) AND (length(y) > 1 OR regexp_full_match(y, '[0-9]+')))"


def content(t: str) -> str:
    return f"list_transform({raw_content(t)}, lambda z: {stem('z')})"


def slug(t: str) -> str:
    return f"regexp_replace(regexp_replace(lower({t}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def groups(n: str) -> str:
    return f"(CASE WHEN {n} % 5 = 0 THEN ['commercial'] WHEN {n} % 5 = 1 THEN ['quality'] ELSE ['commercial', 'quality'] END)"


CHUNKS = (
    "chunks AS (SELECT 'd' || lpad(doc_id::VARCHAR, 10, '0') AS chunk_id, doc_id, text, lang, source, "
    f"{groups("regexp_extract(source, '(\\d+)$', 1)::INT")} AS groups, "
    "CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY text) THEN 'current' ELSE 'superseded' END AS status, contains(text, '|') AS is_table_row FROM documents)"
)
QUESTIONS = "questions AS (SELECT item_id AS qid, text, CASE WHEN item_id % 2 = 0 THEN 'commercial' ELSE 'quality' END AS grp FROM benchmark)"


def postings(source: str, ident: str, text: str) -> str:
    return f"SELECT {ident} AS chunk_id, unnest({content(text)}) AS term FROM {source}"


BM25 = (
    f"toks AS ({postings('chunks', 'chunk_id', 'text')}), "
    f"lens AS (SELECT chunk_id, len({content('text')}) AS len FROM chunks), "
    "tot AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len FROM lens), "
    "tf AS (SELECT chunk_id, term, count(*)::DOUBLE AS tf FROM toks GROUP BY ALL), "
    "df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL), "
    f"qt AS (SELECT DISTINCT qid, unnest({content('text')}) AS term FROM questions), "
    "bm AS (SELECT qid, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score "
    "FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (chunk_id), tot GROUP BY ALL)"
)


def feature_rows(source: str, ident: str) -> str:
    """(id, f): each text's features, repeats included."""
    return (
        f"SELECT {ident} AS id, unnest(ts) AS f FROM (SELECT {ident}, {content('text')} AS ts FROM {source}) UNION ALL "
        f"SELECT id, '#' || substr(t, i, 4) AS f FROM (SELECT id, t, unnest(range(1, length(t) - 2)) AS i FROM (SELECT {ident} AS id, unnest({content('text')}) AS t FROM {source}) WHERE length(t) >= 4) UNION ALL "
        f"SELECT id, ts[i] || '_' || ts[i + 1] AS f FROM (SELECT {ident} AS id, ts, unnest(range(1, len(ts))) AS i FROM (SELECT {ident}, {content('text')} AS ts FROM {source}))"
    )


def features(source: str, ident: str) -> str:
    """(id, b, w): weights by bucket of each text, before they are brought to length one."""
    return (
        "SELECT id, (('0x' || substr(md5(f), 1, 8))::BIGINT % 64)::INT AS b, "
        "(CASE WHEN ('0x' || substr(md5(f), 9, 1))::BIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END) * (1 + ln(count(*)::DOUBLE)) AS w "
        f"FROM ({feature_rows(source, ident)}) GROUP BY id, f"
    )


def vectors(name: str, source: str, ident: str) -> str:
    return (
        f"{name}_f AS ({features(source, ident)}), {name}_b AS (SELECT id, b, sum(w) AS w FROM {name}_f GROUP BY ALL), "
        f"{name} AS (SELECT id, b, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_b)"
    )
