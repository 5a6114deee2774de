"""Quality rules: a table of thresholds compiled into one projection.

No user function runs: each metric is a Column, each rule compares one metric with
one bound, and the verdict is the conjunction. A row of the input is a row of the
result; nothing is shuffled.

Defined results. A null text counts as an empty one: all counts are 0 and the base
rules fail. A text of white space only likewise. A null or repeated doc_id is carried
through as it is. Other columns of the input, whatever their names, stay where
`with_quality` is used and are absent from `quality_report`. An empty table gives an
empty result. Texts are read whole; the repeated-window count sorts a document's own
windows inside its row, so its memory follows the longest single text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.llm.common import let, words

#: Very frequent short words of the four languages of the corpus.
STOP_WORDS = sorted(
    set(
        "the of and to in is that for it was on are as with be by at this from or an have not "
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
        "le la les de des et en un une du que est pour dans par sur au avec pas il qui ce son "
        "el los las y del que en un una por con para se no su al lo como más o".split()
    )
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= metric <= high; a bound of None is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The base rules decide base_failed; they are fixed by definition.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: The threshold table. Bounds are wide of ordinary prose in all four languages.
RULES: tuple[Rule, ...] = (
    Rule("word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("letters", "alpha_ratio", 0.70, None),
    Rule("bangs", "bang_ratio", None, 0.30),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50),
)


#: Low bits of a packed key hold the window's position; longer texts go without the packed step.
_POSITION_BITS = 24


def _repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text.

    A window's hash (upper bits) and position (lower bits) share one long; sorted longs
    put windows with equal hashes side by side. Only those few are compared by their
    words, so the count is exact whatever the hashes do.
    """
    low = (1 << _POSITION_BITS) - 1

    def all_at() -> Column:
        return F.sequence(F.lit(0), F.size(ws) - 3)

    def suspects(keys: Column) -> Column:
        same = lambda x, y: F.shiftright(x, _POSITION_BITS) == F.shiftright(y, _POSITION_BITS)
        return F.transform(
            F.filter(keys, lambda k, i: same(k, F.get(keys, i + 1)) | same(k, F.get(keys, i - 1))),
            lambda k: k.bitwiseAND(F.lit(low)).cast("int"),
        )

    def exact(at: Column) -> Column:
        wins = F.transform(
            at,
            lambda i: F.struct(F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("w"), i.alias("p")),
        )
        return F.when(F.size(at) < 2, F.lit(0)).otherwise(let(F.sort_array(wins), covered))

    def covered(wins: Column) -> Column:
        at = F.transform(
            F.filter(wins, lambda w, i: (F.get(wins, i - 1)["w"] == w["w"]) | (F.get(wins, i + 1)["w"] == w["w"])),
            lambda w: w["p"],
        )
        return let(
            F.sort_array(at),
            lambda ps: F.aggregate(
                F.transform(ps, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(ps, i + 1) - p, F.lit(3)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    keys = F.transform(
        all_at(),
        lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
        .bitwiseAND(F.lit(~low))
        .bitwiseOR(i.cast("long")),
    )
    at = F.when(F.size(ws) <= low, let(F.sort_array(keys), suspects)).otherwise(all_at())
    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(let(at, exact)).cast("long")


def _metrics(text: Column) -> Column:
    """One struct of counts for a text; the word array is bound once."""
    text = F.coalesce(text, F.lit(""))
    squeezed = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))

    def lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        )

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            _repeat_words(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
            F.size(F.filter(ws, lambda w: F.endswith(w, F.lit("!!")))).cast("long").alias("n_bang_words"),
        )

    found = F.struct(
        let(words(text), of).alias("w"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines).alias("l"),
        squeezed.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
    )
    # Bound as a whole: the optimizer would take a bare struct apart and compute its parts once for each field.
    return let(found, lambda x: x)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one Column: the comma-joined names of the rules that fail."""
    parts = []
    for r in rules:
        x = F.col(r.metric)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (x > F.lit(float(r.high)))
        parts.append(F.when(bad, F.lit(r.name)))
    return F.concat_ws(",", *parts)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts, ratios and the verdict of every document."""
    m = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _metrics(F.col(f"`{text}`")).alias("m")).select(
        "doc_id",
        F.col("m.w.n_words").alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("m.w.n_repeat_words").alias("n_repeat_words"),
        F.col("m.l.n_lines").alias("n_lines"),
        F.col("m.w.n_stop_words").alias("n_stop_words"),
        F.col("m.w.n_alpha_words").alias("n_alpha_words"),
        F.col("m.w.n_bang_words").alias("n_bang_words"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    r = m.withColumns(
        {
            "mean_word_length": F.col("word_chars") / n,
            "symbol_ratio": F.col("n_symbols") / n,
            "stop_ratio": F.col("n_stop_words") / n,
            "alpha_ratio": F.col("n_alpha_words") / n,
            "bang_ratio": F.col("n_bang_words") / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    return r.withColumn("failed_rules", compile_rules(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == "")
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows whose text passes; every column of the input and no other."""
    cols = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    metrics = packed.withColumn("_m", _metrics(F.col("_text")))
    n = F.greatest(F.col("_m.w.n_words"), F.lit(1)).cast("double")
    named = {
        "mean_word_length": F.col("_m.word_chars") / n,
        "symbol_ratio": F.col("_m.n_symbols") / n,
        "stop_ratio": F.col("_m.w.n_stop_words") / n,
        "alpha_ratio": F.col("_m.w.n_alpha_words") / n,
        "bang_ratio": F.col("_m.w.n_bang_words") / n,
        "dup_line_ratio": F.col("_m.l.n_dup_lines") / F.greatest(F.col("_m.l.n_lines"), F.lit(1)).cast("double"),
    }
    ok = (F.col("_m.w.n_words") >= MIN_WORDS) & (
        100 * F.col("_m.w.n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("_m.w.n_words")
    )
    return metrics.withColumns(named).filter(ok & (compile_rules(rules) == "")).select(*cols)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
pos AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT rid, p, ws[p] || ' ' || ws[p+1] || ' ' || ws[p+2] AS g FROM pos),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p+1, p+2]) AS q FROM rep) GROUP BY rid),
li AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT w.doc_id,
  len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines,
  len(list_filter(ws, lambda x: lower(x) IN (@STOP@)))::BIGINT AS n_stop_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '\\p{L}')))::BIGINT AS n_alpha_words,
  len(list_filter(ws, lambda x: x LIKE '%!!'))::BIGINT AS n_bang_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN li USING (rid)),
r AS (SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_length, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio,
  n_stop_words / greatest(n_words, 1)::DOUBLE AS stop_ratio, n_alpha_words / greatest(n_words, 1)::DOUBLE AS alpha_ratio,
  n_bang_words / greatest(n_words, 1)::DOUBLE AS bang_ratio, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
f AS (SELECT *, concat_ws(',', @RULES@) AS failed_rules FROM r)
SELECT *, (NOT base_failed AND failed_rules = '') AS kept FROM f
"""


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same report in DuckDB's SQL, from the same table of thresholds."""
    parts = []
    for r in rules:
        bad = [f"{r.metric} < {float(r.low)!r}::DOUBLE"] if r.low is not None else []
        bad += [f"{r.metric} > {float(r.high)!r}::DOUBLE"] if r.high is not None else []
        parts.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    return ORACLE.replace("@STOP@", ", ".join(f"'{w}'" for w in STOP_WORDS)).replace("@RULES@", ", ".join(parts))
