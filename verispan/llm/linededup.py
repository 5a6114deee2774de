"""Line dedup: an exact set-similarity self-join over the lines of all documents.

A line's tokens are its distinct words. A line is removed when an earlier line, by doc_id
and line number, has a token set of Jaccard similarity 0.8 or more with its own; lines
without words stay. All of it is DataFrame operations.

1. Tokens are named by 64-bit hashes. Lines with the same token set (a 128-bit hash of it)
   collapse to their earliest place, pre-aggregated before the shuffle, so a line that is
   everywhere is one row.
2. Tokens are ordered by rarity. Rarity is the count of a token's bucket among BUCKETS, one
   byte each, so what is sent to the executors has a fixed size; any order is exact, a good
   one is fast.
3. Pivots: in the buckets of PIVOTS least hashes of each line's rarer tokens, every line is
   compared with the bucket's earliest line only, then lines not yet decided with its SECOND
   earliest ones. Both are linear, and decide nearly all members of large groups of near
   copies; they skip no comparison of the index below for lines that they don't decide. Only
   buckets of hashes of which a crowd of lines shares two are looked at: others hold no large
   group, and in the index below a small one costs its lines no more meetings than a token does.
   Like what is frequent, a crowd follows the buckets' mean.
4. Prefix index: of n tokens the rarest n - ceil(0.8 n) + 1. Lines that share a token there
   meet, if lengths and positions allow the overlap. Frequent tokens have an index of their
   own, whose probes are cut to the lines not yet decided before the join. For lines of at most
   SHORT tokens its key is the token with each later one of a prefix longer by one (two similar
   lines share their first two common tokens there); longer lines meet by the token alone.
   What is frequent follows the buckets' mean, so a larger vocabulary doesn't turn rare
   tokens into frequent ones. Only lines not yet decided look for earlier ones.
5. A parity sketch of 64 bits, for sets of over WIDE tokens 128, goes along with the index rows: each
   token flips a bit. Two sketches differ in no more bits than the sets do in tokens, and similar
   sets differ in (n + m) / 9 at most; nearly all other candidates end there, inside the join.
6. Candidates are verified by their exact token sets.

Defined results. Null texts count as empty and stay empty strings in the cleaned text.
Rows of one doc_id stand in the order of a 64-bit hash of their texts; rows equal in both are one
document and are treated alike. Null ids stand first. Columns other than id and text are
carried by `dedup_lines` under their own names, whatever these are. An empty table gives
an empty result. A document of any number of lines costs time in proportion to them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispan.llm.common import discard, let, written

#: The similarity as a fraction, so that bounds are exact in whole numbers.
NUM, DEN = 4, 5
#: Buckets of the rarity table, a byte each: 4 log2 of the count.
BUCKETS = 1 << 20
STEPS = 4
#: Least hashes of a line whose buckets have pivots.
PIVOTS = 3
#: A crowd is more lines than this, and than this many times the buckets' mean.
CROWD, CROWD_TIMES = 32, 2
#: Earliest lines of a bucket that undecided lines are compared with in the second round.
SECOND = 16
#: A token is frequent if seen more often than this, and than this many times the buckets' mean.
FREQUENT, TIMES = 1000, 8
#: Lines of up to this many tokens meet by two tokens where these are frequent; so at most C(SHORT / 4 + 2, 2) keys a line.
SHORT = 24
#: Sets of more tokens than this have sketches of 128 bits; two of at most this many differ in 14 tokens, far below what 64 bits tell.
WIDE = 64
#: Bytes of distinct tokens up to which a file of token sets holds places in a dictionary of them.
DICTIONARY = 8 << 20
#: Up to this many ids are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 300_000

_HASH_BITS = 56
_LOW = (1 << _HASH_BITS) - 1
_LEVEL = 127 << _HASH_BITS
_SPACES = "\t\x0b\x0c\r"


def _least(n: Column) -> Column:
    """The tokens that a set of n must share with any similar one: ceil(0.8 n)."""
    return F.floor((n * NUM + (DEN - 1)) / DEN).cast("int")


def _tokens(line: Column) -> Column:
    """The distinct words of a line whose only white space is spaces, as sorted 64-bit hashes."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit("")))))


def token_sets(docs: DataFrame) -> DataFrame:
    """(sid, a, b, n, ids): each distinct token set with its earliest place, sid being any number of its own.

    a is the doc_id, b holds the text's 64-bit hash and the line number, so that (a, b)
    orders lines and names one.
    """
    spaced = F.col("text")
    for c in _SPACES:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    # A filter on the tokens would work them out twice; a line that has any is not all spaces.
    lines = docs.select("a", "h", F.posexplode(F.split(spaced, "\n")).alias("i", "line")).filter(F.trim("line") != "")
    sets = lines.select("a", F.struct("h", "i").alias("b"), _tokens(F.col("line")).alias("ids"))
    key = [F.xxhash64("ids").alias("k1"), F.xxhash64(F.lit(7), F.col("ids"), F.size("ids")).alias("k2")]
    first = sets.groupBy(*key).agg(F.min(F.struct("a", "b", "ids")).alias("m"))
    return first.select(F.monotonically_increasing_id().alias("sid"), "m.a", "m.b", F.size("m.ids").alias("n"), "m.ids")


def _place(h: Column) -> tuple[Column, Column]:
    """A hash's place in the rarity table: the long, by its upper bits, and how far its byte is from the top there, 0 to 56."""
    return F.shiftrightunsigned(h, 64 - (BUCKETS.bit_length() - 4)).cast("int"), h.bitwiseAND(F.lit(56)).cast("int")


def _rarity(sets: DataFrame) -> tuple[str, int]:
    """The rarity table, 8 buckets in a long, and the mean count of a bucket. One row of BUCKETS bytes comes to the driver."""
    # k: the long and the byte in it, from the top.
    eight, down = _place(F.col("t"))
    seen = sets.select(F.explode("ids").alias("t")).groupBy((eight * 8 + F.shiftright(down, 3)).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    every = sets.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("long").alias("c"))
    counts = seen.union(every).groupBy("k").agg(F.sum("c").alias("c"))
    level = F.when(F.col("c") > 1, F.least(F.floor(F.log2("c") * STEPS), F.lit(127))).otherwise(0).cast("long")
    byte = F.call_function("shiftleft", level, 56 - F.col("k").bitwiseAND(F.lit(7)) * 8)
    eights = counts.select(F.shiftright("k", 3).alias("e"), byte.alias("v"), "c").groupBy("e").agg(F.sum("v").alias("v"), F.sum("c").alias("c"))
    parts = eights.groupBy(F.shiftright("e", 9).alias("hi")).agg(F.sort_array(F.collect_list(F.struct("e", "v"))).alias("vs"), F.sum("c").alias("c"))
    parts = parts.select("hi", "c", F.array_join(F.transform("vs", lambda x: x["v"].cast("string")), ",").alias("s"))
    got = parts.agg(F.sort_array(F.collect_list(F.struct("hi", "s"))).alias("all"), F.sum("c").alias("c")).first()
    return ",".join(x["s"] for x in got["all"]), (got["c"] or 0) // BUCKETS


def _prefixes(sets: DataFrame, rarity: str) -> DataFrame:
    """(sid, a, n, u, ids, piv, s0, s1): of each set the prefix's length u, its tokens and one more, pivot keys and the sketch.

    Here a token is a long: its rarity in the upper bits, 56 bits of its hash in the lower, so that rare ones come first.
    """
    table = F.split(F.lit(rarity), ",").cast("array<long>")  # folded to a constant

    # These run on each token of each line, interpreted: as few steps as can be, and no nulls, so that sorting is on plain longs.
    def ranked(h: Column) -> Column:
        eight, down = _place(h)
        level = F.call_function("shiftleft", F.get(table, eight), down).bitwiseAND(F.lit(_LEVEL))
        return F.coalesce(level.bitwiseOR(h.bitwiseAND(F.lit(_LOW))), F.lit(0).cast("long"))

    def parity(one) -> Column:  # noqa: ANN001
        # A shift goes by the lowest 6 bits of its number.
        bit = lambda x: F.call_function("shiftleft", one(x), x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
        return F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x)))

    rows = sets.select("sid", "a", "n", F.sort_array(F.transform("ids", ranked)).alias("all"))
    rows = rows.withColumn("u", F.col("n") - _least(F.col("n")) + 1)
    rarer = F.slice("all", F.lit(1), F.greatest(F.col("u"), F.floor(F.col("n") * 3 / 5).cast("int")))
    least = F.slice(F.sort_array(F.transform(rarer, lambda x: x.bitwiseAND(F.lit(_LOW)))), 1, PIVOTS)
    half = parity(lambda x: F.shiftright(x, 26).bitwiseAND(F.lit(1).cast("long")))
    return rows.select(
        "sid", "a", "n", "u", F.slice("all", F.lit(1), F.col("u") + 1).alias("ids"),
        F.transform(least, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("piv"),
        parity(lambda x: F.lit(1).cast("long")).alias("s0"), F.when(F.col("n") > WIDE, half).otherwise(F.lit(0).cast("long")).alias("s1"),
    )


def _similar_in_part(n: Column, m: Column) -> Column:
    """Lengths and sketches of x and y allow them to be similar."""
    lengths = (n * NUM <= m * DEN) & (m * NUM <= n * DEN)
    # s0 has all flips, s1 those of one half of the tokens: together a sketch of 128 bits, if both sets have it.
    both, half = (F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}")) for s in ("s0", "s1"))
    apart = F.when((n > WIDE) & (m > WIDE), F.bit_count(half) + F.bit_count(both.bitwiseXOR(half))).otherwise(F.bit_count(both))
    return lengths & (apart * (NUM + DEN) <= (n + m) * (DEN - NUM))


def _pairs(probe: DataFrame, index: DataFrame) -> DataFrame:
    """(x, y): sids of a line still to do and another with a common key where lengths, positions and sketches allow similarity."""
    # Length, whether to do, and position travel in one long. Whether to do is asked in the condition on both sides,
    # so that one shuffle serves both where the index is its own probe.
    flag = lambda df: F.shiftleft(F.col("todo").cast("long"), 31) if "todo" in df.columns else F.lit(1 << 31)
    tight = lambda df: df.select("k", "sid", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(flag(df)).bitwiseOR(F.col("p").cast("long")).alias("np"), "s0", "s1")
    x, y = tight(probe).alias("x"), tight(index).alias("y")
    n, m = F.shiftright("x.np", 32), F.shiftright("y.np", 32)
    p, q = F.col("x.np").bitwiseAND(0x7FFFFFFF), F.col("y.np").bitwiseAND(0x7FFFFFFF)
    todo = (F.shiftright("x.np", 31).bitwiseAND(1) * F.col("y.np") != 0) & (F.col("y.sid") != F.col("x.sid"))
    # Common tokens are 1 and those after the key in either at most; 9 * overlap >= 4 * (n + m) is needed.
    places = (1 + F.least(n - p, m - q)) * (NUM + DEN) >= (n + m) * NUM
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & todo & places & _similar_in_part(n, m))
    return met.select(F.col("x.sid").alias("x"), F.col("y.sid").alias("y")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """df for a join: broadcast behind a check of its size."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid) of the lines x that have an earlier similar y, as a written table."""
    pairs = written(pairs, "line-pairs")
    ends = written(pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct(), "line-ends")
    held = sets.join(_small(ends), "sid", "left_semi").select("sid", "a", "b", "ids")
    x, y = held.alias("p"), held.alias("q")
    both = pairs.join(x, F.col("x") == F.col("p.sid")).select("x", "y", *[F.col(f"p.{c}").alias(f"x{c}") for c in ("a", "b", "ids")])
    both = both.join(y, F.col("y") == F.col("q.sid"))
    earlier = F.struct(F.col("q.a"), F.col("q.b")) < F.struct("xa", "xb")
    similar = F.size(F.array_intersect("xids", "q.ids")) * (NUM + DEN) >= (F.size("xids") + F.size("q.ids")) * NUM
    out = written(both.filter(earlier & similar).select(F.col("x").alias("sid")).distinct(), "similar-lines")
    discard(pairs)
    discard(ends)
    return out


def _crowded(ranked: DataFrame, mean: int) -> DataFrame:
    """(k) of the pivot hashes that a crowd of lines has together with one and the same other."""
    twos = [F.shiftleft(F.get("piv", i).cast("long"), 32).bitwiseOR(F.get("piv", j).cast("long")) for i, j in combinations(range(PIVOTS), 2)]
    shared = ranked.select(F.explode(F.array(*twos)).alias("two")).filter(F.col("two").isNotNull())
    crowds = shared.groupBy("two").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > max(CROWD, CROWD_TIMES * mean))
    ends = F.array(F.shiftright("two", 32).cast("int"), F.col("two").bitwiseAND(0x7FFFFFFF).cast("int"))
    return crowds.select(F.explode(ends).alias("k")).distinct()


def _met(ranked: DataFrame, mean: int) -> DataFrame:
    """(x, y) of lines that meet in the prefix index. ranked: with `todo`."""
    limit = F.lit(float(STEPS)) * F.log2(F.lit(float(max(FREQUENT, TIMES * mean))))
    frequent = F.shiftright("k", _HASH_BITS) > limit
    # A count of one is a fact even of a bucket: nobody else has that token.
    rows = ranked.select("*", F.posexplode(F.slice("ids", F.lit(1), F.col("u"))).alias("p0", "k")).filter(F.shiftright("k", _HASH_BITS) > 0)
    rows = rows.withColumn("p", F.col("p0") + 1)
    cold, hot = rows.filter(~frequent), rows.filter(frequent)
    # A line is as long as a similar one to within DEN / NUM, so either index reaches that much over the border.
    long = hot.filter(F.col("n") * DEN >= SHORT * NUM)
    later = F.slice("ids", F.col("p") + 1, F.greatest(F.col("u") - F.col("p0"), F.lit(0)))
    two = hot.filter(F.col("n") * NUM <= SHORT * DEN).withColumn("k2", F.explode(later)).withColumn("k", F.xxhash64("k", "k2"))
    return (
        _pairs(cold, cold)
        .union(_pairs(long.filter("todo").filter(F.col("n") > SHORT), long))
        .union(_pairs(two.filter("todo").filter(F.col("n") <= SHORT), two))
    )


def kept_lines(docs: DataFrame) -> DataFrame:
    """(a, h, keep): for each document with kept lines that have words, their numbers. docs: a, h, text."""
    # A file's distinct tokens pass Parquet's first bound of a dictionary, and 8 bytes for each token is what fills the disk.
    sets = written(token_sets(docs), "token-sets", **{"parquet.dictionary.page.size": str(DICTIONARY)})
    # A set of under 4 tokens is similar to an equal one only; those are one row by now.
    able = sets.filter("n >= 4")
    rarity, mean = _rarity(able)
    ranked = written(_prefixes(able, rarity), "prefixes")

    crowded = written(_crowded(ranked, mean), "crowded")
    where = _small(crowded)

    def few(rows: DataFrame) -> DataFrame:
        return rows.select("sid", "a", "n", F.lit(1).alias("p"), F.explode("piv").alias("k"), "s0", "s1").join(where, "k", "left_semi")

    def marked(decided: DataFrame) -> DataFrame:
        return ranked.join(_small(decided.withColumn("done", F.lit(1))), "sid", "left").withColumn("todo", F.col("done").isNull())

    pivots = few(ranked).groupBy("k").agg(F.min(F.struct("a", "sid", "n", "p", "s0", "s1")).alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    decided = _verified(_pairs(few(ranked), pivots.select("k", "m.*")), sets)
    nth = F.row_number().over(Window.partitionBy("k").orderBy("a", "sid"))
    earliest = few(ranked).withColumn("r", nth).filter(F.col("r") <= SECOND).drop("r")
    second = _verified(_pairs(few(marked(decided).filter("todo")), earliest), sets)

    third = _verified(_met(marked(decided.union(second)), mean), sets)
    gone = written(decided.union(second).union(third).distinct(), "gone")
    kept = sets.select("sid", "a", "b").join(_small(gone), "sid", "left_anti")
    keep = written(kept.groupBy("a", F.col("b.h").alias("h")).agg(F.collect_list("b.i").alias("keep")), "kept-lines")
    for t in (sets, ranked, crowded, decided, second, third, gone):
        discard(t)
    return keep


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", counts: bool = False) -> DataFrame:
    """docs with later similar lines gone from the text; with counts also n_lines and n_removed."""
    packed = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("a"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest"),
    ).withColumn("h", F.xxhash64("text"))
    kept = kept_lines(packed.select("a", "h", "text")).withColumnsRenamed({"a": "ka", "h": "kh"})
    joined = packed.join(kept, (F.col("a") == F.col("ka")) & (F.col("h") == F.col("kh")), "left")
    none = F.array().cast("array<int>")

    def left(ls: Column) -> Column:
        """Kept lines in order: those of `keep`, and those without words."""
        blank = F.filter(F.transform(ls, lambda x, i: F.when(~x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
        return F.transform(F.sort_array(F.concat(F.coalesce("keep", none), blank)), lambda i: F.get(ls, i))

    done = joined.withColumn("lines", F.split("text", "\n")).withColumn("left", let(F.col("lines"), left))
    cols = [F.array_join("left", "\n").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    if counts:
        cols += [F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_removed")]
    return done.select(*cols)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS toks FROM l),
firsts AS (SELECT toks, min((doc_id, i)) AS place, len(toks) AS n, row_number() OVER () AS sid FROM s WHERE len(toks) > 0 GROUP BY toks),
tok AS (SELECT sid, unnest(toks) AS t FROM firsts WHERE n >= 4),
df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
pre AS (SELECT tok.sid, tok.t, row_number() OVER (PARTITION BY tok.sid ORDER BY df.c, tok.t) AS r FROM tok JOIN df USING (t)),
idx AS (SELECT sid, t FROM pre JOIN firsts USING (sid) WHERE r <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT x.sid AS xs, y.sid AS ys FROM idx x JOIN idx y ON x.t = y.t AND x.sid <> y.sid),
gone AS (SELECT DISTINCT c.xs AS sid FROM cand c JOIN firsts x ON x.sid = c.xs JOIN firsts y ON y.sid = c.ys
  WHERE y.place < x.place AND 9 * len(list_intersect(x.toks, y.toks)) >= 4 * (x.n + y.n)),
flag AS (SELECT s.doc_id, s.i, s.line, len(s.toks) > 0 AND (f.place <> (s.doc_id, s.i) OR g.sid IS NOT NULL) AS out
  FROM s LEFT JOIN firsts f ON f.toks = s.toks LEFT JOIN gone g ON g.sid = f.sid)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT out), '') AS text,
  count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE out)::BIGINT AS n_removed
FROM flag GROUP BY doc_id
"""
