"""Text functions as Spark expressions; no user function runs.

Every function takes and returns Columns. Regular expressions that must see Unicode word
characters carry the (?U) flag, since Java's classes are ASCII otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "a about all an and any are as at be been by can did do does each for from had has have how in into is it its "
    "many may much must of on or per than that the their then there these this to under was were what when where "
    "which who why will with within would you your".split()
)
TOKEN = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"
RECORD_ID = r"(?U)\b(?:SOP|DEV|CC|DR|AF|MEMO|SPEC|P|B)-[0-9A-Z]+(?:-[0-9A-Za-z]+)*\b"
NUMBER = r"(?U)(?<![\w.-])-?\d+(?:,\d{3})*(?:\.\d+)?(?![\w-])"
#: White space as Unicode has it, all that (?U)\s matches.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Suffixes in the order in which they are tried, with what takes their place.
SUFFIXES = (("ations", ""), ("ation", ""), ("ings", ""), ("ing", ""), ("ies", "y"), ("ed", ""), ("es", ""), ("s", ""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Lower-case tokens; one with inner dashes or dots comes whole and then in parts."""
    parts = lambda x: F.concat(F.array(x), F.filter(F.split(x, "[-.]"), lambda p: p != ""))
    return F.flatten(F.transform(_found(F.lower(text), TOKEN), lambda x: F.when(x.rlike("[-.]"), parts(x)).otherwise(F.array(x))))


def raw_content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda x: ~x.isin(*STOP_WORDS) & ((F.length(x) > 1) | x.rlike("^[0-9]+$")))


def stem(token: Column) -> Column:
    """Plural and common verb endings off, then a last e of words over four letters."""
    cut = token
    for suffix, new in reversed(SUFFIXES):
        fits = F.endswith(token, F.lit(suffix)) & (F.length(token) - len(suffix) >= 3)
        cut = F.when(fits, F.concat(F.left(token, F.length(token) - len(suffix)), F.lit(new))).otherwise(cut)
    short = bind(cut, lambda x: F.when(F.endswith(x, F.lit("e")) & (F.length(x) > 4), F.left(x, F.length(x) - 1)).otherwise(x))
    return F.when(token.rlike("^[0-9]+$") | F.contains(token, F.lit("-")), token).otherwise(short)


def content_tokens(text: Column) -> Column:
    return F.transform(raw_content_tokens(text), stem)


def sentences(text: Column) -> Column:
    blocks = F.filter(F.transform(F.split(strip(text), r"\n{2,}|\n(?=[-|\d])"), strip), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(b, r"(?<=[.!?])\s+(?=[A-Z0-9\[])"))
    return F.filter(F.transform(F.flatten(parts), strip), lambda s: s != "")


def strip(text: Column) -> Column:
    """White space off both ends, as Unicode has it; the text between is not searched."""
    return F.trim(text, F.lit(WHITE))


def strip_record_ids(text: Column) -> Column:
    return F.regexp_replace(text, RECORD_ID, " ")


def record_ids(text: Column) -> Column:
    return _found(text, RECORD_ID)


def numbers(text: Column) -> Column:
    """Numbers outside record ids, without thousands separators or trailing zeros."""
    bare = lambda n: F.regexp_replace(n, ",", "")
    short = lambda n: F.when(F.contains(n, F.lit(".")), F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.+$", "")).otherwise(n)
    return F.transform(_found(strip_record_ids(text), NUMBER), lambda n: short(bare(n)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def normal_entity(record_id: Column) -> Column:
    """A record id without its version, and a specification's as its product's."""
    return F.regexp_replace(F.regexp_replace(record_id, r"-v\d+$", ""), "^SPEC-", "")


def entities(text: Column, gazetteer: Column | None = None) -> Column:
    """Distinct entities of a text. gazetteer: array of struct(name, entity), name in lower case."""
    found = F.array_distinct(F.transform(record_ids(text), normal_entity))
    if gazetteer is None:
        return found
    named = F.transform(F.filter(gazetteer, lambda g: F.contains(F.lower(text), g["name"])), lambda g: g["entity"])
    return F.array_union(found, named)


def document_of(ref: Column) -> Column:
    return F.substring_index(F.substring_index(ref, "#", 1), "@", 1)


def action(reply: Column) -> Column:
    """A struct(action, input) from a model's reply: its first brace to its last one as JSON; nulls where there is no action in it."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "action string, input string")
    return F.when(found["action"].isNotNull(), found)


def cited_numbers(text: Column, n_hits: Column) -> Column:
    """Distinct citation numbers in range, in the order in which they are first seen."""
    all_ = F.transform(_found(text, r"\[(\d+)\]", 1), lambda n: n.try_cast("int"))
    return F.array_distinct(F.filter(all_, lambda n: n.isNotNull() & (n >= 1) & (n <= n_hits)))


def claims(answer: Column) -> Column:
    """Array of struct(text, cites): each sentence with the numbers of the next run of markers.

    Sentences after the last run have no numbers.
    """
    # \x01 parts the runs' texts from their markers; each piece is "text \x01 markers".
    marked = F.regexp_replace(answer, r"((?:\s*\[\d+\])+)", "\u0001$1\u0002")
    pieces = F.filter(F.split(marked, "\u0002"), lambda p: F.length(p) > 0)

    def of(piece: Column) -> Column:
        text = F.substring_index(piece, "\u0001", 1)
        marks = F.when(F.contains(piece, F.lit("\u0001")), F.substring_index(piece, "\u0001", -1)).otherwise(F.lit(""))
        cites = F.transform(_found(marks, r"\[(\d+)\]", 1), lambda n: n.try_cast("int"))
        # A tail without markers loses its leading dots, as the end of the sentence before.
        body = F.when(marks == "", F.regexp_replace(text, r"^[ .\n]+", "")).otherwise(text)
        real = F.filter(sentences(body), lambda s: F.regexp_replace(s, r"^[ .\n]+|[ .\n]+$", "") != "")
        return F.transform(real, lambda s: F.struct(s.alias("text"), cites.alias("cites")))

    return F.flatten(F.transform(pieces, of))


def has_fact(fact: Column, text: Column) -> Column:
    """Whether an answer states a fact: a figure among its numbers, "4 hours" not inside "14 hours", else as a substring."""
    low = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    f = F.lower(fact)
    figure = f.rlike(r"^-?\d+(?:\.\d+)?$")
    plain = F.when(F.contains(f, F.lit(".")), F.regexp_replace(F.regexp_replace(f, "0+$", ""), r"\.$", "")).otherwise(f)
    g = F.regexp_replace(f, r"(?U)\s+", " ")
    quoted = F.regexp_replace(g, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    led = F.regexp_like(low, F.concat(F.lit(r"(?U)(?<![\d.,])"), quoted, F.lit(r"(?!\w)")))
    return F.when(figure, F.array_contains(numbers(text), plain)).when(g.rlike(r"^\d"), led).otherwise(F.contains(low, g))


def facts_found(key_facts: Column, text: Column) -> Column:
    """How many of array<array<string>> facts hold; an inner array is any-of."""
    return F.size(F.filter(key_facts, lambda any_of: F.exists(any_of, lambda f: has_fact(f, text))))


def table_units(text: Column) -> Column:
    """Sentences, with the rows of a Markdown table as "Header: value; Header: value"."""
    cells = lambda s: F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), strip)
    start = F.struct(F.lit(None).cast("array<string>").alias("header"), _no_strings().alias("out"))

    def step(acc: Column, s: Column) -> Column:
        paired = F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.size(acc["header"]), F.size(cells(s)))), lambda i: F.concat(F.element_at(acc["header"], i), F.lit(": "), F.element_at(cells(s), i))), "; ")
        rule = F.forall(cells(s), lambda c: c.rlike("^[-: ]*$"))
        plain = F.struct(F.lit(None).cast("array<string>").alias("header"), F.concat(acc["out"], F.array(s)).alias("out"))
        first = F.struct(cells(s).alias("header"), acc["out"].alias("out"))
        later = F.struct(acc["header"].alias("header"), F.when(rule, acc["out"]).otherwise(F.concat(acc["out"], F.array(paired))).alias("out"))
        return F.when(~F.startswith(s, F.lit("|")), plain).when(acc["header"].isNull(), first).otherwise(later)

    return F.aggregate(sentences(text), start, step, lambda acc: acc["out"])


def markdown_rows(body: Column) -> Column:
    """Array of struct(n, text): a section's pipe lines after the first two, under the first one's headers."""
    cells = lambda s: F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), strip)
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: F.startswith(x, F.lit("|")))

    def rows(ls: Column) -> Column:
        head = cells(F.get(ls, F.lit(0)))

        def row(line: Column, i: Column) -> Column:
            got = cells(line)
            n = F.least(F.size(head), F.size(got))
            # A header that comes twice keeps its first place and its last value, as a map would.
            at = F.filter(F.sequence(F.lit(1), n), lambda k: F.array_position(head, F.element_at(head, k)) == k)
            last = lambda k: F.array_max(F.filter(F.sequence(F.lit(1), n), lambda j: F.element_at(head, j) == F.element_at(head, k)))
            text = F.array_join(F.transform(at, lambda k: F.concat(F.element_at(head, k), F.lit(": "), F.element_at(got, last(k)))), "; ")
            return F.struct((i + 1).alias("n"), text.alias("text"))

        return F.transform(F.slice(ls, 3, F.greatest(F.size(ls) - 2, F.lit(0))), row)

    empty = F.array().cast("array<struct<n:int,text:string>>")
    return bind(lines, lambda ls: F.when(F.size(ls) < 3, empty).otherwise(rows(ls)))
