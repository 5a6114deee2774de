"""Vectors as arrays of doubles: products, norms and hashed text features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verispan.functions.text import bind, content_tokens


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length one; a zero vector stays."""

    def scaled(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
        return bind(norm, lambda n: F.when(n == 0, x).otherwise(F.transform(x, lambda y: y / n)))

    return bind(doubles(v), scaled)


def features(text: Column) -> Column:
    """Content tokens, their 4-grams as #xxxx, and pairs of neighbours as a_b."""
    grams = lambda t: F.transform(
        F.when(F.length(t) >= 4, F.sequence(F.lit(1), F.length(t) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("#"), F.substring(t, i, F.lit(4))),
    )

    def of(ts: Column) -> Column:
        pairs = F.when(F.size(ts) > 1, F.transform(F.sequence(F.lit(0), F.size(ts) - 2), lambda i: F.concat_ws("_", F.get(ts, i), F.get(ts, i + 1))))
        return F.concat(ts, F.flatten(F.transform(ts, grams)), F.coalesce(pairs, F.array().cast("array<string>")))

    return bind(content_tokens(text), of)


def bucket(digest: Column, dim: int) -> Column:
    """The bucket by a feature's MD5."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim).cast("int")


def sign(digest: Column) -> Column:
    """The sign by a feature's MD5: its ninth digit odd or even."""
    return F.when(F.substring(digest, 9, 1).isin(*"13579bdf"), 1.0).otherwise(-1.0)


def hash_embedding(text: Column, dim: int = 512) -> Column:
    """A text's features, each signed and weighted 1 + ln(count) in its bucket, at length one."""

    def weighted(fs: Column) -> Column:
        # Sorted features bring equal ones together: a run's last position and its length give its count.
        runs = F.filter(
            F.transform(fs, lambda f, i: F.struct(f.alias("f"), i.alias("i"), (F.get(fs, i + 1) == f).alias("more"))),
            lambda x: ~F.coalesce(x["more"], F.lit(False)),
        )
        def one(x: Column, before: Column) -> Column:
            weight = 1 + F.ln((x["i"] - before).cast("double"))
            return bind(F.md5(x["f"]), lambda m: F.struct(bucket(m, dim).alias("b"), (sign(m) * weight).alias("w")))

        return bind(runs, lambda rs: F.transform(rs, lambda x, k: one(x, F.coalesce(F.get(rs, k - 1)["i"], F.lit(-1)))))

    def placed(ws: Column) -> Column:
        # Sorted by bucket, each bucket's weights are a run of the array, summed by its slice.
        ends = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("i"), w["b"].alias("b"))), lambda x: F.coalesce(F.get(ws, x["i"] + 1)["b"] != x["b"], F.lit(True)))

        def sums(es: Column) -> Column:
            def one(x: Column, k: Column) -> Column:
                lo = F.coalesce(F.get(es, k - 1)["i"], F.lit(-1)) + 1
                total = F.aggregate(F.slice(ws, lo + 1, x["i"] - lo + 1), F.lit(0.0), lambda s, w: s + w["w"])
                return F.struct(x["b"].alias("b"), total.alias("w"))

            return F.map_from_entries(F.transform(es, one))

        dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.try_element_at(m, b), F.lit(0.0)))
        return bind(bind(ends, sums), dense)

    return unit(bind(F.sort_array(bind(F.sort_array(features(text)), weighted)), placed))
