"""N-grams of token lists, as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.tokens import without


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; a lambda that names an expression would compute it for every element."""
    return F.transform(F.array(value), lambda v: body(v)).getItem(0)


def ngrams(tokens: Column, n: int = 2) -> Column:
    """N neighbours joined by a blank; none if there are fewer than n tokens."""

    def made(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return once(tokens, made)


def ngrams_without(tokens: Column, stops, n: int = 2) -> Column:
    """Stop words go first, so n-grams reach across them."""
    return ngrams(without(tokens, stops), n)


def with_ngrams(par: DataFrame, tokens: str, n: int, stops=None, filter_unigrams: bool | None = None) -> DataFrame:
    """Paragraph tokens followed by their n-grams, in column `grams`.

    For pairs, stop words also go from the tokens and paragraphs left empty
    are dropped; for triples they go from the n-grams alone.
    """
    drop = (n == 2) if filter_unigrams is None else filter_unigrams
    bare = without(F.col(tokens), stops) if stops else F.col(tokens)
    out = par.withColumn("grams", F.concat(bare if stops and drop else F.col(tokens), ngrams(bare, n)))
    return out.filter(F.size(bare) > 0) if stops and drop else out


def tiles(tokens: Column, n: int) -> Column:
    """N tokens at a time from the end of a flattened act, without overlap; what is left at the start is dropped."""

    def made(w: Column) -> Column:
        size = F.size(w)
        whole = F.floor(size / n).cast("int")
        cut = F.transform(F.sequence(F.lit(0), whole - 1), lambda k: F.array_join(F.slice(w, size - n * k - (n - 1), F.lit(n)), " "))
        return F.when(whole > 0, cut).otherwise(F.array().cast("array<string>"))

    return once(tokens, made)


def repeated_ngrams(grams: Column, times: int = 2) -> Column:
    """N-grams found `times` or more, once each, in the order they are first seen.

    Sorted with their places, equal n-grams are neighbours: one that has an
    equal one times - 1 places on and no equal one before it is the first of
    enough. So a text of n n-grams takes n log n steps.
    """

    def found(all_: Column) -> Column:
        ordered = F.array_sort(F.transform(all_, lambda g, i: F.struct(g.alias("g"), i.alias("at"))))

        def firsts(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["g"] == x["g"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, i: ~same(x, i - 1) & same(x, i + (times - 1))), lambda x: F.struct(x["at"].alias("at"), x["g"].alias("g"))))

        return F.transform(once(ordered, firsts), lambda x: x["g"])

    return once(grams, found)


def ngram_range(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams from low to high."""
    return F.concat(*(ngrams(tokens, n) for n in range(low, high + 1)))
