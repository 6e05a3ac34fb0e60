"""Vectors of documents in sparse long form: (key, token, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from glyphmill.operators.vocabulary import numbered
from glyphmill.sources.scratch import stored

#: Signs the indexer replaces by blanks; the hyphen is among them, the apostrophe isn't.
FILTERED = r"[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n]"
MODES = ("binary", "count", "freq", "tfidf")


def indexer_tokens(text: Column) -> Column:
    """Lower-cased, the signs replaced, split at blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), FILTERED, " "), " "), lambda x: x != "")


def counted_words(text: Column) -> Column:
    """Lower-cased words of two or more letters, digits or `_`."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) > 1)


def term_index(tokens: DataFrame, order: list[str]) -> DataFrame:
    """(token, idx) from 1, most frequent first, ties first seen."""
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct(*order)).alias("_first"))
    counted = stored(counted.select("token", "cnt", F.struct((-F.col("cnt")).alias("few"), "_first").alias("_by")))
    return numbered(counted, "_by", "idx").select("token", (F.col("idx") + 1).cast("int").alias("idx"), "cnt")


def vectors(tokens: DataFrame, key: str, mode: str = "binary", vocabulary: DataFrame | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """(key, token, value) of the tokens in vocabulary; documents without any have no rows.

    binary 1; count; freq, the share of the document's in-vocabulary tokens;
    tfidf, (1 + ln c) * ln(1 + N / (1 + df)) with N documents and df of the
    tokens `fitted` (else tokens itself).
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    kept = tokens if vocabulary is None else tokens.join(vocabulary.select("token"), "token", "left_semi")
    counts = kept.groupBy(key, "token").agg(F.count(F.lit(1)).alias("cnt"))
    if mode == "binary":
        return counts.select(key, "token", F.lit(1.0).alias("value"))
    if mode == "count":
        return counts.select(key, "token", F.col("cnt").cast("double").alias("value"))
    if mode == "freq":
        total = F.sum("cnt").over(W.Window.partitionBy(key))
        return counts.select(key, "token", (F.col("cnt") / total).alias("value"))
    base = tokens if fitted is None else fitted
    once = base.select(key, "token").distinct()
    df = once.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = once.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(df, "token", "left").join(F.broadcast(n))  # n is one row
    value = (1 + F.log(F.col("cnt"))) * F.log(1 + F.col("n") / (1 + F.coalesce("df", F.lit(0))))
    return weighed.select(key, "token", value.alias("value"))
