"""Vocabularies: counts, cut-offs, first-seen order, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from glyphmill.sources.scratch import stored


def exploded(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, tok_pos, token): a row for each token; texts are projected away before they are multiplied."""
    return df.select(*keys, F.posexplode(tokens).alias("tok_pos", "token"))


def word_counts(*tokens: DataFrame) -> DataFrame:
    """(token, cnt) over one or more token tables, counted together."""
    rows = tokens[0].select("token")
    for t in tokens[1:]:
        rows = rows.unionByName(t.select("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def more_than(counts: DataFrame, n: int = 1) -> DataFrame:
    """strictly more than n."""
    return counts.filter(F.col("cnt") > n)


def at_least(counts: DataFrame, n: int = 2) -> DataFrame:
    """N or more."""
    return counts.filter(F.col("cnt") >= n)


def descending(counts: DataFrame, *ties: str) -> DataFrame:
    """most frequent first; ties by the given columns, else by token."""
    return counts.orderBy(F.desc("cnt"), *(ties or ("token",)))


def sorted_keys(df: DataFrame, key: str) -> DataFrame:
    """the distinct values of a column in order, nulls left out."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(key)


def most_common(tokens: DataFrame, k: int, order: list[str]) -> DataFrame:
    """the k most frequent tokens, ties in first-seen order of the columns `order`."""
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct(*order)).alias("first"))
    return counted.orderBy(F.desc("cnt"), "first").limit(k).select("token", "cnt")


def in_vocabulary(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Left semi join; Spark broadcasts the vocabulary where it is small."""
    return tokens.join(vocabulary.select("token"), "token", "left_semi")


def not_stopped(tokens: DataFrame, stops: DataFrame) -> DataFrame:
    """Left anti join."""
    return tokens.join(stops.select("token"), "token", "left_anti")


def term_counts(tokens: DataFrame, key: str) -> DataFrame:
    """(key, token, cnt), the sparse document-term matrix."""
    return tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("cnt"))


def document_frequency(tokens: DataFrame, key: str) -> DataFrame:
    """A10: documents that hold each token."""
    return tokens.select(key, "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def distinct_longer(tokens: DataFrame, than: int = 1) -> DataFrame:
    """Distinct tokens of more than `than` characters."""
    return tokens.select("token").filter(F.length("token") > than).distinct()


#: Words of a vocabulary that is sent to the executors (some 60 bytes each); a larger one is joined token by token.
MOST_WORDS = 4_000_000


def lines_in_vocabulary(df: DataFrame, key: str, tokens: Column, vocabulary: DataFrame) -> DataFrame:
    """T19-T21 for a vocabulary of any size: (key, line) of every row; a row without such tokens has an empty line.

    No token is shuffled but those that the vocabulary lacks, once a row of
    df; rows of df come to them once.
    """
    vocabulary = stored(vocabulary.select("token"))
    if vocabulary.count() <= MOST_WORDS:
        lost = df.select(key, F.explode(F.array_distinct(tokens)).alias("token")).join(F.broadcast(vocabulary), "token", "left_anti")  # MOST_WORDS rows
        rows = df.join(lost.groupBy(key).agg(F.collect_set("token").alias("_lost")), key, "left").withColumn("_lost", F.coalesce("_lost", F.array().cast("array<string>")))
        # Lost tokens become null, so those of rows with the same key keep their places.
        kept = rows.select(key, F.transform(tokens, lambda x: F.when(~F.array_contains("_lost", x), x)).alias("_kept")).groupBy(key).agg(F.collect_list("_kept").alias("_all"))
        merged = F.transform(F.array_sort(F.flatten(F.transform("_all", lambda a: F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x")))))), lambda x: x["x"])
        line = F.array_join(F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).otherwise(merged), " ")
        return kept.select(key, F.when(F.col(key).isNull(), F.lit("")).otherwise(F.coalesce(line, F.lit(""))).alias("line"))
    found = in_vocabulary(exploded(df, [key], tokens), vocabulary)
    lines = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_pos", "token"))), lambda x: x.getField("token")), " ").alias("line"))
    return df.select(key).distinct().join(lines, key, "left").select(key, F.coalesce("line", F.lit("")).alias("line"))


def chosen(tokens: DataFrame, more_than_times: int | None = None, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(token, cnt) found more than so many times, or else the `most` most frequent ones, ties in first-seen order; one must be given."""
    if more_than_times:
        return more_than(word_counts(tokens), more_than_times)
    if most:
        return most_common(tokens, most, order or ["tok_pos"])
    raise TypeError("give more_than_times or most")


#: Rows that numbered() sorts in one task, and rows it looks at for each bound between tasks.
ROWS_A_BUCKET, SAMPLED = 1_000_000, 50


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df, which should be stored, with the place (from 0) of each row in the order of the column `by`.

    A sample of it bounds buckets of about ROWS_A_BUCKET rows that follow one
    another in this order; each is sorted by itself and the counts of those
    before it are added. The sample makes tasks even, not results right.
    """
    n = df.count()
    k = n // ROWS_A_BUCKET
    bucket = F.lit(0)
    if k:
        seen = sorted(r[0] for r in df.select(by).sample(min(1.0, SAMPLED * k / n), seed=1).collect())  # some SAMPLED a bucket
        bounds = [seen[(i + 1) * len(seen) // (k + 1)] for i in range(min(k, len(seen)))]
        literal = lambda v: F.struct(*map(literal, v)) if isinstance(v, tuple) else F.lit(v)
        # Bounds are compared field by field, as by's own type has them.
        bucket = F.size(F.filter(F.array(*(literal(b).cast(df.schema[by].dataType) for b in bounds)), lambda b: b <= F.col(by))) if bounds else bucket
    placed = df.withColumn("_bucket", bucket)
    before = W.Window.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each ROWS_A_BUCKET
    own = F.row_number().over(W.Window.partitionBy("_bucket").orderBy(by))
    return placed.join(F.broadcast(counts), "_bucket").withColumn(name, F.col("_before") + own - 1).drop("_bucket", "_before")


def first_seen_index(tokens: DataFrame, order: list[str]) -> DataFrame:
    """(token, idx) from 0 in first-seen order."""
    first = stored(tokens.groupBy("token").agg(F.min(F.struct(*order)).alias("first")))
    return numbered(first, "first", "idx").select("token", F.col("idx").cast("int").alias("idx"))


def profile(df: DataFrame, **counts: Column) -> DataFrame:
    """The numbers a run reports, in one row."""
    return df.agg(*(c.alias(n) for n, c in counts.items()))
