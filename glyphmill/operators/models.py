"""Classifiers of sparse vectors, their evaluation, and topics."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from glyphmill.functions.segments import paragraphs
from glyphmill.operators import nets
from glyphmill.operators.ngrams import ngram_range
from glyphmill.operators.vectors import MODES, indexer_tokens, term_index, vectors
from glyphmill.operators.vocabulary import exploded
from glyphmill.sources.scratch import stored


def forward(docs: DataFrame, values: DataFrame, key: str, weights: DataFrame, units: DataFrame, bias: float) -> DataFrame:
    """(key, p) of every row of docs, by one hidden layer of rectified units and a sigmoid.

    values has (key, token, value), weights (token, unit, w), units (unit, b,
    out). Only terms with weights are joined; a document without any has what
    the biases give.
    """
    sums = values.join(weights, "token").groupBy(key, "unit").agg(F.sum(F.col("value") * F.col("w")).alias("z"))
    every = docs.select(key).distinct().join(F.broadcast(units))  # units: a row a hidden unit
    active = every.join(sums, [key, "unit"], "left").select(key, (F.greatest(F.coalesce("z", F.lit(0.0)) + F.col("b"), F.lit(0.0)) * F.col("out")).alias("a"))
    return active.groupBy(key).agg((1 / (1 + F.exp(-(F.sum("a") + F.lit(bias))))).alias("p"))


def if_likely(p: Column, at: float = 0.85) -> Column:
    """the probability as text, or nothing below the threshold."""
    return F.when(p < at, F.lit("")).otherwise(p.cast("string"))


def sentiment(p: Column) -> Column:
    """(percent, label); one half counts as negative, as rounding to even has it."""
    negative = F.bround(p) == 0
    return F.struct(F.when(negative, 1 - p).otherwise(p).alias("share"), F.when(negative, "NEGATIVE").otherwise("POSITIVE").alias("label"))


def feature_rows(docs: DataFrame, values: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """docs with a sparse `features` vector of (key, token, value) by index (token, idx from 1); place 0 stays empty.

    Vectors are put together as the columns that a stored vector consists of,
    and read back as vectors: no row passes through Python.
    """
    size = (index.agg(F.max("idx")).first()[0] or 0) + 1
    placed = values.join(index, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_pairs"))
    rows = docs.join(placed, key, "left")
    indices = F.coalesce(F.col("_pairs.idx"), F.array().cast("array<int>"))
    numbers = F.coalesce(F.col("_pairs.value"), F.array().cast("array<double>"))
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), numbers.alias("values"))
    made = rows.withColumn("features", sparse).drop("_pairs")
    return stored(made, StructType([StructField(f.name, VectorUDT()) if f.name == "features" else f for f in made.schema]))


def train(rows: DataFrame, hidden: int = 50, epochs: int = 10, seed: int = 1) -> nets.Net:
    """A net with one hidden layer on (features, label); its units are sigmoid, not rectified, which accuracy may show."""
    return nets.trained(rows, hidden, epochs, seed)


def probabilities(model: nets.Net, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of label 1, in place of features."""
    return nets.judged(model, rows)


def accuracy(rows: DataFrame, predicted: Column) -> DataFrame:
    """One row with the share of rows whose label is predicted."""
    return rows.agg(F.avg((F.col("label").cast("int") == predicted).cast("double")).alias("accuracy"))


def evaluate_modes(docs: DataFrame, tokens: DataFrame, key: str, order: list[str], modes: tuple[str, ...] = MODES, repeats: int = 5, least: int = 2, epochs: int = 10) -> DataFrame:
    """(mode, repeat, accuracy) on the rows held out; docs has (key, label, test), tokens (key, token, order).

    Vocabulary, index and document frequencies come from training rows alone.
    """
    learning = tokens.join(docs.filter("not test").select(key), key, "left_semi")
    index = term_index(learning, order).filter(F.col("cnt") >= least).select("token", "idx").cache()
    made = {mode: feature_rows(docs.select(key, "label", "test"), vectors(tokens, key, mode, index, learning), key, index) for mode in modes}
    turn = Lock()  # weights come to the driver one net at a time

    def judge(at: tuple[str, int]) -> tuple[str, int, float]:
        mode, r = at
        model = train(made[mode].filter("not test"), epochs=epochs, seed=r)
        with turn:
            right = accuracy(probabilities(model, made[mode].filter("test")), F.bround("p").cast("int")).first()[0]
        return mode, r, right

    with ThreadPool(len(modes) * repeats) as pool:  # each net is trained by one task
        rows = pool.map(judge, [(mode, r + 1) for mode in modes for r in range(repeats)], 1)
    index.unpersist()
    return docs.sparkSession.createDataFrame(rows, "mode string, repeat int, accuracy double")


def auto_mode(right: DataFrame, wrong: DataFrame, raw: DataFrame, key: str, text: str, order: list[str], epochs: int = 10) -> DataFrame:
    """(key, par_pos, par, p) of raw's paragraphs, judged by a net that tells the texts of right from those of wrong.

    All three have key and text. Words found more than once in either kind
    make the index, as in M06.
    """
    docs = wrong.select(F.concat(F.lit("0:"), F.col(key)).alias("_id"), F.lit(0).alias("label"), F.col(text).alias("_text")).unionByName(right.select(F.concat(F.lit("1:"), F.col(key)).alias("_id"), F.lit(1).alias("label"), F.col(text).alias("_text")))
    rows = exploded(docs, ["_id"], indexer_tokens(F.col("_text")))
    index = term_index(rows, order).filter("cnt > 1").select("token", "idx")
    model = train(feature_rows(docs, vectors(rows, "_id", "binary", index), "_id", index), epochs=epochs)
    pars = paragraphs(raw, key, text).withColumn("_id", F.concat_ws(":", key, "par_pos"))
    values = vectors(exploded(pars, ["_id"], indexer_tokens(F.col("par"))), "_id", "binary", index)
    return probabilities(model, feature_rows(pars, values, "_id", index)).select(key, "par_pos", "par", "p")


def described(scores: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles and most, by group."""
    v = F.col(value)
    parts = [F.percentile(v, p).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    return scores.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), *parts, F.max(v).alias("high"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share) with the share of rows in percent, to one digit."""
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("_all"))
    return counted.join(F.broadcast(total)).select(by, "n", F.round(100 * F.col("n") / F.col("_all"), 1).alias("share"))  # total is one row


def topics(docs: DataFrame, tokens: Column, k: int = 5, words: int = 10, grams: tuple[int, int] = (1, 1), rounds: int = 10, seed: int = 1) -> DataFrame:
    """(topic, place, word, weight), the heaviest words of each topic; documents without words take no part.

    Every round uses every text. The online optimizer wouldn't, at any rate: it draws with replacement.
    """
    rows = docs.select(ngram_range(tokens, *grams).alias("terms")).filter("size(terms) > 0")
    n_terms = rows.select(F.explode("terms").alias("t")).agg(F.countDistinct("t")).first()[0]
    counter = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=max(1, n_terms)).fit(rows)
    model = LDA(k=k, maxIter=rounds, seed=seed, optimizer="em").fit(counter.transform(rows).select("features"))
    found = [(t.topic, j + 1, counter.vocabulary[x], w) for t in model.describeTopics(words).collect() for j, (x, w) in enumerate(zip(t.termIndices, t.termWeights, strict=True))]  # k * words
    return docs.sparkSession.createDataFrame(found, "topic int, place int, word string, weight double")
