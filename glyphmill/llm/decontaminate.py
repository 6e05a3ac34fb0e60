"""Benchmark decontamination: spaced seeds find where test items and texts may agree, aligned words decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import cut, let, likely, table

#: Masks over neighbouring words: 1 is hashed, 0 may be any word. Of LEAST_WORDS to 20 words of which PERCENT are equal, wherever
#: the others stand, at least one mask fits everywhere it asks; a test tries all places.
MASKS = ("1100100111", "11111000001", "1000011111", "11101011")
#: The least words of any overlap, and the least share of them that agree, in percent. Shorter items must be held whole, word for word.
LEAST_WORDS, PERCENT = 13, 80
#: Seeds of all items that are broadcast at most (about 50 bytes each, and the items' words); a larger benchmark is joined by shuffling.
MOST_BROADCAST_SEEDS = 200_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words (runs of letters and digits, lower-cased) of a text; null has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x))


def _seeds(w: Column) -> Column:
    """For each place the masks' hashes of the words they name, with the mask's number; null where a mask ends behind the text."""
    spans = [len(m) for m in MASKS]

    def at(i: Column) -> Column:
        hashes = (F.xxhash64(F.lit(k), *(F.get(w, i + j) for j, c in enumerate(m) if c == "1")) for k, m in enumerate(MASKS))
        return F.array(*(F.when(F.get(w, i + (n - 1)).isNotNull(), h) for h, n in zip(hashes, spans, strict=True)))

    places = F.sequence(F.lit(0), F.size(w) - F.lit(min(spans)))
    return F.when(F.size(w) >= min(spans), F.transform(places, at)).otherwise(F.array().cast("array<array<bigint>>"))


def seeded(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, at, seed): a row for each place and mask of each text."""
    placed = rows.select(*keys, F.posexplode(let(word_hashes(F.col(text)), _seeds)).alias("at", "seeds"))
    return placed.select(*keys, "at", F.explode("seeds").alias("seed")).filter("seed is not null")


def _sum(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def _least(equal: Column) -> Column:
    return F.least(F.lit(LEAST_WORDS), F.size(equal))


def _good(n_equal: Column, n_words: Column, least: Column) -> Column:
    """(n_equal, less) of a stretch that stands, else null; the greatest of them is the best."""
    stands = (n_words >= least) & (100 * n_equal >= PERCENT * n_words)
    return F.when(stands, F.struct(n_equal.alias("n_equal"), (-n_words).alias("less")))


def _stretch(equal: Column) -> Column:
    """The best stretch anywhere in an alignment, of any length from LEAST_WORDS on; null if none stands.

    More equal words at either end never lower the share, so the best one
    goes from the start of a run of equal words to the end of a run, filled
    up with unequal words where that is too short.
    """
    n = F.size(equal)
    places = F.sequence(F.lit(1), n)
    on = lambda i: F.coalesce(F.get(equal, i - 1), F.lit(0)) == 1
    starts = F.filter(places, lambda i: on(i) & ~on(i - 1))
    ends = F.filter(places, lambda i: on(i) & ~on(i + 1))
    grown = lambda runs, r: F.concat(runs, F.array(F.struct(r["a"].alias("a"), r["b"].alias("b"), (F.coalesce(F.get(runs, F.size(runs) - 1)["upto"], F.lit(0)) + r["b"] - r["a"] + 1).alias("upto"))))
    runs = F.aggregate(F.arrays_zip(starts.alias("a"), ends.alias("b")), F.array().cast("array<struct<a:int,b:int,upto:int>>"), grown)
    pair = lambda r, t: _good(t["upto"] - r["upto"] + r["b"] - r["a"] + 1, F.greatest(t["b"] - r["a"] + 1, _least(equal)), _least(equal))
    return let(runs, lambda x: F.array_max(F.flatten(F.transform(x, lambda r: F.transform(F.filter(x, lambda t: t["a"] >= r["a"]), lambda t: pair(r, t))))))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id): items of the same words have the smallest item_id of them as class."""
    rows = benchmark.select("item_id", F.md5(F.array_join(F.transform(word_hashes(F.col("text")), lambda x: x.cast("string")), ",").cast("binary")).alias("_same")).filter("item_id is not null")
    low = rows.groupBy("_same").agg(F.min("item_id").alias("class_id"))
    return rows.join(low, "_same").select("item_id", "class_id").distinct()


def _alignments(documents: DataFrame, seeds: DataFrame, few: bool) -> DataFrame:
    """(doc_id, copy, found): for each text with hits its items and offsets (a text's word less the item's).

    Many seeds are first tried against a Bloom filter, so only words that may
    hit are shuffled; a row holds numbers alone.
    """
    tried = seeded(documents, "doc_id", "copy")
    hits = tried.join(F.broadcast(seeds), "seed") if few else likely(tried, "seed", seeds.select("seed")).join(seeds.hint("merge"), "seed")
    lines = hits.select("doc_id", "copy", "item_id", "item_words", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    return lines.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("item_id", "item_words", "offset")).alias("found"))


def _whole(documents: DataFrame, items: DataFrame, few: bool) -> DataFrame:
    """(doc_id, item_id, n_words, n_equal) of items of fewer than LEAST_WORDS words that a text holds whole, found by a hash of all their words."""
    sizes = sorted(r.n for r in items.select(F.size("item").alias("n")).distinct().collect())  # at most LEAST_WORDS - 1
    runs = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, F.lit(n)))).otherwise(F.array().cast("array<array<bigint>>"))
    hashed = lambda w, n: F.transform(runs(w, n), lambda x: F.xxhash64(x))
    parts = let(word_hashes(F.col("text")), lambda w: F.flatten(F.array(*(F.transform(F.array_distinct(hashed(w, n)), lambda h: F.struct(F.lit(n).alias("n"), h.alias("whole"))) for n in sizes))))  # noqa: B023
    wanted = items.select("item_id", "item", F.size("item").alias("n"), F.xxhash64("item").alias("whole"))
    held = documents.select("doc_id", "copy", F.explode(parts).alias("part")).select("doc_id", "copy", "part.n", "part.whole")
    met = held.join(F.broadcast(wanted), ["n", "whole"]) if few else likely(held, "whole", cut(wanted.select("whole"))).join(wanted.hint("merge"), ["n", "whole"])
    met = cut(met.select("doc_id", "copy", "item_id", "item", "n").distinct())
    again = likely(documents, "doc_id", met.select("doc_id").distinct()).join(met, ["doc_id", "copy"])
    sure = again.filter(let(word_hashes(F.col("text")), lambda w: F.exists(runs(w, F.col("n")), lambda x: x == F.col("item"))))
    return sure.select("doc_id", "item_id", F.col("n").cast("long").alias("n_words"), F.col("n").cast("long").alias("n_equal")).distinct()


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_equal, n_items): the best overlap of each document with each item it shares a passage with.

    documents has (doc_id, text), benchmark (item_id, text). A place where a
    mask's words agree aligns a text with an item; all words of the item, ahead
    of the place and behind it, are then compared one by one. An overlap is a
    stretch of at least LEAST_WORDS words of which PERCENT are equal, so
    substituted words are borne; the best has most equal words, then fewest
    words. An item of fewer than LEAST_WORDS words must be held whole and word
    for word.

    Of items with the same words only the smallest item_id is named, n_items
    says how many they are, and item_classes() which. Null or empty texts,
    items without words and null ids give no rows. Repeated rows count once;
    of texts that share a doc_id the best overlap counts.
    """
    items = benchmark.select("item_id", "text").filter("item_id is not null")
    classes = cut(item_classes(items))
    many = classes.groupBy(F.col("class_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n_items"))
    first = classes.filter("item_id = class_id").select("item_id")
    sized = items.join(first, "item_id", "left_semi").dropDuplicates(["item_id"])
    wanted = cut(sized.select("item_id", word_hashes(F.col("text")).alias("item")))
    long_, short = wanted.filter(F.size("item") >= LEAST_WORDS), wanted.filter(F.size("item").between(1, LEAST_WORDS - 1))
    seeds = seeded(sized, "item_id").select("item_id", F.col("at").alias("item_at"), "seed")
    seeds = cut(seeds.join(long_.select("item_id", F.size("item").alias("item_words")), "item_id"))
    few = seeds.count() <= MOST_BROADCAST_SEEDS

    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("copy")).filter("doc_id is not null")
    met = cut(_alignments(texts, seeds, few))
    again = likely(texts, "doc_id", met.select("doc_id").distinct()).join(met, ["doc_id", "copy"])
    lead = lambda a: F.greatest(-a["offset"], F.lit(0))  # noqa: E731  item words before the text's first
    part = lambda w, a: F.slice(w, F.greatest(a["offset"], F.lit(0)) + 1, a["item_words"] - lead(a))
    parts = let(word_hashes(F.col("text")), lambda w: F.transform("found", lambda a: F.struct(a["item_id"].alias("item_id"), lead(a).alias("lead"), part(w, a).alias("part"))))
    lines = again.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.*").join(F.broadcast(long_) if few else long_, "item_id")  # a quarter of the seeds, in words
    bits = F.zip_with(F.slice("item", F.col("lead") + 1, F.size("item")), "part", lambda a, b: F.when(a == b, 1).otherwise(0))
    compared = lines.select("doc_id", "item_id", F.concat(F.array_repeat(F.lit(0), F.col("lead")), bits).alias("equal"))
    enough = compared.filter(100 * _sum(F.col("equal")) >= PERCENT * _least(F.col("equal")))
    rated = enough.withColumn("b", _stretch(F.col("equal"))).filter("b is not null")
    best = rated.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    found = best.select("doc_id", "item_id", (-F.col("b.less")).cast("long").alias("n_words"), F.col("b.n_equal").cast("long").alias("n_equal"))
    if n_short := short.count():
        found = found.unionByName(_whole(texts, short, n_short <= MOST_BROADCAST_SEEDS))
    return found.join(many, "item_id").select("doc_id", "item_id", "n_words", "n_equal", "n_items")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that overlap with no item; rows without doc_id are kept."""
    leaks = cut(overlaps(documents, benchmark).select("doc_id").distinct())
    return documents.join(leaks, "doc_id", "left_anti").select(*(f"`{c}`" for c in documents.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: By definition, without seeds: every alignment that shares words, and every stretch of it between two equal words.
SQL = rf"""
with texts as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from documents where doc_id is not null),
items as (
  select min(item_id) as item_id, count(distinct item_id) as n_items, w
  from (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from benchmark where item_id is not null)
  group by w),
d as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from texts),
b as (select item_id, len(w) as size, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from items),
lines as (
  select doc_id, item_id, any_value(size) as size, d.i - b.i as shift, list(distinct b.i order by b.i) as p
  from d join b using (word) group by doc_id, item_id, d.i - b.i),
live as (select row_number() over () as k, * from lines where 100 * len(p) >= {PERCENT} * least({LEAST_WORDS}, size)),
ends as (select k, doc_id, item_id, size, p, unnest(range(1, len(p) + 1)) as a from live),
pairs as (select doc_id, item_id, size, p, a, unnest(range(a, len(p) + 1)) as z from ends),
stretches as (select doc_id, item_id, size, z - a + 1 as n_equal, greatest(p[z] - p[a] + 1, least({LEAST_WORDS}, size)) as n_words from pairs),
good as (
  select * from stretches
  where case when size < {LEAST_WORDS} then n_equal = size else 100 * n_equal >= {PERCENT} * n_words end)
select doc_id, item_id, cast(n_words as bigint) as n_words, cast(n_equal as bigint) as n_equal, n_items
from (select *, row_number() over (partition by doc_id, item_id order by n_equal desc, n_words) as k from good) join items using (item_id) where k = 1
"""
