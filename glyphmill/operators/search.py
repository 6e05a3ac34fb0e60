"""Cosine search: for each conclusion, the paragraph of every act that is nearest to it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from glyphmill.operators.ngrams import once

#: Dense numbers a task holds at most (8 bytes each), conclusions a block, and terms of conclusions that one pass over the acts is sent.
MOST_CELLS, MOST_ITEMS, MOST_POSTINGS = 8_000_000, 1_024, 16_000_000
ACTS_AT_ONCE = 256
#: Rows, and bytes of their texts, of a batch of the result; a row of longer texts is a batch of its own.
MOST_ROWS, MOST_BYTES = 16_384, 8_000_000


def cosine_distance(dot: Column, left: Column, right: Column) -> Column:
    """From the dot product and both squared norms; null where one is zero."""
    return F.when((left > 0) & (right > 0), F.lit(1.0) - dot / (F.sqrt(left) * F.sqrt(right)))


def sentence_distances(docs: DataFrame, counts: DataFrame, key: str, n: int = 21, reverse: bool = False) -> DataFrame:
    """(key, distance) of the document with the least key to the n that follow it, nearest first, or last if reverse.

    docs has key, counts (key, token, cnt). Ties go by key. A document without
    a common term has distance 1, one without terms null, sorted last. Fewer
    than n others are no error.
    """
    few = docs.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(key).limit(n + 1)  # n + 1 rows
    first = few.agg(F.min(key).alias("_first"))
    mine = counts.join(F.broadcast(few), key).join(F.broadcast(first))
    query = mine.filter(F.col(key) == F.col("_first")).select("token", F.col("cnt").alias("q"))
    norm = query.agg(F.sum(F.col("q") * F.col("q")).cast("double").alias("qq"))
    sums = mine.filter(F.col(key) > F.col("_first")).join(query, "token", "left").groupBy(key).agg(F.sum(F.col("cnt") * F.coalesce("q", F.lit(0))).cast("double").alias("dot"), F.sum(F.col("cnt") * F.col("cnt")).cast("double").alias("pp"))
    d = F.round(cosine_distance(F.coalesce("dot", F.lit(0.0)), F.coalesce("qq", F.lit(0.0)), F.coalesce("pp", F.lit(0.0))), 9) + F.lit(0.0)
    others = few.join(F.broadcast(first)).filter(F.col(key) > F.col("_first")).select(key)
    order = F.desc_nulls_last("distance") if reverse else F.asc_nulls_last("distance")
    return others.join(sums, key, "left").join(F.broadcast(norm)).select(key, d.alias("distance")).orderBy(order, key)


@dataclass
class Block:
    """Some conclusions: their ids, the counts of their terms (sorted by term; rows start at ptr), and roots of their squared norms."""

    ids: np.ndarray
    terms: np.ndarray
    ptr: np.ndarray
    item: np.ndarray
    n: np.ndarray
    norm: np.ndarray

    def dense(self, used: np.ndarray) -> np.ndarray:
        """Counts of the terms used, a row each, by conclusion."""
        out = np.zeros((len(used), len(self.ids)))
        at = np.minimum(np.searchsorted(self.terms, used), max(0, len(self.terms) - 1))
        rows = np.flatnonzero(self.terms[at] == used) if len(self.terms) else np.array([], int)
        start, many = self.ptr[at[rows]], np.diff(self.ptr)[at[rows]]
        places = np.repeat(start - np.concatenate([[0], many.cumsum()[:-1]]), many) + np.arange(many.sum()) if len(rows) else np.array([], int)
        out[np.repeat(rows, many), self.item[places]] = self.n[places]
        return out


def _block(items: list[tuple[int, list[str]]], known: dict[str, int]) -> Block:
    term, item = [], []
    for j, (_, tokens) in enumerate(items):
        term += [known.setdefault(t, len(known)) for t in tokens]
        item += [j] * len(tokens)
    cell, n = np.unique(np.array(term, np.int64) * len(items) + np.array(item, np.int64), return_counts=True)
    terms, start = np.unique(cell // len(items), return_index=True)
    own = cell % len(items)
    norm = np.sqrt(np.bincount(own, weights=n.astype(float) ** 2, minlength=len(items)) + 1)
    return Block(np.array([i for i, _ in items]), terms, np.append(start, len(cell)), own, n.astype(float), norm)


def _passes(items: Iterable[tuple[int, list[str]]]) -> Iterator[tuple[dict[str, int], list[Block]]]:
    """(numbers of terms, blocks of conclusions) for each pass over the acts: one, unless the conclusions have over MOST_POSTINGS words."""
    known: dict[str, int] = {}
    blocks: list[Block] = []
    waiting: list[tuple[int, list[str]]] = []
    held = 0
    for item, tokens in items:
        if held and held + len(tokens) > MOST_POSTINGS:
            yield known, [*blocks, *([_block(waiting, known)] if waiting else [])]
            known, blocks, waiting, held = {}, [], [], 0
        waiting.append((item, tokens))
        held += len(tokens)
        if len(waiting) == MOST_ITEMS:
            blocks.append(_block(waiting, known))
            waiting = []
    if waiting:
        blocks.append(_block(waiting, known))
    if blocks:
        yield known, blocks


def _cells(tokens: pa.Array, known: dict[str, int], n_pars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, term, count) of the known terms of paragraphs (a list array of tokens), sorted."""
    offsets = tokens.offsets.to_numpy()
    words = tokens.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    if not len(words.dictionary):
        return (np.array([], np.int64),) * 3
    number = np.array([known.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
    term = number[words.indices.fill_null(0).to_numpy(zero_copy_only=False)]
    par = np.repeat(np.arange(n_pars), np.diff(offsets))
    live = term >= 0
    cell, n = np.unique(par[live] * max(1, len(known)) + term[live], return_counts=True)
    return cell // max(1, len(known)), cell % max(1, len(known)), n.astype(float)


def _distances(block: Block, par: np.ndarray, term: np.ndarray, n: np.ndarray, lo: int, hi: int, places: int | None) -> np.ndarray:
    """Distances of paragraphs lo to hi and the block's conclusions, rounded to so many places or not at all."""
    s = slice(*np.searchsorted(par, [lo, hi]))
    used, column = np.unique(term[s], return_inverse=True)
    p = np.zeros((hi - lo, len(used)))
    p[par[s] - lo, column] = n[s]
    counts = block.dense(used)
    d = 1 - (p @ counts + 1) / (block.norm * np.sqrt((p**2) @ (counts > 0) + 1))
    return d if places is None else np.round(d, places) + 0.0


def _nearest(block: Block, cells: tuple[np.ndarray, np.ndarray, np.ndarray], a: int, b: int, step: int, places: int | None) -> tuple[np.ndarray, np.ndarray]:
    """By conclusion the least distance among paragraphs a to b, and the place of the first that has it."""
    low, spot = np.full(len(block.ids), np.inf), np.zeros(len(block.ids), np.int64)
    for lo in range(a, b, step):
        d = _distances(block, *cells, lo, min(b, lo + step), places)
        k = d.argmin(axis=0)
        least = d[k, np.arange(len(block.ids))]
        spot = np.where(least < low, k + lo - a, spot)
        low = np.minimum(low, least)
    return low, spot


FOUND = "item_id long, act_id long, par_pos int, cosine double, court string, requisites string, paragraph string"


def conclusion_search(acts: DataFrame, conclusions: DataFrame, output: str = "best", places: int | None = 9) -> DataFrame:
    """FOUND of every conclusion and act: the act's nearest paragraph, the first of equals; with output "all" each paragraph.

    acts has act_id, texts (its paragraphs) and pars (an array of tokens for
    each of these, n-grams already taken apart); conclusions has item_id and
    tokens. Counts are of the conclusion's own terms with a constant 1 put to
    both sides, so the distance is 1 - (c.p + 1) / sqrt((c.c + 1)(p.p + 1))
    and never undefined. It is rounded to so many places, which lets equals
    tie; pass None if you round it yourself, for two roundings can differ from
    one. The court is the act's first paragraph, its requisites the third, null
    where there are fewer. Acts without paragraphs give no rows.

    Every pair is part of the result, so nothing is saved by joining on terms:
    the conclusions, as sparse counts, are sent to where the acts are read
    once, no act is shuffled, and the texts of the result are taken from the
    row at hand. Conclusions of more than MOST_POSTINGS words in all (some 200
    MB) take further passes. For a ranking see nearest_acts().
    """
    if output not in ("best", "all"):
        raise ValueError(f"output is 'best' or 'all', not {output!r}")
    named = conclusions.select(F.col("item_id").cast("long"), "tokens").filter("item_id is not null")
    items = ((r.item_id, r.tokens or []) for r in named.orderBy("item_id").toLocalIterator())
    out = None
    for sent in _passes(items):
        scored = _scored(acts, acts.sparkSession.sparkContext.broadcast(sent), output == "all", places)
        out = scored if out is None else out.unionByName(scored)
    return acts.sparkSession.createDataFrame([], FOUND) if out is None else out


def reported(ids: pa.Array, texts: pa.ListArray, item: np.ndarray, act: np.ndarray, cosine: np.ndarray, spot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """FOUND of conclusions, acts (places in ids and texts), distances and places of paragraphs, in batches: each row repeats three texts of its act."""
    first = texts.offsets.to_numpy()
    many = np.diff(first)[act]
    values = texts.values.slice(first[0], first[-1] - first[0])
    sizes = np.append(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), 0)
    places = [np.where(many > place, first[act] - first[0] + place, -1) for place in (0, 2, spot)]  # the last of sizes is that of none
    total = sum(sizes[at].astype(np.int64) for at in places).cumsum()
    lo = 0
    while lo < len(item):
        before = total[lo - 1] if lo else 0
        hi = min(len(item), lo + MOST_ROWS, max(lo + 1, int(np.searchsorted(total, before + MOST_BYTES, "right"))))
        text = [values.take(pa.array(at[lo:hi], pa.int64(), mask=at[lo:hi] < 0)) for at in places]
        yield pa.RecordBatch.from_arrays([pa.array(item[lo:hi], pa.int64()), ids.take(pa.array(act[lo:hi])), pa.array((spot[lo:hi] + 1).astype(np.int32)), pa.array(cosine[lo:hi]), *text], ["item_id", "act_id", "par_pos", "cosine", "court", "requisites", "paragraph"])
        lo = hi


def _scored(acts: DataFrame, shared: Broadcast, every: bool, places: int | None) -> DataFrame:
    def rows(part: pa.RecordBatch, known: dict[str, int], blocks: list[Block]) -> Iterator[pa.RecordBatch]:
        ids, texts, pars = part.column(0), part.column(1), part.column(2)
        bounds = pars.offsets.to_numpy()
        if not part.num_rows or bounds[0] == bounds[-1]:
            return  # no paragraphs; the arrays below would have no offsets
        tokens = pars.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        cells = _cells(tokens, known, len(tokens))
        step = max(1, MOST_CELLS // max(1, len(known), *(len(b.ids) for b in blocks)))
        live = [k for k in range(part.num_rows) if bounds[k + 1] > bounds[k]]
        for block in blocks:
            m, waiting, held = len(block.ids), [], 0
            for k in live:
                a, b = int(bounds[k]), int(bounds[k + 1])
                if every:
                    few = max(1, min(step, MOST_ROWS // m))
                    found = ((lo, _distances(block, *cells, lo, min(b, lo + few), places)) for lo in range(a, b, few))
                    pieces = ((np.tile(block.ids, len(d)), np.full(d.size, k), d.ravel(), np.repeat(np.arange(lo, lo + len(d)) - a, m)) for lo, d in found)
                else:
                    pieces = iter([(block.ids, np.full(m, k), *_nearest(block, cells, a, b, step, places))])
                for piece in pieces:
                    waiting.append(piece)
                    held += len(piece[0])
                    if held >= MOST_ROWS:
                        yield from reported(ids, texts, *map(np.concatenate, zip(*waiting, strict=True)))
                        waiting, held = [], 0
            if waiting:
                yield from reported(ids, texts, *map(np.concatenate, zip(*waiting, strict=True)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ACTS_AT_ONCE):
                yield from rows(batch.slice(lo, ACTS_AT_ONCE), known, blocks)

    none = F.array().cast("array<string>")
    whole = acts.select(F.col("act_id").cast("long"), F.coalesce("texts", none), F.coalesce("pars", F.array().cast("array<array<string>>")))
    return whole.mapInArrow(score, FOUND)


def nearest_acts(found: DataFrame, k: int) -> DataFrame:
    """Of each conclusion the k nearest acts, nearest first, ties by act_id; `place` counts from 1."""
    place = F.row_number().over(W.Window.partitionBy("item_id").orderBy("cosine", "act_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def gram_words(tokens: Column, n: int = 2) -> Column:
    """Tokens, then the words of all their n-grams; these weigh a word by the n-grams that cover it."""

    def made(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.concat(w, F.flatten(F.transform(starts, lambda i: F.slice(w, i, F.lit(n)))))).otherwise(w)

    return once(tokens, made)


def with_gram_words(tokens: Column, grams: Column) -> Column:
    """Tokens and the words of given n-grams."""
    words = F.flatten(F.transform(grams, lambda g: F.split(g, " ")))
    return F.concat(tokens, words)
