"""Toxicity: disguised words are restored by a noisy-channel decoder, then the restored text is scored."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import agreed_labels, bounded_sample, crc_of_id, cut, table
from glyphmill.llm.linear import lasso_logistic

#: Labelled rows learned from at most (smallest md5 of doc_id first), and words and prefixes kept as features at most.
MOST_LABELLED, MOST_FEATURES, LEAST_TEXTS = 20_000, 2_048, 8
FOLDS, HELD_OUT, AT = 3, 1, 0.7
LETTERS = 27  # 0 is a word's edge, then a to z
MOST_CACHED = 300_000

#: Costs in nats of what the channel may do: write a letter as a sign, put in a sign or a space, say a letter again (or just twice).
SIGN, NOISE, GAP, EDGE, AGAIN, TWICE = 0.5, 12.0, 0.1, 2.0, 0.3, 4.0
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
_ENDS = re.compile(r"^[.,;:?\"'()\[\]{}]+|(?:[.,;:?!\"'()\[\]{}]|([#$%&*])\1+)+$")
_ODD = re.compile(r"[0-9@$!|+(€£*#%._\-~^]|(.)\1\1")
_LETTER = re.compile(r"[^\W\d_]")


def _fold_table() -> np.ndarray:
    """Letter numbers of the Latin-1 characters: case and accents are dropped, all but letters are edges."""
    import unicodedata

    out = np.zeros(256, np.int64)
    for c in range(256):
        base = unicodedata.normalize("NFD", chr(c))[0].lower()
        out[c] = ord(base) - 96 if "a" <= base <= "z" else 0
    out[ord("ß")] = 19
    return out


FOLD = _fold_table()


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            texts = batch.slice(lo, 256).column(0).to_pylist()
            codes = FOLD[np.frombuffer("  ".join(["", *(t or "" for t in texts), ""]).encode("latin-1", "replace"), np.uint8)]
            total += np.bincount((codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:], minlength=LETTERS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["trigram", "n"])


def trigram_counts(documents: DataFrame) -> np.ndarray:
    """Letter trigrams of all whole texts: each task counts its own, at most 27**3 rows a task are added up."""
    rows = documents.select(F.col("text").cast("string")).mapInArrow(_count_trigrams, "trigram int, n long")
    out = np.zeros(LETTERS**3)
    for r in rows.groupBy("trigram").agg(F.sum("n").alias("n")).collect():  # at most 27**3
        out[r.trigram] = r.n
    return out.reshape(LETTERS, LETTERS, LETTERS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative log probabilities) of a letter after two others, smoothed by the one before and by all letters."""
    c = counts.copy()
    c[0, 0] = counts[:, 0].sum(axis=0)  # a word begins: whatever stood before its edge
    c[0, 0, 0] = 0
    one = counts.sum(axis=(0, 1)) + 1.0
    one = one / one.sum()
    two = counts.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (c + 5 * two[None]) / (c.sum(axis=2, keepdims=True) + 5)
    return -np.log(three)


class Restorer:
    """Viterbi decoding of a token's lattice under the language model; states are the last two letters."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def _arcs(self, c: str, again: float | None) -> list[tuple[str, float]]:
        """What a character may stand for: letters, a word's edge (' ') or nothing, each with its cost; again: that of dropping a repeated one."""
        low = c.lower()
        if _LETTER.match(c):
            code = int(FOLD[ord(low)]) if ord(low) < 256 else 0
            arcs = [(chr(96 + code) if code else "", 0.0)]
            if again is not None:
                arcs.append(("", again))
            return arcs
        if c in " \t":
            return [("", GAP), (" ", EDGE)]
        arcs = [(x, SIGN) for x in LEET.get(c, "")]
        arcs.append(("", GAP if c in ".-_~^" else NOISE))
        if again is not None:
            arcs.append(("", again))
        return arcs

    def decode(self, token: str) -> str:
        """The likeliest letters that token may disguise; its edges are blanks."""
        costs = self.costs
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        low = token.lower() if len(token.lower()) == len(token) else token
        for i, c in enumerate(token):
            again = None
            if i and low[i] == low[i - 1]:
                again = AGAIN if low[i - 2 : i] == 2 * low[i] or low[i + 1 : i + 2] == low[i] else TWICE
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for emit, cost in self._arcs(c, again):
                code = 0 if emit in ("", " ") else ord(emit) - 96
                for (a, b), (total, path) in states.items():
                    if emit == "":
                        to, t, p = (a, b), total + cost, path
                    elif emit == " ":
                        if not b:
                            continue
                        to, t, p = (0, 0), total + cost + costs[a][b][0], (path, " ")
                    else:
                        to, t, p = (b, code), total + cost + costs[a][b][code], (path, emit)
                    if to not in new or t < new[to][0]:
                        new[to] = (t, p)
            states = new
        best = min(((t + (costs[a][b][0] if b else 0.0), p) for (a, b), (t, p) in states.items()), key=lambda x: x[0])[1]
        out = []
        while best:
            best, x = best
            out.append(x)
        return "".join(reversed(out))


def restored_words(words: list[str], restorer: Restorer, cache: dict[str, tuple[str, ...]]) -> set[str]:
    """The distinct words of a text as they would read undisguised, in lower case.

    Plain words only lose punctuation at their ends. Tokens with signs beside
    letters or a letter three times running, and runs of three or more
    one-character tokens, are decoded; the plain reading stays beside it. A
    letter said just twice, and words cut into parts of two letters or more,
    are not taken for disguise: plain text is full of both.
    """
    out: set[str] = set()
    for w in set(words):
        got = cache.get(w)
        if got is None:
            bare = _ENDS.sub("", w)
            low = bare.lower()
            got = (low,)
            if _ODD.search(bare) and _LETTER.search(bare):
                got = (low, *restorer.decode(bare).split())
            if w[:1] in "$(@!|" or w[-1:] in "!|":
                got = (*got, *restorer.decode(w).split()) if sum(map(str.isalpha, w)) >= 2 and not w.endswith("!!") else got
            if len(cache) > MOST_CACHED:
                cache.clear()
            cache[w] = got
        out.update(got)
    single = [i for i, w in enumerate(words) if len(w) == 1]
    if len(single) >= 3:
        start = 0
        for k in range(1, len(single) + 1):
            if k == len(single) or single[k] != single[k - 1] + 1:
                run = [words[i] for i in single[start:k]]
                if len(run) >= 3 and sum(map(str.isalpha, run)) >= 2:
                    out.update(restorer.decode(" ".join(run)).split())
                start = k
    return out


def stems_of(word: str) -> tuple[str, ...]:
    """A word, and its beginnings of 4 to 7 letters."""
    return (word, *("^" + word[:k] for k in range(4, min(8, len(word)))))


#: A stem is a feature for each of these numbers of a text's distinct words that have it.
TIMES = (1, 2, 4)


def features_of(words: set[str]) -> set[str]:
    stems = Counter(f for w in words for f in stems_of(w))
    return {f"{f}#{n}" for f, m in stems.items() for n in TIMES if m >= n}


def _count_features(costs: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    restorer, cache, counts = Restorer(costs), {}, (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["feature", "n0", "n1"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label].update(features_of(restored_words((text or "").split(), restorer, cache)))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flush()
    yield flush()


@dataclass
class Model:
    costs: np.ndarray
    intercept: float
    weights: dict[str, float]


class Finder:
    """Which of the known features (name: number) a text has."""

    def __init__(self, costs: np.ndarray, known: dict[str, int]):
        self.restorer, self.cache, self.hits = Restorer(costs), {}, {}
        self.stems: dict[str, list[tuple[int, int]]] = {}
        for f, k in known.items():
            stem, _, n = f.rpartition("#")
            self.stems.setdefault(stem, []).append((int(n), k))

    def find(self, text: str | None) -> list[int]:
        met: Counter[str] = Counter()
        hits, stems = self.hits, self.stems
        for w in restored_words((text or "").split(), self.restorer, self.cache):
            at = hits.get(w)
            if at is None:
                if len(hits) > MOST_CACHED:
                    hits.clear()
                at = hits[w] = tuple(f for f in stems_of(w) if f in stems)
            if at:
                met.update(at)
        return sorted(k for f, m in met.items() for n, k in stems[f] if m >= n)


def _vectors(costs: np.ndarray, known: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Finder(costs, known)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([finder.find(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["label", "at"])


def fit(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """The model for documents (doc_id, text) with labels (doc_id, toxic) that may be learned from.

    The language model counts all texts. Features are the words and prefixes
    that labelled toxic texts hold most significantly more often, the
    MOST_FEATURES best of those in LEAST_TEXTS texts or more; a lasso logistic
    fit weighs them. Without labels the score is the smoothed share. Repeated
    rows of a labelled doc_id are learned from as often as they stand.
    """
    costs = language_model(trigram_counts(documents))
    chosen = bounded_sample(agreed_labels(labels, "toxic"), most_labelled)
    seen = cut(documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label"))
    n = {r.label: r["count"] for r in seen.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    y, at, known = np.array([]), [], {}
    if n0 and n1:
        counted = seen.mapInArrow(functools.partial(_count_features, costs), "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        share = n1 / (n0 + n1)
        both = F.col("n0") + F.col("n1")
        z = (F.col("n1") - share * both) / F.sqrt(share * (1 - share) * both)
        best = counted.filter(F.col("n1") >= LEAST_TEXTS).withColumn("z", z).filter("z > 3").orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()
        known = {r.feature: k for k, r in enumerate(best)}
    rows = seen.mapInArrow(functools.partial(_vectors, costs, known), "label int, at array<int>").collect() if known else []  # at most most_labelled
    rows = sorted((r.label, r.at) for r in rows)
    y = np.array([r[0] for r in rows], float) if rows else np.repeat([0.0, 1.0], [n0, n1])
    places = [(i, k) for i, r in enumerate(rows) for k in r[1]]
    i, k = (np.array([p[j] for p in places], int) for j in (0, 1))
    intercept, w = lasso_logistic(i, k, len(known), y, penalty=2e-5, steps=600)
    return Model(costs, intercept, {f: float(w[j]) for f, j in known.items() if w[j]})


def _scores(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Finder(model.costs, {f: k for k, f in enumerate(model.weights)})
    weights = list(model.weights.values())
    for batch in batches:
        out = []
        for lo in range(0, batch.num_rows, 512):
            for text in batch.slice(lo, 512).column(1).to_pylist():
                z = model.intercept + sum(weights[k] for k in finder.find(text))
                out.append(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])


def score(documents: DataFrame, model: Model, at: float = AT) -> DataFrame:
    """doc_id, score and predicted of every row of documents (doc_id, text).

    Null and empty texts hold no words and get the intercept's score. Each row
    is scored by itself: repeated rows alike, null doc_ids like any other, an
    empty table gives none. A score of exactly `at` counts as toxic.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(functools.partial(_scores, model), "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= at).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """Learned from labels outside the held-out fold; a null doc_id is in no fold and has no label."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    model = fit(documents, table(spark, sf_dir, "labels").filter(~held_out))
    return score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
