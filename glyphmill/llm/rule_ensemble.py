"""Quality classifier: tree paths become rules, a lasso logistic fit weighs them, Spark columns apply them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import agreed_labels, bounded_sample, crc_of_id, table
from glyphmill.llm.linear import lasso_logistic
from glyphmill.llm.text_stats import FEATURES, conjunction, with_stats

#: Labelled rows that the ensemble is fitted on at most: those with the smallest md5 of their doc_id.
MOST_LABELLED = 20_000
FOLDS, HELD_OUT, AT = 4, 2, 0.7

Condition = tuple[str, str, float]


@dataclass(frozen=True)
class Ensemble:
    """score = sigmoid(intercept + the weights of the rules that hold)."""

    intercept: float
    rules: list[tuple[float, list[Condition]]]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(conjunction(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(binned: np.ndarray, cuts: list[np.ndarray], r: np.ndarray, h: np.ndarray, depth: int, least: int, features: np.ndarray) -> tuple[list[list[tuple[int, str, int]]], np.ndarray]:
    """Paths to every node of one regression tree on gradients r and curvatures h, and the leaves' steps a row."""
    paths, out = [], np.zeros(len(r))

    def split(at: np.ndarray, path: list[tuple[int, str, int]]) -> None:
        if path:
            paths.append(path)
        total_r, total_h, best = r[at].sum(), h[at].sum(), (1e-6, None)
        if len(path) < depth and len(at) >= 2 * least:
            for j in features:
                n = len(cuts[j]) + 1
                b = binned[at, j]
                rr, hh, nn = (np.bincount(b, weights=w, minlength=n).cumsum()[:-1] for w in (r[at], h[at], None))
                ok = (nn >= least) & (len(at) - nn >= least)
                gain = np.where(ok, rr**2 / (hh + 1) + (total_r - rr) ** 2 / (total_h - hh + 1) - total_r**2 / (total_h + 1), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (j, int(gain.argmax())))
        if best[1] is None:
            out[at] = total_r / (total_h + 1)
            return
        j, k = best[1]
        low = binned[at, j] <= k
        split(at[low], [*path, (j, "<=", k)])
        split(at[~low], [*path, (j, ">", k)])

    split(np.arange(len(r)), [])
    return paths, out


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str] = FEATURES, trees: int = 24, depth: int = 3, least: int = 5, penalty: float = 2e-4, seed: int = 11) -> Ensemble:
    """Boosts shallow trees on half the features each, takes every node's path as a rule, and fits their lasso weights.

    Rows of one label only, or none, give an ensemble without rules whose
    score is the smoothed share of label 1.
    """
    x, y = np.asarray(x, float).reshape(-1, len(names)), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Ensemble(lasso_logistic(np.array([], int), np.array([], int), 0, y, penalty)[0], [])
    cuts = []
    for column in x.T:
        v = np.unique(column) if len(np.unique(column)) <= 64 else np.unique(np.quantile(column, np.linspace(0, 1, 65)))
        cuts.append((v[1:] + v[:-1]) / 2)
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    rng, f, found = np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        features = np.sort(rng.choice(len(names), max(1, (len(names) + 1) // 2), replace=False))
        paths, step = _tree(binned, cuts, y - p, p * (1 - p), depth, least, features)
        f += 0.3 * step
        found |= {tuple(sorted(path)): None for path in paths}
    places = []
    for k, rule in enumerate(found):
        on = np.ones(len(y), bool)
        for j, sign, b in rule:
            on &= (binned[:, j] <= b) if sign == "<=" else (binned[:, j] > b)
        at = np.flatnonzero(on)
        places.append((at, np.full(len(at), k)))
    rows, columns = (np.concatenate([p[i] for p in places]) for i in (0, 1)) if places else (np.array([], int),) * 2
    intercept, weights = lasso_logistic(rows, columns, len(found), y, penalty)
    named = [(float(w), [(names[j], sign, float(cuts[j][b])) for j, sign, b in rule]) for w, rule in zip(weights, found, strict=True) if w]
    return Ensemble(intercept, named)


def fit(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Ensemble:
    """The ensemble for documents (doc_id, text) with labels (doc_id, quality) that may be learned from."""
    chosen = bounded_sample(agreed_labels(labels, "quality"), most_labelled)
    rows = with_stats(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("label", *FEATURES).collect()
    x = np.array([[float(v) for v in r[1:]] for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([float(r[0]) for r in rows])
    order = np.lexsort([*x.T, y])
    return fit_rules(x[order], y[order])


def classify(documents: DataFrame, ensemble: Ensemble, at: float = AT) -> DataFrame:
    """documents with statistics, score and predicted.

    Null and empty texts are scored by their (zero) statistics. Each row is
    scored by itself: repeated rows alike, null doc_ids like any other, an
    empty table gives none. A score of exactly `at` is predicted 1.
    """
    out = with_stats(documents).withColumn("score", ensemble.score())
    return out.withColumn("predicted", (F.col("score") >= at).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """Fitted on labels outside the held-out fold; a null doc_id is in no fold and has no label."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    ensemble = fit(documents, table(spark, sf_dir, "labels").filter(~held_out))
    return classify(documents, ensemble).select("doc_id", held_out.alias("held_out"), "score", "predicted")
