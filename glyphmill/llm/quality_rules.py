"""Quality rules: a decision list learned by sequential covering, applied as one Spark conditional expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import agreed_labels, bounded_sample
from glyphmill.llm.text_stats import FEATURES, conjunction, with_stats

#: Labelled rows that the list is learned from at most: those with the smallest md5 of their doc_id.
MOST_LABELLED = 20_000
MIN_WORDS, MOST_REPEATED = 20, 30

Rule = list[tuple[str, str, float]]


def _covers(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, sign, at in rule:
        out &= (x[:, j] <= at) if sign == "<=" else (x[:, j] > at)
    return out


def _cuts(column: np.ndarray, most: int = 48) -> np.ndarray:
    """Midpoints between neighbouring values, at the quantiles where there are many."""
    v = np.unique(column)
    if len(v) > most + 1:
        v = np.unique(np.quantile(column, np.linspace(0, 1, most + 1)))
    return (v[1:] + v[:-1]) / 2


def _grow(x: np.ndarray, bad: np.ndarray, most_conditions: int) -> list[tuple[int, str, float]]:
    """Adds the condition with the largest FOIL gain until only rejected rows are covered."""
    rule: list[tuple[int, str, float]] = []
    live = np.ones(len(x), bool)
    while len(rule) < most_conditions:
        p, n = bad[live].sum(), (~bad[live]).sum()
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for j in range(x.shape[1]):
            column, is_bad = x[live, j], bad[live]
            cuts = _cuts(column)
            if not len(cuts):
                continue
            side = np.searchsorted(cuts, column, side="left")  # cuts below the value
            hit = np.bincount(side[is_bad], minlength=len(cuts) + 1).cumsum()[:-1]
            miss = np.bincount(side[~is_bad], minlength=len(cuts) + 1).cumsum()[:-1]
            for sign, pp, nn in (("<=", hit, miss), (">", p - hit, n - miss)):
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, sign, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _covers(x, rule[-1:])
    return rule


def _prune(x: np.ndarray, bad: np.ndarray, rule: list[tuple[int, str, float]]) -> tuple[list[tuple[int, str, float]], float, int]:
    """Drops final conditions while the pruning rows' (p - n) / (p + n) doesn't fall; also its precision and cover there."""
    best = (-2.0, rule, 0.0, 0)
    for k in range(1, len(rule) + 1):
        on = _covers(x, rule[:k])
        p, n = int(bad[on].sum()), int((~bad[on]).sum())
        worth = (p - n) / (p + n) if p + n else -2.0
        if worth > best[0]:
            best = (worth, rule[:k], p / (p + n), p)
    return best[1], best[2], best[3]


def learn_list(x: np.ndarray, bad: np.ndarray, names: list[str] = FEATURES, most_rules: int = 16, most_conditions: int = 4, precision: float = 0.9, least_cover: int = 3, seed: int = 7) -> list[Rule]:
    """An ordered list of rejecting rules from statistics x (rows by names) and bad (True: label 0).

    Sequential covering: of the rows no rule covers yet, two thirds grow a
    conjunction, a third prunes it; it joins the list if it is precise on the
    latter. No rows, or rows of one label, give an empty list.
    """
    x, bad = np.asarray(x, float), np.asarray(bad, bool)
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and bad[left].sum() >= 2 * least_cover:
        at = rng.permutation(np.flatnonzero(left))
        pruning, growing = at[: len(at) // 3], at[len(at) // 3 :]
        rule = _grow(x[growing], bad[growing], most_conditions)
        if not rule:
            break
        rule, right, cover = _prune(x[pruning], bad[pruning], rule)
        if right < precision or cover < least_cover:
            break
        rules.append([(names[j], sign, cut) for j, sign, cut in rule])
        left &= ~_covers(x, rule)
    return rules


def fit(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> list[Rule]:
    """The decision list for documents (doc_id, text) with labels (doc_id, quality); it sees only labelled texts' statistics."""
    chosen = bounded_sample(agreed_labels(labels, "quality"), most_labelled)  # at most most_labelled rows of two numbers
    rows = with_stats(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("label", *FEATURES).collect()
    x = np.array([[float(v) for v in r[1:]] for r in rows]).reshape(len(rows), len(FEATURES))
    bad = np.array([r[0] == 0 for r in rows], bool)
    order = np.lexsort([*x.T, bad])
    return learn_list(x[order], bad[order])


def rule_number(rules: list[Rule]) -> Column:
    """The place (from 1) of the first rule that holds, else 0: one ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(conjunction(rule), k) if out is None else out.when(conjunction(rule), k)
    return (F.lit(0) if out is None else out.otherwise(0)).cast("int")


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """documents with their statistics, base_failed, rule (0: none holds) and kept.

    A null or empty text has no words and so fails the base test. Repeated
    rows are judged alike; every row is returned, whatever its doc_id.
    """
    out = with_stats(documents)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("rule", rule_number(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def as_text(rules: list[Rule]) -> str:
    """The list for people to read."""
    return "\n".join([*(f"reject if {' and '.join(f'{n} {s} {v:.6g}' for n, s, v in r)}" for r in rules), "else keep"])


def query(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._shared import table

    documents = table(spark, sf_dir, "documents")
    rules = fit(documents, table(spark, sf_dir, "labels"))
    return judge(documents.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
