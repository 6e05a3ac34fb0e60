"""Lemmas by dictionary: distinct words are analysed once, tokens are joined to them."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.segments import parts_of
from glyphmill.functions.tokens import word_tokens, word_tokens_without


def lemma_dictionary(words: DataFrame, analyser: Callable[[str], str | None] | Column) -> DataFrame:
    """(token, lemma) of the distinct tokens of words.

    The analyser is a column expression over `token`, or a function of a word,
    which then runs once a distinct word in Arrow batches; null where it has
    no answer. None is built in; another analyser is another argument.
    """
    distinct = words.select("token").distinct()
    if isinstance(analyser, Column):
        return distinct.select("token", analyser.alias("lemma"))

    @F.pandas_udf("string")
    def analysed(w: pd.Series) -> pd.Series:
        return w.map(analyser)

    return distinct.select("token", analysed("token").alias("lemma"))


def lemmatized(tokens: DataFrame, lemmas: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Tokens replaced by their lemmas, unknown ones dropped (inner join); L02: unknown ones kept as they are (left join)."""
    others = [c for c in tokens.columns if c != "token"]
    if keep_unknown:
        return tokens.join(lemmas, "token", "left").select(*others, F.coalesce("lemma", "token").alias("token"))
    return tokens.join(lemmas, "token").select(*others, F.col("lemma").alias("token"))


#: Entries of a dictionary that is sent along with an expression; a larger one is joined.
MOST_LEMMAS = 20_000


def lookup(lemmas: DataFrame) -> Callable[[Column], Column] | None:
    """What puts lemmas in place of a list's tokens, unknown ones kept, without a join; None if the dictionary is too large or has two lemmas of a word.

    The dictionary is a constant: entries lie in buckets by the hash of their
    token, a few in each, so a token costs the same however many there are.
    """
    rows = lemmas.filter("token is not null").select("token", "lemma", F.hash("token").alias("h")).limit(MOST_LEMMAS + 1).collect()
    if len(rows) > MOST_LEMMAS or len({r.token for r in rows}) < len(rows):
        return None
    n = max(1, len(rows) // 2)
    buckets: list[dict[str, str]] = [{} for _ in range(n)]
    for r in rows:
        buckets[r.h % n][r.token] = r.lemma
    known = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    return lambda tokens: F.transform(tokens, lambda x: F.coalesce(F.element_at(F.get(known, F.pmod(F.hash(x), F.lit(n))), x), x))


def regathered(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tokens): token lists in the order of tok_pos."""
    gathered = F.array_sort(F.collect_list(F.struct("tok_pos", "token")))
    return tokens.groupBy(*keys).agg(F.transform(gathered, lambda x: x.getField("token")).alias("tokens"))


def inflected(tokens: DataFrame, forms: DataFrame, missing: str = "error") -> DataFrame:
    """Tokens put into the form that forms (token, lemma) has for them, here the nominative singular.

    A token without one is an error; or it is kept, or dropped, as `missing` says.
    """
    if missing not in ("error", "keep", "drop"):
        raise ValueError("missing is 'error', 'keep' or 'drop'")
    if missing != "error":
        return lemmatized(tokens, forms, missing == "keep")
    others = [c for c in tokens.columns if c != "token"]
    lost = F.raise_error(F.concat(F.lit("no form of the word "), "token"))
    return tokens.join(forms, "token", "left").select(*others, F.coalesce("lemma", lost).alias("token"))


def normalized(df: DataFrame, key: str, text: str, lemmas: DataFrame, unit: str = "paragraph") -> DataFrame:
    """(key, part from 1, text): each word between single blanks is replaced by its lemma, unknown ones stay.

    A part is a paragraph (empty ones too) or, by unit, the whole document.
    """
    rows = df.select(key, F.posexplode(parts_of(F.col(text), unit)).alias("_p", "_part"))
    if known := lookup(lemmas):
        return rows.select(key, (F.col("_p") + 1).alias("part"), F.array_join(known(F.split("_part", " ")), " ").alias("text"))
    words = rows.select(key, (F.col("_p") + 1).alias("part"), F.posexplode(F.split("_part", " ")).alias("tok_pos", "token"))
    return regathered(lemmatized(words, lemmas, True), [key, "part"]).select(key, "part", F.array_join("tokens", " ").alias("text"))


def full_process(df: DataFrame, key: str, text: str, lemmas: DataFrame, stops: Sequence[str] | None = None) -> DataFrame:
    """(key, par_pos from 1, tokens): each paragraph's words (T02, or T03 with stops) as lemmas, unknown ones as they are.

    Paragraphs without words have an empty list.
    """
    of = lambda p: word_tokens_without(p, stops) if stops else word_tokens(p)
    pars = df.select(key, F.posexplode(parts_of(F.col(text), "paragraph")).alias("_p", "par")).select(key, (F.col("_p") + 1).alias("par_pos"), "par")
    if known := lookup(lemmas):
        return pars.select(key, "par_pos", F.coalesce(known(of(F.col("par"))), F.array().cast("array<string>")).alias("tokens"))
    words = pars.select(key, "par_pos", F.posexplode(of(F.col("par"))).alias("tok_pos", "token"))
    found = regathered(lemmatized(words, lemmas, True), [key, "par_pos"])
    return pars.select(key, "par_pos").join(found, [key, "par_pos"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def zipped(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that belong together by position are joined on it."""
    return left.join(right, keys)
