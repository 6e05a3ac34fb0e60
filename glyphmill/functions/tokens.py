"""Tokenizers and cleaners. Each takes and returns a column; token lists keep order and repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import patterns as P
from glyphmill.functions.segments import parts_of

Tokens = Column


def newlines(text: Column) -> Column:
    """\\r\\n and \\r become \\n, as files opened as text have it."""
    return F.regexp_replace(text, "\r\n?", "\n")


def latin_tokens(text: Column) -> Tokens:
    """Runs of a-z of the lower-cased text; an accent splits a word."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def word_tokens(text: Column, longer_than: int = 1) -> Tokens:
    """Lower-cased, split at all but letters, digits and `_`, tokens of more than longer_than characters."""
    return F.filter(F.split(F.lower(text), P.NOT_WORD), lambda x: F.length(x) > longer_than)


def without(tokens: Tokens, stops: Sequence[str] | Column) -> Tokens:
    """Tokens that aren't stop words, repeats kept."""
    if isinstance(stops, Column):
        return F.filter(tokens, lambda x: ~F.array_contains(stops, x))
    return F.filter(tokens, lambda x: ~x.isin(list(stops))) if stops else tokens


def only(tokens: Tokens, words: Sequence[str]) -> Tokens:
    """Tokens that are among words, repeats kept."""
    return F.filter(tokens, lambda x: x.isin(list(words))) if words else F.filter(tokens, lambda x: F.lit(False))


def word_tokens_without(text: Column, stops: Sequence[str]) -> Tokens:
    """T03."""
    return without(word_tokens(text), stops)


def russian_tokens(text: Column, stops: Sequence[str] | None = None) -> Tokens:
    """Russian words of the lower-cased text, with up to four hyphens; given stops, these and one-letter tokens go."""
    found = F.regexp_extract_all(F.lower(text), F.lit(P.RU_WORD), F.lit(0))
    return found if stops is None else F.filter(without(found, stops), lambda x: F.length(x) > 1)


def stripped_tokens(text: Column, stops: Sequence[str] | None = None) -> Tokens:
    """Lower-cased, split at white space, punctuation deleted; tokens left empty stay unless stops are given."""
    found = F.transform(blank_split(F.lower(text)), lambda x: punctuation_deleted(x))
    return found if stops is None else F.filter(without(found, stops), lambda x: F.length(x) > 1)


def blank_split(text: Column) -> Tokens:
    """Split at runs of Unicode white space, no empty tokens."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def punctuation_deleted(text: Column, signs: str | None = None) -> Column:
    """Without ASCII punctuation, or without the given signs."""
    return F.regexp_replace(text, P.PUNCTUATION, "") if signs is None else F.translate(text, signs, "")


def clean_tokens(text: Column, stops: Sequence[str]) -> Tokens:
    """Split at white space, punctuation deleted; words of letters alone, no stops, two letters or more. Case stays."""
    bare = F.transform(blank_split(text), lambda x: punctuation_deleted(x))
    return F.filter(without(F.filter(bare, lambda x: x.rlike(r"^\p{L}+$")), stops), lambda x: F.length(x) > 1)


def short_stops(stops: Sequence[str]) -> list[str]:
    """Stop words of at most three letters, without the negation."""
    return [w for w in stops if len(w) <= 3 and w != "нет"]


def russian_only(text: Column) -> Column:
    """Russian words joined by blanks; digits and Latin letters vanish."""
    return F.array_join(F.regexp_extract_all(text, F.lit(P.RU_WORD), F.lit(0)), " ")


def stops_removed(text: Column, stops: Sequence[str], lowered: bool = True) -> Column:
    """Split at single blanks, stops dropped, joined again; nothing happens to a text that wasn't lower-cased first."""
    return F.array_join(without(F.split(text, " "), stops), " ") if lowered else text


def cleaned(text: Column, stops: Sequence[str]) -> Column:
    """T13, T14 and T15 in turn, on one part of a text."""
    return stops_removed(F.lower(russian_only(text)), stops)


def cleaned_parts(text: Column, stops: Sequence[str], unit: str = "paragraph") -> Column:
    """The cleaned parts of a text, by paragraph, sentence or as one document."""
    return F.transform(parts_of(text, unit), lambda p: cleaned(p, stops))


def stops_removed_parts(text: Column, stops: Sequence[str], unit: str = "paragraph") -> Column:
    """The lower-cased parts of a text without stop words."""
    return F.transform(parts_of(text, unit), lambda p: stops_removed(F.lower(p), stops))


def line_of(tokens: Tokens, vocabulary: Sequence[str]) -> Column:
    """The tokens that are in a small vocabulary, joined by blanks."""
    return F.array_join(only(tokens, vocabulary), " ")


def times_286(x: Column) -> Column:
    """T23."""
    return x * 286


def stamped(name: str, prefix: object = "", when=None) -> str:
    """Prefix or, without one, the date, then `_` and the name."""
    from datetime import date

    return f"{prefix or when or date.today()}_{name}"


def with_verdict(text: Column, probability: Column, tag: str, at: float = 0.85) -> Column:
    """Below the threshold the text alone, else three blanks, the probability and the tag behind it."""
    return F.when(probability < at, text).otherwise(F.concat(text, F.lit("   "), probability.cast("string"), F.lit("# " + tag)))
