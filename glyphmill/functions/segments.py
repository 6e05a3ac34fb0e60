"""Segmentation of texts into acts, paragraphs, sentences and marked sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import patterns as P


def boilerplate_removed(text: Column) -> Column:
    """The supplier's notes between rules, then its two header lines."""
    return F.regexp_replace(F.regexp_replace(text, P.NOTE, ""), P.HEADER, "")


def split_acts(text: Column, by: str = "rule") -> Column:
    """Acts of a file, split at the rule between them or at the supplier's line; empty pieces stay."""
    return F.split(text, P.BETWEEN_ACTS if by == "rule" else P.PROVIDED)


def split_paragraphs(text: Column, keep_empty: bool = False) -> Column:
    """G03 (empty ones dropped, blank ones kept) and G04."""
    parts = F.split(text, "\n")
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def paragraphs(df: DataFrame, key: str, text: str, keep_empty: bool = False) -> DataFrame:
    """(key, par_pos from 1, par): a row for each paragraph."""
    rows = df.select(key, F.posexplode(split_paragraphs(F.col(text), keep_empty)).alias("_p", "par"))
    return rows.select(key, (F.col("_p") + 1).cast("int").alias("par_pos"), "par")


def sentences(text: Column) -> Column:
    """Split behind a full stop that ends a word and stands before a capital. No trained model is used."""
    return F.split(text, P.SENTENCE_END)


def parts_of(text: Column, unit: str) -> Column:
    """A text's paragraphs (empty ones too) or sentences, or the whole document as one part."""
    if unit == "paragraph":
        return split_paragraphs(text, True)
    if unit == "sentence":
        return sentences(text)
    if unit == "document":
        return F.array(text)
    raise ValueError("unit is 'paragraph', 'sentence' or 'document'")


def between(text: Column, start: str, stop: str, inclusive: bool = False) -> Column:
    """From the first start to the last stop (regular expressions), over line ends; null where there is none."""
    found = F.regexp_extract(text, rf"(?s)(?={start}).+(?<={stop})" if inclusive else rf"(?s)(?<={start}).+(?={stop})", 0)
    return F.nullif(found, F.lit(""))


def tagged_part(text: Column, tag: str, strict: bool = False) -> Column:
    """What stands between tag and /tag; null, or an error if strict, where there is none."""
    part = between(text, tag, "/" + tag)
    return F.coalesce(part, F.raise_error(F.lit(f"no part is marked {tag}"))) if strict else part


def tagged_part_lower(text: Column, tag: str) -> Column:
    """G08."""
    return F.lower(tagged_part(text, tag))


def result_lines(text: Column) -> Column:
    """The lines that name the law they rest on, if a line end follows.

    Each line is looked at by itself: one pattern for the line and the mark in
    it would begin anew at every character of a long line without the mark.
    """
    parts = F.split(text, "\n")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda line: line.rlike(P.RESULT_MARK))


def all_of(text: Column, pattern: str) -> Column:
    """Every match of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
