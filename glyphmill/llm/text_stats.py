"""Statistics of a text as native column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import BLANK_RUN, let, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

#: Ratios and counts that rules may set thresholds on.
FEATURES = ["n_words", "mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio", "echo_ratio", "digit_ratio", "words_a_line"]


def repeated_words(tokens: Column) -> Column:
    """Words that lie in WINDOW-word windows found twice or more in the text, the first occurrence included.

    Windows are told apart by a 64-bit hash of their words. Where all differ
    (nearly every text) only the hashes are made; else they are sorted with
    their positions, and the positions of equal neighbours are laid out again:
    a window covers WINDOW words, or as many as lie before the next one.
    """
    n_windows = F.size(tokens) - F.lit(WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), n_windows), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(WINDOW))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def twice(s: Column) -> Column:
            same = lambda x, i: (F.get(s, i - 1).getField("h") == x.getField("h")) | (F.get(s, i + 1).getField("h") == x.getField("h"))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x.getField("at")))

        def cover(at: Column) -> Column:
            spans = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(ordered, lambda s: let(twice(s), cover))

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n_windows >= 2, found).otherwise(F.lit(0).cast("long"))


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of each text (null counts as empty) and the ratios of FEATURES; `text` itself stays.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are as the
    quality rules define them. Ratios of an empty text are 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_text", t).withColumn("_words", words(F.col("_text")))
    tokens = F.col("_words")
    with_word = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.length(F.regexp_replace(x, BLANK_RUN, "")) > 0)
    df = df.withColumns(
        {
            "_lines": with_word,
            "n_words": F.size(tokens).cast("long"),
            "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "n_upper": F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long"),
            "n_bangs": F.regexp_count("_text", F.lit("!")).cast("long"),
            "n_digits": F.regexp_count("_text", F.lit("[0-9]")).cast("long"),
            "n_echoes": F.size(F.filter(tokens, lambda x, i: x == F.get(tokens, i - 1))).cast("long"),
            "n_repeat_words": repeated_words(tokens),
        }
    )
    lines = F.col("_lines")
    df = df.withColumns({"n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")}).drop("_lines", "_words", "_text")
    a_word, a_char, a_line = (1.0 / F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    ratios = {"mean_word_chars": F.col("word_chars") * a_word, "symbol_ratio": F.col("n_symbols") * a_word, "dup_line_ratio": F.col("n_dup_lines") * a_line, "repeat_ratio": F.col("n_repeat_words") * a_word, "upper_ratio": F.col("n_upper") * a_char, "bang_ratio": F.col("n_bangs") * a_word, "echo_ratio": F.col("n_echoes") * a_word, "digit_ratio": F.col("n_digits") * a_char, "words_a_line": F.col("n_words") * a_line}
    return df.withColumns(ratios)


def conjunction(conditions: list[tuple[str, str, float]]) -> Column:
    """The column expression of (feature, '<=' or '>', threshold) conditions that all hold."""
    out = F.lit(True)
    for name, sign, at in conditions:
        out = out & ((F.col(name) <= F.lit(float(at))) if sign == "<=" else (F.col(name) > F.lit(float(at))))
    return out
