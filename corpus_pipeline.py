"""A training corpus from `documents`: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from glyphmill.llm._shared import cut, free_paths, scope, table

#: Rules are learned and texts tokenized on the way, which SQL can't state.
ORACLE_SQL = None

#: Tables cut by stages that are done. Each stage deletes those of the stages before it, once its own docs no longer read them.
_spent: list[str] = []


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or that a learned rule rejects go; a null or empty text fails it.

    Columns of docs pass through whatever their names.
    """
    free_paths(spark, _spent, docs)
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), docs["text"].cast("string").alias("text"))
    # The row number keeps the filter above the statistics: pushed below them it would compute each anew for every use.
    judged = quality_rules.judge(packed, rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.filter("kept and _row >= 0").select("doc.*")


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share go from all but the largest doc_id; n_chars follows the text.

    Rows without doc_id or text, and columns of any name, come back as they are.
    """
    free_paths(spark, _spent, docs)
    with scope(_spent):
        return line_dedup.rewrite(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays; documents without doc_id or words are in no group.

    Repeated rows of a doc_id that stays all stay. Columns of any name pass through.
    """
    free_paths(spark, _spent, docs)
    with scope(_spent):
        groups = near_dedup.near_duplicates(docs, near_dedup.STAGE)
        gone = cut(groups.filter(~F.col("kept")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; those without doc_id or words stay. Columns of any name pass through."""
    free_paths(spark, _spent, docs)
    with scope(_spent):
        return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; a null text is an empty one, a null doc_id is carried along."""
    free_paths(spark, _spent, docs)
    with scope(_spent):
        return packing.pack(packing.tokenized_pieces(docs, packing.tokenizer_path()))


STAGES = [("quality rules", _quality), ("line dedup", _lines), ("near dedup", _near), ("decontamination", _leaks), ("packing", _packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = cut(out) if k + 1 < len(STAGES) else out
    return docs
