"""The corpus pipeline, stage by stage as the driver runs it."""

from types import SimpleNamespace

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import _shared


def test_stages_and_their_effects(spark, small, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            assert docs.filter(F.col("n_chars") != F.length("text")).isEmpty()
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0
    kept = spark.read.parquet(str(tmp_path / "3"))
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_stages_of_an_empty_table(spark, small):
    none = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0


def test_stages_keep_columns_of_any_name(spark, small, tmp_path):
    """Columns whose names the operators use, and rows with nulls, pass through all stages but the last."""
    names = ["rule", "kept", "n_words", "n_lines", "drops", "row", "_maybe", "rep", "key", "at", "doc", "seed", "rank", "_text"]
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({n: F.lit(f"mine {n}") for n in names})
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long")})).unionByName(docs.limit(1).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == docs.columns and after.count() > 0
            assert after.filter(" or ".join(f"{n} is null or {n} <> 'mine {n}'" for n in names)).isEmpty()
        docs = after


def test_tables_of_stages_that_are_done_go(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lines = corpus_pipeline._lines(spark, docs, small)
    held = list(corpus_pipeline._spent)
    assert held
    corpus_pipeline._near(spark, lines, small)  # still reads them
    assert any(p in corpus_pipeline._spent for p in held)
    lines.write.parquet(str(tmp_path / "lines"))
    corpus_pipeline._leaks(spark, spark.read.parquet(str(tmp_path / "lines")), small)
    assert not any(p in corpus_pipeline._spent for p in held)
    place, files = _shared._place(spark, held[0])
    assert not files.exists(place)


def test_a_machines_own_folder_is_for_one_process_only():
    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://some:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            _shared.shared_dir(session(master, None))
        assert _shared.shared_dir(session(master, "hdfs://shared/")) == "hdfs://shared"
    assert _shared.shared_dir(session("local[4]", None)).startswith("file:///")
