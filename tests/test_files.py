"""Sources, sinks and the stream of new files, over temporary folders."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import tokens
from glyphmill.sources import files, sinks
from glyphmill.streaming import ingest


def test_texts_of_a_charset(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/1.txt").write_bytes("Суд\r\nрешил\r".encode("cp1251"))
    (tmp_path / "a/b/2.txt").write_bytes("Ёлка".encode("cp1251"))
    (tmp_path / "a/skip.csv").write_bytes(b"x")
    rows = files.texts(spark, str(tmp_path), suffix=".txt").orderBy("path").collect()
    assert [r.text for r in rows] == ["Суд\nрешил\n", "Ёлка"]


def test_lines_keep_their_ends(spark):
    df = spark.createDataFrame([("a\n\nb",), ("a\n",), ("",)], "t string")
    assert [r.v for r in df.select(files.lines(F.col("t")).alias("v")).collect()] == [["a\n", "\n", "b"], ["a\n"], []]


def test_held_out_names(spark):
    df = spark.createDataFrame([("x/cv901.txt",), ("cv9/cv101.txt",), ("cv9",)], "n string")
    assert [r.v for r in df.select(files.held_out(F.col("n")).alias("v")).collect()] == [True, False, True]


def test_store(spark, tmp_path):
    store = files.Store(spark, str(tmp_path))
    store.put("tags", spark.createDataFrame([("b",), ("a",)], "tag string"))
    store.put("marked_acts", spark.createDataFrame([("k", "t")], "act_key string, text string"))
    assert [r.tag for r in store.extract("tags").collect()] == ["a", "b"]
    assert [r.text for r in store.extract("marked_acts").collect()] == ["t"]
    assert store.describe("tags") == [("tag", "string")]
    assert store.extract("acts_keys") == 0
    assert [r.key for r in store.keys().collect()] == ["marked_acts", "tags"]
    assert [r.key for r in store.keys("tags").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        store.extract("other")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x|y", "q #h"), ("", "plain")], "a string, b string")
    sinks.write_csv(df, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*")))
    assert "#x|y#|#q ##h#" in text
    assert sorted((r.a or "", r.b) for r in sinks.read_csv(spark, str(tmp_path / "c"), "a string, b string").collect()) == [("", "plain"), ("x|y", "q #h")]


def test_report_with_a_banner(spark, tmp_path):
    df = spark.createDataFrame([("суд", 0.5)], "court string, cosine double")
    assert sinks.write_report(df, str(tmp_path / "r.csv"), banner="вопрос") == 1
    assert (tmp_path / "r.csv").read_bytes().decode("cp1251") == "вопрос|na\r\ncourt|cosine\r\nсуд|0.5\r\n"
    assert sinks.write_report(df.limit(0), str(tmp_path / "e.csv")) == 0


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b",), (None,)], "t string")
    for _ in range(2):
        sinks.append_text(df, "t", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    sinks.save_list(df, "t", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 1
    assert sinks.save_table(df, str(tmp_path / "p")).count() == 2
    sinks.table_to_text(spark, str(tmp_path / "p"), "t", str(tmp_path / "q"))
    assert spark.read.text(str(tmp_path / "q")).count() == 1
    with pytest.raises(ValueError):
        sinks.table_to_text(spark, str(tmp_path / "p"), "t", str(tmp_path / "p"))


def test_tables_have_a_name_for_each_column(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "token string, cnt long")
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "t"), ("one",))
    sinks.write_table(df.limit(0), str(tmp_path / "t"), ("one", "two"))
    sinks.export_counts(df, str(tmp_path / "v"), sinks.GRAMS_HEADER)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part*"))).splitlines()
    assert lines == ["|".join(sinks.GRAMS_HEADER), "c|5", "a|2", "b|2"]


def test_recode(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_bytes("Ёлка".encode("koi8_r"))
    sinks.recode(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert bytes(spark.read.parquet(str(tmp_path / "out")).first().content).decode("cp1251") == "Ёлка"


def test_slug_and_stages():
    assert sinks.slug("Взыскать долг. Да/нет") == "Взыскать_долг._Да_нет"
    assert sinks.stage_paths("/x", ["a"]) == {"a": "/x/a"}
    assert sinks.act_folders("/x", ["a/b.c.txt", "d"]) == ["/x/b.c", "/x/d"]
    assert sinks.numbered_paths("/x", 2) == ["/x/0.txt", "/x/1.txt"]


def test_stage_folders_leave_out_the_root(tmp_path):
    made = sinks.make_stage_folders(sinks.stage_paths(str(tmp_path), [sinks.ROOT_STAGE, "b", "a"]), "acts")
    assert made == [str(tmp_path / "a/acts"), str(tmp_path / "b/acts")] and not (tmp_path / sinks.ROOT_STAGE).exists()


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.txt").write_text(f"word w{k} word")
    rows = ingest.new_texts(spark, str(tmp_path / "in"))
    words = rows.select(F.explode(tokens.word_tokens(F.col("text"))).alias("token"))
    for _ in range(2):  # the second run finds nothing new
        ingest.append(words, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    counts = {r.token: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("token").count().collect()}
    assert counts == {"word": 6, "w0": 1, "w1": 1, "w2": 1}


def test_counts_by_time_are_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = ingest.word_counts_by_time(ingest.new_texts(spark, str(tmp_path / "in")), tokens.word_tokens(F.col("text")))
    assert out.isStreaming and out.columns == ["window", "token", "cnt"]
