import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import models
from glyphmill.plans import queries
from glyphmill.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(name, spark, small, duck, check):
    check(QUERIES[name](spark, small), duck, SQL[name])


#: Operators of the survey, by section. Some are parts of a query of another number, some functions that tests alone call.
SURVEY = {"S": 15, "G": 14, "T": 25, "A": 11, "N": 9, "J": 7, "L": 3, "V": 11, "C": 7, "F": 7, "U": 2, "M": 10, "K": 13, "P": 2}
WITHIN = {
    "S02": "S01", "S05": "S01", "S06": "S01", "G14": "G05", "T24": "test_text", "A07": "C04", "J04": "C04", "J07": "M06", "L03": "J06", "V02": "A04", "V04": "C04",
    "C01": "C02", "C07": "C04", "M01": "M08", "M02": "M08", "M03": "M08", "M07": "M08", "K08": "K05", "K09": "K05", "K12": "K07", "K13": "test_files", "P02": "A08",
}
#: Queries whose results come from training and have no SQL.
TRAINED = {"M06_predicted_paragraphs", "M08_mode_accuracy", "M09_topics", "M10_sections_to_verdicts"}


def test_every_operator_of_the_survey_has_a_query():
    named = {n[:3] for n in QUERIES}
    wanted = {f"{s}{k:02d}" for s, n in SURVEY.items() for k in range(1, n + 1)}
    assert wanted - named == set(WITHIN) and named <= wanted
    assert all(w in named for w in WITHIN.values() if not w.startswith("test_"))
    assert set(QUERIES) - set(SQL) == TRAINED


def test_topics_name_words(spark, small):
    rows = QUERIES["M09_topics"](spark, small).collect()
    assert {r.topic for r in rows} == set(range(5))
    assert all(r.word and r.weight > 0 for r in rows)


def test_entry_module_lists_every_query():
    import __spark_entry__ as registered

    assert set(QUERIES) <= set(registered.queries())
    assert set(SQL) <= set(registered.oracle_sql()) <= set(registered.queries())


def test_modes_are_judged_five_times_on_all_repeated_words(spark, small, monkeypatch):
    sizes, train = set(), models.train
    monkeypatch.setattr(models, "train", lambda rows, **k: sizes.add(rows.select("features").first()[0].size) or train(rows, hidden=2, **(k | {"epochs": 1})))
    got = {(r.mode, r.repeat) for r in QUERIES["M08_mode_accuracy"](spark, small).collect()}
    docs, rows = queries._quality_rows(spark, small)
    repeated = rows.join(docs.filter("not test").select("doc_id"), "doc_id", "left_semi").groupBy("token").count().filter("count > 1").count()
    assert got == {(m, r) for m in models.MODES for r in range(1, 6)} and sizes == {repeated + 1}


def test_topics_use_every_text_in_every_round(spark, small, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.models, "topics", lambda docs, *_: seen.append(docs.count()))
    QUERIES["M09_topics"](spark, small)
    assert seen == [spark.read.parquet(f"{small}/documents.parquet").count()]


def test_two_kinds_of_text_make_two_topics(spark):
    texts = [" ".join(f"{'ab'[k % 2]}{(k + 7 * j) % 12}" for j in range(30)) for k in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {}
    for r in models.topics(docs, F.split("text", " "), k=2, words=6, rounds=40).collect():
        found.setdefault(r.topic, set()).add(r.word[0])
    assert sorted(found.values(), key=min) == [{"a"}, {"b"}]


def test_every_paragraph_of_the_documents_is_judged(spark, small, monkeypatch):
    sizes, train = [], models.train
    monkeypatch.setattr(models, "train", lambda rows: sizes.append(rows.select("features").first()[0].size) or train(rows, hidden=2, epochs=1))
    got = QUERIES["M06_predicted_paragraphs"](spark, small)
    pars = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("par")).filter("par <> ''")
    assert {(r.doc_id, r.n) for r in got.groupBy("doc_id").agg(F.count("par").alias("n")).collect()} == {(r.doc_id, r["count"]) for r in pars.groupBy("doc_id").count().collect()}
    rows = queries._quality_rows(spark, small)[1]
    assert sizes == [rows.groupBy("token").count().filter("count > 1").count() + 1]


def test_distances_of_all_paragraphs_are_rounded_once(spark, tmp_path, check):
    """1 - 11 / sqrt(31 * 51) = 0.72335249984...: nine places make it 0.7233525 and six then 0.723353. 1 - 614 / 1280 = 0.5203125 is a tie, its double below it."""
    text = lambda **n: " ".join(" ".join([w * 2] * k) for w, k in n.items())
    items = [(1, text(a=4, b=3, c=2, d=1)), (2, text(e=100, f=100, g=5, h=2, i=1, j=213, k=10, l=6))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, text(b=1, d=7) + "\n" + text(e=3, f=3, g=2, h=1, i=1))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = QUERIES["C03_all_paragraphs"](spark, str(tmp_path))
    assert {(r.item_id, r.par_pos): r.cosine for r in got.collect()}.items() >= {((1, 1), 0.723352), ((2, 2), 0.520312)}
    check(got, con, SQL["C03_all_paragraphs"])
