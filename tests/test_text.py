"""Literal cases of tokenizers, segmentation, n-grams and vectors."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from glyphmill.functions import patterns as P
from glyphmill.functions import segments, tokens
from glyphmill.operators import lemmas, models, nets, ngrams, search, vectors, vocabulary

DASHES = "-" * 66


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, column, want",
    [
        ("Best movie ever! It's a café_2.", tokens.latin_tokens, "best movie ever it s a caf".split()),
        ("Суд_1 решил: взыскать 15 руб. с ООО «Ёлка-2», а не я", tokens.word_tokens, "суд_1 решил взыскать 15 руб ооо ёлка не".split()),
        ("The movie, it is GREAT; don't miss part 2! a-b x", lambda c: tokens.clean_tokens(c, ["the", "it", "is", "a", "don't"]), "The movie GREAT dont miss part ab".split()),
        ("Социально-экономический довод № 5, iPhone, слово- и Ёлка", tokens.russian_only, "Социально-экономический довод слово- и Ёлка"),
        ("a b c  d", tokens.blank_split, ["a", "b", "c", "d"]),
        ("", tokens.word_tokens, []),
        (" \t", tokens.word_tokens, []),
        ("в, б!", lambda c: tokens.stripped_tokens(c), ["в", "б"]),
        ("- a", lambda c: tokens.stripped_tokens(c), ["", "a"]),
        ("The the", lambda c: tokens.stops_removed(c, ["the"]), "The"),
        ("The the", lambda c: tokens.stops_removed(c, ["the"], lowered=False), "The the"),
        ("a\r\nb\rc", tokens.newlines, "a\nb\nc"),
        (f"КонсультантПлюс: x\nдата\nТело\n{DASHES}\nКонсультантПлюс: note\nмного\n{DASHES}\nКонец\n", segments.boilerplate_removed, "Тело\nКонец\n"),
        (f"акт1\n\n\n{DASHES}\n\n\nакт2\n\n\n{DASHES}\n\n\n", segments.split_acts, ["акт1", "акт2", ""]),
        ("a\n\n b\n", segments.split_paragraphs, ["a", " b"]),
        ("a\n\n b\n", lambda c: segments.split_paragraphs(c, True), ["a", "", " b", ""]),
        ("z/02_DEM", lambda c: segments.between(c, "02_DEM", "/02_DEM", True), "02_DEM"),
        ("<02_DEM>one</02_DEM> mid <02_DEM>two</02_DEM>", lambda c: segments.tagged_part(c, "02_DEM"), ">one</02_DEM> mid <02_DEM>two<"),
        ("nothing", lambda c: segments.tagged_part(c, "02_DEM"), None),
        ("x\nУстановил:\n\nистец требует\nконец", lambda c: segments.all_of(c, P.CLAIM), ["истец требует"]),
        ("ёлка----ель слово-", lambda c: segments.all_of(c, P.RU_WORD), ["ёлка----ель", "слово-"]),
        ("Дело (да). Суд решил. итог", segments.sentences, ["Дело (да)", "Суд решил. итог"]),
        ("a1 b1 c1", lambda c: ngrams.ngrams(F.split(c, " ")), ["a1 b1", "b1 c1"]),
        ("a1", lambda c: ngrams.ngrams(F.split(c, " ")), []),
        ("a b c d e f g", lambda c: ngrams.tiles(F.split(c, " "), 2), ["f g", "d e", "b c"]),
        ("a b c d e f g", lambda c: ngrams.tiles(F.split(c, " "), 3), ["e f g", "b c d"]),
        ("aa bb aa bb cc", lambda c: ngrams.repeated_ngrams(ngrams.ngrams(F.split(c, " "))), ["aa bb"]),
        (None, tokens.word_tokens, None),
    ],
)
def test_literal_case(spark, text, column, want):
    assert one(spark, text, column) == want


def test_strict_part_raises(spark):
    with pytest.raises(Exception, match="no part is marked"):
        one(spark, "nothing", lambda c: segments.tagged_part(c, "02_DEM", strict=True))


def test_short_stops_keep_the_negation():
    assert tokens.short_stops(["и", "нет", "или", "если"]) == ["и", "или"]


def test_name_is_stamped():
    assert tokens.stamped("x", "p") == "p_x" and tokens.stamped("x", when="2020-01-02") == "2020-01-02_x"


def test_lemmas_drop_or_keep_unknown_words(spark):
    rows = vocabulary.exploded(spark.createDataFrame([(1, "судом xyz дела дела")], "k int, t string"), ["k"], F.split("t", " "))
    known = spark.createDataFrame([("дела", "дело"), ("судом", "суд")], "token string, lemma string")
    assert lemmas.regathered(lemmas.lemmatized(rows, known), ["k"]).first().tokens == ["суд", "дело", "дело"]
    assert lemmas.regathered(lemmas.lemmatized(rows, known, True), ["k"]).first().tokens == ["суд", "xyz", "дело", "дело"]


def test_forms_and_missing_ones(spark):
    rows = spark.createDataFrame([(1, 0, "дела"), (1, 1, "xyz")], "k int, tok_pos int, token string")
    forms = spark.createDataFrame([("дела", "дело")], "token string, lemma string")
    assert [r.token for r in lemmas.inflected(rows, forms, "keep").orderBy("tok_pos").collect()] == ["дело", "xyz"]
    assert [r.token for r in lemmas.inflected(rows, forms, "drop").collect()] == ["дело"]
    with pytest.raises(Exception, match="no form of the word xyz"):
        lemmas.inflected(rows, forms).collect()


def test_parts_are_normalized_and_processed(spark):
    df = spark.createDataFrame([(1, "дела суда\n\nдела"), (2, None), (3, "")], "k int, t string")
    forms = spark.createDataFrame([("дела", "дело")], "token string, lemma string")
    rows = lambda unit: sorted((r.k, r.part, r.text) for r in lemmas.normalized(df, "k", "t", forms, unit).collect())
    assert rows("paragraph") == [(1, 1, "дело суда"), (1, 2, ""), (1, 3, "дело"), (3, 1, "")]
    assert rows("document") == [(1, 1, "дело суда\n\nдела"), (3, 1, "")]
    got = sorted((r.k, r.par_pos, r.tokens) for r in lemmas.full_process(df, "k", "t", forms, ["суда"]).collect())
    assert got == [(1, 1, ["дело"]), (1, 2, []), (1, 3, ["дело"]), (3, 1, [])]
    with pytest.raises(ValueError):
        segments.parts_of(F.col("t"), "word")


def test_vocabulary_of_a_line_is_chosen_one_way(spark):
    rows = spark.createDataFrame([(1, k, w) for k, w in enumerate("b a b c a b".split())], "k int, tok_pos int, token string")
    assert {r.token for r in vocabulary.chosen(rows, more_than_times=1, most=1).collect()} == {"a", "b"}
    assert [r.token for r in vocabulary.chosen(rows, most=1).collect()] == ["b"]
    with pytest.raises(TypeError):
        vocabulary.chosen(rows)


@pytest.mark.parametrize("times", [2, 3])
@settings(max_examples=10, deadline=None)
@given(words=st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=14))
def test_repeated_ngrams_in_first_seen_order(spark, times, words):
    row = spark.createDataFrame([(words,)], "w array<string>").select(ngrams.repeated_ngrams(F.col("w"), times).alias("g")).first()
    assert row.g == [w for w in dict.fromkeys(words) if words.count(w) >= times]


def test_words_of_all_ngrams(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    both = rows.select(search.gram_words(F.col("w"), 2).alias("x"), search.with_gram_words(F.col("w"), ngrams.ngrams(F.col("w"))).alias("y")).collect()
    assert all(r.x == r.y for r in both) and both[0].x == list("abcabbc")


def test_result_lines(spark):
    text = "a\nРуководствуясь статьями 1 АПК РФ\nруководствуясь ст. 2 Арбитражного процессуального кодекса\nруководствуясь ст. 3\nруководствуясь ст. 4 АПК"
    assert one(spark, text, segments.result_lines) == text.split("\n")[1:3]


def test_bigrams_drop_empty_paragraphs_and_trigrams_do_not(spark):
    par = spark.createDataFrame([(1, ["a", "b"]), (2, ["the"]), (3, ["the", "x", "y", "z"])], "k int, w array<string>")
    two = {r.k: r.grams for r in ngrams.with_ngrams(par, "w", 2, ["the"]).collect()}
    three = {r.k: r.grams for r in ngrams.with_ngrams(par, "w", 3, ["the"]).collect()}
    assert two == {1: ["a", "b", "a b"], 3: ["x", "y", "z", "x y", "y z"]}
    assert three == {1: ["a", "b"], 2: ["the"], 3: ["the", "x", "y", "z", "x y z"]}


@pytest.mark.parametrize("mode, want", [("binary", [1, 1, 1, 1, 1]), ("count", [2, 1, 1, 1, 1]), ("freq", [0.666667, 0.333333, 0.5, 0.5, 1]), ("tfidf", [1.551415, 0.693147, 0.916291, 0.693147, 0.916291])])
def test_vector_modes(spark, mode, want):
    docs = spark.createDataFrame([(1, "cat sat cat"), (2, "dog sat"), (3, "bird")], "k int, t string")
    rows = vocabulary.exploded(docs, ["k"], vectors.indexer_tokens(F.col("t")))
    got = {(r.k, r.token): r.value for r in vectors.vectors(rows, "k", mode).collect()}
    for key, value in zip([(1, "cat"), (1, "sat"), (2, "dog"), (2, "sat"), (3, "bird")], want, strict=True):
        assert got[key] == pytest.approx(value, abs=1e-6)
    assert [r.token for r in vectors.term_index(rows, ["k", "tok_pos"]).orderBy("idx").collect()] == ["cat", "sat", "dog", "bird"]


def test_places_from_many_buckets(spark, monkeypatch):
    """However the rows are cut into buckets, places follow the order."""
    rows = [(f"t{k * 7 % 101:03d}", -(k % 5), (k * 37) % 100) for k in range(100)]
    df = spark.createDataFrame(rows, "token string, few long, first int").selectExpr("token", "struct(few, struct(first)) as at")
    for n in (1_000_000, 40, 7):
        monkeypatch.setattr(vocabulary, "ROWS_A_BUCKET", n)
        got = {r.token: r.place for r in vocabulary.numbered(df, "at", "place").collect()}
        assert [t for t, _ in sorted(got.items(), key=lambda x: x[1])] == [t for t, _, _ in sorted(rows, key=lambda r: r[1:])] and sorted(got.values()) == list(range(100))


def test_feature_rows_are_sparse_vectors(spark):
    docs = spark.createDataFrame([(1, 0), (2, 1)], "k int, label int")
    values = spark.createDataFrame([(1, "b", 0.5), (1, "a", 2.0), (1, "other", 1.0)], "k int, token string, value double")
    index = spark.createDataFrame([("a", 1), ("b", 3)], "token string, idx int")
    got = {r.k: r.features for r in models.feature_rows(docs, values, "k", index).collect()}
    assert got[1].size == 4 and got[1].toArray().tolist() == [0, 2, 0, 0.5] and got[2].toArray().tolist() == [0, 0, 0, 0]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        vectors.vectors(spark.createDataFrame([(1, "a")], "k int, token string"), "k", "other")


def test_sentiment_of_one_half(spark):
    assert one(spark, "0.5", lambda c: models.sentiment(c.cast("double"))) == (0.5, "NEGATIVE")


CONCLUSION = "долг взыскать долг"
PARS = ["суд москва", "дело номер", "взыскать долг", "долг долг взыскать пени", "отказать"]


ACTS = "act_id long, texts array<string>, pars array<array<string>>"


def searched(spark, pars, conclusion=CONCLUSION, output="best"):
    acts = spark.createDataFrame([(7, pars, [p.split() for p in pars])], ACTS)
    items = spark.createDataFrame([(1, conclusion.split())], "item_id long, tokens array<string>")
    return search.conclusion_search(acts, items, output).collect()


@pytest.mark.parametrize("k, want", list(enumerate([0.591751710, 0.591751710, 0.057190958, 0.0, 0.591751710])))
def test_distance_of_each_paragraph(spark, k, want):
    row = searched(spark, [PARS[k]])[0]
    assert row.cosine == pytest.approx(want, abs=1e-9) and math.copysign(1, row.cosine) == 1


def test_nearest_paragraph_and_report(spark):
    found = searched(spark, PARS)
    assert [(r.item_id, r.act_id, r.par_pos) for r in found] == [(1, 7, 4)]
    assert (found[0].court, found[0].requisites, found[0].paragraph) == (PARS[0], PARS[2], PARS[3])


def test_all_paragraphs_or_the_best(spark):
    rows = searched(spark, PARS, output="all")
    assert [(r.par_pos, r.paragraph, r.court) for r in rows] == [(k, p, PARS[0]) for k, p in enumerate(PARS, 1)]
    assert min(rows, key=lambda r: (r.cosine, r.par_pos)) == searched(spark, PARS)[0]
    with pytest.raises(ValueError):
        searched(spark, PARS, output="worst")


def test_distances_of_the_documents_that_follow_the_first(spark):
    docs = spark.createDataFrame([(k,) for k in range(2, 32)], "k long")
    counts = spark.createDataFrame([(2, "a", 2), (2, "b", 1), (3, "a", 4), (3, "b", 2), (4, "c", 1), (5, "b", 1), (6, "d", 3), (30, "a", 1)], "k long, token string, cnt long")
    near = search.sentence_distances(docs, counts, "k").collect()
    assert [r.k for r in near] == [3, 5, 4, 6, *range(7, 24)]
    assert [r.distance for r in near[:4]] == pytest.approx([0, 1 - 1 / 5**0.5, 1, 1], abs=1e-9) and near[4].distance is None
    assert [r.k for r in search.sentence_distances(docs, counts, "k", n=3, reverse=True).collect()] == [4, 5, 3]
    assert search.sentence_distances(docs.limit(0), counts, "k").collect() == []


def test_ties_go_to_the_first_and_short_acts_have_no_requisites(spark):
    found = searched(spark, ["отказать", "номер"])
    assert found[0].par_pos == 1
    assert found[0].court == "отказать" and found[0].requisites is None


def test_search_of_nothing(spark):
    assert searched(spark, []) == []
    assert search.conclusion_search(spark.createDataFrame([], ACTS), spark.createDataFrame([], "item_id long, tokens array<string>")).collect() == []
    assert searched(spark, ["a b"], "")[0].cosine == 0


def test_blocks_of_conclusions_change_nothing(spark, monkeypatch):
    acts = spark.createDataFrame([(k, [f"{k} {j}" for j in range(5)], [[f"w{(k + j) % 7}", f"w{j}"] for j in range(5)]) for k in range(6)] + [(8, None, None)], ACTS)
    items = spark.createDataFrame([(k, [f"w{k}", f"w{(2 * k) % 9}"]) for k in range(8)], "item_id long, tokens array<string>")
    whole = sorted(search.conclusion_search(acts, items).collect())
    assert len(whole) == 48
    for name, least in (("MOST_CELLS", 8), ("MOST_ITEMS", 3), ("MOST_POSTINGS", 5), ("ACTS_AT_ONCE", 2)):
        monkeypatch.setattr(search, name, least)
        assert sorted(search.conclusion_search(acts, items).collect()) == whole
    nearest = search.nearest_acts(search.conclusion_search(acts, items), 2).collect()
    for k in range(8):
        mine = sorted((r.cosine, r.act_id) for r in whole if r.item_id == k)
        assert [(r.cosine, r.act_id) for r in sorted((r for r in nearest if r.item_id == k), key=lambda r: r.place)] == mine[:2]


@settings(max_examples=15, deadline=None)
@given(words=st.lists(st.sampled_from(["a", "b", "cc"]), max_size=9), n=st.integers(1, 4))
def test_number_of_ngrams(spark, words, n):
    row = spark.createDataFrame([(words,)], "w array<string>").select(ngrams.ngrams(F.col("w"), n).alias("g")).first()
    assert row.g == [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_sparse_nets_are_the_dense_ones(spark):
    """The same start, steps and end as MLlib's perceptron, which takes a dense row for each text."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(100):
        at = sorted(rng.choice(np.arange(1, 60), 8, replace=False).tolist())
        rows.append((k, int(rng.random() < 0.2 + 0.6 * (at[0] % 2)), Vectors.sparse(60, at, rng.integers(1, 4, 8).astype(float).tolist())))
    df = spark.createDataFrame(rows, ["k", "label", "features"]).coalesce(1)
    dense = MultilayerPerceptronClassifier(layers=[60, 7, 2], maxIter=10, seed=3).fit(df.withColumn("label", F.col("label").cast("double")))
    want = [r.p for r in dense.transform(df).orderBy("k").select(vector_to_array("probability")[1].alias("p")).collect()]
    assert [r.p for r in models.probabilities(models.train(df, hidden=7, epochs=10, seed=3), df).orderBy("k").collect()] == pytest.approx(want, abs=1e-9)


def test_nets_of_many_terms_hold_few_weights(tmp_path, monkeypatch):
    """Neither rows nor all weights are dense at once: 3 million terms, 50 units; a few units at a time change nothing."""
    assert nets.Trainer(str(tmp_path), 3_000_000, 50, nets.hashed(1)).wide * 3_000_000 <= nets.MOST_WEIGHTS
    found = []
    for most in (10**9, 80):
        monkeypatch.setattr(nets, "MOST_WEIGHTS", most)
        monkeypatch.setattr(nets, "MOST_CELLS", most)
        (at := tmp_path / str(most)).mkdir()
        net = nets.Trainer(str(at), 40, 6, nets.hashed(1))
        net.take(((np.arange(k % 5, 40, 7), np.ones(len(range(k % 5, 40, 7)))) for k in range(30)), [k % 2 for k in range(30)])
        a = net.train(5)
        found.append(np.hstack([net.initial(lo, hi) + net.gathered(a, lo, hi) for lo, hi in net.units()]))
    assert found[0] == pytest.approx(found[1], abs=1e-9)


def test_batches_of_found_paragraphs_are_bounded():
    """Each row repeats texts of its act: of 300 rows of 60 kB no batch holds more than MOST_BYTES, and none is lost."""
    texts, ids = pa.array([["c" * 20_000, "x", "r" * 20_000, "p" * 20_000], ["q"]]), pa.array([7, 8])
    item, act, spot = np.arange(301), np.append(np.zeros(300, int), 1), np.append(np.full(300, 3), 0)
    got = list(search.reported(ids, texts, item, act, np.zeros(301), spot))
    assert max(b.nbytes for b in got) < search.MOST_BYTES * 1.1 and sum(b.num_rows for b in got) == 301
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["item_id"] for r in rows] == list(range(301)) and all((r["court"], r["requisites"], r["paragraph"]) == ("c" * 20_000, "r" * 20_000, "p" * 20_000) for r in rows[:300])
    assert rows[300] == {"item_id": 300, "act_id": 8, "par_pos": 1, "cosine": 0.0, "court": "q", "requisites": None, "paragraph": "q"}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_lemmas_of_a_small_dictionary_shuffle_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the maisons\n\na  b maisons c"), (2, ""), (3, None)], "k int, t string")
    found = []
    for words in ([("maisons", "maison"), ("b", None), (None, "x"), ("c", "")], [(f"w{k}", "w") for k in range(5_000)] + [("maisons", "maison"), ("c", "")]):
        dictionary = spark.createDataFrame(words, "token string, lemma string")
        made = [lemmas.normalized(docs, "k", "t", dictionary), lemmas.full_process(docs, "k", "t", dictionary, ["the"])]
        assert [exchanges(x) for x in made] == [0, 0]
        with monkeypatch.context() as m:
            m.setattr(lemmas, "MOST_LEMMAS", 1)
            joined = [lemmas.normalized(docs, "k", "t", dictionary), lemmas.full_process(docs, "k", "t", dictionary, ["the"])]
            assert min(exchanges(x) for x in joined) > 0
            found.append([sorted(x.collect()) for x in made])
            assert found[-1] == [sorted(x.collect()) for x in joined]
    assert found[0] == found[1] and (1, 3, "a  b maison ") in found[0][0]
    twice = spark.createDataFrame([("b", "x"), ("b", "a")], "token string, lemma string")
    assert lemmas.normalized(docs, "k", "t", twice).filter("part = 3").first().text == "a  a x maisons c"


def test_lines_shuffle_only_tokens_the_vocabulary_lacks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b rare a"), (1, "c rare b"), (2, "odd"), (3, None), (None, "a b"), (4, "a a b")], "k int, t string")
    words, split = spark.createDataFrame([("a",), ("b",), ("c",)], "token string"), F.split("t", " ")
    got = vocabulary.lines_in_vocabulary(docs, "k", split, words)
    assert "left_anti" in got._jdf.queryExecution().toString().lower().replace("leftanti", "left_anti")
    monkeypatch.setattr(vocabulary, "MOST_WORDS", 1)
    joined = vocabulary.lines_in_vocabulary(docs, "k", split, words)
    assert {(r.k, r.line) for r in got.collect()} == {(r.k, r.line) for r in joined.collect()} == {(1, "a c b b a"), (2, ""), (3, ""), (None, ""), (4, "a a b")}
