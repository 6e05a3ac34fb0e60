"""Queries over the driver's tables and, where SQL can state them, the SQL that DuckDB checks them with.

Names begin with the operator's number in the survey. Tables hold no Cyrillic,
so patterns of court acts run over the documents with court texts put before
and behind each, the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import patterns as P
from glyphmill.functions import segments, tokens
from glyphmill.operators import lemmas, models, ngrams, search, vectors, vocabulary
from glyphmill.sources import files, scratch, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STOPS = ("the", "of", "and", "to", "in", "la", "de", "le", "der", "die", "und", "el", "que", "et")
LEMMAS = [("words", "word"), ("word", "word"), ("the", "the"), ("maisons", "maison"), ("is", "be"), ("was", "be"), ("are", "be"), ("des", "de"), ("les", "le"), ("una", "uno"), ("eine", "ein"), ("einen", "ein"), ("data", "datum"), ("years", "year"), ("people", "person")]
COURT_TEXTS = [
    (1, "КонсультантПлюс: первая\nвторая\nТело акта\n" + "-" * 66 + "\nКонсультантПлюс: заметка\nеё конец\n" + "-" * 66 + "\nКонец\n"),
    (2, "акт1\n\n\n" + "-" * 66 + "\n\n\nакт2\n\n\n" + "-" * 66 + "\n\n\n"),
    (3, "один Документ предоставлен КонсультантПлюс два"),
    (4, "АРБИТРАЖНЫЙ СУД Москвы\nУстановил:\n\nистец требует долг\nруководствуясь статьями 1 АПК РФ, решил\nвзыскать" + "-" * 66),
    (5, "Социально-экономический довод № 5, iPhone, слово- и Ёлка-2. Суд решил дело. Он прав"),
    (6, "Суд_1 решил: взыскать 15 руб. с ООО «Ёлка-2», а не я. Нет <S>12.5 довода</S>"),
    (7, ""),
]
RU_STOPS = ("и", "не", "на", "нет", "он", "или", "если")
SCORES = [("binary", 0.80), ("binary", 0.82), ("binary", 0.85), ("binary", 0.86), ("binary", 0.90), ("freq", 0.5), ("freq", 0.75), ("tfidf", 1.0)]
WEIGHTS = [("the", 1, 0.5), ("the", 2, -0.25), ("of", 1, -0.5), ("is", 2, 0.75), ("and", 3, 0.25), ("a", 3, -1.0)]
UNITS = [(1, 0.1, 1.5), (2, -0.2, -1.0), (3, 0.3, 0.5)]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"cast({v!r} as double)" if isinstance(v, float) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") t({names})"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _projection(name: str, tab: str, key: str, column: Callable[[], Column], sql: str) -> None:
    """A query of one value for every row of a table; both sides name it v."""
    query(name, f"select {key}, {sql} as v from {tab}")(lambda spark, d: _table(spark, d, tab).select(key, column().alias("v")))


_COURT_ROWS = f"(select doc_id, t.text || d.text || chr(10) || t.text as text from documents d join {_values(COURT_TEXTS, 'id, text')} on t.id = doc_id % {len(COURT_TEXTS)} + 1)"


def _court_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the court text whose turn it is before and behind each."""
    marks = F.broadcast(spark.createDataFrame(COURT_TEXTS, "id long, mark string"))  # seven rows
    rows = _table(spark, d, "documents").withColumn("id", F.col("doc_id") % len(COURT_TEXTS) + 1).join(marks, "id")
    return rows.select("doc_id", F.concat("mark", "text", F.lit("\n"), "mark").alias("text"))


def _court(name: str, column: Callable[[], Column], sql: str) -> None:
    """A query of one value for every document among court texts; both sides name it v."""
    query(name, f"select doc_id, {sql} as v from {_COURT_ROWS}")(lambda spark, d: _court_rows(spark, d).select("doc_id", column().alias("v")))


TEXT = F.col  # named late: columns need a session in some builds
W = r"[^\p{L}\p{N}_]"
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SIGNS = r"[!-/:-@\[-`{-~]"
RU = r"[А-Яа-яЁё]+-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*"
TOKENS = rf"list_filter(regexp_split_to_array(lower(text), '{W}'), lambda x: length(x) > 1)"
PARS = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"
PAR_ROWS = f"select doc_id, unnest({PARS}) as text, unnest(range(1, len({PARS}) + 1)) as par_pos from documents"
INDEXED = r'''list_filter(string_split(regexp_replace(lower(text), '[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n]', ' ', 'g'), ' '), lambda x: x <> '')'''
BLANKS = f"list_filter(regexp_split_to_array(text, '{BLANK}'), lambda x: x <> '')"


def _rows(tab: str, key: str, list_sql: str) -> str:
    """SQL: (key, tok_pos from 0, token)."""
    return f"select {key}, unnest(w) as token, unnest(range(0, len(w))) as tok_pos from (select {key}, {list_sql} as w from {tab})"


def _joined(tokens_: Column) -> Column:
    return F.array_join(tokens_, " ")


# Sources and splits
query("S03_lines", r"select item_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+$')) as line from benchmark")(lambda s, d: _table(s, d, "benchmark").select("item_id", F.explode(files.lines(F.col("text"))).alias("line")))
query("S08_labelled", "select doc_id, 0 as label from labels where quality = 0 union all select doc_id, 1 from labels where quality = 1")(lambda s, d: files.labelled(*(_table(s, d, "labels").filter(f"quality = {k}").select("doc_id") for k in (0, 1))))
query("S09_held_out", "select doc_id, starts_with('cv' || (doc_id % 10), 'cv9') as test from documents")(lambda s, d: _table(s, d, "documents").select("doc_id", files.held_out(F.concat(F.lit("reviews/cv"), (F.col("doc_id") % 10).cast("string"))).alias("test")))
query("S14_vocabulary_file", f"select distinct unnest({BLANKS}) as token from benchmark")(lambda s, d: _table(s, d, "benchmark").select(F.explode(files.vocabulary_words(F.col("text"))).alias("token")).distinct())

ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very s t can will just don should
now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()  # fixed values: the list that files.stop_words() must give


query("S13_stop_words", f"select doc_id, array_to_string(list_filter(string_split(lower(text), ' '), lambda x: x not in {_in(w.replace(chr(39), 2 * chr(39)) for w in ENGLISH)}), ' ') as v from documents")(lambda s, d: _table(s, d, "documents").select("doc_id", tokens.stops_removed(F.lower(F.col("text")), files.stop_words(s)).alias("v")))


# Files: each query writes what it reads back
def _item_files(spark: SparkSession, d: str) -> str:
    """A folder with a text file for each item of `benchmark`."""
    to = scratch.folder(spark)
    _table(spark, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(to)
    return to


_ITEM = r"item_id=(\d+)"
_ITEM_TEXT = r"regexp_replace(text, '\r\n?', chr(10), 'g') || chr(10)"


def _file_items(rows: DataFrame) -> DataFrame:
    return rows.withColumn("item_id", F.regexp_extract("path", _ITEM, 1).cast("long"))


@query("S01_text_files", f"select item_id, {_ITEM_TEXT} as text from benchmark")
def _text_files(spark: SparkSession, d: str) -> DataFrame:
    """S01, S02, S05, S06."""
    return _file_items(files.texts(spark, _item_files(spark, d), "utf-8", ".txt")).select("item_id", "text")


@query("S04_sorted_files", "select item_id, row_number() over (order by cast(item_id as varchar) || '/') as place from benchmark")
def _sorted_files(spark: SparkSession, d: str) -> DataFrame:
    """The order as the rows come to the driver."""
    rows = _file_items(files.texts(spark, _item_files(spark, d), "utf-8", ".txt", ordered=True).select("path")).select("item_id").toLocalIterator()
    return spark.createDataFrame([(r.item_id, k) for k, r in enumerate(rows, 1)], "item_id long, place long")


@query("S07_stored_acts", "select doc_id, text from documents")
def _stored_acts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.save_table(_table(spark, d, "documents").select("doc_id", "text"), scratch.folder(spark))


@query("S10_lines_of_two_folders", " union all ".join(f"select item_id, cast({k} as integer) as label, cast(unnest(range(1, len(l) + 1)) as integer) as line_pos, unnest(l) as line from (select item_id, regexp_extract_all({_ITEM_TEXT}, '[^\n]*\n|[^\n]+$') as l from benchmark)" for k in (0, 1)))
def _lines_of_two_folders(spark: SparkSession, d: str) -> DataFrame:
    folder = _item_files(spark, d)
    return _file_items(files.labelled_lines(spark, folder, folder, "utf-8")).select("item_id", "label", "line_pos", "line")


def _store(spark: SparkSession, d: str) -> files.Store:
    store = files.Store(spark, scratch.folder(spark))
    store.put("tags", _table(spark, d, "documents").select(F.col("source").alias("tag")).filter("tag is not null").distinct())
    store.put("marked_acts", _table(spark, d, "documents").select(F.col("doc_id").alias("act_key"), "text"))
    return store


query("S11_stored_tags", "select distinct source as tag from documents where source is not null order by tag")(lambda s, d: _store(s, d).extract("tags"))
query("S11_stored_values", "select text from documents")(lambda s, d: _store(s, d).extract("marked_acts"))
query("S12_stored_names", "select unnest(['marked_acts', 'tags']) as key")(lambda s, d: _store(s, d).keys())
query("S12_stored_keys", "select distinct doc_id as key from documents order by key")(lambda s, d: _store(s, d).keys("marked_acts"))


@query("S15_stage_texts", f"select item_id, {_ITEM_TEXT} as text from benchmark")
def _stage_texts(spark: SparkSession, d: str) -> DataFrame:
    root, stage = _item_files(spark, d).rsplit("/", 1)
    return _file_items(files.stage_texts(spark, root, stage, "utf-8")).select("item_id", "text")


_REPORT = "doc_id long, source string, lang string, n_chars long"


@query("K01_csv", "select doc_id, source, lang, cast(n_chars as bigint) as n_chars from documents")
def _csv(spark: SparkSession, d: str) -> DataFrame:
    to = scratch.folder(spark)
    sinks.write_csv(_table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), to)
    return sinks.read_csv(spark, to, _REPORT)


@query("K02_csv_with_header", "select doc_id as number, source as court from documents")
def _csv_with_header(spark: SparkSession, d: str) -> DataFrame:
    """Read with the header that was written."""
    to = scratch.folder(spark)
    sinks.write_table(_table(spark, d, "documents").select("doc_id", "source"), to, ("number", "court"))
    rows = spark.read.options(**sinks.FORMAT, header=True).csv(to)
    return rows.select(F.col("number").cast("long").alias("number"), "court")


def _counted_report(spark: SparkSession, counts: DataFrame, header: tuple[str, str]) -> DataFrame:
    """The report as read back: its lines must be as many, with the counts of these tokens."""
    to = scratch.folder(spark)
    sinks.export_counts(counts, to, header)
    return spark.read.options(**sinks.FORMAT, header=True).csv(to).select(F.col(header[0]).alias("token"), F.col(header[1]).cast("long").alias("cnt"))


@query("T19_lines_of_most_common", f"with v as (select token from (select token, count(*) as cnt, min(struct_pack(a := doc_id, b := tok_pos)) as f from ({_rows('documents', 'doc_id', TOKENS)}) group by token order by cnt desc, f limit 100)) select doc_id, coalesce(line, '') as line from (select distinct doc_id from documents) left join (select doc_id, string_agg(token, ' ' order by tok_pos) as line from ({_rows('documents', 'doc_id', TOKENS)}) where token in (select token from v) group by doc_id) using (doc_id)")
def _lines_of_most_common(spark: SparkSession, d: str) -> DataFrame:
    found = vocabulary.chosen(_doc_tokens(spark, d), most=100, order=["doc_id", "tok_pos"])
    return vocabulary.lines_in_vocabulary(_table(spark, d, "documents"), "doc_id", tokens.word_tokens(F.col("text")), found)


query("K03_vocabulary_report", f"select token, count(*) as cnt from ({_rows('documents', 'doc_id', TOKENS)}) group by token")(lambda s, d: _counted_report(s, vocabulary.word_counts(_doc_tokens(s, d)), sinks.WORDS_HEADER))
query("K04_gram_report", f"select token, count(*) as cnt from (select unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as token from (select {TOKENS} as w from benchmark)) group by token")(lambda s, d: _counted_report(s, vocabulary.word_counts(_table(s, d, "benchmark").select(F.explode(ngrams.ngrams(tokens.word_tokens(F.col("text")))).alias("token"))), sinks.GRAMS_HEADER))


@query("K05_appended_lines", "select source as value from documents where source is not null union all select source from documents where source is not null")
def _appended(spark: SparkSession, d: str) -> DataFrame:
    """Written twice, the second time behind the first."""
    to = scratch.folder(spark)
    for _ in range(2):
        sinks.append_text(_table(spark, d, "documents"), "source", to)
    return spark.read.text(to)


@query("K06_table_as_text", "select cast(doc_id as varchar) as value from documents")
def _table_as_text(spark: SparkSession, d: str) -> DataFrame:
    to = scratch.folder(spark)
    sinks.table_to_text(spark, f"{d}/documents.parquet", "doc_id", to)
    return spark.read.text(to)


@query("K07_saved_index", "select token, cast(row_number() over (order by cnt desc, f) as integer) as idx, cnt from (select token, count(*) as cnt, min(struct_pack(a := item_id, b := tok_pos)) as f from (" + _rows("benchmark", "item_id", INDEXED) + ") group by token)")
def _saved_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of a tokenizer, saved and loaded."""
    return sinks.save_table(vectors.term_index(_index_tokens(spark, d), ["item_id", "tok_pos"]), scratch.folder(spark))


@query("K10_saved_list", "select lang as value from documents where lang is not null")
def _saved_list(spark: SparkSession, d: str) -> DataFrame:
    """Written twice, the second time in place of the first."""
    to = scratch.folder(spark)
    for _ in range(2):
        sinks.save_list(_table(spark, d, "documents"), "lang", to)
    return spark.read.text(to)


@query("K11_recoded", f"select item_id, {_ITEM_TEXT} as text from benchmark")
def _recoded(spark: SparkSession, d: str) -> DataFrame:
    to = scratch.folder(spark)
    sinks.recode(spark, _item_files(spark, d), to, "utf-8", "utf-16-be")
    return _file_items(spark.read.parquet(to)).select("item_id", F.decode("content", "UTF-16BE").alias("text"))


# Segmentation
NOTE_SQL = P.NOTE.replace("(?s)", "")
_court("G01_boilerplate", lambda: segments.boilerplate_removed(TEXT("text")), rf"regexp_replace(regexp_replace(text, '{NOTE_SQL}', '', 'gs'), '\AКонсультантПлюс[^\n]+?\n[^\n]+?\n', '')")
_court("G02_acts_by_rule", lambda: F.array_join(segments.split_acts(TEXT("text")), "|"), rf"array_to_string(regexp_split_to_array(text, '{P.BETWEEN_ACTS}'), '|')")
_court("G02_acts_by_supplier", lambda: F.array_join(segments.split_acts(TEXT("text"), "supplier"), "|"), f"array_to_string(string_split(text, '{P.PROVIDED}'), '|')")
query("G03_paragraphs", PAR_ROWS.replace("unnest(range", "cast(unnest(range").replace(") as par_pos", ") as integer) as par_pos").replace(" as text,", " as par,"))(lambda s, d: segments.paragraphs(_table(s, d, "documents"), "doc_id", "text"))
query("G04_paragraphs_all", "select doc_id, cast(unnest(range(1, len(p) + 1)) as integer) as par_pos, unnest(p) as par from (select doc_id, string_split(text, chr(10)) as p from documents)")(lambda s, d: segments.paragraphs(_table(s, d, "documents"), "doc_id", "text", True))
_SENTENCES = r"string_split(regexp_replace(text, '([\p{L}\p{N}_][\p{L}\p{N}_)])\.\s+([А-ЯЁ](?:\s|[А-Яа-яЁё]))', '\1␞\2', 'g'), '␞')"
_court("G05_sentences", lambda: F.array_join(segments.sentences(TEXT("text")), "|"), f"array_to_string({_SENTENCES}, '|')")
_projection("G06_between", "pages", "page_id", lambda: segments.between(TEXT("html"), "<nav>", "</nav>", True), "regexp_extract(html, '(?s)<nav>.+</nav>', 0)")
_projection("G07_tagged_part", "pages", "page_id", lambda: segments.tagged_part(TEXT("html"), "title"), "regexp_extract(html, '(?s)title(.+)/title', 1)")
_projection("G08_tagged_lower", "pages", "page_id", lambda: segments.tagged_part_lower(TEXT("html"), "footer"), "lower(regexp_extract(html, '(?s)footer(.+)/footer', 1))")
_court("G09_claim", lambda: F.array_join(segments.all_of(TEXT("text"), P.CLAIM), "|"), r"array_to_string(regexp_extract_all(text, '(?:Установил|УСТАНОВИЛ|установил):\n\n([^\n]*)\n', 1), '|')")
_court("G10_note", lambda: F.array_join(segments.all_of(TEXT("text"), P.NOTE_LOOSE), "|"), r"array_to_string(regexp_extract_all(text, '(?s)-{66}\nКонсультантПлюс.*?-{66}\n'), '|')")
_court("G11_result", lambda: F.array_join(segments.result_lines(TEXT("text")), "|"), r"array_to_string(regexp_extract_all(text, '([^\n]*[Рр]уководствуясь (?:статьями|ст)[^\n]*?(?:Арбитражного процессуального кодекса|АПК)[^\n]*?)\n', 1), '|')")
_court("G12_act", lambda: F.array_join(segments.all_of(TEXT("text"), P.ACT), "|"), r"array_to_string(regexp_extract_all(text, '(?s)(АРБИТРАЖНЫЙ СУД.*?)-{66}', 1), '|')")
for _name, _pattern in {"words": P.RU_WORD, "marked": P.RU_WORD_MARKED, "numbered": P.RU_WORD_MARKED_NUMBERED, "any": P.ANY_WORD}.items():
    _court(f"G13_{_name}", lambda p=_pattern: F.array_join(segments.all_of(TEXT("text"), p), "|"), f"array_to_string(regexp_extract_all(text, '{_pattern}'), '|')")

# Tokenizers and cleaners
_projection("T01_latin_tokens", "documents", "doc_id", lambda: _joined(tokens.latin_tokens(TEXT("text"))), "array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ')")
_projection("T02_word_tokens", "documents", "doc_id", lambda: _joined(tokens.word_tokens(TEXT("text"))), f"array_to_string({TOKENS}, ' ')")
_projection("T03_without_stops", "documents", "doc_id", lambda: _joined(tokens.word_tokens_without(TEXT("text"), STOPS)), f"array_to_string(list_filter({TOKENS}, lambda x: x not in {_in(STOPS)}), ' ')")
_projection("T04_stops_removed", "conversations", "conv_id", lambda: _joined(tokens.without(F.split(TEXT("text"), " "), STOPS)), f"array_to_string(list_filter(string_split(text, ' '), lambda x: x not in {_in(STOPS)}), ' ')")
_court("T05_russian_tokens", lambda: _joined(tokens.russian_tokens(TEXT("text"), RU_STOPS)), f"array_to_string(list_filter(regexp_extract_all(lower(text), '{RU}'), lambda x: length(x) > 1 and x not in {_in(RU_STOPS)}), ' ')")
_projection("T06_stripped_tokens", "benchmark", "item_id", lambda: F.array_join(tokens.stripped_tokens(TEXT("text")), "|"), f"array_to_string(list_transform({BLANKS.replace('(text,', '(lower(text),')}, lambda x: regexp_replace(x, '{SIGNS}', '', 'g')), '|')")
_CLEAN = f"list_filter(list_transform({BLANKS}, lambda x: regexp_replace(x, '{SIGNS}', '', 'g')), lambda x: regexp_matches(x, '^\\p{{L}}+$') and length(x) > 1 and x not in %s)"
_projection("T08_clean_tokens", "documents", "doc_id", lambda: _joined(tokens.clean_tokens(TEXT("text"), STOPS)), f"array_to_string({_CLEAN % _in(STOPS)}, ' ')")
_court("T09_clean_russian", lambda: _joined(tokens.clean_tokens(F.lower(TEXT("text")), RU_STOPS)), f"array_to_string({_CLEAN.replace('(text,', '(lower(text),') % _in(RU_STOPS)}, ' ')")
_projection("T10_punctuation", "documents", "doc_id", lambda: tokens.punctuation_deleted(TEXT("text")), f"regexp_replace(text, '{SIGNS}', '', 'g')")
_projection("T10_given_signs", "documents", "doc_id", lambda: tokens.punctuation_deleted(TEXT("text"), ".,-"), "translate(text, '.,-', '')")
_court("T11_cleaned", lambda: tokens.cleaned(TEXT("text"), RU_STOPS), f"array_to_string(list_filter(string_split(lower(array_to_string(regexp_extract_all(text, '{RU}'), ' ')), ' '), lambda x: x not in {_in(RU_STOPS)}), ' ')")
_court("T12_short_stops", lambda: tokens.stops_removed(F.lower(TEXT("text")), tokens.short_stops(RU_STOPS)), "array_to_string(list_filter(string_split(lower(text), ' '), lambda x: x not in ('и', 'не', 'на', 'он')), ' ')")
_court("T13_russian_only", lambda: tokens.russian_only(TEXT("text")), f"array_to_string(regexp_extract_all(text, '{RU}'), ' ')")
_projection("T14_lower", "documents", "doc_id", lambda: F.lower(TEXT("text")), "lower(text)")
_projection("T15_stops_from_line", "benchmark", "item_id", lambda: tokens.stops_removed(F.lower(TEXT("text")), STOPS), f"array_to_string(list_filter(string_split(lower(text), ' '), lambda x: x not in {_in(STOPS)}), ' ')")
_MAPPED = "coalesce(map {" + ", ".join(f"'{a}': '{b}'" for a, b in LEMMAS) + "}[x], x)"
_STOPPED = f"array_to_string(list_filter(string_split(lower(p), ' '), lambda x: x not in {_in(STOPS)}), ' ')"
query("T17_by_paragraph", f"select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda p: {_STOPPED}), chr(10)) as v from documents")(lambda s, d: _table(s, d, "documents").select("doc_id", F.array_join(tokens.stops_removed_parts(F.col("text"), STOPS), "\n").alias("v")))
query("T17_whole", f"select doc_id, {_STOPPED.replace('(p)', '(text)')} as v from documents")(lambda s, d: _table(s, d, "documents").select("doc_id", tokens.stops_removed_parts(F.col("text"), STOPS, "document")[0].alias("v")))
_CLEANED = f"array_to_string(list_filter(string_split(lower(array_to_string(regexp_extract_all(p, '{RU}'), ' ')), ' '), lambda x: x not in {_in(RU_STOPS)}), ' ')"
_court("T11_by_paragraph", lambda: F.array_join(tokens.cleaned_parts(TEXT("text"), RU_STOPS), "|"), f"array_to_string(list_transform(string_split(text, chr(10)), lambda p: {_CLEANED}), '|')")
_court("T11_by_sentence", lambda: F.array_join(tokens.cleaned_parts(TEXT("text"), RU_STOPS, "sentence"), "|"), f"array_to_string(list_transform({_SENTENCES}, lambda p: {_CLEANED}), '|')")


def _dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEMMAS, "token string, lemma string")


_TEXT_ROWS = _rows("documents", "doc_id", TOKENS)
query("T07_inflected", f"select doc_id, string_agg({_MAPPED.replace('[x], x', '[token], token')}, ' ' order by tok_pos) as v from ({_TEXT_ROWS}) group by doc_id")(lambda s, d: lemmas.regathered(lemmas.inflected(_doc_tokens(s, d), _dictionary(s), "keep"), ["doc_id"]).select("doc_id", _joined(F.col("tokens")).alias("v")))
query("T16_normalized", f"select doc_id, cast(unnest(range(1, len(p) + 1)) as integer) as part, array_to_string(list_transform(string_split(unnest(p), ' '), lambda x: {_MAPPED}), ' ') as text from (select doc_id, string_split(text, chr(10)) as p from documents)")(lambda s, d: lemmas.normalized(_table(s, d, "documents"), "doc_id", "text", _dictionary(s)))
_PROCESSED = f"list_transform(list_filter({TOKENS.replace('(text)', '(par)')}, lambda x: x not in {_in(STOPS)}), lambda x: {_MAPPED})"
query("T18_full_process", f"select doc_id, par_pos, array_to_string({_PROCESSED}, ' ') as v from (select doc_id, cast(unnest(range(1, len(p) + 1)) as integer) as par_pos, unnest(p) as par from (select doc_id, string_split(text, chr(10)) as p from documents))")(lambda s, d: lemmas.full_process(_table(s, d, "documents"), "doc_id", "text", _dictionary(s), STOPS).select("doc_id", "par_pos", _joined(F.col("tokens")).alias("v")))
_projection("T22_flattened", "documents", "doc_id", lambda: F.array_join(F.flatten(F.transform(segments.split_paragraphs(TEXT("text")), lambda p: tokens.word_tokens(p))), " "), f"array_to_string(flatten(list_transform({PARS}, lambda p: {TOKENS.replace('(text)', '(p)')})), ' ')")
_projection("T23_times_286", "documents", "doc_id", lambda: tokens.times_286(TEXT("n_chars")), "n_chars * 286")
#: A text's share of the letters a to z, in place of a probability.
_SHARE = "round(length(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(length(text), 1), 6)"


def _share() -> Column:
    return F.round(F.length(F.regexp_replace("text", "[^a-z]", "")) / F.greatest(F.length("text"), F.lit(1)), 6)


_projection("T25_verdict_text", "documents", "doc_id", lambda: tokens.with_verdict(TEXT("source"), _share(), "02_DEM", 0.8), f"case when {_SHARE} < 0.8 then source else source || '   ' || cast({_SHARE} as varchar) || '# 02_DEM' end")


def _doc_tokens(spark: SparkSession, d: str, tab: str = "documents", key: str = "doc_id") -> DataFrame:
    return vocabulary.exploded(_table(spark, d, tab), [key], tokens.word_tokens(F.col("text")))


DOC_ROWS, ITEM_ROWS = _rows("documents", "doc_id", TOKENS), _rows("benchmark", "item_id", TOKENS)
COUNTS = f"select token, count(*) as cnt from ({DOC_ROWS}) group by token"

# Lines of vocabulary words
VOCABULARY_10 = f"(select token from ({COUNTS}) where cnt > 10)"


@query("T19_lines_in_vocabulary", f"select doc_id, coalesce(line, '') as line from (select distinct doc_id from documents) left join (select doc_id, string_agg(token, ' ' order by tok_pos) as line from ({DOC_ROWS}) where token in {VOCABULARY_10} group by doc_id) using (doc_id)")
def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return vocabulary.lines_in_vocabulary(docs, "doc_id", tokens.word_tokens(F.col("text")), vocabulary.more_than(vocabulary.word_counts(_doc_tokens(spark, d)), 10))


@query("T20_line_of_small_vocabulary", f"select doc_id, array_to_string(list_filter({TOKENS}, lambda x: x in {_in(STOPS)}), ' ') as v from documents")
def _line_small(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", tokens.line_of(tokens.word_tokens(F.col("text")), STOPS).alias("v"))


def _part_sql(tag: str) -> str:
    return f"(select page_id, lower(regexp_extract(html, '(?s){tag}(.+)/{tag}', 1)) as text from pages)"


_TAG_VOCABULARY = f"(select token from ({_rows(_part_sql('title'), 'page_id', TOKENS)}) group by token having count(*) >= 2)"


@query("T21_lines_of_two_tags", " union all ".join(f"select page_id, {k} as label, array_to_string(list_filter({TOKENS}, lambda x: list_contains(known, x)), ' ') as line from {_part_sql(t)}, (select list(token) as known from {_TAG_VOCABULARY})" for t, k in (("title", 1), ("nav", 0))))
def _two_tags(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages")
    part = lambda tag: pages.select("page_id", tokens.word_tokens(segments.tagged_part_lower(F.col("html"), tag)).alias("w"))
    known = vocabulary.at_least(vocabulary.word_counts(vocabulary.exploded(part("title"), ["page_id"], F.col("w"))), 2)
    line = lambda tag: vocabulary.lines_in_vocabulary(part(tag), "page_id", F.col("w"), known)
    return files.labelled(line("nav"), line("title")).select("page_id", "label", "line")


# Counts
query("A01_word_counts", COUNTS)(lambda s, d: vocabulary.word_counts(_doc_tokens(s, d)))
query("A02_counts_of_two", f"select token, count(*) as cnt from (select token from ({DOC_ROWS}) union all select token from ({ITEM_ROWS})) group by token")(lambda s, d: vocabulary.word_counts(_doc_tokens(s, d), _doc_tokens(s, d, "benchmark", "item_id")))
query("A03_tag_vocabulary", _TAG_VOCABULARY[1:-1])(lambda s, d: vocabulary.at_least(vocabulary.word_counts(vocabulary.exploded(_table(s, d, "pages"), ["page_id"], tokens.word_tokens(segments.tagged_part_lower(F.col("html"), "title"))))).select("token"))
query("A04_term_counts", f"select doc_id, token, count(*) as cnt from ({DOC_ROWS}) group by doc_id, token")(lambda s, d: vocabulary.term_counts(_doc_tokens(s, d), "doc_id"))
query("A05_distinct_tokens", f"select distinct token from ({DOC_ROWS}) where length(token) > 3")(lambda s, d: vocabulary.distinct_longer(_doc_tokens(s, d), 3))
_BIGRAMS = "list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])"
_TRIGRAMS = "list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
query("A06_repeated_bigrams", f"with b as (select item_id, {_BIGRAMS} as g from (select item_id, {TOKENS} as w from benchmark)), u as (select item_id, unnest(g) as g, unnest(range(len(g))) as p from b), r as (select item_id, g, min(p) as p from u group by item_id, g having count(*) >= 2) select item_id, coalesce(string_agg(r.g, '|' order by p), '') as v from b left join r using (item_id) group by item_id")(lambda s, d: _table(s, d, "benchmark").select("item_id", F.array_join(ngrams.repeated_ngrams(ngrams.ngrams(tokens.word_tokens(F.col("text")))), "|").alias("v")))
query("A08_described", f"select mode, count(accuracy) as n, round(avg(accuracy), 9) as mean, round(stddev_samp(accuracy), 9) as std, min(accuracy) as low, round(quantile_cont(accuracy, 0.25), 9) as p25, round(quantile_cont(accuracy, 0.5), 9) as p50, round(quantile_cont(accuracy, 0.75), 9) as p75, max(accuracy) as high from {_values(SCORES, 'mode, accuracy')} group by mode")(lambda s, d: models.described(s.createDataFrame(SCORES, "mode string, accuracy double"), "mode", "accuracy").select("mode", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "low", *(F.round(c, 9).alias(c) for c in ("p25", "p50", "p75")), "high"))
query("A09_accuracy", "select round(avg(case when quality = cast(n_chars > 400 as integer) then 1.0 else 0.0 end), 9) as accuracy from labels join documents using (doc_id)")(lambda s, d: models.accuracy(_table(s, d, "labels").join(_table(s, d, "documents"), "doc_id").withColumn("label", F.col("quality")), (F.col("n_chars") > 400).cast("int")).select(F.round("accuracy", 9).alias("accuracy")))
query("A10_document_frequency", f"select token, count(distinct doc_id) as df from ({DOC_ROWS}) group by token")(lambda s, d: vocabulary.document_frequency(_doc_tokens(s, d), "doc_id"))
query("A11_profile", f"select count(*) as tokens, count(distinct token) as words, count(distinct doc_id) as documents from ({DOC_ROWS})")(lambda s, d: vocabulary.profile(_doc_tokens(s, d), tokens=F.count(F.lit(1)), words=F.count_distinct("token"), documents=F.count_distinct("doc_id")))
query("F01_more_than", f"select * from ({COUNTS}) where cnt > 5")(lambda s, d: vocabulary.more_than(vocabulary.word_counts(_doc_tokens(s, d)), 5))
query("F02_most_common", f"select token, cnt from (select token, count(*) as cnt, min(struct_pack(a := doc_id, b := tok_pos)) as f from ({DOC_ROWS}) group by token order by cnt desc, f limit 50)")(lambda s, d: vocabulary.most_common(_doc_tokens(s, d), 50, ["doc_id", "tok_pos"]))
query("F03_descending", f"{COUNTS} order by cnt desc, token")(lambda s, d: vocabulary.descending(vocabulary.word_counts(_doc_tokens(s, d))))
query("F04_at_least", f"select * from ({COUNTS}) where cnt >= 2")(lambda s, d: vocabulary.at_least(vocabulary.word_counts(_doc_tokens(s, d))))
query("F05_sorted_keys", "select distinct source from documents where source is not null order by source")(lambda s, d: vocabulary.sorted_keys(_table(s, d, "documents"), "source"))
_projection("F06_threshold", "documents", "doc_id", lambda: models.if_likely(_share(), 0.8), f"case when {_SHARE} < 0.8 then '' else cast({_SHARE} as varchar) end")
query("F07_sentiment", f"select doc_id, round(case when p <= 0.5 then 1 - p else p end, 6) as share, case when p <= 0.5 then 'NEGATIVE' else 'POSITIVE' end as label from (select doc_id, {_SHARE} as p from documents)")(lambda s, d: _table(s, d, "documents").select("doc_id", models.sentiment(_share()).alias("s")).select("doc_id", F.round("s.share", 6).alias("share"), "s.label"))
query("U01_union", "select doc_id as id, text, 1 as label from documents union all select item_id, text, 0 from benchmark")(lambda s, d: files.labelled(_table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), _table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")))
query("U02_distinct", f"select distinct token from ({ITEM_ROWS})")(lambda s, d: vocabulary.distinct_longer(_doc_tokens(s, d, "benchmark", "item_id")))


# N-grams
def _gram(name: str, column: Callable[[Column], Column], grams_sql: str, words_sql: str = TOKENS) -> None:
    query(name, f"select conv_id, turn, array_to_string({grams_sql}, '|') as v from (select conv_id, turn, {words_sql} as w from conversations)")(lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", F.array_join(column(tokens.word_tokens(F.col("text"))), "|").alias("v")))


_BARE = f"list_filter({TOKENS}, lambda x: x not in {_in(STOPS)})"
_gram("N01_bigrams", ngrams.ngrams, _BIGRAMS)
_gram("N02_trigrams", lambda w: ngrams.ngrams(w, 3), _TRIGRAMS)
_gram("N03_bigrams_without_stops", lambda w: ngrams.ngrams_without(w, STOPS), _BIGRAMS, _BARE)
_gram("N04_trigrams_without_stops", lambda w: ngrams.ngrams_without(w, STOPS, 3), _TRIGRAMS, _BARE)
_gram("N09_ngram_range", lambda w: ngrams.ngram_range(w, 1, 3), f"list_concat(list_concat(w, {_BIGRAMS}), {_TRIGRAMS})")
_turns = lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", tokens.word_tokens(F.col("text")).alias("w"))
query("N05_with_bigrams", f"select conv_id, turn, array_to_string(list_concat(w, {_BIGRAMS}), '|') as v from (select conv_id, turn, {_BARE} as w from conversations) where len(w) > 0")(lambda s, d: ngrams.with_ngrams(_turns(s, d), "w", 2, STOPS).select("conv_id", "turn", F.array_join("grams", "|").alias("v")))
query("N06_with_trigrams", f"select conv_id, turn, array_to_string(list_concat(v, {_TRIGRAMS}), '|') as v from (select conv_id, turn, {TOKENS} as v, {_BARE} as w from conversations)")(lambda s, d: ngrams.with_ngrams(_turns(s, d), "w", 3, STOPS).select("conv_id", "turn", F.array_join("grams", "|").alias("v")))
query("N07_tile_counts", f"select token, count(*) as cnt from (select unnest(list_transform(range(0, len(w) // 2), lambda k: w[len(w) - 2 * k - 1] || ' ' || w[len(w) - 2 * k])) as token from (select {TOKENS} as w from documents)) group by token")(lambda s, d: vocabulary.word_counts(vocabulary.exploded(_table(s, d, "documents"), ["doc_id"], ngrams.tiles(tokens.word_tokens(F.col("text")), 2))))
query("N08_tiles_of_each", f"select item_id, array_to_string(list_transform(range(0, len(w) // 3), lambda k: w[len(w) - 3 * k - 2] || ' ' || w[len(w) - 3 * k - 1] || ' ' || w[len(w) - 3 * k]), '|') as v from (select item_id, {TOKENS} as w from benchmark)")(lambda s, d: _table(s, d, "benchmark").select("item_id", F.array_join(ngrams.tiles(tokens.word_tokens(F.col("text")), 3), "|").alias("v")))


# Joins
_LEM = _values(LEMMAS, "token, lemma")
query("J01_lemmatized", f"select doc_id, string_agg(lemma, ' ' order by tok_pos) as v from ({DOC_ROWS}) join {_LEM} using (token) group by doc_id")(lambda s, d: lemmas.regathered(lemmas.lemmatized(_doc_tokens(s, d), _dictionary(s)), ["doc_id"]).select("doc_id", _joined(F.col("tokens")).alias("v")))
query("L02_lemma_or_token", f"select doc_id, string_agg(coalesce(lemma, token), ' ' order by tok_pos) as v from ({DOC_ROWS}) left join {_LEM} using (token) group by doc_id")(lambda s, d: lemmas.regathered(lemmas.lemmatized(_doc_tokens(s, d), _dictionary(s), True), ["doc_id"]).select("doc_id", _joined(F.col("tokens")).alias("v")))
query("J02_in_vocabulary", f"select doc_id, tok_pos, token from ({DOC_ROWS}) where token in (select token from ({ITEM_ROWS}))")(lambda s, d: vocabulary.in_vocabulary(_doc_tokens(s, d), vocabulary.distinct_longer(_doc_tokens(s, d, "benchmark", "item_id"))).select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), "token"))
query("J03_not_stopped", f"select item_id, tok_pos, token from ({ITEM_ROWS}) where token not in {_in(STOPS)}")(lambda s, d: vocabulary.not_stopped(_doc_tokens(s, d, "benchmark", "item_id"), s.createDataFrame([(w,) for w in STOPS], "token string")).select("item_id", F.col("tok_pos").cast("long").alias("tok_pos"), "token"))
query("J05_zipped_by_position", "select doc_id, par_pos, par, length(par) as n from (select doc_id, unnest(range(1, len(p) + 1)) as par_pos, unnest(p) as par from (select doc_id, string_split(text, chr(10)) as p from documents))")(lambda s, d: lemmas.zipped(p := segments.paragraphs(_table(s, d, "documents"), "doc_id", "text", True), p.select("doc_id", "par_pos", F.length("par").cast("long").alias("n")), ["doc_id", "par_pos"]).select("doc_id", F.col("par_pos").cast("long").alias("par_pos"), "par", "n"))
query("J06_lemma_dictionary", f"select distinct token, left(token, 4) as lemma from ({DOC_ROWS})")(lambda s, d: lemmas.lemma_dictionary(_doc_tokens(s, d), F.substring("token", 1, 4)))
query("L01_analysed_words", f"select distinct token, token[::-1] as lemma from ({ITEM_ROWS})".replace("token[::-1]", "reverse(token)"))(lambda s, d: lemmas.lemma_dictionary(_doc_tokens(s, d, "benchmark", "item_id"), lambda w: w[::-1]))

# Vectors
_INDEX_ROWS = _rows("benchmark", "item_id", INDEXED)


def _index_tokens(spark: SparkSession, d: str, tab: str = "benchmark", key: str = "item_id") -> DataFrame:
    return vocabulary.exploded(_table(spark, d, tab), [key], vectors.indexer_tokens(F.col("text")))


query("V01_first_seen_index", f"select token, cast(row_number() over (order by f) - 1 as integer) as idx from (select token, min(struct_pack(a := item_id, b := tok_pos)) as f from ({ITEM_ROWS}) group by token)")(lambda s, d: vocabulary.first_seen_index(_doc_tokens(s, d, "benchmark", "item_id"), ["item_id", "tok_pos"]))
query("V03_counted_words", f"select item_id, token, count(*) as cnt from ({_rows('benchmark', 'item_id', TOKENS.replace(W, W + '+'))}) group by item_id, token")(lambda s, d: vocabulary.term_counts(vocabulary.exploded(_table(s, d, "benchmark"), ["item_id"], vectors.counted_words(F.col("text"))), "item_id"))
query("V05_term_index", f"select token, cast(row_number() over (order by cnt desc, f) as integer) as idx, cnt from (select token, count(*) as cnt, min(struct_pack(a := item_id, b := tok_pos)) as f from ({_INDEX_ROWS}) group by token)")(lambda s, d: vectors.term_index(_index_tokens(s, d), ["item_id", "tok_pos"]))
query("V10_index_of_two", f"select token, cast(row_number() over (order by cnt desc, f) as integer) as idx, cnt from (select token, count(*) as cnt, min(struct_pack(o := o, a := id, b := tok_pos)) as f from (select 0 as o, item_id as id, token, tok_pos from ({_INDEX_ROWS}) union all select 1, conv_id * 100 + turn, token, tok_pos from ({_rows('conversations', 'conv_id, turn', INDEXED)})) group by token)")(lambda s, d: vectors.term_index(_index_tokens(s, d).select(F.lit(0).alias("o"), F.col("item_id").alias("id"), "token", "tok_pos").unionByName(vocabulary.exploded(_table(s, d, "conversations"), ["conv_id", "turn"], vectors.indexer_tokens(F.col("text"))).select(F.lit(1).alias("o"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "token", "tok_pos")), ["o", "id", "tok_pos"]))
_DOC_INDEX_ROWS = _rows("documents", "doc_id", INDEXED)
_FITTED = f"with fit as ({_INDEX_ROWS}), df as (select token, count(distinct item_id) as df from fit group by token), n as (select count(distinct item_id) as n from fit), c as (select doc_id, token, count(*) as cnt from ({_DOC_INDEX_ROWS}) where token in (select token from df) group by doc_id, token) "
for _mode, _value in {"binary": "1.0::double", "count": "cast(cnt as double)", "freq": "round(cnt / sum(cnt) over (partition by doc_id), 9)", "tfidf": "round((1 + ln(cnt)) * ln(1 + n.n / (1 + df.df)), 9)"}.items():
    query(f"V{6 + list(vectors.MODES).index(_mode):02d}_{_mode}", f"{_FITTED} select doc_id, token, {_value} as value from c join df using (token), n")(lambda s, d, m=_mode: vectors.vectors(_index_tokens(s, d, "documents", "doc_id"), "doc_id", m, _index_tokens(s, d).select("token").distinct(), _index_tokens(s, d).withColumnRenamed("item_id", "doc_id")).withColumn("value", F.round("value", 9)))
query("V11_unknown_words", f"{_FITTED} select doc_id, coalesce(sum(cnt), 0)::bigint as known from (select distinct doc_id from documents) left join c using (doc_id) group by doc_id")(lambda s, d: _table(s, d, "documents").select("doc_id").distinct().join(vectors.vectors(_index_tokens(s, d, "documents", "doc_id"), "doc_id", "count", _index_tokens(s, d).select("token").distinct()), "doc_id", "left").groupBy("doc_id").agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("long").alias("known")))


# Search
def _acts(spark: SparkSession, d: str, of: Callable[[Column], Column]) -> DataFrame:
    texts = segments.split_paragraphs(F.col("text"))
    return _table(spark, d, "documents").select(F.col("doc_id").alias("act_id"), texts.alias("texts"), F.transform(texts, lambda p: of(p)).alias("pars"))


def _search(spark: SparkSession, d: str, of: Callable[[Column], Column], concluded: Callable[[Column], Column] | None = None) -> DataFrame:
    items = _table(spark, d, "benchmark").select("item_id", (concluded or of)(F.col("text")).alias("tokens"))
    found = search.conclusion_search(_acts(spark, d, of), items)
    return found.select("item_id", "act_id", "court", "requisites", F.round("cosine", 6).alias("cosine"), "paragraph")


def _search_sql(par_words: str, item_words: str) -> str:
    return f"""
with pars as ({PAR_ROWS}), raw as (select doc_id, {PARS} as p from documents),
p as (select doc_id, par_pos, unnest(x) as token from (select doc_id, par_pos, {par_words} as x from (select *, {TOKENS} as w from pars))),
pc as (select doc_id, par_pos, token, count(*) as n from p group by all),
ic as (select item_id, token, count(*) as n from (select item_id, unnest(x) as token from (select item_id, {item_words} as x from (select *, {TOKENS} as w from benchmark))) group by all),
cc as (select b.item_id, coalesce(sum(n * n), 0) + 1 as cc from benchmark b left join ic using (item_id) group by b.item_id),
met as (select item_id, doc_id, par_pos, sum(ic.n * pc.n) as dot, sum(pc.n * pc.n) as pp from pc join ic using (token) group by all),
every as (
  select item_id, doc_id, par_pos, round(1 - (coalesce(dot, 0) + 1) / (sqrt(cast(cc as double)) * sqrt(cast(coalesce(pp, 0) + 1 as double))), 9) as d
  from cc cross join pars left join met using (item_id, doc_id, par_pos)),
best as (select item_id, doc_id, min(struct_pack(d := d, par_pos := par_pos)) as b from every group by item_id, doc_id)
select item_id, doc_id as act_id, raw.p[1] as court, raw.p[3] as requisites, round(b.d, 6) + 0.0 as cosine, raw.p[b.par_pos] as paragraph
from best join raw using (doc_id)"""


_words_of = lambda grams: f"list_concat(w, flatten(list_transform({grams}, lambda g: string_split(g, ' '))))"
_REPEATED = f"list_filter(list_distinct({_BIGRAMS}), lambda g: len(list_filter({_BIGRAMS}, lambda x: x = g)) >= 2)"


@query("C04_conclusion_search", _search_sql("w", "w"))
def conclusion_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: for every conclusion and act, the act's nearest paragraph, its court and requisites."""
    return _search(spark, d, tokens.word_tokens)


_lemma_map = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in LEMMAS) + "}"


def _lemmatized(text: Column) -> Column:
    """By a small literal dictionary, words it lacks dropped; larger ones are joined (lemmas.lemmatized)."""
    known = F.create_map(*(F.lit(x) for pair in LEMMAS for x in pair))
    return F.filter(F.transform(tokens.word_tokens(text), lambda w: F.get(F.filter(F.array(known[w]), lambda x: x.isNotNull()), F.lit(0))), lambda x: x.isNotNull())


_LEMMATIZED = f"list_filter(list_transform(w, lambda x: {_lemma_map}[x]), lambda x: x is not null)"
query("C04_lemmatized_search", _search_sql(_LEMMATIZED, _LEMMATIZED))(lambda s, d: _search(s, d, _lemmatized))


def _with_repeated_bigrams(text: Column) -> Column:
    words = tokens.word_tokens(text)
    return search.with_gram_words(words, ngrams.repeated_ngrams(ngrams.ngrams(words)))


@query("C05_bigram_search", _search_sql(_words_of(_BIGRAMS), _words_of(_REPEATED)))
def _bigram_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, lambda t: search.gram_words(tokens.word_tokens(t), 2), _with_repeated_bigrams)


@query("C06_trigram_search", _search_sql(_words_of(_TRIGRAMS), _words_of(_TRIGRAMS)))
def _trigram_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, lambda t: search.gram_words(tokens.word_tokens(t), 3))


@query(
    "C04_nearest_acts",
    f"""
select item_id, place, act_id, cosine from (
  select item_id, act_id, cosine, cast(row_number() over (partition by item_id order by cosine, act_id) as integer) as place from ({_search_sql("w", "w")}))
where place <= 10""",
)
def _ranking(spark: SparkSession, d: str) -> DataFrame:
    """C04's order by distance, to ten places; distances are rounded first, as the SQL's are."""
    return search.nearest_acts(_search(spark, d, tokens.word_tokens), 10).select("item_id", "place", "act_id", "cosine")


@query(
    "C03_all_paragraphs",
    f"""
with pars as ({PAR_ROWS}),
pc as (select doc_id, par_pos, token, count(*) as n from (select doc_id, par_pos, unnest({TOKENS}) as token from pars) group by all),
items as (select * from benchmark where item_id <= (select min(item_id) + 2 from benchmark)),
ic as (select item_id, token, count(*) as n from (select item_id, unnest({TOKENS}) as token from items) group by all),
cc as (select i.item_id, coalesce(sum(n * n), 0) + 1 as cc from items i left join ic using (item_id) group by i.item_id),
met as (select item_id, doc_id, par_pos, sum(ic.n * pc.n) as dot, sum(pc.n * pc.n) as pp from pc join ic using (token) group by all)
select item_id, doc_id as act_id, cast(par_pos as integer) as par_pos,
  round(1 - (coalesce(dot, 0) + 1) / (sqrt(cast(cc as double)) * sqrt(cast(coalesce(pp, 0) + 1 as double))), 6) + 0.0 as cosine
from cc cross join pars left join met using (item_id, doc_id, par_pos)""",
)
def _all_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """C03 with output "all": every paragraph's distance from the first conclusions (their number is this query's, not a limit of the operator).

    Rounded once, and as the SQL's round() does it: scaled, to a whole number, ties away from zero.
    """
    items = _table(spark, d, "benchmark")
    few = items.filter(F.col("item_id") <= items.agg(F.min("item_id")).first()[0] + 2)
    found = search.conclusion_search(_acts(spark, d, tokens.word_tokens), few.select("item_id", tokens.word_tokens(F.col("text")).alias("tokens")), "all", places=None)
    return found.select("item_id", "act_id", "par_pos", (F.round(F.col("cosine") * 1e6) / 1e6).alias("cosine"))


_LATIN_ROWS = _rows("benchmark", "item_id", "regexp_extract_all(lower(text), '[a-z]+')")


def _c02_sql(direction: str) -> str:
    return f"""
with few as (select item_id from benchmark where item_id is not null order by item_id limit 22),
c as (select item_id, token, count(*) as n from ({_LATIN_ROWS}) where item_id in (select item_id from few) group by all),
q as (select token, n from c where item_id = (select min(item_id) from few)),
s as (
  select few.item_id, coalesce(sum(c.n * coalesce(q.n, 0)), 0)::double as dot, coalesce(sum(c.n * c.n), 0)::double as pp
  from few left join c using (item_id) left join q using (token) where few.item_id > (select min(item_id) from few) group by few.item_id),
far as (select item_id, case when pp > 0 then round(1 - dot / (sqrt((select sum(n * n)::double from q)) * sqrt(pp)), 9) + 0.0 end as distance from s)
select item_id, round(distance, 6) as distance, row_number() over (order by distance {direction} nulls last, item_id) as place from far"""


def _distances(spark: SparkSession, d: str, reverse: bool) -> DataFrame:
    """With the place that the operator's order gives each row."""
    items = _table(spark, d, "benchmark")
    counts = vocabulary.term_counts(vocabulary.exploded(items, ["item_id"], tokens.latin_tokens(F.col("text"))), "item_id")
    rows = search.sentence_distances(items, counts, "item_id", reverse=reverse).collect()  # 21 rows
    return spark.createDataFrame([(r.item_id, None if r.distance is None else round(r.distance, 6), k) for k, r in enumerate(rows, 1)], "item_id long, distance double, place long")


query("C02_sentence_distances", _c02_sql("asc"))(lambda s, d: _distances(s, d, False))
query("C02_reversed", _c02_sql("desc"))(lambda s, d: _distances(s, d, True))


# Models and shares
@query("M04_forward", f"with v as (select doc_id, token, count(*)::double as value from ({_rows('documents', 'doc_id', INDEXED)}) group by all), s as (select doc_id, unit, sum(value * w) as z from v join {_values(WEIGHTS, 'token, unit, w')} using (token) group by all) select doc_id, round(1 / (1 + exp(-(sum(greatest(coalesce(z, 0) + u.b, 0) * u.out) - 0.2))), 6) as p from (select distinct doc_id from documents) cross join {_values(UNITS, 'unit, b, out').replace(' t(', ' u(')} left join s using (doc_id, unit) group by doc_id")
def _forward(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    values = vectors.vectors(_index_tokens(spark, d, "documents", "doc_id"), "doc_id", "count")
    out = models.forward(docs, values, "doc_id", spark.createDataFrame(WEIGHTS, "token string, unit int, w double"), spark.createDataFrame(UNITS, "unit int, b double, out double"), -0.2)
    return out.select("doc_id", F.round("p", 6).alias("p"))


_SECTION = "select page_id, {label} as label, regexp_extract(html, '(?s){tag}(.+)/{tag}', 1) as part from pages where regexp_matches(html, '(?s){tag}.+/{tag}')"


def _section(spark: SparkSession, d: str, tag: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", segments.tagged_part(F.col("html"), tag).alias("part")).filter("part is not null")


@query("M05_section_labels", _SECTION.format(label=1, tag="title") + " union all " + _SECTION.format(label=0, tag="nav"))
def _section_labels(spark: SparkSession, d: str) -> DataFrame:
    """Sections of one tag are labelled 1, those of another 0, however many there are of each."""
    return files.labelled(_section(spark, d, "nav"), _section(spark, d, "title"))


@query("M10_sections_to_verdicts")
def _sections_to_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Sections of two tags train a net that judges the paragraphs of `benchmark`."""
    part = lambda tag: _section(spark, d, tag).select(F.col("page_id").cast("string").alias("id"), F.col("part").alias("text"))
    raw = _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return models.auto_mode(part("title"), part("nav"), raw, "id", "text", ["_id", "tok_pos"])
query("P01_shares", "select lang, count(*) as n, round(100 * count(*)::double / sum(count(*)) over (), 1) as share from documents group by lang")(lambda s, d: models.shares(_table(s, d, "documents"), "lang"))


def _quality_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, d, "labels").filter("quality is not null").join(_table(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").alias("label"), files.held_out(F.concat(F.lit("cv"), (F.col("doc_id") % 10).cast("string"))).alias("test"), "text")
    return docs, vocabulary.exploded(docs, ["doc_id"], vectors.indexer_tokens(F.col("text")))


@query("M08_mode_accuracy")
def _modes(spark: SparkSession, d: str) -> DataFrame:
    """Nets trained on each encoding, accuracy on the rows held out."""
    docs, rows = _quality_rows(spark, d)
    return models.evaluate_modes(docs, rows, "doc_id", ["doc_id", "tok_pos"])


@query("M06_predicted_paragraphs")
def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """A net trained on labelled texts judges every paragraph of the documents; its probability is put behind the likely ones."""
    docs, rows = _quality_rows(spark, d)
    index = vectors.term_index(rows, ["doc_id", "tok_pos"]).filter("cnt > 1").select("token", "idx")
    model = models.train(models.feature_rows(docs, vectors.vectors(rows, "doc_id", "binary", index), "doc_id", index))
    pars = segments.paragraphs(_table(spark, d, "documents"), "doc_id", "text").withColumn("id", F.concat_ws(":", "doc_id", "par_pos"))
    values = vectors.vectors(vocabulary.exploded(pars, ["id"], vectors.indexer_tokens(F.col("par"))), "id", "binary", index)
    judged = models.probabilities(model, models.feature_rows(pars, values, "id", index))
    return judged.select("doc_id", "par_pos", tokens.with_verdict(F.col("par"), F.round("p", 6), "quality").alias("par"))


query("M09_topics")(lambda s, d: models.topics(_table(s, d, "documents"), tokens.word_tokens(F.col("text"))))
