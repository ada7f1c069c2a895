"""Cleaner, text functions, hashes, statistics, vocabulary, language and files on small rows."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import hashing, text
from lexloom.operators import align, annotate, cleaner, files, lani, mwu, stats, tokenizer, vocabulary

GOOD = "Das ist ein ganz normaler Satz ohne Fehler."
#: rule -> a sentence that it rejects
BAD = {
    1: "das beginnt mit einem kleinen Buchstaben.",
    2: ")Das beginnt mit einer Klammer am Anfang.",
    3: "Hier fehlt am Ende das Satzzeichen doch",
    5: "Das ist s p e r r a t i v geschrieben worden.",
    6: "Hier sind  zwei Leerzeichen im Satz gewesen.",
    7: "Eins, zwei, drei, vier, fuenf, sechs, sieben, acht, neun, zehn, elf.",
    8: "A.b. c.d. e.f. g.h. und so weiter im Text.",
    9: "A " * 51 + "ende.",
    10: "A b c d e f g h i j k l.",
    11: "Das [hier] steht in eckigen Klammern.",
    12: "A/b/c/d/e/f/g/h/i sind viele Schraegstriche.",
    13: "DAS IST ALLES GANZ GROSS GESCHRIEBEN worden.",
    14: "Die Nummer 0123456789012345 ist sehr lang.",
    15: "Kurz 12.34.56 mit Zahlen drin.",
    16: "Das ist ein Satz der so aufhoert . . .",
    17: "Das ist ... mit Punkten in der Mitte.",
    18: "Was soll das denn?? Das ist zu viel.",
    19: "Der Herr Doktor Hans Peter Karl Otto Meier kam.",
    20: "Das Leerzeichen steht falsch , oder nicht?",
    21: "Das ist von Johann B.",
    22: "Zu kurz.",
    23: "Lang" + "lang " * 60 + "ist das.",
    24: "Ein\tTabulator steht in diesem Satz.",
    25: "Ein weiches­Trennzeichen steht in dem Satz.",
    26: "#Das beginnt mit einem Gitterzeichen hier.",
    27: "Ein # steht in der Mitte des Satzes hier.",
    28: "Das a = b ist eine Gleichung im Satz hier.",
    29: "Das {hier} steht in geschweiften Klammern.",
    30: "Der Satz endet mit einem Doppelpunkt hier:",
    31: "Hier * sind * drei * Sterne in dem Satz.",
    32: "Das &auml; ist eine Entitaet in dem Satz.",
    33: "Das?hier ist falsch in diesem Satz gesetzt.",
    34: "Der Satz endet mit Komma und Name, B.",
    35: "12345 Einwohner hat die Stadt am Fluss.",
    36: "Ein Smiley \U0001f600 steht in diesem Satz hier.",
    37: "Ein Trenner steht in diesem Satz hier.",
    38: "Der Satz endet. und dann geht es weiter so.",
    39: "Das sind zwei.. Punkte in der Mitte gewesen.",
    40: "7 Tage hat die Woche in jedem Jahr gehabt.",
}


def values(spark, rows, expression, name="s"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r["x"] for r in df.select("i", expression(F.col(name)).alias("x")).orderBy("i").collect()]


def test_each_rule_rejects(spark):
    rules = cleaner.load_rules()
    assert len(rules) == 39 and {r.number for r in rules} == set(BAD)
    got = values(spark, [GOOD, *BAD.values()], lambda s: cleaner.reasons(s, rules))
    assert got[0] == []
    assert [n for n, found in zip(BAD, got[1:]) if n not in found] == []


@pytest.mark.parametrize("text_type, lang, count", [(None, None, 39), (None, "chr", 37), (None, "fas", 39), (None, "ces", 40), ("web", None, 40)])
def test_layers(text_type, lang, count):
    rules = cleaner.load_rules(text_type=text_type, lang_code=lang)
    assert len(rules) == count
    if lang == "fas":
        assert rules[-1].number == 23 and rules[-1].max_length == 400


def test_rule_language(spark):
    rules = cleaner.parse_rules("# c\nrule 1\nDESC: d\nregexp:a+\nMINLENGTH:9\n\nRULE 2\nDESC: nothing\nRULE 3\nREGEXP:$UNMATCHABLE\nRULE 4\nHEX_REGEXP:^c3\nRULE 5\nREPLACE_CHARS:xy \nREPLACE_COUNT:3\n", "file")
    assert rules[1].description == "file: d" and 2 not in rules and rules[3].disabled and rules[5].replace_chars == "xy "
    layered = cleaner.layered([rules, cleaner.parse_rules("RULE 1\nREGEXP:zz\nRULE 4\nDISABLE\n")])
    assert [r.number for r in layered] == [5, 1]
    got = values(spark, ["aa", "aaaaaaaaaaaa", "ü", "x y", "xy"], lambda s: cleaner.reasons(s, [rules[1], rules[4], rules[5]]))
    assert got == [[1], [], [4], [5], []]


def test_clean_and_replace(spark):
    pairs = cleaner.parse_replacements("# none\n&a;\tb\nbb\tc\n&sp;\t \n")
    assert pairs == [("&a;", "b"), ("bb", "c")]
    df = spark.createDataFrame([("&a;b",), (None,), ("",), ("zz",)], "sentence string")
    rules = cleaner.layered([cleaner.parse_rules("RULE 1\nREGEXP:z")])
    assert [r[0] for r in cleaner.clean(df, rules, replacements=pairs).collect()] == ["c"]
    assert cleaner.clean(df, rules, custom=lambda s: s != "&a;b").count() == 0
    nested = spark.createDataFrame([(["zz", "ok", ""],)], "sentences array<string>")
    assert cleaner.clean_arrays(nested, rules).first()[0] == ["ok"]
    assert annotate.annotate_cleaning(df.where("sentence = 'zz'"), rules).first()["filter_reasons"][0]["id"] == 1


def test_lines_and_blanks(spark):
    rows = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc\x0bd\x1ce\x85f g", "\n"]
    assert values(spark, rows, text.lines) == [r.splitlines() for r in rows]
    rows = ["", " a  b ", "a\xa0b　c\x1fd\te", " x"]
    assert values(spark, rows, text.tokens) == [r.split() for r in rows]
    assert values(spark, rows, text.strip) == [r.strip() for r in rows]


def brute_hash(units):
    h = 0

    def wrap(x):
        return (x + 2**31) % 2**32 - 2**31

    for u in units[:15]:
        h = wrap(h * 37 + u)
    if len(units) > 15:
        for u in units[15 :: max(1, len(units) // 16)]:
            h = wrap(h * 39 + u)
    return abs(h)


def test_hashes(spark):
    rows = ["", "a", "Hello world, this is long enough to be sampled " * 5, "ünï\U0001f600", "x" * 15, "y" * 16, "z" * 40]
    assert values(spark, rows, hashing.string_hash) == [brute_hash([ord(c) for c in r]) for r in rows]
    assert values(spark, rows, hashing.bucket_id) == [brute_hash([b - 256 * (b > 127) for b in r.encode()]) for r in rows]
    got = values(spark, ["a big elephant and " + "x" * 36 + " " + "y" * 35], lambda s: hashing.word_length_signature(F.split(s, " ")))
    assert got == ["abig8and0z"]
    assert hashing.bytes_int(hashing.int_bytes(-5)) == -5 and len(hashing.long_bytes(1)) == 8


def test_statistics(spark):
    docs = spark.createDataFrame([("a", "d1", "x y\n"), ("a", "d2", "z\r\nq é"), (None, None, "")], "location string, date string, content string")
    assert tuple(stats.document_stats(docs).first()) == (3, 3, 5, 10, 2, 3, 3)
    assert stats.stats_tsv(stats.document_stats(docs.limit(0))).first()[0] == "\t" * 6
    s = spark.createDataFrame([("a b", "l"), ("c", None)], "sentence string, location string")
    assert tuple(stats.sentence_stats(s).first()) == (2, 2, 3, 4)
    assert stats.stats_tsv(stats.sentence_stats(s.limit(0))).first()[0] == "0\t0\t0\t0"
    assert stats.stats_json(stats.sentence_stats(s)).first()[0].startswith("{")


def test_numbers(spark, tmp_path):
    df = spark.createDataFrame([("b a a c", "s", "2024-01-02"), ("c  a zz", "s", None), ("b", None, "bad")], "tokenized string, location string, date string").withColumn("sent_id", F.monotonically_increasing_id())
    words = vocabulary.word_numbers(vocabulary.word_frequencies(df))
    assert [tuple(r) for r in words.orderBy("word_id").collect()] == [(1, "a", 3), (2, "b", 2), (3, "c", 2), (4, "zz", 1)]
    sources = vocabulary.source_numbers(df)
    assert [tuple(r) for r in sources.orderBy("source_id").collect()] == [(1, "s", "2024-01-02", 1), (2, "s", "NULL", 1), (3, "NULL", "bad", 1)]
    known = tmp_path / "known.txt"
    known.write_text("5\tb\n9\tq\n5\tc\n")
    next_id, table = vocabulary.read_known_words(spark, str(known))
    assert next_id == 10 and vocabulary.read_known_words(spark, str(tmp_path / "none"))[0] == 1
    catalog = vocabulary.external_numbers(words, table, next_id, unseen=True)
    assert {(r["word"], r["word_nr"], r["freq"]) for r in catalog.collect()} == {("b", 5, 2), ("c", 5, 2), ("q", 9, 0), ("a", 10, 3), ("zz", 11, 1)}
    index = vocabulary.sentence_index(df, words, sources, number="word_id")
    got = {(r["source_id"], r["ts_min"], tuple(r["word_ids"])) for r in index.collect()}
    assert got == {(1, 28402560, (2, 1, 1, 3)), (2, -100, (3, 1, 4)), (3, -100, (2,))}
    assert len(vocabulary.encode_index_row(1, 2, 3, [4, 5], [([0, 1], 7)])) == 4 * 12


def test_index_of_odd_sentences(spark, monkeypatch):
    """Blocks of few rows; a key twice, no key, no text, words and sources without number, no words at all."""
    monkeypatch.setattr(vocabulary, "BLOCK_BYTES", 40)
    monkeypatch.setattr(vocabulary, "FREQUENT_WORDS", 1)
    rows = [(1, "a b  a", "s", "2024-01-02"), (2, "", "s", "2024-01-02"), (3, None, None, None), (4, "x y", "none", None), (5, "b a q", "s", "2024-01-02"), (5, "a c b a", "s", "bad"), (5, "c", "none", None), (None, "a", "s", "bad")]
    rows += [(i, "c b", "s", "2024-01-02") for i in range(10, 20)]
    df = spark.createDataFrame(rows, "sent_id long, tokenized string, location string, date string").coalesce(1)
    words = spark.createDataFrame([(7, "a"), (2**40, "b"), (9, "c"), (1, "")], "word_nr long, word string")
    sources = spark.createDataFrame([(1, "s", "2024-01-02"), (2, "NULL", "NULL"), (3, "s", "bad")], "source_id long, source string, date string")
    got = vocabulary.sentence_index(df, words, sources)
    assert got.columns == ["sent_id", "source_id", "ts_min", "word_ids"]
    day, b = 28402560, 2**40
    five = tuple(n for _, n in sorted([(0, b), (1, 7), (0, 7), (1, 9), (2, b), (3, 7), (0, 9)]))
    want = {(1, 1, day, (7, b, 7)), (2, 1, day, ()), (3, 2, -100, ()), (5, 1, day, five), (5, 3, -100, five), (None, 3, -100, ())} | {(i, 1, day, (9, b)) for i in range(10, 20)}
    found = [(r["sent_id"], r["source_id"], r["ts_min"], tuple(r["word_ids"])) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def shuffled_rows(spark) -> int:
    """Rows that all stages of the session so far have written to shuffles."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_index_of_many_words_moves_no_tokens(spark, monkeypatch):
    """Also if the words are too many to be broadcast."""
    monkeypatch.setattr(vocabulary, "BROADCAST_ROWS", 0)
    df = spark.range(2000).select(F.col("id").alias("sent_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("w"), (F.col("id") + i) % 100)), " ").alias("tokenized"), F.lit("s").alias("location"), F.lit("2024-01-02").alias("date"))
    words = spark.range(100).select(F.col("id").alias("word_nr"), F.concat(F.lit("w"), F.col("id")).alias("word"))
    sources = spark.createDataFrame([(1, "s", "2024-01-02")], "source_id long, source string, date string")
    before = shuffled_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = vocabulary.sentence_index(df, words, sources).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 2000 and all(r["word_ids"] == [(r["sent_id"] + i) % 100 for i in range(50)] for r in rows)
    assert shuffled_rows(spark) - before < 20_000  # of 100,000 tokens


def test_units(spark):
    units = spark.createDataFrame([("new york", "New York"), ("york city", "York City")], "unit_tok string, unit string")
    df = spark.createDataFrame([(1, "in new york city"), (2, "new york"), (3, "york")], "id int, tokenized string")
    found = mwu.find_units(df, units, ["id"])
    assert {(r["id"], r["pos"], r["unit"]) for r in found.collect()} == {(1, 1, "New York"), (1, 2, "York City"), (2, 0, "New York")}
    assert mwu.find_units(df, units, ["id"], compat=True).count() == 4
    assert mwu.UnitTokenizer(str, {"new york": "New_York"})("in new york , newer york") == "in New_York , newer york"


def test_language(spark, tmp_path):
    (tmp_path / "aa.words").write_text("100\n20\tder\n10\tund\n5\tder\n")
    (tmp_path / "bb.words").write_text("100\n30\tthe\n10\tund\n")
    words = lani.read_wordlists(spark, tmp_path)
    assert {tuple(r) for r in words.collect()} == {("aa", "der", 0.2), ("aa", "und", 0.1), ("bb", "the", 0.3), ("bb", "und", 0.1)}
    with pytest.raises(ValueError):
        lani.read_wordlists(spark, tmp_path, ["cc"])
    with pytest.raises(FileNotFoundError):
        lani.read_wordlists(spark, tmp_path / "none")
    df = spark.createDataFrame([(1, "der und, der"), (2, "the"), (3, "xx yy"), (4, "the und the und zz")], "id int, sentence string")
    scored = lani.scores(df, words, ["id"])
    got = {(r["id"], r["lang"]): (r["score"], r["coverage"], r["wordcount"]) for r in scored.collect()}
    # a language that lacks a word has 0.1 / n of its mass
    assert got[1, "aa"][0] == pytest.approx(1 / (1 + 0.05**2)) and got[1, "aa"][1:] == (1.0, 3) and got[3, "bb"] == (0.5, 0.0, 0)
    best = {r["id"]: (r["language"], r["probability"]) for r in lani.best(scored, ["id"]).collect()}
    assert best == {1: ("aa", 100), 2: ("unknown", 0), 3: ("unknown", 0), 4: ("bb", 100)}
    known = annotate.language_struct(lani.best(scored, ["id"]), ["id"]).where("id = 1").first()["language"]
    assert tuple(known) == ("aa", 1.0)
    assert lani.scores(df, words, ["id"], filter_list=spark.createDataFrame([("the",)], "word string")).where("id = 2 and wordcount > 0").count() == 0
    docs = spark.createDataFrame([(1, "der und der und\nthe und the\n\nder der und")], "id int, content string")
    parts = {r["language"]: r["content"] for r in lani.split_by_language(docs, words, ["id"]).collect()}
    assert parts == {"aa": "der und der und\nder der und", "bb": "the und the", "unknown": ""}


def test_config(tmp_path):
    (tmp_path / "a.ini").write_text("wordlists = lists/plain\nlimit = 3\n")
    assert lani.read_config(tmp_path / "a.ini") == {"wordlists": str(tmp_path / "lists/plain"), "limit": "3"}


def test_alignment(spark):
    df = spark.createDataFrame([("Hello, world!", "Hello , world !"), ("a b", "a c"), ("a b", "a")], "raw string, tok string")
    tokens = align.split_tokens(F.col("tok"))
    starts = align.token_starts(F.col("raw"), tokens)
    rows = df.select(starts.alias("s"), align.token_glue(tokens, starts).alias("g")).collect()
    assert [tuple(r) for r in rows] == [([0, 5, 7, 12], [True, False, True]), (None, None), (None, None)]
    with pytest.raises(Exception, match="align"):
        df.select(align.token_starts(F.col("raw"), tokens, strict=True)).collect()
    first = df.select(annotate.token_structs(F.col("raw"), F.col("tok")).alias("t")).first()["t"]
    assert [(x["text"], x["space_after"], x["is_sent_start"]) for x in first] == [("Hello", False, True), (",", True, False), ("world", False, False), ("!", False, False)]


def test_slices_and_splits(spark):
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate([5, 5, 30, 1, 9, 1])], "path string, doc_ord long, length long")
    assert [r["doc_ord"] for r in files.slice_documents(df, 2, 3).orderBy("doc_ord").collect()] == [1, 2]
    assert files.slice_documents(df, 4).count() == 3
    for bad in ((None, None), (0, 1), (3, 2)):
        with pytest.raises(ValueError):
            files.slice_documents(df, *bad)
    parts = lambda d: [r["part"] for r in d.orderBy("doc_ord").collect()]
    assert parts(files.split_by_documents(df, 4)) == [1, 1, 1, 1, 2, 2]
    assert parts(files.split_by_bytes(df, 10)) == [1, 1, 2, 3, 3, 4]
    assert parts(files.split_by_bytes(df, 100, max_docs=2)) == [1, 1, 2, 2, 3, 3]
    with pytest.raises(FileNotFoundError):
        files.merge_documents([])
    assert files.file_names("d/a.txt", 1, 3) == ["d/a_001.txt", "d/a_002.txt"]
    assert files.file_names("a.txt", 7, 8, where="prefix") == ["007_a.txt"] and files.file_names("a", 7, 8, "-", 1, "suffix") == ["a-7"]


def test_number_replacement(spark):
    assert values(spark, ["12.5-3", "a1", "%"], tokenizer.number_replaced) == ["%N%", "a1", "%N%"]
