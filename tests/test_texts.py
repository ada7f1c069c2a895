"""Segmenter and tokenizer, alone and over rows, batch and stream."""

import pickle

import pytest
from pyspark.sql import functions as F

from lexloom.operators import cleaner, segmenter, tokenizer
from lexloom.streaming import streams

PLAIN = segmenter.Segmenter()
DEFAULT = segmenter.Segmenter.default()
WORDS = tokenizer.Tokenizer.default()


def test_plain_sentences():
    assert PLAIN("A b. C d! E\nf? g") == ["A b.", "C d!", "E", "f?", "g"]
    assert PLAIN("") == [] and PLAIN(None) == [] and PLAIN("  \n ") == []


def test_default_rules():
    assert DEFAULT("Dr. Meier kam am 3. Mai 1990. Er ging (vgl. Abb. 2) heim. Ende") == ["Dr. Meier kam am 3. Mai 1990.", "Er ging (vgl. Abb. 2) heim.", "Ende"]
    assert DEFAULT('He said "Stop." Then he left. See www.example.com now.') == ['He said "Stop."', "Then he left.", "See www.example.com now."]
    assert DEFAULT("One. two three. Four") == ["One. two three.", "Four"]


def test_vetoes():
    s = segmenter.Segmenter(before=frozenset({"abc."}), after=frozenset({"pdf"}), before_rules=((r"\d+", False), (r"[A-Z]", True), (r"\w", False)), after_rules=((" x.*", False),))
    assert s("Abc. D. e. 5. abc. z x. y") == ["Abc. D.", "e. 5. abc. z x. y"]
    # the entry is one token; without a blank after it there is no token and no veto
    assert s("file.pdf has. Ends.pdf") == ["file.pdf has.", "Ends.", "pdf"]
    assert s("q. xyz w. r") == ["q. xyz w. r"]


def test_line_flags():
    text = "a\n\nb\nc"
    assert segmenter.Segmenter(line_feed=False)(text) == ["a", "b c"]
    assert segmenter.Segmenter(line_feed=False, empty_line=False)(text) == ["a b c"]
    assert segmenter.Segmenter(trim=False)("a  b. c") == ["a  b.", " c\n"]


def test_earliest_boundary_wins():
    s = segmenter.Segmenter(boundaries=('."', ".", "!"))
    assert s.split('a." b. c') == ['a."', " b.", " c"]


def test_files(tmp_path):
    (tmp_path / "r").write_text("+ a\n- b\nnone\n- (\n# c\n")
    assert segmenter.read_decisions(tmp_path / "r") == [("a", True), ("b", False)]
    assert segmenter.read_entries(None) == [] and segmenter.read_entries(tmp_path / "missing") == []
    assert segmenter.Segmenter.from_files().plain()


def test_segment_columns(spark):
    texts = ["A b. C  d! E\nf? g", "", None, "x\r\ny z. ", "no end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    for s in (PLAIN, DEFAULT, pickle.loads(pickle.dumps(DEFAULT))):
        got = [r["sentences"] for r in segmenter.segment(df, s).orderBy("i").collect()]
        assert got == [s(t) for t in texts]
    rows = segmenter.sentence_rows(segmenter.segment(df.select("i", "content"), PLAIN).select("i", "sentences"))
    assert rows.where("i = 0").count() == 5
    custom = df.withColumn("s", segmenter.text_function(lambda t: (t or "").split("b"), "array<string>")(F.col("content")))
    assert custom.where("i = 0").first()["s"] == ["A ", ". C  d! E\nf? g"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Hello, world!", "Hello , world !"),
        ('He said "yes".', 'He said " yes " .'),
        ("Wait... what?", "Wait ... what ?"),
        ("Das (hier) ist gut.", "Das ( hier ) ist gut ."),
        ("Dr. Meier kam um 10:30 Uhr.", "Dr. Meier kam um 10:30 Uhr ."),
        ("C++ and AC/DC.", "C++ and AC/DC ."),
        ("Es kostet 3,50 €.", "Es kostet 3,50 € ."),
        ("a  b ", "a b"),
        ("%^% x %$%", "%^% x %$%"),
        ("", ""),
    ],
)
def test_tokens(raw, want):
    assert WORDS(raw) == want


def test_token_options():
    assert tokenizer.Tokenizer(WORDS.actions, replace_numbers=True)("It was 1.5 in 1990") == "It was %N% in %N%"
    delete = tokenizer.Tokenizer({"-": (2, 2, 2, 2)})
    assert delete("-a- b") == "a b" and WORDS(None) is None
    assert WORDS("!!!!!!") and pickle.loads(pickle.dumps(WORDS))("a.") == "a ."


def test_tokenize_rows(spark):
    df = spark.createDataFrame([("Hello, world!",), (None,)], "sentence string")
    assert [r["tokenized"] for r in tokenizer.tokenize(df, WORDS).collect()] == ["Hello , world !", None]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"location":"l","date":"d","content":"Das ist ein ganz normaler Satz ohne Fehler. kurz. Noch ein ganz normaler Satz ohne Fehler."}\n')
    rules = cleaner.load_rules()
    docs = streams.read_document_stream(spark, str(folder))
    streams.write_stream(streams.sentence_stream(docs, PLAIN, rules, WORDS), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = streams.sentence_stream(spark.read.schema("location string, date string, content string").json(str(folder)), PLAIN, rules, WORDS)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() == 2


def test_windowed_rejections(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "kurz."), ("2024-01-01 00:50:00", "auch."), ("2024-01-01 01:10:00", "nein.")], "t string, sentence string").withColumn("t", F.to_timestamp("t"))
    rows = streams.rejections_by_window(df, cleaner.load_rules(), "t").collect()
    assert sorted(r["hits"] for r in rows) == [1, 2]


def test_a_batch_is_made_piece_by_piece(spark):
    """What Python holds at a time doesn't grow with the batch."""

    class Made(list):
        alive = most = 0

        def __init__(self, *a):
            super().__init__(*a)
            Made.alive += 1
            Made.most = max(Made.most, Made.alive)

        def __del__(self):
            Made.alive -= 1

    df = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("content"))
    most = segmenter.text_function(lambda t: Made([str(len(t)), str(Made.most)]), "array<string>")
    rows = df.select(most(F.col("content")).alias("s")).collect()
    assert len(rows) == 4000 and {r["s"][0] for r in rows} == {"1000"}
    assert max(int(r["s"][1]) for r in rows) <= 1002


def test_exploded_sentences_are_made_once(spark):
    df = spark.createDataFrame([(1, "A b. C d.")], "i int, content string")
    rows = segmenter.sentence_rows(segmenter.segment(df, DEFAULT).select("i", "sentences"))
    assert str(rows._jdf.queryExecution().executedPlan().toString()).count("ArrowEvalPython") == 1 and rows.count() > 0
