"""Readers and writers, conversions, workflows, command line."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexloom import cli
from lexloom.operators import cleaner, segmenter, tokenizer
from lexloom.plans import workflows
from lexloom.sources import formats, sentences, source_docs, warc

DOCS = (
    "lost line\n<source><location>http://a.example/1</location><date>2024-01-05</date></source>\nFirst line here.\nSecond. one\n"
    "<source><location>http://a.example/2</location></source>\nÜber zwei.\n\n"
    "<source><nothing>x</nothing><y></y></source>\nlost\n"
    "<source><location></location><date>2024-01-07</date><encoding>utf-8</encoding><z>1</z></source>\nno end"
)


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


@pytest.fixture
def source_file(tmp_path):
    p = tmp_path / "in.source"
    p.write_text(DOCS, encoding="utf-8")
    return p


def test_headers():
    assert source_docs.is_header("<source><location>x</location></source>") and source_docs.is_header(b"<source><date></date></source>\n")
    assert not any(map(source_docs.is_header, ["", "<source></source>", "<source>x</source>", "x<source><a></a></source>", "<source><a></source>"]))
    assert source_docs.parse_header("<source><location>a</location></source>") == ("a", None, [])
    assert source_docs.parse_header("<source><location></location><date></date></source>") == ("", "", [])
    assert source_docs.parse_header("<source><other>1</other></source>") is None
    line = '<source><location>a</location><date>b</date><x>1</x><languages ls-version="1.2">e</languages><encoding>u</encoding></source>'
    assert source_docs.parse_header(line) == ("a", "b", ["<encoding>u</encoding>", '<languages ls-version="1.2">e</languages>', "<x>1</x>"])
    assert source_docs.header_text("a", None, ["<x>1</x>"]) == "<source><location>a</location><date></date><x>1</x></source>\n"


@pytest.mark.parametrize("step", [1 << 27, 40, 7])
def test_source_ranges(spark, source_file, step):
    rows = source_docs.read_source(spark, str(source_file), rangeBytes=str(step)).orderBy("doc_ord").collect()
    assert [r["location"] for r in rows] == ["http://a.example/1", "http://a.example/2", ""]
    assert [r["date"] for r in rows] == ["2024-01-05", None, "2024-01-07"]
    assert [r["content"] for r in rows] == ["First line here.\nSecond. one\n", "Über zwei.\n\n", "no end"]
    assert rows[2]["extra"] == ["<encoding>utf-8</encoding>", "<z>1</z>"]
    raw = DOCS.encode()
    assert all(raw[r["offset"] : r["offset"] + r["length"]].decode().endswith(r["content"]) for r in rows)
    if step == 1 << 27:
        assert rows[0]["offset"] == 0
        assert source_docs.read_source(spark, str(source_file), includeContent="false").where("content is not null").count() == 0


def test_source_round_trip(spark, source_file, tmp_path):
    docs = source_docs.read_source(spark, str(source_file))
    source_docs.write_source(docs, str(tmp_path / "out"), single=True)
    again = source_docs.read_source(spark, str(tmp_path / "out")).orderBy("doc_ord").collect()
    assert [(r["location"], r["date"], r["content"].rstrip("\n")) for r in again] == [(r["location"], r["date"] or "", r["content"].rstrip("\n")) for r in docs.orderBy("doc_ord").collect()]
    df = spark.createDataFrame([("l", "d", None), ("l", "d", "")], "location string, date string, content string")
    made = [r[0] for r in df.select(source_docs.source_text(F.col("location"), F.col("date"), F.col("content"))).collect()]
    head = "<source><location>l</location><date>d</date></source>"
    assert made == [head, head + "\n"]


def test_medusa(spark, tmp_path):
    p = tmp_path / "a.medusa"
    p.write_text("s one\t2024-01-01\tloc\nbad line\nx\ty\t\n\"q\t2024\tl \n")
    assert [tuple(r)[1:] for r in sentences.read_medusa(spark, str(p)).orderBy("date").collect()] == [('"q', "2024", "l"), ("s one", "2024-01-01", "loc")]
    df = spark.createDataFrame([(["a\tb", "c"], "d", None)], "sentences array<string>, date string, location string")
    sentences.write_medusa(df, str(tmp_path / "out"), single=True)
    assert text_of(tmp_path / "out") == "a b\td\tunknown source\nc\td\tunknown source\n"


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    lines = ['{"location":"l","date":null,"content":"c"}', '{"location":"l","date":"d"}', "bad", '{"location":"l","date":"d","sentence":"s","sentences":["x"]}', '{"location":"l","date":"d","sentences":["x","y"]}']
    p.write_text("\n".join(lines))
    assert [tuple(r)[1:4] for r in sentences.read_document_jsonl(spark, str(p)).collect()] == [("l", None, "c")]
    assert sorted(r["sentences"] for r in sentences.read_sentence_jsonl(spark, str(p)).collect()) == [["s"], ["x", "y"]]
    assert sentences.read_sentence_jsonl(spark, str(p), single=True).count() == 3
    df = spark.createDataFrame([("l", None, "é\n", ["t"])], "location string, date string, content string, extra array<string>")
    assert json.loads(sentences.document_json(df, extra=True).first()["line"]) == {"location": "l", "date": None, "content": "é\n", "extra_meta": ["t"]}


def test_long_json_strings(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    long = "q" * 20_000_001
    p.write_text("\n".join(json.dumps({"location": "l", "date": "d", k: v}) for k, v in (("content", long), ("sentences", [long, "r"]))))
    assert [len(r["content"]) for r in sentences.read_document_jsonl(spark, str(p)).collect()] == [len(long)]
    assert [[len(s) for s in r["sentences"]] for r in sentences.read_sentence_jsonl(spark, str(p)).collect()] == [[len(long), 1]]


def record(kind, body, extra=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    plain = record("warcinfo", b"i") + record("response", b"HTTP/1.1 200 OK\r\n\r\nhi", "WARC-Target-URI: http://x/\r\nWARC-Date: 2020-02-03T04:05:06Z\r\nWARC-Record-ID: <urn:1>\r\n") + record("request", b"") + record("conversion", b"text")
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (plain[:100], plain[100:])))
    for name in ("a.warc", "b.warc.gz"):
        rows = warc.read_warc(spark, str(tmp_path / name)).orderBy("doc_ord").collect()
        assert [(r["record_type"], r["content"]) for r in rows] == [("response", "HTTP/1.1 200 OK\r\n\r\nhi"), ("conversion", "text")]
        assert (rows[0]["location"], rows[0]["date"], rows[0]["record_id"]) == ("http://x/", "2020-02-03", "<urn:1>") and rows[1]["location"] == "unknown source"
        assert plain[rows[0]["offset"] :].startswith(b"WARC/1.0\r\nWARC-Type: response")
        assert warc.read_warc(spark, str(tmp_path / name), ()).count() == 4
    df = spark.createDataFrame([("p", 1, "http://y/", "2024-01-01", "é"), ("p", 2, "http://z/", "2024-01-01", None)], "path string, doc_ord long, location string, date string, content string")
    warc.write_warc(df, str(tmp_path / "out"), single=True)
    got = warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert [(r["location"], r["date"], r["content"]) for r in got] == [("http://y/", "2024-01-01", "é")]
    assert "WARC-Payload-Digest" in got[0]["headers"]
    warc.write_warc(df, str(tmp_path / "out2"), write_empty=True)
    assert warc.read_warc(spark, str(tmp_path / "out2")).count() == 2


def test_formats(tmp_path):
    names = {"a.warc": "warc", "a.WET": "warc", "a.arc": "warc", "x.jsonl": "jsonl", "x.jsonlines": "jsonl", "a.source": "source", "a.medusa": "medusa", "a.json": None, "a.warc.gz": None, "a": None, "": None}
    assert {n: formats.detect_format(n) for n in names} == names
    with pytest.raises(ValueError):
        formats.check_format("tokenize", "a.source")
    with pytest.raises(ValueError):
        formats.check_conversion("jsonl", "source")
    (tmp_path / "s").mkdir()
    for n in ("a.txt", "b.txt", "s/c.txt"):
        (tmp_path / n).write_text("")
    assert len(formats.find_files(tmp_path, "*.txt")) == 2 and len(formats.find_files(tmp_path, "*.txt", recursive=True)) == 3
    for bad in ("../x", "**/x"):
        with pytest.raises(ValueError):
            formats.find_files(tmp_path, bad)


def test_workflows(spark, source_file, tmp_path):
    out = lambda n: tmp_path / n
    workflows.segment_files(spark, str(source_file), str(out("seg.medusa")), segmenter.Segmenter(), single=True)
    assert [x.split("\t")[0] for x in text_of(out("seg.medusa")).splitlines()] == ["First line here.", "Second.", "one", "Über zwei.", "no end"]
    rules = cleaner.layered([cleaner.parse_rules("RULE 1\nREGEXP:^[Sn]")])
    workflows.clean_files(spark, str(source_file), str(out("clean.source")), rules, single=True)
    kept = source_docs.read_source(spark, str(out("clean.source"))).orderBy("doc_ord").collect()
    assert [r["content"].strip() for r in kept] == ["First line here.", "Über zwei.", ""]
    workflows.clean_files(spark, str(source_file), str(out("clean.warc")), rules)
    assert warc.read_warc(spark, str(out("clean.warc"))).count() == 2
    with pytest.raises(ValueError):
        workflows.clean_files(spark, "a.medusa", "b.source", rules)
    workflows.tokenize_files(spark, str(out("seg.medusa")), str(out("tok.jsonl")), tokenizer.Tokenizer.default(), single=True)
    assert {json.loads(x)["sentence"] for x in text_of(out("tok.jsonl")).splitlines()} >= {"First line here .", "one"}
    for kind in ("medusa", "jsonl", "warc"):
        workflows.convert_files(spark, str(source_file), str(out(f"conv.{kind}")))
    assert warc.read_warc(spark, str(out("conv.warc"))).count() == 3
    assert len(text_of(out("conv.jsonl")).splitlines()) == 3 and len(text_of(out("conv.medusa")).splitlines()) == 5
    workflows.convert_files(spark, str(out("conv.warc")), str(out("back.source")))
    assert source_docs.read_source(spark, str(out("back.source"))).count() == 3
    workflows.slice_files(spark, str(source_file), str(out("slice.source")), 2, 2)
    assert [r["location"] for r in source_docs.read_source(spark, str(out("slice.source"))).collect()] == ["http://a.example/2"]
    workflows.split_files(spark, str(source_file), str(out("split")), max_docs=2)
    assert sorted(p.name for p in out("split").glob("part=*")) == ["part=1", "part=2"]
    out("two").mkdir()
    for n in ("b.source", "a.source"):
        (out("two") / n).write_text(f"<source><location>{n}</location></source>\nx\n")
    workflows.merge_files(spark, str(out("two")), "*.source", str(out("merged")))
    assert [r["location"] for r in source_docs.read_source(spark, str(out("merged"))).orderBy("doc_ord").collect()] == ["a.source", "b.source"]
    assert workflows.document_stats(spark, str(source_file)).first()["docs"] == 3
    assert workflows.sentence_stats(spark, str(out("seg.medusa"))).first()["lines"] == 4  # an empty location at the end of a line is lost


def test_flow(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Der Hund bellt.", "2024-01-01", "a"), (2, "Der Hund.", None, "a")], "i int, sentence string, date string, location string")
    words = tokenizer.Tokenizer.default()
    first = workflows.run_flow(spark, str(tmp_path / "flow"), rows, words, ["i"])
    assert [r["word"] for r in first["words"].orderBy("word_id").collect()] == [".", "Der", "Hund", "bellt"]
    again = workflows.run_flow(spark, str(tmp_path / "flow"), rows.limit(0), words, ["i"])
    assert again["index"].count() == first["index"].count() == 2


def test_command_line(source_file, tmp_path, spark):
    assert cli.main(["segmentize", str(source_file), str(tmp_path / "o.medusa"), "--single-file"]) == 0
    assert len(text_of(tmp_path / "o.medusa").splitlines()) >= 4
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_a_record_without_date_is_of_today():
    from datetime import datetime, timezone

    from lexloom.sources.warc import record_bytes

    day = datetime.now(timezone.utc).strftime("%Y-%m-%d")
    assert f"WARC-Date: {day}T00:00:00Z".encode() in record_bytes("http://a.example", None, b"x")
