"""The driver's contract: names, SQL, and agreement of both on the smallest tables."""

import math

import __spark_entry__ as entry
import duckdb
import pytest
from lexloom.plans.oracles import ORACLES
from lexloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["lines_flatten", "clean_survivors", "clean_first_rule", "clean_nested", "doc_stats", "known_word_remap", "sentence_index", "bucket_hash", "string_hash", "lani_best", "language_split_counts", "segment_plain", "align_glue", "split_by_bytes", "top_sources"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    relation = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(relation.columns)

    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        show = lambda x: round(x, 9) if isinstance(x, float) and not math.isnan(x) else x
        return sorted(repr([show(r[i]) for i in order]) for r in data)

    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())


def odd_documents(tmp_path, rows):
    """A folder with documents (doc_id, text, source) and a connection that sees them."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?)", rows)
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    return con


def test_sentences_of_odd_documents(spark, tmp_path):
    """No text, no line, a number twice, no source, more characters than JSON readers take by default."""
    rows = [(1, None, "s"), (2, "", "s"), (3, "\n", "s"), (4, "a\n\nb\r\n", None), (8, "x\ny\nz", "s"), (8, "x\ny", "s"), (8, None, "s"), (8, "x", "t"), (9, "", None), (10, "q" * 20_000_001 + "\nr", "s")]
    con = odd_documents(tmp_path, rows)
    for name in ("jsonl_sentences", "jsonl_doc"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.sql(ORACLES[name])
        assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))
