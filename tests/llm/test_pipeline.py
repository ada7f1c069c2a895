"""The pipeline's stages on a small folder of tables, each against what it must do."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from lexloom.llm import decontaminate, mixing, simhash, toxicity

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
NAMES = ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "hilbert_sharding"]


def clean_text(i):
    return " ".join(f"word{(i * 7919 + k * k * 31) % 9973}" for k in range(60))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, clean_text(i), "en", f"s{i % 3}", "x") for i in range(40)]
    rows += [(100 + i, clean_text(500 + i) + f" vilestword{i % 4} vilestword{(i + 1) % 4} vilestword{i % 4}", "en", "s0", "x") for i in range(12)]
    rows += [(200, clean_text(3) + " tail", "en", "s1", "x"), (201, clean_text(3), "en", None, "x"), (202, clean_text(4).upper(), None, "s1", "x")]
    rows += [(300, clean_text(900) + " " + ITEM.upper() + " " + clean_text(901), "en", "s2", "x"), (301, None, "en", "s2", "x"), (302, "", "en", "s2", "x"), (None, clean_text(950), "en", "s0", "x"), (5, clean_text(5), "en", "s2", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string").selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) n_chars", "shard").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).persist()
        seen.append((name, before, docs))
    return seen


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == NAMES
    assert all(after.columns == before.columns for _, before, after in stages[:-1])
    assert {"doc_id", "text", "shard", "slot"} <= set(stages[-1][2].columns)


def test_toxic_documents_go(stages):
    _, before, after = stages[0]
    gone = texts(before) - texts(after)
    assert {i for i, _ in gone} >= {100 + i for i in range(12)} and all(re.search("vilestword", t or "") for _, t in gone)


def test_one_of_each_near_group_stays(stages):
    _, before, after = stages[1]
    near = simhash.near_duplicates(before).collect()
    want = Counter(r["component_id"] for r in near).keys()
    got = [r["doc_id"] for r in after.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert 201 not in got and 202 not in got and got.count(5) == 1 and 3 in got


def test_contaminated_documents_go(stages):
    _, before, after = stages[2]
    assert {i for i, _ in texts(before) - texts(after)} == {300}


def test_sources_are_mixed(stages):
    _, before, after = stages[3]
    size = lambda t: len((t or "").split())
    by, took = Counter(), Counter()
    for r in before.collect():
        by[r["source"]] += size(r["text"])
    for r in after.collect():
        took[r["source"]] += size(r["text"])
    target = mixing.budgets(dict(by))
    assert set(texts(after)) <= set(texts(before)) and max(texts(after).values()) <= 3
    assert all(abs(took[s] - target[s]) <= 130 for s in by)


def test_everything_is_sharded(stages):
    _, before, after = stages[4]
    assert texts(before) == texts(after)
    slots = {}
    for r in after.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_stages_take_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_run_gives_the_last_stage(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder)
    assert texts(got) == texts(stages[-1][2])
    assert corpus_pipeline.ORACLE_SQL is None and toxicity and decontaminate
