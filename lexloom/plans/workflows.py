"""File-to-file workflows: what the command line runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import lines
from lexloom.operators import cleaner, files, lani, stats, tokenizer, vocabulary
from lexloom.operators.segmenter import segment, sentence_rows
from lexloom.schemas import CONVERSIONS
from lexloom.sources import formats, sentences, source_docs, warc

ORDER = ["path", "doc_ord"]


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return source_docs.read_source(spark, path) if kind == "source" else warc.read_warc(spark, path)


def _write_nested(df: DataFrame, path: str, kind: str, single: bool) -> None:
    """Documents with sentences: rejoined for document formats, flat otherwise. A document without
    sentences keeps its header in a source file and has no archive record."""
    if kind == "medusa":
        sentences.write_medusa(df, path, single=single)
        return
    joined = F.array_join("sentences", "\n")
    content = F.when(F.size("sentences") > 0, joined) if kind == "warc" else joined
    out = df.withColumn("content", content)
    (source_docs.write_source if kind == "source" else warc.write_warc)(out, path, single=single)


def segment_files(spark: SparkSession, path_in: str, path_out: str, segmenter, kind_in: str | None = None, kind_out: str | None = None, single: bool = False) -> None:
    kind_in, kind_out = formats.check_format("segment", path_in, kind_in), formats.check_format("segment", path_out, kind_out, output=True)
    _write_nested(segment(read_documents(spark, path_in, kind_in), segmenter).drop("content"), path_out, kind_out, single)


def clean_files(spark: SparkSession, path_in: str, path_out: str, rules: list[cleaner.Rule], replacements=(), kind_in: str | None = None, kind_out: str | None = None, single: bool = False) -> None:
    kind_in, kind_out = formats.check_format("clean", path_in, kind_in), formats.check_format("clean", path_out, kind_out, output=True)
    if kind_in == "medusa":
        if kind_out != "medusa":
            raise ValueError("sentences can't be written as documents")
        sentences.write_medusa(cleaner.clean(sentences.read_medusa(spark, path_in), rules, replacements=replacements), path_out, single=single)
        return
    docs = read_documents(spark, path_in, kind_in).withColumn("sentences", lines(F.col("content"))).drop("content")
    _write_nested(cleaner.clean_arrays(docs, rules, replacements=replacements), path_out, kind_out, single)


def tokenize_files(spark: SparkSession, path_in: str, path_out: str, words, kind_in: str | None = None, kind_out: str | None = None, single: bool = False) -> None:
    formats.check_format("tokenize", path_in, kind_in)
    kind_out = formats.check_format("tokenize", path_out, kind_out, output=True)
    out = tokenizer.tokenize(sentences.read_medusa(spark, path_in), words, into="sentence")
    if kind_out == "medusa":
        sentences.write_medusa(out, path_out, single=single)
    else:
        sentences.write_text(sentences.sentence_json(out), path_out, single=single)


def convert_files(spark: SparkSession, path_in: str, path_out: str, kind_in: str | None = None, kind_out: str | None = None, single: bool = False) -> None:
    """One of the six conversions."""
    kind_in, kind_out = kind_in or formats.detect_format(path_in), kind_out or formats.detect_format(path_out)
    formats.check_conversion(kind_in, kind_out)
    assert (kind_in, kind_out) in CONVERSIONS
    if kind_in == "medusa":
        sentences.write_text(sentences.sentence_json(sentences.read_medusa(spark, path_in)), path_out, single=single)
        return
    docs = read_documents(spark, path_in, kind_in)
    if kind_out == "medusa":
        full = docs.where(F.col("content").isNotNull() & (F.col("content") != ""))
        sentences.write_medusa(full.withColumn("sentences", lines(F.col("content"))).drop("content"), path_out, single=single)
    elif kind_out == "jsonl":
        sentences.write_text(sentences.document_json(docs), path_out, ORDER, single=single)
    elif kind_out == "warc":
        warc.write_warc(docs, path_out, write_empty=True, single=single)
    else:
        source_docs.write_source(docs, path_out, single=single)


def identify_files(spark: SparkSession, path_in: str, path_out: str, wordlist: DataFrame) -> None:
    """Lines of each document by language, in one folder a language."""
    docs = source_docs.read_source(spark, path_in)
    split = lani.split_by_language(docs, wordlist, ["path", "doc_ord", "location", "date"])
    source_docs.write_source(split, path_out, partition_by=["language"])


def slice_files(spark: SparkSession, path_in: str, path_out: str, start: int | None = 1, stop: int | None = None) -> None:
    source_docs.write_source(files.slice_documents(source_docs.read_source(spark, path_in), start, stop), path_out, single=True)


def split_files(spark: SparkSession, path_in: str, path_out: str, max_docs: int | None = None, max_bytes: int | None = None) -> None:
    """Parts as folders ``part=n``."""
    docs = source_docs.read_source(spark, path_in)
    if max_bytes is None and max_docs is None:
        raise ValueError("a limit is needed")
    parts = files.split_by_documents(docs, max_docs) if max_bytes is None else files.split_by_bytes(docs, max_bytes, max_docs=max_docs)
    source_docs.write_source(parts, path_out, partition_by=["part"])


def merge_files(spark: SparkSession, folder: str, pattern: str, path_out: str) -> None:
    found = formats.find_files(folder, pattern)
    merged = files.merge_documents([source_docs.read_source(spark, p) for p in found])
    source_docs.write_source(merged, path_out, order=["merged_ord"], single=True)


def document_stats(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return stats.document_stats(read_documents(spark, path, formats.check_format("document_stats", path, kind)))


def sentence_stats(spark: SparkSession, path: str, count_sources: bool = True) -> DataFrame:
    return stats.sentence_stats(sentences.read_medusa(spark, path), count_sources=count_sources)


def index_flow(rows: DataFrame, words, order: list[str], known: DataFrame | None = None, next_id: int = 1) -> dict[str, DataFrame]:
    """The preparation of sentence rows (sentence, date, location) for co-occurrence counts: numbered
    tokenized sentences with their signatures, sources, words in both numberings, and the index."""
    from lexloom.functions import hashing, scratch

    sent = vocabulary.numbered(tokenizer.tokenize(rows, words), [F.col(c) for c in order], "sent_id")
    sent = scratch.written(sent.select("sent_id", "sentence", "tokenized", "location", "date"), "sentences")
    sources = vocabulary.source_numbers(sent)
    internal = scratch.written(vocabulary.word_numbers(vocabulary.word_frequencies(sent)), "words")
    known = known if known is not None else rows.sparkSession.createDataFrame([], "known_id long, word string")
    catalog = scratch.written(vocabulary.external_numbers(internal, known, next_id), "catalog")
    tokens = F.split("tokenized", " ")
    signatures = sent.select("sent_id", hashing.bucket_id(F.col("sentence")).alias("bucket"), hashing.word_length_signature(tokens).alias("signature"))
    return {"sentences": sent, "sources": sources, "words": internal, "catalog": catalog, "signatures": signatures, "index": vocabulary.sentence_index(sent, catalog, sources)}


def run_flow(spark: SparkSession, folder: str, rows: DataFrame, words, order: list[str], overwrite: bool = False, **options) -> dict[str, DataFrame]:
    """``index_flow`` with its tables kept in ``folder``: a stage whose table is there is read, and
    once a stage runs all later ones do."""
    from pathlib import Path

    made, fresh, out = None, overwrite, {}
    for name in ("sentences", "sources", "words", "catalog", "signatures", "index"):
        path = f"{folder}/{name}.parquet"
        fresh = fresh or not Path(path).exists()
        if fresh:
            made = made or index_flow(rows, words, order, **options)
            made[name].write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def nested_to_flat(df: DataFrame) -> DataFrame:
    return sentence_rows(df)
