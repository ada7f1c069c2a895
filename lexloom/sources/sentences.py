"""Tab-separated sentence files and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import rstrip

UNKNOWN_SOURCE = "unknown source"


def read_medusa(spark: SparkSession, path: str) -> DataFrame:
    """path, sentence, date, location of lines with just three fields; the rest is passed over.

    White space at the end goes first, so a line whose location is empty has two fields."""
    parts = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(rstrip(F.col("value")), "\t", -1).alias("f"))
    return parts.where(F.size("f") == 3).select("path", F.get("f", F.lit(0)).alias("sentence"), F.get("f", F.lit(1)).alias("date"), F.get("f", F.lit(2)).alias("location"))


def one_line(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "   ")


def medusa_line(sentence: Column, date: Column, location: Column) -> Column:
    """sentence, date, location by tabs; a missing date is today, a missing location unknown."""
    today = F.date_format(F.current_date(), "yyyy-MM-dd")
    return F.concat_ws("\t", one_line(sentence), F.coalesce(date, today), F.coalesce(location, F.lit(UNKNOWN_SOURCE)))


def write_text(lines: DataFrame, path: str, order: list[str] = (), single: bool = False, mode: str = "error") -> None:
    """The column line, in order within each file."""
    df = lines.repartition(1) if single else (lines.repartitionByRange(*order) if order else lines)
    df = df.sortWithinPartitions(*order) if order else df
    df.select("line").write.mode(mode).text(path)


def write_medusa(df: DataFrame, path: str, order: list[str] | None = None, **options) -> None:
    """Flat sentences (column sentence), or nested ones (column sentences)."""
    if "sentences" in df.columns:
        df = df.select(*[c for c in df.columns if c != "sentences"], F.posexplode("sentences").alias("sent_ord", "sentence"))
    order = order if order is not None else [c for c in ("path", "doc_ord", "sent_ord") if c in df.columns]
    write_text(df.withColumn("line", medusa_line(F.col("sentence"), F.col("date"), F.col("location"))), path, order, **options)


def parsed_json(line: str, schema: str) -> Column:
    """A line's fields. By default a string of over 20 million characters makes all of them null."""
    return F.from_json(line, schema, {"maxStringLen": str(2**31 - 1)})


def read_document_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """path, location, date, content, extra_meta of lines that are JSON and have the first three keys."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    keys = F.json_object_keys("value")
    good = raw.where(F.array_contains(keys, "location") & F.array_contains(keys, "date") & F.array_contains(keys, "content"))
    parsed = good.select("path", parsed_json("value", "location string, date string, content string, extra_meta array<string>").alias("d"))
    return parsed.select("path", "d.*")


def read_sentence_jsonl(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """Nested sentences (path, location, date, sentences), or one a row with ``single``.

    A line has ``sentence`` or ``sentences``; the first wins. Other lines are passed over."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    keys = F.json_object_keys("value")
    has = lambda k: F.array_contains(keys, k)
    good = raw.where(has("location") & has("date") & (has("sentence") | has("sentences")))
    parsed = good.select("path", has("sentence").alias("one"), parsed_json("value", "location string, date string, sentence string, sentences array<string>").alias("d"))
    nested = parsed.select("path", "d.location", "d.date", F.when(F.col("one"), F.array("d.sentence")).otherwise(F.col("d.sentences")).alias("sentences"))
    return nested.select("path", "location", "date", F.posexplode("sentences").alias("sent_ord", "sentence")) if single else nested


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def document_json(df: DataFrame, extra: bool = False) -> DataFrame:
    """``df`` with the line of a document."""
    more = [F.col("extra").alias("extra_meta")] if extra else []
    return df.withColumn("line", _json(F.col("location"), F.col("date"), F.col("content"), *more))


def sentences_json(df: DataFrame) -> DataFrame:
    return df.withColumn("line", _json(F.col("location"), F.col("date"), F.col("sentences")))


def sentence_json(df: DataFrame) -> DataFrame:
    return df.withColumn("line", _json(F.col("location"), F.col("date"), F.col("sentence")))
