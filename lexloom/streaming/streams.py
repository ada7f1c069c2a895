"""The stateless operators over streams.

Segmenting, cleaning and tokenizing are projections and filters, so they run unchanged on streaming
DataFrames. Counts over time take a watermark, so their state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import cleaner, segmenter, tokenizer


def read_document_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents (location, date, content) from a folder, as files arrive."""
    return spark.readStream.schema("location string, date string, content string").json(path)


def sentence_stream(docs: DataFrame, split: segmenter.Segmenter, rules: list[cleaner.Rule], words=None) -> DataFrame:
    """location, date, sentence (and tokenized) of the sentences that no rule rejects."""
    rows = segmenter.segment(docs, split).select("location", "date", *[c for c in docs.columns if c not in ("location", "date", "content")], F.explode("sentences").alias("sentence"))
    kept = cleaner.clean(rows, rules)
    return tokenizer.tokenize(kept, words) if words is not None else kept


def rejections_by_window(sentences: DataFrame, rules: list[cleaner.Rule], time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rejected sentences by rule and window of time; rows later than ``late`` are passed over."""
    hit = sentences.withWatermark(time, late).select(time, cleaner.first_rule(F.col("sentence"), rules).alias("rule")).where("rule is not null")
    return hit.groupBy(F.window(time, window), "rule").agg(F.count(F.lit(1)).alias("hits"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
