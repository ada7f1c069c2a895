"""Corpus statistics: one aggregation with partial sums, no row leaves its partition unaggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import BYTE_LINE_BREAK, BYTE_SPACE, lines, tokens

DOC_COUNTERS = ("docs", "lines", "tokens", "chars", "sources", "dates", "source_dates")
SENTENCE_COUNTERS = ("sources", "lines", "tokens", "chars")


def _distinct(c: Column, approximate: bool) -> Column:
    return F.approx_count_distinct(c) if approximate else F.count_distinct(c)


def document_stats(docs: DataFrame, by: list[str] | None = None, content: str = "content", location: str = "location", date: str = "date", approximate: bool = False) -> DataFrame:
    """Documents, lines, tokens, characters; different sources (null as ''), dates (null is one of
    them), and sources with dates. Lines and tokens are those of bytes: ASCII breaks and blanks."""
    text = F.coalesce(F.col(content), F.lit(""))
    place = F.coalesce(F.col(location), F.lit(""))
    zero = F.lit(0).cast("long")
    aggregates = [
        F.count(F.lit(1)).alias("docs"),
        F.coalesce(F.sum(F.size(lines(text, BYTE_LINE_BREAK)).cast("long")), zero).alias("lines"),
        F.coalesce(F.sum(F.size(tokens(text, BYTE_SPACE)).cast("long")), zero).alias("tokens"),
        F.coalesce(F.sum(F.length(text).cast("long")), zero).alias("chars"),
        _distinct(place, approximate).alias("sources"),
        (_distinct(F.col(date), approximate) + F.coalesce(F.max(F.col(date).isNull().cast("long")), zero)).alias("dates"),
        _distinct(F.concat(place, F.coalesce(F.col(date), F.lit(""))), approximate).alias("source_dates"),
    ]
    return (docs.groupBy(*by) if by else docs.groupBy()).agg(*aggregates)


def sentence_stats(sentences: DataFrame, column: str = "sentence", location: str = "location", count_sources: bool = True) -> DataFrame:
    """Sources, lines, tokens (Unicode blanks), characters of flat sentences."""
    s, zero = F.coalesce(F.col(column), F.lit("")), F.lit(0).cast("long")
    sources = F.count_distinct(F.coalesce(F.col(location), F.lit(""))) if count_sources else zero
    return sentences.agg(sources.alias("sources"), F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.size(tokens(s)).cast("long")), zero).alias("tokens"), F.coalesce(F.sum(F.length(s).cast("long")), zero).alias("chars"))


def nested_sentence_stats(docs: DataFrame, column: str = "sentences", location: str = "location", count_sources: bool = True) -> DataFrame:
    return sentence_stats(docs.select(location, F.explode(column).alias("sentence")), location=location, count_sources=count_sources)


def stats_tsv(stats: DataFrame) -> DataFrame:
    """One column line: counters by tabs; document statistics print 0 as nothing."""
    columns = DOC_COUNTERS if "docs" in stats.columns else SENTENCE_COUNTERS
    show = (lambda c: F.when(F.col(c) == 0, "").otherwise(F.col(c).cast("string"))) if columns is DOC_COUNTERS else (lambda c: F.col(c).cast("string"))
    return stats.select(F.concat_ws("\t", *[show(c) for c in columns]).alias("line"))


def stats_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("line"))
