"""Schemas of the tables that operators exchange, and what formats each workflow takes."""

from pyspark.sql.types import ArrayType, LongType, MapType, StringType, StructField, StructType

_S, _L = StringType(), LongType()

#: Header-delimited documents; ``offset`` and ``length`` are bytes, header included.
DOCUMENTS = StructType(
    [
        StructField("path", _S),
        StructField("doc_ord", _L),
        StructField("location", _S),
        StructField("date", _S),
        StructField("extra", ArrayType(_S)),
        StructField("content", _S),
        StructField("offset", _L),
        StructField("length", _L),
    ]
)

#: Web archive records.
WARC = StructType(
    [
        StructField("path", _S),
        StructField("doc_ord", _L),
        StructField("record_type", _S),
        StructField("location", _S),
        StructField("date", _S),
        StructField("record_id", _S),
        StructField("headers", MapType(_S, _S)),
        StructField("content", _S),
        StructField("offset", _L),
        StructField("length", _L),
    ]
)

#: One sentence a row.
SENTENCES = StructType([StructField("path", _S), StructField("doc_ord", _L), StructField("sent_ord", _L), StructField("location", _S), StructField("date", _S), StructField("sentence", _S)])

#: workflow -> (formats it reads, formats it writes)
WORKFLOW_FORMATS = {
    "segment": ({"source", "warc"}, {"source", "warc", "medusa"}),
    "clean": ({"source", "warc", "medusa"}, {"source", "warc", "medusa"}),
    "tokenize": ({"medusa"}, {"medusa", "jsonl"}),
    "identify": ({"source"}, {"source"}),
    "document_stats": ({"source", "warc"}, set()),
    "sentence_stats": ({"medusa"}, set()),
}

#: Conversions on offer, as (from, to).
CONVERSIONS = {("source", "medusa"), ("source", "jsonl"), ("medusa", "jsonl"), ("source", "warc"), ("warc", "source"), ("warc", "jsonl")}
