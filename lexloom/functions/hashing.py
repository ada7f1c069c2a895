"""Hashes and signatures of sentences, as column expressions."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import code_point

#: Codes of the lengths 4, 5, ... of words.
LENGTH_CODES = "456789abcdefghijklmnopqrstuvwxyz"


def _int32(x: Column) -> Column:
    return F.shiftright(F.shiftleft(x, 32), 32)


def _rolling(n: Column, unit_at: Callable[[Column], Column]) -> Column:
    """32-bit rolling hash of ``n`` units: the first 15 weigh 37, a stride of the others 39. Only the
    units that count are looked at."""
    none = F.array().cast("array<struct<p:int,m:bigint>>")

    def weighed(places: Column, weight: int) -> Column:
        return F.transform(places, lambda p: F.struct(p.alias("p"), F.lit(weight).cast("long").alias("m")))

    head = F.when(n > 0, weighed(F.sequence(F.lit(1), F.least(n, F.lit(15))), 37)).otherwise(none)
    tail = F.when(n > 15, weighed(F.sequence(F.lit(16), n, F.greatest(F.lit(1), F.floor(n / 16).cast("int"))), 39)).otherwise(none)
    return F.abs(F.aggregate(F.concat(head, tail), F.lit(0).cast("long"), lambda h, x: _int32(h * x["m"] + unit_at(x["p"]))))


def string_hash(text: Column) -> Column:
    """Non-negative 32-bit hash over code points; '' is 0."""
    return _rolling(F.length(text), lambda p: code_point(F.substring(text, p, F.lit(1))))


def bucket_id(text: Column) -> Column:
    """The same over the signed bytes of the UTF-8 form."""

    def byte(p: Column) -> Column:
        pair = F.hex(F.substring(F.encode(text, "UTF-8"), p, F.lit(1)))
        return F.conv(pair, 16, 10).cast("long") - F.when(pair >= "80", 256).otherwise(0)

    return _rolling(F.octet_length(text), byte)


def word_length_signature(tokens: Column, shortest: int = 4) -> Column:
    """Words of under ``shortest`` letters as they are, others as the code of their length, or 0."""
    codes = F.lit(LENGTH_CODES)

    def one(t: Column) -> Column:
        place = F.length(t) - 3
        return F.when(F.length(t) < shortest, t).when(place <= len(LENGTH_CODES), F.substring(codes, place, F.lit(1))).otherwise("0")

    return F.array_join(F.transform(tokens, one), "")


def int_bytes(value: int) -> bytes:
    return struct.pack("<i", value)


def long_bytes(value: int) -> bytes:
    return struct.pack("<q", value)


def bytes_int(data: bytes) -> int:
    return struct.unpack("<i", data)[0]
