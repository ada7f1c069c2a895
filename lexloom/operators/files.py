"""Slices, merges and splits of ordered documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.vocabulary import numbered

ORDER = ["path", "doc_ord"]


def check_slice(start: int | None, stop: int | None) -> tuple[int, int | None]:
    if start is None and stop is None:
        raise ValueError("a slice needs a start or a stop")
    start = 1 if start is None else start
    if start < 1 or (stop is not None and stop < start):
        raise ValueError(f"no such slice: {start} to {stop}")
    return start, stop


def slice_documents(docs: DataFrame, start: int | None = 1, stop: int | None = None, order: list[str] = ORDER) -> DataFrame:
    """Documents ``start`` to ``stop``, counted from 1, both included."""
    start, stop = check_slice(start, stop)
    place = numbered(docs, [F.col(c) for c in order], "__place").where(F.col("__place") >= start)
    return (place if stop is None else place.where(F.col("__place") <= stop)).drop("__place")


def split_by_documents(docs: DataFrame, max_docs: int, order: list[str] = ORDER) -> DataFrame:
    """``docs`` with ``part``, from 1: runs of ``max_docs`` documents."""
    if max_docs < 1:
        raise ValueError("max_docs must be positive")
    return numbered(docs, [F.col(c) for c in order], "__place").withColumn("part", (F.floor((F.col("__place") - 1) / max_docs) + 1).cast("long")).drop("__place")


def split_by_bytes(docs: DataFrame, max_bytes: int, size: str = "length", max_docs: int | None = None, order: list[str] = ORDER) -> DataFrame:
    """``docs`` with ``part``: filled in order up to ``max_bytes`` (and ``max_docs``); a document over
    the limit has a part of its own.

    Filling is sequential, so ids and sizes alone go through one ordered task, batch by batch."""
    if max_bytes < 1 or (max_docs is not None and max_docs < 1):
        raise ValueError("limits must be positive")
    placed = numbered(docs, [F.col(c) for c in order], "__place")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, used, count = 1, 0, 0
        for frame in batches:
            parts = []
            for n in frame["n"]:
                if count and (used + n > max_bytes or count == max_docs):
                    part, used, count = part + 1, 0, 0
                used, count = used + n, count + 1
                parts.append(part)
            yield pd.DataFrame({"__place": frame["__place"], "part": parts})

    sizes = placed.select("__place", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")).coalesce(1).sortWithinPartitions("__place")
    return placed.join(sizes.mapInPandas(fill, "__place long, part long"), "__place").drop("__place")


def merge_documents(parts: list[DataFrame]) -> DataFrame:
    """All documents, renumbered in the order of path and number."""
    if not parts:
        raise FileNotFoundError("nothing to merge")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return numbered(out, [F.col(c) for c in ORDER], "merged_ord")


def file_names(name: str, start: int, stop: int, sep: str = "_", pad: int = 3, where: str = "infix") -> list[str]:
    """Names with counters before the name, before its extension, or after it."""
    if where not in ("prefix", "infix", "suffix"):
        raise ValueError(f"a counter is a prefix, an infix or a suffix, not {where}")
    folder, slash, base = name.rpartition("/")
    stem, dot, ext = base.rpartition(".")
    if not stem:
        stem, dot, ext = base, "", ""
    numbers = [str(i).zfill(pad) for i in range(start, stop)]
    make = {"prefix": lambda n: f"{n}{sep}{base}", "infix": lambda n: f"{stem}{sep}{n}{dot}{ext}", "suffix": lambda n: f"{base}{sep}{n}"}[where]
    return [folder + slash + make(n) for n in numbers]


def ranks(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
