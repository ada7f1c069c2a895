"""Language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent n-grams (one to three letters, words padded
with a blank). A document's own ranking is compared with each by the out-of-place distance: the sum
of the rank differences of its n-grams, one missing from the profile counting as the longest
possible. The nearest language is predicted.

Profiles are fitted on a bounded sample: ``TRAIN_BYTES`` of text a language, in pieces of its texts that
are chosen by a hash, so that a language of a few long texts is learned like any other. Every document is predicted from its whole text, in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import sampled_pieces

#: Bytes of text that a language's profile is fitted on at most.
TRAIN_BYTES = 4_000_000
#: N-grams in a profile and in a document's ranking.
PROFILE = 400
#: More languages than this are an error.
MAX_LANGUAGES = 500
#: Code points that are counted at a time; cuts are made between words only.
PIECE = 1 << 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _pieces(text: str) -> Iterator[str]:
    start, n = 0, len(text)
    while start < n:
        stop = min(n, start + PIECE)
        while stop < n and text[stop].isalpha():
            stop += 1
        yield text[start:stop]
        start = stop


def _codes(text: str) -> np.ndarray:
    """N-grams of a text as numbers: 20 bits a letter, blanks are 0, the length above them."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    c = np.where(_letter_table()[cp], cp & 0xFFFFF, 0)
    c = np.concatenate(([0], c, [0]))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]  # one blank between words
    two = (c[:-1] << 20) | c[1:]
    three = (c[:-2] << 40) | (c[1:-1] << 20) | c[2:]
    return np.concatenate((c[c != 0] | (1 << 60), two | (2 << 60), three[c[1:-1] != 0] | (3 << 60)))


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts."""
    parts = [np.unique(_codes(p), return_counts=True) for p in _pieces(text or "")]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def ranking(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, first the most frequent, ties by code."""
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    """Rankings of all languages, laid out for comparison with a document's."""

    def __init__(self, rankings: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.languages = size, sorted(rankings)
        self.grams = np.unique(np.concatenate([rankings[x] for x in self.languages])) if rankings else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, dtype=np.int64)
        for i, x in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.grams, rankings[x])] = np.arange(len(rankings[x]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest possible."""
        at = np.searchsorted(self.grams, own)
        known = (at < len(self.grams)) & (np.append(self.grams, -1)[at] == own)
        ranks = self.ranks[:, np.where(known, at, len(self.grams))]
        place = np.abs(ranks - np.arange(len(own)))
        return np.where(ranks < 0, self.size, place).sum(axis=1) / (self.size * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` and 0 for a text without letters, or if none was learned."""
        own = ranking(*ngram_counts(text), self.size)
        own = own[own != (2 << 60)]
        if not len(own) or not self.languages:
            return "und", 0.0
        d = self.distances(own)
        best = int(np.argmin(d))
        return self.languages[best], float(1.0 - d[best])


def fit_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_bytes: int = TRAIN_BYTES, size: int = PROFILE) -> Profiles:
    """Profiles of the languages of ``labelled`` rows, of all languages that have some text; rows
    without language or text are passed over. Pieces may be cut within a word."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    sample, share = sampled_pieces(rows, "lang", train_bytes)
    if not share:
        return Profiles({}, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                grams, n = ngram_counts(text)
                found.setdefault(lang, Counter()).update(dict(zip(grams.tolist(), n.tolist())))
        for lang, counter in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter)), pa.array(list(counter), pa.int64()), pa.array(list(counter.values()), pa.int64())], names=["lang", "gram", "n"])

    blank = F.lit(2 << 60).cast("long")  # two blanks are no n-gram
    totals = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").where(F.col("gram") != blank).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    rankings: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.select("lang", "gram", "r").collect():  # PROFILE rows a language
        rankings.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return Profiles({x: np.array([g for _, g in sorted(v)], dtype=np.int64) for x, v in rankings.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep``, lang_pred and score of every row.

    Score is one less the distance's share of the largest possible. Null texts and texts without a
    letter are ``und`` with score 0; long texts are read whole, piece by piece; ties go to the first language by code point; repeated rows are
    predicted alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            names = ["id", *keep, "lang_pred", "score"]
            rest = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=names)

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"id {kinds[id_col]}", *[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string", "score double"])
    return docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text")).mapInArrow(predict, schema).withColumnRenamed("id", id_col)
