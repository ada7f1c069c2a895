"""Benchmark decontamination by a set of normalised test n-grams (DataFrame functions only).

Each window of ``width`` words of a benchmark item has a hash, and an anchor, its longest word: long
words are rare, so few places of a document need a closer look. The anchors and hashes are two sets
of numbers that travel to the executors as one broadcast with the plan, behind a check of their size
(``SET_BYTES``). A document's words are scanned for anchors, the windows around a hit for their
hashes, and what is left, hardly more than true hits, is joined with the windows' own texts, which
verifies them word by word and gives their items.

Beyond that size the hashes of all windows of the documents are joined with those of the benchmark
by a shuffle, and verified in the same way: slower, but as exact, and without any bound.

Rows are addressed by id and content, so copies and null or repeated ids need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checked_join, text_key, written

#: Words of a window.
WIDTH = 10
#: Bytes that the sets of anchors and hashes may take in an executor.
SET_BYTES = 96 << 20
#: Bytes that a number takes in such a set.
ENTRY_BYTES = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words and what words are, before letters are made lower case.
_RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _BREAK), lambda w: w != "")


def windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """txt, len, items, h, anchor of every distinct window; an item shorter than a window is one
    itself. Windows of items without id are there, with no item to name."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, width))).alias("w"))
    found = each.groupBy(F.array_join("w", " ").alias("txt"), F.size("w").alias("len")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    longest = F.array_max(F.transform(F.split("txt", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return found.select("txt", "len", "items", F.xxhash64("txt").alias("h"), F.xxhash64(longest).alias("anchor"))


def _window(words: Column, start: Column, length: int) -> Column:
    # looked up word by word: a slice would go over the whole array
    return F.concat_ws(" ", *[F.get(words, start + k) for k in range(length)])


def _candidates(words: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """id, text_key, start, len, txt of the windows in ``words`` whose hash is one of the benchmark's."""
    n_anchors, n_hashes = grams.agg(F.count_distinct("anchor"), F.count_distinct("h")).first()
    w = F.col("w")
    if (n_anchors + n_hashes) * ENTRY_BYTES <= SET_BYTES:
        anchors = [r[0] for r in grams.select("anchor").distinct().collect()]
        hashes = [r[0] for r in grams.select("h").distinct().collect()]
        spots = F.filter(F.transform(w, lambda x, i: F.when(F.xxhash64(x).isin(anchors), i)), lambda i: i.isNotNull())
        words = words.withColumn("spots", spots)
        parts = []
        for n in lengths:
            starts = F.array_distinct(F.flatten(F.transform("spots", lambda i: F.sequence(F.greatest(F.lit(0), i - (n - 1)), i))))
            hit = F.filter(starts, lambda s: (s + n <= F.size(w)) & F.xxhash64(_window(w, s, n)).isin(hashes))
            parts.append(F.transform(hit, lambda s: F.struct(s.alias("start"), F.lit(n).alias("len"), _window(w, s, n).alias("txt"))))
        found = words.withColumn("found", F.concat(*parts))
        return found.select("id", "text_key", F.explode(F.when(F.col("u") >= 0, F.col("found"))).alias("x")).select("id", "text_key", "x.*")
    parts = []
    for n in lengths:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(n).alias("len"), F.xxhash64(_window(w, s, n)).alias("h"))))
    each = words.select("id", "text_key", F.explode(F.when(F.col("u") >= 0, F.concat(*parts))).alias("x")).select("id", "text_key", "x.*")
    hits = each.join(grams.select("h").distinct().hint("merge"), "h", "left_semi").groupBy("id", "text_key").agg(F.collect_set(F.struct("start", "len")).alias("spots"))
    hits = written(hits.select(F.col("id").alias("h_id"), F.col("text_key").alias("h_key"), "spots"), "leaks-spots")
    again = checked_join(words, hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "inner")
    most = max(lengths)
    word = lambda s, k: F.when(s["len"] > k, F.get(w, s["start"] + k))
    text = F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), F.concat_ws(" ", *[word(s, k) for k in range(most)]).alias("txt")))
    return again.select("id", "text_key", F.explode(F.when(F.col("u") >= 0, text)).alias("x")).select("id", "text_key", "x.*")


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """__id, __key, __hits, __items of each distinct document with a window; written."""
    grams = written(windows(benchmark, width, item_col, item_text), "leaks-windows")
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most ``width``
    words = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("text_key"), words_of(F.col(f"`{text_col}`")).alias("w"), F.monotonically_increasing_id().alias("u"))
    # a field that isn't deterministic keeps filters above this projection: pushed below, they would
    # have the words split again for every word
    if not lengths:
        words, lengths = words.limit(0), [width]
    found = checked_join(_candidates(words, grams, lengths), grams.select("txt", "items"), "txt", "inner")
    spans = F.collect_set(F.struct("start", "len"))
    by = found.groupBy("id", "text_key").agg(spans.alias("spans"), F.collect_set("items").alias("items"))
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten("items")))
    return written(by.select(F.col("id").alias("__id"), F.col("text_key").alias("__key"), hits.alias("__hits"), items.alias("__items")), "leaks")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, hits (word numbers inside occurring windows) and items (ids, sorted as
    strings), under names that start with ``prefix``.

    Null and wordless texts have no words and no hits; items without words match nothing; windows of
    items without id hit like any other but name none; repeated rows are each marked; an empty
    benchmark marks nothing; long texts are read whole; an empty table gives no rows."""
    found = occurrences(docs, benchmark, width, id_col, text_col, item_col, item_text)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (text_key(F.col(f"`{text_col}`")) == F.col("__key"))
    out = checked_join(docs, found, same)
    none = {"hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    made = [F.size(words_of(F.col(f"`{text_col}`"))).cast("long").alias(f"{prefix}n_words"), *[F.coalesce(f"__{c}", x).alias(f"{prefix}{c}") for c, x in none.items()]]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *made)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, spans: bool = False, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window, or, with ``spans``, without the hit words."""
    found = occurrences(docs, benchmark, width, id_col, text_col)
    text, names = F.col(f"`{text_col}`"), [F.col(f"`{c}`") for c in docs.columns]
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (text_key(text) == F.col("__key"))
    if not spans:
        return checked_join(docs, found.select("__id", "__key"), same, "left_anti").select(*names)
    gaps, words = F.split(text, _RAW_WORD, -1), F.regexp_extract_all(text, F.lit(_RAW_WORD), F.lit(0))
    marked = checked_join(docs, found, same).withColumns({"__gaps": gaps, "__raw": words})
    kept = F.transform(F.col("__raw"), lambda w, i: F.concat(F.get(F.col("__gaps"), i), F.when(F.array_contains(F.col("__hits"), i), F.lit("")).otherwise(w)))
    rebuilt = F.concat(F.array_join(kept, ""), F.element_at("__gaps", -1))
    return marked.withColumn(text_col, F.when(F.col("__hits").isNull(), text).otherwise(rebuilt)).select(*names)
