"""Word and source numbering, known words, and the sentence index.

Numbers 1..n follow a total order. ``numbered`` gives them without a window over all rows: rows are
sorted in ranges, written with their range, and each range is numbered after the sizes of those
before it, so it holds for vocabularies of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.scratch import written

NULL_TEXT = "NULL"
#: Minute written where a date can't be read.
NO_MINUTE = -100
#: Rows up to which a lookup table is broadcast.
BROADCAST_ROWS = 500_000
#: Words with the lowest numbers that are looked up by a broadcast in any case.
FREQUENT_WORDS = 100_000
#: Text of sentences whose words are looked up together.
BLOCK_BYTES = 4_000_000


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: places 1, 2, ... in the given total order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__before") + place).cast("long")).drop("__range", "__before")


def lookup(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of any size, broadcast only if it is counted to be small."""
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, on, how)


def word_frequencies(sentences: DataFrame, column: str = "tokenized") -> DataFrame:
    """word, freq; tokens are split at single blanks, empty ones don't count."""
    words = sentences.select(F.explode(F.split(column, " ")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def word_numbers(frequencies: DataFrame) -> DataFrame:
    """word_id, word, freq by falling frequency, then by code point."""
    return numbered(frequencies, [F.desc("freq"), F.col("word")], "word_id").select("word_id", "word", "freq")


def source_numbers(sentences: DataFrame, location: str = "location", date: str = "date") -> DataFrame:
    """source_id, source, date, n by falling number of sentences, then date, then source."""
    null = F.lit(NULL_TEXT)
    counts = sentences.groupBy(F.coalesce(F.col(location), null).alias("source"), F.coalesce(F.col(date), null).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, [F.desc("n"), F.col("date"), F.col("source")], "source_id").select("source_id", "source", "date", "n")


def read_known_words(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Next free number and (known_id, word) of a file ``id<TAB>word``; of a repeated word the last
    holds; no file is an empty table with next number 1."""
    from lexloom.operators.segmenter import read_entries

    found: dict[str, int] = {}
    most = 0
    for line in read_entries(path):
        number, tab, word = line.partition("\t")
        if tab and word:
            found[word] = int(number)
            most = max(most, int(number))
    return most + 1, spark.createDataFrame([(i, w) for w, i in found.items()], "known_id long, word string")


def external_numbers(numbers: DataFrame, known: DataFrame, next_id: int, unseen: bool = False) -> DataFrame:
    """word_nr, word, len, freq, word_id: known words keep their number, others follow from
    ``next_id`` on by falling frequency, then word, then old number. ``unseen``: known words that
    don't occur are listed too, with frequency 0."""
    joined = lookup(numbers, known, ["word"], "full" if unseen else "left") if not unseen else numbers.join(known, "word", "full")
    joined = joined.withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))
    old = joined.where("known_id is not null").select(F.col("known_id").alias("word_nr"), "word", "freq", "word_id")
    new = numbered(joined.where("known_id is null"), [F.desc("freq"), F.col("word"), F.col("word_id")], "place")
    new = new.select((F.col("place") + (next_id - 1)).alias("word_nr"), "word", "freq", "word_id")
    return old.unionByName(new).select("word_nr", "word", F.length("word").cast("long").alias("len"), "freq", "word_id")


def date_minutes(date: Column) -> Column:
    """Minutes since 1970 of an ISO date, UTC; -100 where it can't be read."""
    return F.coalesce(F.floor(F.unix_seconds(F.try_to_timestamp(date)) / 60).cast("int"), F.lit(NO_MINUTE))


def _pieces(batches, column: str, limit: int):
    """Record batches of about ``limit`` bytes of a text column each, made of such of any size."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64") + 16)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit - size, "right")))
            held.append(batch.slice(at, stop - at))
            size, at = size + int(ends[stop - 1]) - done, stop
            if size >= limit or at < batch.num_rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _coded(df: DataFrame, column: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with block, codes and words instead of the text: blocks have about ``limit`` bytes of
    text; the first row of each has its different tokens, and codes are places among them."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(_pieces(batches, column, limit)):
            tokens = pc.split_pattern(batch.column(column), " ")
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0).cast("int32"))
            coded = tokens.flatten().dictionary_encode()
            start = pa.array([0], "int32")
            codes = pa.ListArray.from_arrays(pa.concat_arrays([start, ends]), coded.indices)
            words = pa.ListArray.from_arrays(pa.array([0] + [len(coded.dictionary)] * len(batch), "int32"), coded.dictionary.cast("string"))
            rest = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.repeat(pa.scalar(first + n, "int64"), len(batch)), codes, words], [*rest, "block", "codes", "words"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != column)
    return df.mapInArrow(run, f"{fields}block bigint, codes array<int>, words array<string>")


def _looked_up(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (block, codes) with w instead: the numbers of its codes in ``ids`` (of_block, code, id)."""
    rest = [c for c in rows.columns if c not in ("block", "codes")]

    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = lambda table, name: pa.concat_arrays(table.column(name).chunks)
        codes = whole(left, "codes")
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(codes), 0).cast("int32"))
        found = whole(right.sort_by("code"), "id").take(codes.flatten()) if right.num_rows else pa.array([], "int64")
        w = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], "int32"), ends]), found)
        return pa.table({**{c: left.column(c) for c in rest}, "w": w})

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in rest)
    return rows.groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(run, f"{fields}w array<bigint>")


def sentence_index(sentences: DataFrame, words: DataFrame, sources: DataFrame, key: str = "sent_id", column: str = "tokenized", number: str = "word_nr") -> DataFrame:
    """sent_id, source_id, ts_min, word_ids: the numbers of a sentence's words in order.

    Words without number are left out; so are sentences whose source has none. A word has one number.
    Rows with one key all have the words of all of them, by place.

    Tokens never move one by one: of a block of sentences its different words alone meet the numbers,
    and come back to it to be looked up by code."""
    null = F.lit(NULL_TEXT)
    base = sentences.select(F.col(key).alias("key"), F.coalesce("location", null).alias("source"), F.coalesce("date", null).alias("date"), F.col(column).alias("__t"))
    heads = lookup(base, sources.select("source_id", "source", "date"), ["source", "date"], "left").select("key", "source_id", date_minutes(F.col("date")).alias("ts_min"), "__t")
    coded = written(_coded(heads, "__t"), "coded")
    pairs = coded.select(F.col("block").alias("of_block"), F.posexplode("words").alias("code", "word"))
    numbers = words.where("word != ''").select("word", F.col(number).cast("bigint").alias("id"))
    # words with low numbers are frequent ones, in most blocks: they are broadcast, at most 6 MB
    frequent = written(numbers.where(F.octet_length("word") <= 64).orderBy("id").limit(FREQUENT_WORDS).coalesce(1), "frequent")
    rare = pairs.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(numbers, "word", "left")
    both = pairs.join(F.broadcast(frequent), "word").unionByName(rare).select("of_block", "code", "id")
    each = _looked_up(coded.drop("words"), both)

    def done(rows: DataFrame, w: Column) -> DataFrame:
        return rows.where("source_id is not null").select(F.col("key").alias(key), "source_id", "ts_min", w.alias("word_ids"))

    own = done(each, F.when(F.col("key").isNull(), F.array().cast("array<bigint>")).otherwise(F.filter("w", lambda x: x.isNotNull())))
    repeated = coded.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    if repeated.isEmpty():
        return own
    repeated = written(repeated, "repeated")
    again = lookup(each, repeated, ["key"])
    placed = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("id"))), lambda p: p["id"].isNotNull())
    merged = again.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("all"))
    several = done(again.drop("w").join(merged, "key"), F.transform("all", lambda p: p["id"]))
    return lookup(own, repeated.withColumnRenamed("key", key), [key], "left_anti").unionByName(several)


def encode_index_row(sent_id: int, source_id: int, minute: int, word_ids: list[int], units: list[tuple[list[int], int]] = ()) -> bytes:
    """A record of the binary index: int32 little endian; words end with -1, multi-word units (their
    places, then their number) follow their count, and a zero ends the record."""
    import struct

    out = [sent_id, source_id, minute, *word_ids, -1, len(units)]
    for places, number in units:
        out += [len(places), *places, number]
    return struct.pack(f"<{len(out) + 1}i", *out, 0)
