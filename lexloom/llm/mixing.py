"""Mixing sources to target weights.

Every document has a hash-random key. Within its source, documents are sorted by that key in ranges,
prefix sums of token counts are formed over range totals and then inside each range, and the order
is cut at the source's exact budget. A budget above the source's size takes whole epochs first.

Scale: rows of id, size, source and key are written once; texts are read once and never shuffled. A
source that holds a third of all rows is divided into as many ranges as its rows need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import checked_join, text_key, written

#: Weights by the order of the sources, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows that one range of a source holds on average at most.
RANGE_ROWS = 50_000
#: Most sources whose budgets are computed on the driver; more are an error, never dropped.
MAX_SOURCES = 100_000
_WORD_BREAK = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, _WORD_BREAK), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def budgets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """Targets that share the sum of all sizes by weight, none above ``most`` times its source.

    Sources are taken by code point, null last. What lies above a limit is shared again among those
    below theirs until none is above; sources without words have target 0."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target = float(sum(sizes.values())), dict.fromkeys(order, 0.0)
    open_ = [s for s in order if sizes[s] > 0]
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        closed = set(over)
        open_ = [s for s in open_ if s not in closed]
    return target


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = 3.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    exact: bool = True,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per document: id, text_key, size, source, source_size, target, taken.

    ``taken`` is how many of its words the mix has, repeats counted. With ``exact`` the document on
    the cut gives just the words that are missing; otherwise it is taken or left whole, whichever
    comes nearer. Keys are md5 of seed and id, so reruns agree; ties are ordered by id and content.
    Null and empty texts have size 0 and nothing taken; a null source is a source; repeated rows are
    documents of their own; an empty table gives no rows."""
    spark = docs.sparkSession
    slim = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            text_key(F.col(text_col)).alias("text_key"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("key"),
        ),
        "mix",
    )
    found = slim.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    target = budgets({r["source"]: r["s"] for r in found}, weights, most)
    rows = []
    for r in found:
        whole = int(target[r["source"]] // r["s"]) if r["s"] else 0
        rest = math.floor(target[r["source"]] - whole * r["s"] + 0.5) if r["s"] else 0
        rows.append((r["source"], r["s"], target[r["source"]], whole, rest, max(1, -(-r["n"] // range_rows))))
    plan = F.broadcast(spark.createDataFrame(rows, "p_source string, source_size long, target double, epochs long, rest long, ranges long"))  # MAX_SOURCES rows at most
    base = slim.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "inner").drop("p_source")
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    base = base.withColumn("range", F.floor(at * F.col("ranges")).cast("long"))
    totals = base.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = totals.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(F.sum("words").over(before), zero).alias("off"))
    run = Window.partitionBy("source", "range").orderBy("key", "id", "text_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranged = base.join(totals, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    if exact:
        cut = ranged.withColumn("left", F.col("rest") - (F.col("off") + F.sum("size").over(run) - F.col("size")))
        extra = F.greatest(zero, F.least(F.col("size"), F.col("left")))
    else:  # repeated rows share one decision
        peers = Window.partitionBy("source", "range").orderBy("key", "id", "text_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        alike = Window.partitionBy("source", "range", "key", "id", "text_key")
        cut = ranged.withColumn("unit", F.sum("size").over(alike)).withColumn("left", F.col("rest") - (F.col("off") + F.sum("size").over(peers) - F.col("unit")))
        extra = F.when(F.col("left") * 2 >= F.col("unit"), F.col("size")).otherwise(zero)
    return cut.select(F.col("id").alias(id_col), "text_key", "size", F.col("source").alias(source_col), "source_size", "target", (F.col("epochs") * F.col("size") + extra).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, whole, with its own columns.

    Texts are joined to their number of copies only where that is not one, if few enough; documents
    are never cut here."""
    taken = mix(docs, id_col=id_col, text_col=text_col, exact=False, **options)
    times = written(
        taken.select(F.col(id_col).alias("__mix_id"), F.col("text_key").alias("__mix_key"), F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int").alias("__mix_times")).where("__mix_times != 1").distinct(),
        "mix-times",
    )
    key = text_key(F.col(text_col))
    out = checked_join(docs, times, F.col(id_col).eqNullSafe(F.col("__mix_id")) & (key == F.col("__mix_key")))
    return out.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("__mix_times"), F.lit(1))))).select(*[F.col(f"`{c}`") for c in docs.columns])
