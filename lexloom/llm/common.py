"""Shared pieces: written tables instead of lineage, checked joins, folds and row keys.

Every operator of this subpackage follows the same habits:

* rows are addressed by ``(doc_id, xxhash64(text))`` rather than by ``doc_id`` alone, so null and
  repeated ids are well defined: rows that agree in both are the same document;
* only the columns that are needed are read, under names of the operator's own, so extra input
  columns with clashing names do no harm;
* what several passes read is written to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.scratch import drop, root, written

__all__ = ["drop", "root", "written"]

#: Bytes up to which one side of a join is broadcast; above it the join shuffles.
BROADCAST_BYTES = 48 << 20
#: Bytes that a row of a broadcast side takes besides its strings and arrays.
ROW_OVERHEAD = 64
#: A key is hot from this share of all rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3
#: Code points of the pieces that long texts are sampled by.
PIECE = 65_536


def fold(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id never does."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(mod) == F.lit(remainder), F.lit(False))


def text_key(text: Column) -> Column:
    """64-bit content key of a text; null has a key of its own."""
    return F.xxhash64(F.coalesce(text, F.lit("\u0000null")))


def share_threshold(share: float) -> int:
    """``xxhash64(x)`` is at most this for about ``share`` of all ``x``."""
    return min(2**63 - 1, -(2**63) + int(min(1.0, max(0.0, share)) * 2**64))


def small(df: DataFrame) -> bool:
    """Whether ``df`` takes at most ``BROADCAST_BYTES``, as added up over its rows."""
    size = F.lit(ROW_OVERHEAD + 8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{name}`"), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.length(F.to_json(F.struct(f"`{name}`"))), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def checked_join(big: DataFrame, side: DataFrame, on: Any, how: str = "left") -> DataFrame:
    """Join that broadcasts ``side`` only after adding up its bytes; a larger one is shuffled."""
    return big.join(F.broadcast(side) if small(side) else side.hint("merge"), on, how)


def hot_join(members: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``members`` with ``groups`` (one row per key, of ``n`` members each).

    At most ``1 / HOT_SHARE`` groups hold over that share of the members, so those are broadcast and
    their members never move; the others are joined by a shuffle in which no key is hot."""
    hot = groups.where(F.col(n) > F.lit(max(1.0, total * HOT_SHARE)))
    cold = groups.where(F.col(n) <= F.lit(max(1.0, total * HOT_SHARE)))
    first = members.join(F.broadcast(hot), key)
    rest = members.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return first.unionByName(rest)


def sampled_pieces(rows: DataFrame, group: str, bound: int, seed: int = 0) -> tuple[DataFrame, dict[Any, float]]:
    """A sample of the pieces of the texts of each group, of ``bound`` bytes or somewhat less, and the
    share of each group's bytes that it holds.

    ``rows``: id, text and the group's column. Texts are cut into pieces of at most an eightieth of
    the bound, so that a group has many pieces however few or long its texts are, and those with the
    smallest hashes are taken: all of a group within the bound, and of any other some 64 at least.
    Groups are few: their sizes are collected."""
    piece = max(256, min(PIECE, bound // 80 // 2))
    slim = rows.where(F.octet_length("text") > 0)
    sizes = {r[0]: r[1] for r in slim.groupBy(group).agg(F.sum(F.octet_length("text"))).collect()}
    share = {g: (1.0 if n <= bound else 0.8 * bound / n) for g, n in sizes.items()}
    limit = F.lit(None).cast("long")
    for g, x in share.items():
        limit = F.when(F.col(group) == F.lit(g), F.lit(share_threshold(x))).otherwise(limit)
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int"))
    key = F.xxhash64("id", "text", F.lit(seed))
    keyed = slim.select(group, "id", "text", limit.alias("__limit"), key.alias("__key"))
    hashed = F.transform(numbers, lambda k: F.struct(F.xxhash64(F.col("__key"), k).alias("h"), k.alias("k")))
    taken = F.filter(hashed, lambda x: x["h"] <= F.col("__limit"))
    cut = F.transform(taken, lambda x: F.struct(x["h"].alias("h"), F.substring(F.col("text"), x["k"] * piece + 1, F.lit(piece)).alias("text")))
    return keyed.select(group, "id", F.explode(cut).alias("__p")).select(group, "id", "__p.h", "__p.text"), share


def spread(rows: DataFrame, major: list[str], part: str, tie: str, uid: str, limit: int) -> DataFrame:
    """``rows`` with ``hot`` and ``sub``: blocks (major, part, hot, sub) that hold no hot tie.

    A part is a run of ties. Rows of a tie that has over ``limit`` rows in its part form blocks of
    their own, cut by the task that wrote them (``uid``: monotonically increasing ids of a written
    table), so no block is larger than a part's other rows or a tie's rows of one task. Sorted by
    (part, hot, sub) and, in a block, by tie, equal ties stay neighbours. There are at most
    rows / limit hot ties."""
    keys = [*major, part, tie]
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    hot = written(hot.select(*[F.col(k).alias(f"__{k}") for k in keys]), "hot-ties")
    if hot.isEmpty():
        return rows.withColumns({"hot": F.lit(None).cast(dict(rows.dtypes)[tie]), "sub": F.lit(0).cast("long")})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    marked = checked_join(rows, hot, same)
    sub = F.when(F.col(f"__{tie}").isNull(), F.lit(0).cast("long")).otherwise(F.shiftright(F.col(uid), 33))
    return marked.withColumns({"hot": F.col(f"__{tie}"), "sub": sub}).drop(*[f"__{k}" for k in keys])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
