"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint within 6 bits of another differs by at most one bit in one of 4 segments of 16
bits (else it would differ by 8). Each segment is indexed 16 times, each time with another bit
struck out: two segments agree in at least one of these variants just when they differ by at most
one bit. An equality join on (segment, struck bit, rest) finds all candidates; the full distance is
checked inside the join, and a pair passes at the first variant that it shares only, so links need
no deduplication.

Copies are folded first: only distinct fingerprints are indexed, with the number and the smallest id
of their documents, so a group that holds a third of all rows costs one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checked_join, hot_join, text_key, written

BITS, SEGMENTS, SEGMENT_BITS = 64, 4, 16
#: Most differing bits of linked fingerprints.
DISTANCE = 6
#: Shingles that are added up at a time; texts are taken whole, piece by piece.
PIECE = 32_768


def fingerprint(text: bytes | None) -> int:
    """SimHash over the 2-word shingles of the text; ASCII letters count as lower case."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) == 1:
        return xxhash.xxh64_intdigest(words[0], seed=42)
    total, n = np.zeros(BITS, dtype=np.int64), len(words) - 1
    for start in range(0, n, PIECE):
        stop = min(n, start + PIECE)
        shingles = map(b" ".join, zip(words[start:stop], words[start + 1 : stop + 1]))
        digests = b"".join([xxhash.xxh64_digest(s, 42) for s in shingles])
        total += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
        signed = np.array(fps, dtype=np.uint64).view(np.int64) if fps else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(signed, pa.int64())], names=["id", "text_key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, fp of every row."""
    named = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    return named.mapInArrow(_fingerprints, f"id {dict(docs.dtypes)[id_col]}, text_key long, fp long")


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * s).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _first_variant(diff: Column) -> Column:
    """The first (segment, struck bit) that two fingerprints with this XOR share, as in the index."""
    found = F.lit(-1).cast("long")
    for s in range(SEGMENTS - 1, -1, -1):
        part = _segment(diff, s)
        # the place of the only differing bit; bit 0 if none differs
        place = F.when(part == 0, 0).otherwise(F.bit_count(part - 1)).cast("long")
        found = F.when(F.bit_count(part) <= 1, F.lit(s * SEGMENT_BITS).cast("long") + place).otherwise(found)
    return found


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) within ``distance`` bits; 7 bits at most."""
    if distance > 2 * SEGMENTS - 1:
        raise ValueError("4 segments with one struck bit find distances up to 7")
    fp = F.col("fp")
    variants = F.array(
        *[
            (F.lit((s * SEGMENT_BITS + p) << SEGMENT_BITS).cast("long") + _segment(fp, s).bitwiseAND(F.lit(~(1 << p) & 0xFFFF))).cast("int")
            for s in range(SEGMENTS)
            for p in range(SEGMENT_BITS)
        ]
    )
    index = nodes.select("fp", F.explode(variants).alias("key"))
    a, b = index.select("key", F.col("fp").alias("a")), index.select("key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(diff) <= distance)
    # the size of an exploded index is badly estimated: never let it be broadcast
    return a.hint("merge").join(b, "key").where(near & (_first_variant(diff) == F.shiftright(F.col("key"), SEGMENT_BITS).cast("long"))).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps; each is written, and they end when nothing changes.
    """
    edges = written(edges.where("a != b"), "cc")

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()

    seen = None
    for _ in range(rounds):
        edges = written(stars(stars(edges, True), False), "cc")
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", rooted: bool = False) -> DataFrame:
    """One row per document: id, fingerprint, n_near, component_id, text_key.

    ``rooted``: also root, the smallest fingerprint of the component, which alone tells components
    apart where ids are null or repeat. Null and wordless texts have fingerprint zero and link like
    any other. Repeated rows are documents of their own that link with each other. A component's id is the smallest id in it; null ids are
    passed over unless it has no other. An empty table gives no rows."""
    slim = written(fingerprints(docs, id_col, text_col), "simhash")
    total = slim.count()
    nodes = written(slim.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "simhash-nodes")
    pairs = written(links(nodes.select("fp"), distance), "simhash-links")
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(nodes.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    roots = written(components(pairs), "simhash-roots")
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    info = (
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .join(ids, "root", "left")
        .join(around, "fp", "left")
        .select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), (F.col("n") - 1 + F.coalesce(F.col("others"), F.lit(0))).alias("n_near"))
    )
    out = hot_join(slim, written(info, "simhash-info"), "fp", "n", total)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id", "text_key", *(["root"] if rooted else []))


def keep_one(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, of repeated rows one."""
    near = written(near_duplicates(docs, distance, id_col, text_col, rooted=True).select(F.col(id_col).alias("__id"), "text_key", "root"), "simhash-near")
    groups = near.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("text_key").alias("k"))).alias("keep"), F.count(F.lit(1)).alias("n"))
    # what goes: every (id, content) of a larger group except the one that stays
    held = groups.where("n > 1").select("root", F.col("keep.id").alias("__id"), F.col("keep.k").alias("text_key"))
    held = written(held, "simhash-held")
    stays = checked_join(near, held.select(F.col("root").alias("c"), F.col("__id").alias("h_id"), F.col("text_key").alias("h_key")), F.col("root") == F.col("c"), "inner")
    gone = written(stays.where(~(F.col("__id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")))).select(F.col("__id").alias("__g_id"), F.col("text_key").alias("__g_key")).distinct(), "simhash-gone")
    again = near.groupBy("__id", "text_key").count().where("count > 1").select(F.col("__id").alias("__r_id"), F.col("text_key").alias("__r_key"))
    again = written(again, "simhash-again")
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = text_key(F.col(text_col))
    left = checked_join(docs, gone, F.col(id_col).eqNullSafe(F.col("__g_id")) & (key == F.col("__g_key")), "left_anti")
    if again.isEmpty():
        return left.select(*names)
    same = F.col(id_col).eqNullSafe(F.col("__r_id")) & (key == F.col("__r_key"))
    once = checked_join(left, again, same, "left_anti").select(*names)
    more = checked_join(left, again, same, "inner").dropDuplicates(["__r_id", "__r_key"]).select(*names)
    return once.unionByName(more)
