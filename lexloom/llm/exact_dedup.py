"""Exact deduplication by exchange of Golomb-coded fingerprints.

1. Every input partition (a *sender*) reduces its texts to SHA-256 of the normalised text and a
   64-bit fingerprint, its head. This slim table is written once.
2. A sender sorts its distinct fingerprints, cuts them by *owner* (a range of fingerprints) and sends
   each owner the gaps, Golomb-Rice coded: about ``log2(gap) + 1.5`` bits each.
3. An owner decodes what it got, finds what several senders sent, and answers each with a bitmap.
4. Senders mark as suspects what is set in the bitmaps or occurs twice at home.
5. Only suspects' texts move, to be compared byte by byte, with copies collapsed before the shuffle.
   Should two texts have one SHA-256, each is a group of its own.

A fingerprint that a third of all rows share is sent once by a sender and collapses in every
aggregation; its members get their result through a broadcast of the few hot groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checked_join, hot_join, text_key, written

#: Distinct fingerprints that one owner holds on average at most.
OWNER_ROWS = 1_000_000
#: Rows of one sender at most; a larger partition is several senders.
SENDER_ROWS = 500_000
_BLANKS = b" \t\n\x0b\x0c\r"
_BLANK_PATTERN = r"[\x20\x09-\x0D]+"


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as Golomb-Rice coded gaps; unary and fixed parts apart, so that
    both decode without a loop over values."""
    n = len(values)
    if n == 0:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = float(values[-1]) / n
    k = int(max(0, min(63, np.floor(np.log2(max(1.0, mean * 0.693))))))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = np.zeros((n, k), dtype=np.uint8)
    for bit in range(k):
        low[:, bit] = (gaps >> np.uint64(bit)) & np.uint64(1)
    head = np.array([n, k, len(unary)], dtype="<i8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    """Inverse of ``rice_encode``."""
    if not data:
        return np.zeros(0, dtype=np.uint64)
    n, k, length = (int(x) for x in np.frombuffer(data, dtype="<i8", count=3))
    raw = np.frombuffer(data, dtype=np.uint8, offset=24)
    unary_bytes = (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[:unary_bytes], count=length))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(raw[unary_bytes:], count=n * k).reshape(n, k)
        for bit in range(k):
            gaps |= low[:, bit].astype(np.uint64) << np.uint64(bit)
    return np.cumsum(gaps, dtype=np.uint64)


def _owners(sorted_fp: np.ndarray, owners: int) -> np.ndarray:
    return ((sorted_fp >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _cuts(sorted_owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, start, stop) of the runs of a sorted array."""
    found, start = np.unique(sorted_owner, return_index=True)
    return list(zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(sorted_owner)]))


def _sha(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _digest(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column("text")
        n_cp = pa.compute.coalesce(pa.compute.utf8_length(texts), pa.scalar(0, pa.int32())).cast(pa.int64())
        sha = [digest((t or "").encode("utf-8", "surrogatepass").translate(None, _BLANKS)) for t in texts.to_pylist()]
        n = len(sha)
        at = np.arange(row, row + n, dtype=np.int64)
        row += n
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("text_key"),
                n_cp,
                pa.array([s.hex() for s in sha], pa.string()),
                pa.array(np.frombuffer(b"".join(s[:8] for s in sha), dtype=">i8").astype(np.int64), pa.int64()),
                pa.array((np.int64(part) << 20) + at // SENDER_ROWS, pa.int64()),
                pa.array(at % SENDER_ROWS, pa.int64()),
            ],
            names=["id", "text_key", "n_cp", "sha", "fp", "sender", "pos"],
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_rows: int = OWNER_ROWS, digest: Callable[[bytes], bytes] = _sha) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``; null counts as empty. Of
    equal texts the row with most code points stays, then the smallest id, null ids last; of
    repeated rows just one stays. Texts that differ under one digest are groups of their own.
    An empty table gives no rows."""
    id_type = dict(docs.dtypes)[id_col]
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    fields = f"id {id_type}, text_key long, n_cp long, sha string, fp long"
    slim = written(named.mapInArrow(lambda it: _digest(it, digest), f"{fields}, sender long, pos long"), "dedup-slim")
    total = slim.count()
    owners = max(8, -(-total // owner_rows))

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(frame["fp"].to_numpy().astype(np.uint64))
        cuts = _cuts(_owners(fp, owners))
        return pd.DataFrame({"owner": [o for o, _, _ in cuts], "sender": frame["sender"].iloc[0], "hashes": [rice_encode(fp[a:b]) for _, a, b in cuts]})

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        sent = [rice_decode(x) for x in frame["hashes"]]
        values, count = np.unique(np.concatenate(sent), return_counts=True)
        twice = values[count > 1]
        bitmaps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in sent]
        return pd.DataFrame({"sender": frame["sender"], "owner": frame["owner"], "bitmap": bitmaps})

    def mark(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        # only fingerprints and places become arrays: ids of any type pass as they are
        raw = rows["fp"].to_numpy().astype(np.uint64)
        fp, where, count = np.unique(raw, return_inverse=True, return_counts=True)
        answers = dict(zip(bitmaps["owner"].to_pylist(), bitmaps["bitmap"].to_pylist()))
        hit = count > 1
        for o, a, b in _cuts(_owners(fp, owners)):
            hit[a:b] |= np.unpackbits(np.frombuffer(answers[o], np.uint8), count=b - a).astype(bool)
        pos = rows["pos"].to_numpy() + rows["sender"].to_numpy() * SENDER_ROWS
        return rows.select(["id", "text_key", "n_cp", "sha", "fp"]).append_column("pos", pa.array(pos, pa.int64())).append_column("suspect", pa.array(hit[where], pa.bool_()))

    hashes = slim.select("sender", "fp").groupBy("sender").applyInPandas(send, "owner long, sender long, hashes binary")
    bitmaps = hashes.groupBy("owner").applyInPandas(answer, "sender long, owner long, bitmap binary")
    marked = written(slim.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInArrow(mark, f"{fields}, pos long, suspect boolean"), "dedup-marked")
    suspects = verified(named, marked.where("suspect"))

    alone = marked.where("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "text_key")
    best = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("pos").alias("pos")))
    groups = suspects.groupBy("class").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = written(groups.select("class", "group_size", F.col("best.id").alias("keep_id"), F.col("best.pos").alias("keep_pos")), "dedup-groups")
    grouped = hot_join(suspects, groups, "class", "group_size", total).select("id", "keep_id", "group_size", (F.col("pos") == F.col("keep_pos")).alias("kept"), "sha", "text_key")
    out = alone.unionByName(grouped)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), "text_key")


def verified(named: DataFrame, suspects: DataFrame) -> DataFrame:
    """``suspects`` with ``class``: the digest, and where different texts have it, which of them.

    Suspects' normalised texts are shuffled and compared as bytes. Other texts don't move while the
    suspects are few enough to be broadcast."""
    ids = written(suspects.select(F.col("id").alias("s_id"), F.col("text_key").alias("s_key"), "sha").distinct(), "dedup-suspects")
    texts = checked_join(named, ids, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "inner")
    bare = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), _BLANK_PATTERN, "")
    classes = texts.groupBy("sha", bare.alias("bare")).agg(F.count(F.lit(1)).alias("n"))
    clash = written(classes.groupBy("sha").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(F.col("sha").alias("c_sha")), "dedup-clashes")
    if clash.isEmpty():
        return suspects.withColumn("class", F.col("sha"))
    apart = checked_join(texts, clash, F.col("sha") == F.col("c_sha"), "inner")
    split = written(apart.select("s_id", "s_key", F.col("sha").alias("s_sha"), bare.alias("bare")).distinct(), "dedup-apart")
    same = F.col("id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")) & (F.col("sha") == F.col("s_sha"))
    return checked_join(suspects, split, same).withColumn("class", F.concat_ws(":", "sha", "bare")).select(*suspects.columns, "class")
