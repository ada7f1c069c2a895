"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model over all training tokens of the corpus. Each order is smoothed towards
the one below with a Dirichlet prior, the lowest additively. As an automaton it has a state for each
seen history of two words, for each of one, and a root. A seen n-gram is an arc out of its history's
state, to the state of its longest suffix that is one. For any other word a state has a failure arc,
weighted with what its history leaves to the lower order, to the state of the shorter history; the
root has an arc for every word. A text is scored by one traversal from its start to its end token
that carries its state and adds the weights of the arcs taken.

No count table is ever broadcast, and no token is shuffled by itself:

1. Texts are packed into blocks (written once): a local vocabulary and a stream of local numbers.
2. A block sends its distinct words, and its distinct bigrams and trigrams as sorted, gap-coded
   hashes, with their training counts, to the owners of those words and n-grams.
3. Owners add up what they got and answer each block with the corpus counts, in the block's order.
4. A block has then all arcs that its texts can take, and its documents are scored.

A word that makes up a third of all tokens is one entry in a block's message. Words are exchanged as
they are, so all that ``base_score`` needs is exact. N-grams are known by hashes with ``MARGIN`` bits
more than the corpus has tokens: one in 2 ** MARGIN may share the count of another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 12_000_000
#: Tokens of the corpus for each owner of a kind.
OWNER_TOKENS = 4_000_000
#: Pseudo-counts with which a history of one and of two words falls back to the shorter one.
KAPPA = (500.0, 2.0)
#: Bits of an n-gram's hash beyond those that number the corpus's tokens.
MARGIN = 25
#: Tokens whose arcs are laid out at a time; the state is carried on.
STRETCH = 65_536
_MIX = np.uint64(0xD6E8FEB86659FD93)
_START = np.uint64(0x9E3779B97F4A7C15)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 3)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 as gaps: whole low bytes in planes, and what is above in unary."""
    n = len(keys)
    gaps = np.diff(keys, prepend=np.uint64(0))
    used = max(1, min(7, int(np.ceil((np.log2(max(2.0, float(gaps.mean()))) - 0.5) / 8)))) if n else 1
    high = (gaps >> np.uint64(8 * used)).astype(np.int64)
    if high.sum() > 8 * n:
        used, high = 8, np.zeros(n, dtype=np.int64)
    unary = np.zeros(int(high.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([used]) + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.ascontiguousarray(planes[:, :used].T).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    used, length = data[0], int.from_bytes(data[1:9], "little")
    stop = 9 + (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, stop - 9, 9), count=length))
    planes = np.zeros((len(ends), 8), dtype=np.uint8)
    planes[:, :used] = np.frombuffer(data, np.uint8, offset=stop).reshape(used, -1).T
    gaps = planes.view("<u8").ravel()
    if used < 8:
        gaps = gaps + ((np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(8 * used))
    return np.cumsum(gaps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, a byte each; those from 255 on follow in full."""
    return zstandard.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes(), 3)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    data = zstandard.decompress(data)
    out = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, dtype="<i8", offset=n)
    return out


def _mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (v * _MIX) ^ (w + (v >> np.uint64(29)))


class Grams:
    """The distinct n-grams of one order in a block: keys, sorted; for each token the place of the
    n-gram that ends there, or the number of n-grams where there is none."""

    def __init__(self, keys: np.ndarray, place: np.ndarray, train: np.ndarray):
        self.keys, self.place = keys, place
        self.counts = np.bincount(place[train], minlength=len(keys) + 1)[: len(keys)]


class Block:
    """Documents as a stream of local word numbers. Number 0 is the end token, its word the empty
    string, which no other word can be; every document ends with it."""

    def __init__(self, words: list[bytes], stream: np.ndarray, lengths: np.ndarray, held: np.ndarray):
        self.words, self.stream, self.lengths, self.held = words, stream, lengths, held
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        self.train = np.repeat(~held, lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.stream[self.train], minlength=len(self.words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), dtype=np.uint64, count=len(self.words))

    def grams(self, hashes: np.ndarray, bits: int) -> tuple[Grams, Grams]:
        """Bigrams, the first with the start of the text as history, and trigrams, from the second
        token on; their hashes are the upper ``bits`` of 64."""
        n = len(self.words)
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[self.starts] = n
        h = np.append(hashes, _START)
        local, where = np.unique(before.astype(np.int64) * (n + 1) + self.stream, return_inverse=True)
        full = _mixed(h[local // (n + 1)], h[local % (n + 1)])
        keys, inverse = np.unique(full >> np.uint64(64 - bits), return_inverse=True)
        two = Grams(keys, inverse[where], self.train)
        # a trigram is told by the local numbers of its history, a bigram, and of its word
        past = np.empty_like(where)
        past[1:] = where[:-1]
        inner = np.ones(len(self.stream), dtype=bool)
        inner[self.starts] = False
        third, at = np.unique(past[inner] * (n + 1) + self.stream[inner], return_inverse=True)
        keys, inverse = np.unique(_mixed(full[third // (n + 1)] * _START, h[third % (n + 1)]) >> np.uint64(64 - bits), return_inverse=True)
        place = np.full(len(self.stream), len(keys), dtype=np.int64)
        place[inner] = inverse[at]
        return two, Grams(keys, place, self.train)


def _owner(hashes: np.ndarray, owners: int, bits: int = 64) -> np.ndarray:
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(owners)) >> np.uint64(32)


class Automaton:
    """The part of the backoff automaton that a block's texts can reach. Weights are log10.

    States are the root, the block's words (and the start), and its bigrams. ``root``: weights of the
    words' arcs out of the root. ``arc1``: weights of the bigrams' arcs out of the states of their
    first words; ``arc2``: of the trigrams' arcs out of the states of their bigrams; nan: there is no
    such arc. ``fail1`` and ``fail2``: weights of the states' failure arcs; nan: no such state."""

    def __init__(self, block: Block, two: Grams, three: Grams, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, v: int, texts: int, kappa: tuple[float, float]):
        self.block, self.two, self.three = block, two, three
        p = (words + 0.5) / (n + 0.5 * (v + 1))
        stream, first = block.stream, np.ones(len(block.stream), dtype=bool)
        first[:] = False
        first[block.starts] = True
        before = np.empty_like(stream)
        before[1:] = stream[:-1]
        before[first] = len(words)
        history, word = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
        history[two.place], word[two.place] = before, stream
        seen = np.append(words, texts)  # every token but the end has a successor
        with np.errstate(divide="ignore", invalid="ignore"):
            self.root = np.log10(p)
            below = (pairs + kappa[0] * p[word]) / (seen[history] + kappa[0])
            self.arc1 = np.where(pairs > 0, np.log10(below), np.nan)
            self.fail1 = np.where(seen > 0, np.log10(kappa[0] / (seen + kappa[0])), np.nan)
            # the probability of a trigram's word after the last word of its history alone
            lower, past = np.zeros(len(triples)), np.zeros(len(triples), dtype=np.int64)
            inner = ~first
            then = np.zeros_like(two.place)
            then[1:] = two.place[:-1]
            lower[three.place[inner]] = below[two.place[inner]]
            past[three.place[inner]] = then[inner]
            self.arc2 = np.where(triples > 0, np.log10((triples + kappa[1] * lower) / (pairs[past] + kappa[1])), np.nan)
            self.fail2 = np.where(pairs > 0, np.log10(kappa[1] / (pairs + kappa[1])), np.nan)
        self.before, self.then, self.first = before, then, first

    def traverse(self) -> np.ndarray:
        """Log-probability of each document: one traversal from left to right that carries the state.

        The state is told by how many of the last words its history has: ``depth`` 2, 1 or 0. What
        can be met at a token (its arcs out of these states, and their failure arcs) is laid out for
        a stretch of tokens at a time."""
        b, out, total, depth = self.block, [], 0.0, 1
        arc2, fail2 = np.append(self.arc2, np.nan), self.fail2
        for at in range(0, len(b.stream), STRETCH):
            cut = slice(at, at + STRETCH)
            met = zip(
                b.stream[cut].tolist(),
                self.root[b.stream[cut]].tolist(),
                self.fail1[self.before[cut]].tolist(),
                self.arc1[self.two.place[cut]].tolist(),
                np.where(self.first[cut], np.nan, fail2[self.then[cut]]).tolist(),
                arc2[self.three.place[cut]].tolist(),
            )
            for word, root, fail1, arc1, fail2_, arc2_ in met:
                if depth == 2:
                    if arc2_ == arc2_:  # not nan: there is an arc
                        total += arc2_
                        if word:
                            continue  # a seen trigram ends in a seen bigram
                        out.append(total)
                        total, depth = 0.0, 1
                        continue
                    total += fail2_
                    depth = 1
                if depth == 1:
                    if arc1 == arc1:
                        total += arc1
                        depth = 2
                    else:
                        if fail1 == fail1:
                            total += fail1
                        total += root
                else:
                    total += root
                    depth = 1
                if not word:
                    out.append(total)
                    total, depth = 0.0, 1
        return np.array(out)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block each; ids stay Arrow arrays, so no type of id is altered."""

    def fresh():
        return {b"": 0}, [], [], [], [], 0

    vocab, stream, lengths, held, ids, size = fresh()

    def flush() -> pa.RecordBatch:
        words = sorted(vocab, key=vocab.get)
        row = {
            "block": [uuid.uuid4().hex],
            "words": [zstandard.compress(b"\n".join(words[1:]), 3)],
            "stream": [_pack(np.concatenate(stream))],
            "lengths": [_pack(np.array(lengths, dtype="<i8"))],
            "held": [_pack(np.array(held, dtype=np.uint8))],
            "n_tokens": [int(sum(lengths))],
        }
        own = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([*[pa.array(x) for x in row.values()], pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=[*row, "ids"])

    for batch in batches:
        for i, (text, h) in enumerate(zip(batch.column("text").to_pylist(), batch.column("held").to_pylist())):
            words = (text or b"").lower().split()
            numbers = [vocab.setdefault(w, len(vocab)) for w in words]
            numbers.append(0)
            stream.append(np.array(numbers, dtype="<i4"))
            lengths.append(len(numbers))
            held.append(h)
            ids.append(batch.column("id").slice(i, 1))
            size += len(text or b"") + 16
            if size >= block_bytes:
                yield flush()
                vocab, stream, lengths, held, ids, size = fresh()
    if ids:
        yield flush()


def _block(row: dict) -> Block:
    body = zstandard.decompress(row["words"])
    words = [b"", *body.split(b"\n")] if body else [b""]
    return Block(words, _unpack(row["stream"], "<i4"), _unpack(row["lengths"], "<i8"), _unpack(row["held"], "u1").astype(bool))


def _cuts(sorted_owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    found, start = np.unique(sorted_owner, return_index=True)
    for o, a, b in zip(found, start, np.append(start[1:], len(sorted_owner))):
        yield int(o), slice(int(a), int(b))


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", kappa: tuple[float, float] = KAPPA, block_bytes: int = BLOCK_BYTES, owner_tokens: int = OWNER_TOKENS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column of ``docs``; the counts are of all other rows. Null counts as
    empty: its only token is the end. Repeated rows are counted and scored like any other. Without
    training rows every count is 0; an empty table gives no rows.

    A task holds one block, or what an owner was sent: both are of a fixed size. Messages number
    blocks times owners, so with more memory both sizes should be larger (see README)."""
    id_type = dict(docs.dtypes)[id_col]
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), held_out.alias("held"))
    schema = f"block string, words binary, stream binary, lengths binary, held binary, n_tokens long, ids array<{id_type}>"
    blocks = written(named.mapInArrow(lambda it: _blocks(it, block_bytes), schema), "lm-blocks", "none")
    tokens, n_blocks = blocks.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    owners, bits = max(8, -(-(tokens or 0) // owner_tokens)), min(64, max(40, MARGIN + (tokens or 1).bit_length()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _block(row)
                counts, hashes = b.word_counts(), b.hashes()
                owner = _owner(hashes, owners)
                order = np.argsort(owner, kind="stable")
                out = []
                for o, cut in _cuts(owner[order]):
                    mine = order[cut]
                    out.append((o, 1, len(mine), zstandard.compress(b"\n".join([b.words[i] for i in mine]), 3), pack_counts(counts[mine])))
                for kind, g in enumerate(b.grams(hashes, bits), 2):
                    for o, cut in _cuts(_owner(g.keys, owners, bits)):
                        out.append((o, kind, cut.stop - cut.start, pack_keys(g.keys[cut]), pack_counts(g.counts[cut])))
                o, kind, size, body, count = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o, pa.int64()), pa.array(kind, pa.int32()), pa.array([row["block"]] * len(o)), pa.array(size, pa.int64()), pa.array(body, pa.binary()), pa.array(count, pa.binary())],
                    names=["owner", "kind", "block", "size", "body", "counts"],
                )

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        owner, kind = int(frame["owner"].iloc[0]), int(frame["kind"].iloc[0])
        if kind == 1:
            number: dict[bytes, int] = {}
            places = [np.array([number.setdefault(w, len(number)) for w in zstandard.decompress(body).split(b"\n")], dtype=np.int64) for body in frame["body"]]
            total = np.zeros(len(number), dtype=np.int64)
        else:
            keys = [unpack_keys(body) for body in frame["body"]]
            known = np.unique(np.concatenate(keys))
            places = [np.searchsorted(known, k).astype(np.int32) for k in keys]
            total = np.zeros(len(known), dtype=np.int64)
            del keys, known
        for at, c, n in zip(places, frame["counts"], frame["size"]):
            total[at] += unpack_counts(c, n)  # no place twice in one block
        replies = [pack_counts(total[at]) for at in places]
        n, v = (int(total.sum()), int((total > 0).sum())) if kind == 1 else (0, 0)
        first = np.arange(len(frame)) == 0
        return pd.DataFrame({"block": frame["block"], "kind": kind, "owner": owner, "counts": replies, "n": np.where(first, n, 0), "v": np.where(first, v, 0)})

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    requests = blocks.select("block", "words", "stream", "lengths", "held").mapInArrow(ask, "owner long, kind int, block string, size long, body binary, counts binary")
    # as many partitions as there are owners, so that a task's share doesn't grow with the corpus
    requests = requests.repartition(max(parts, 6 * owners), "owner", "kind")
    replies = written(requests.groupBy("owner", "kind").applyInPandas(answer, "block string, kind int, owner long, counts binary, n long, v long"), "lm-replies")
    sums = replies.agg(F.sum("n"), F.sum("v")).first()
    total_n, total_v = sums[0] or 0, sums[1] or 0
    texts = docs.where(~held_out).count()

    def finish(block: pa.Table, reply: pa.Table) -> pa.Table:
        (row,) = block.drop_columns(["ids"]).to_pylist()
        b = _block(row)
        hashes = b.hashes()
        answers = {(k, o): c for k, o, c in zip(reply["kind"].to_pylist(), reply["owner"].to_pylist(), reply["counts"].to_pylist())}
        owner = _owner(hashes, owners)
        order = np.argsort(owner, kind="stable")
        words = np.zeros(len(b.words), dtype=np.int64)
        for o, cut in _cuts(owner[order]):
            words[order[cut]] = unpack_counts(answers[1, o], cut.stop - cut.start)
        grams, found = b.grams(hashes, bits), []
        for kind, g in enumerate(grams, 2):
            found.append(np.zeros(len(g.keys), dtype=np.int64))
            for o, cut in _cuts(_owner(g.keys, owners, bits)):
                found[-1][cut] = unpack_counts(answers[kind, o], cut.stop - cut.start)
        machine = Automaton(b, *grams, words, *found, total_n, total_v, texts, kappa)
        columns = {
            "id": block["ids"].combine_chunks().flatten(),
            "held_out": pa.array(b.held, pa.bool_()),
            "n_tokens": pa.array(b.lengths, pa.int64()),
            "n_known": pa.array(np.add.reduceat((words > 0)[b.stream].astype(np.int64), b.starts), pa.int64()),
            "train_tokens": pa.array(np.full(len(b.held), total_n), pa.int64()),
            "base_score": pa.array(np.add.reduceat(machine.root[b.stream], b.starts), pa.float64()),
            "score": pa.array(machine.traverse(), pa.float64()),
        }
        return pa.table(list(columns.values()), names=list(columns))

    result = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    n = max(parts, 2 * (n_blocks or 0))
    left = blocks.drop("n_tokens").repartition(n, "block").groupBy("block")
    right = replies.select("block", "kind", "owner", "counts").repartition(n, "block").groupBy("block")
    return left.cogroup(right).applyInArrow(finish, result).withColumnRenamed("id", id_col)
