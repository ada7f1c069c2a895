"""Token counts by overlap resynchronisation.

A long document is encoded in overlapping chunks, each with the offsets of its tokens. Two chunks are
spliced where both have a token boundary that is proven stable: between a word and white space or a
line break and a word, or where letters, digits and other signs change, the tokenizer's first pass
cuts whatever came before (an apostrophe excepted); and far enough from the end of the earlier chunk
that the cut there can't reach it. The overlap is widened to reach such a place. A chunk without any
is doubled, so that a text that has none costs at most about twice its plain encoding. Counts equal
those of the whole text.

What is proven holds for byte-level BPE with the usual first pass. The file says whether it is that;
other ``.json`` files are run whole by ``tokenizers``, and ``.model`` files by ``sentencepiece``. The
vocabulary is read from its file on each worker. Its path is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a chunk; shorter documents are encoded at once.
CHUNK = 65_536
#: Code points by which chunks overlap at first.
OVERLAP = 512
#: Code points before a chunk's end in which its tokens may still depend on what follows.
MARGIN = 32

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies are written in."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    table = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            table[chr(next(spare))] = b
    return table


class ByteBpe:
    """Byte-level BPE read from a ``tokenizers`` JSON file, run by ``tiktoken``."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if not byte_level(data):
            raise ValueError("a byte-level BPE without normalizer and with the usual first pass is needed")
        alphabet = _byte_alphabet()
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        for token, i in special.items():
            lengths[i] = len(token.encode())
        self.lengths = lengths

    def encode(self, text: str) -> list[int]:
        """Token ids; special strings inside the text are special tokens, as is the library's default."""
        return self.encoding.encode(text, allowed_special="all")

    def boundaries(self, text: str) -> np.ndarray:
        """Byte offsets in ``text`` at which a token starts, and its end."""
        return np.concatenate(([0], np.cumsum(self.lengths[np.array(self.encode(text), dtype=np.int64)])))


def byte_level(data: dict) -> bool:
    """Whether a tokenizer's file is of the kind that ``ByteBpe`` and its stable places hold for."""
    first, model = data.get("pre_tokenizer") or {}, data.get("model") or {}
    usual = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", False)
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    marks = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) or t["content"] in model.get("vocab", {}) for t in data.get("added_tokens", []))
    return model.get("type") == "BPE" and usual and plain and marks and not data.get("normalizer")


class Whole:
    """Any other tokenizer, run over whole texts by its own library."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            run = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda text: run.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe | Whole:
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            if byte_level(json.load(f)):
                return ByteBpe(path)
    return Whole(path)


_STABLE = regex.compile(
    r"(?<=\S)(?=\s)|(?<=[^\S ])(?=\S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)


def _stable(text: str, start: int, stop: int) -> list[int]:
    """Places in ``text[start:stop]`` where a token starts for sure."""
    return [m.start() for m in _STABLE.finditer(text, max(1, start), stop) if m.start() < stop]


def splice(left: str, left_ends: np.ndarray, right: str, right_ends: np.ndarray, shift: int, margin: int = MARGIN) -> tuple[int, int] | None:
    """Tokens of ``left`` before, and of ``right`` up to, the last proven common boundary of two
    chunks, ``right`` starting ``shift`` code points into ``left``; None if there is none."""
    lead = len(left[:shift].encode("utf-8", "surrogatepass"))
    for place in reversed(_stable(left, shift + 1, len(left) - margin)):
        byte = lead + len(left[shift:place].encode("utf-8", "surrogatepass"))
        a, b = int(np.searchsorted(left_ends, byte)), int(np.searchsorted(right_ends, byte - lead))
        if a < len(left_ends) and left_ends[a] == byte and b < len(right_ends) and right_ends[b] == byte - lead:
            return a, b
    return None


def _reach(text: str, overlap: int, margin: int) -> int | None:
    """The overlap that has a stable place: ``overlap``, or wider; None if there is no such place."""
    n, wide = len(text), overlap
    while wide < n:
        if _stable(text, n - wide + 1, n - margin):
            return wide
        wide *= 2
    places = _stable(text, 1, n - margin)
    return n - places[-1] + 1 if places and n - places[-1] + 1 < n else None


def count_tokens(text: str, model: ByteBpe | Whole, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Number of tokens of the whole text."""
    if len(text) <= chunk or isinstance(model, Whole):
        return len(model.encode(text))
    total, start, skip, size, extra = 0, 0, 0, chunk, overlap  # skip: tokens of this chunk already counted
    while True:
        here = text[start : start + size]
        if start + size >= len(text):
            return total + len(model.encode(here)) - skip
        wide = _reach(here, extra, margin)
        if wide is None:
            size, extra = 2 * size, overlap
            continue
        ends = model.boundaries(here)
        begin = start + size - wide
        then = text[begin : begin + max(chunk, 2 * wide)]
        step = splice(here, ends, then, model.boundaries(then), begin - start, margin)
        if step is None:  # stable places, but none that both chunks have: look further back
            if extra * 4 < size:
                extra *= 4
            else:
                size, extra = 2 * size, overlap
            continue
        total += step[0] - skip
        skip, start, size, extra = step[1], begin, max(chunk, 2 * wide), overlap


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than ``limit``) of every row.

    Null counts as empty: no bytes, no tokens. Repeated rows are counted alike; an empty table gives
    no rows. One pass without a shuffle; a task holds one batch of texts and one chunk of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [count_tokens(t, model) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.col(text_col)
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return named.mapInArrow(count, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
