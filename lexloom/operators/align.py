"""Alignment of tokens with the raw sentence.

Finding the tokens is sequential, each search starting where the last one ended, so it runs in an
Arrow-batched function that is linear in the sentence; what follows from the places is columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(tokenized: Column) -> Column:
    return F.split(tokenized, " ")


def find_tokens(raw: str, tokens: list[str]) -> list[int] | None:
    """Places of the tokens in ``raw``; None if one is missing or anything but blanks is left."""
    at, out = 0, []
    for t in tokens:
        place = raw.find(t, at)
        if place < 0:
            return None
        out.append(place)
        at = place + len(t)
    return None if raw[at:].strip() else out


def token_starts(raw: Column, tokens: Column, strict: bool = False) -> Column:
    """array<int> of the tokens' places (from 0), each looked for after the one before.

    Null where they don't align, or if either side is null; an error with ``strict``."""

    @F.pandas_udf("array<int>")
    def run(sentences: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for s, ts in zip(sentences, lists):
            found = None if s is None or ts is None else find_tokens(s, list(ts))
            if found is None and strict:
                raise ValueError(f"tokens don't align: {s}")
            out.append(found)
        return pd.Series(out, dtype=object)

    return run(raw, tokens)


def token_glue(tokens: Column, starts: Column) -> Column:
    """array<boolean>: whether each token but the first touches the one before it."""
    # zipped, not looked up by place: what a lambda refers to outside is evaluated for every element
    ends = F.zip_with(starts, tokens, lambda s, t: s + F.length(t))
    rest = F.greatest(F.lit(0), F.size(tokens) - 1)
    return F.zip_with(F.slice(ends, 1, rest), F.slice(starts, 2, rest), lambda e, s: e == s)
