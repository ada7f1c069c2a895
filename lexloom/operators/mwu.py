"""Multi-word units: n-grams of tokens that are in a list."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.segmenter import read_entries
from lexloom.operators.vocabulary import lookup


def read_units(path: str | Path, tokenizer) -> dict[str, str]:
    """Tokenized form -> unit, from the first column of a list; a backslash stands for a blank.

    An entry needs a blank, and no three in a row."""
    units = (line.split("\t")[0].replace("\\", " ") for line in read_entries(path))
    return {tokenizer(u): u for u in units if " " in u.strip() and "   " not in u}


def find_units(sentences: DataFrame, units: DataFrame, key: list[str], column: str = "tokenized", compat: bool = False) -> DataFrame:
    """``key``, pos, unit: where a unit (units: unit_tok, unit) starts, counted in tokens from 0.

    With ``compat`` a unit at the end of a sentence that isn't at its start counts twice."""
    most = units.agg(F.max(F.size(F.split("unit_tok", " ")))).first()[0] or 2
    tokens = F.filter(F.split(column, " "), lambda t: t != "")
    base = sentences.select(*key, tokens.alias("t"))
    grams = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(most)), lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.struct(i.alias("pos"), n.alias("n"), F.array_join(F.slice(F.col("t"), i + 1, n), " ").alias("unit_tok")))).otherwise(F.array().cast("array<struct<pos:int,n:int,unit_tok:string>>"))))
    found = lookup(base.select(*key, F.size("t").alias("size"), F.explode(grams).alias("g")).select(*key, "size", "g.pos", "g.n", "g.unit_tok"), units, ["unit_tok"])
    if compat:
        twice = (F.col("pos") > 0) & (F.col("pos") + F.col("n") == F.col("size"))
        found = found.withColumn("again", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return found.select(*key, "pos", F.col("n").alias("words"), "unit")


def unit_map(units: DataFrame) -> DataFrame:
    """Lines ``tokenized<TAB>unit`` of the mapping file."""
    return units.select(F.concat_ws("\t", "unit_tok", "unit").alias("line"))


class UnitTokenizer:
    """A tokenizer whose fixed tokens include the units: longest first, they are kept together."""

    def __init__(self, tokenizer, units: dict[str, str], joiner: str = " "):
        self.tokenizer, self.units, self.joiner = tokenizer, dict(units), joiner
        longest_first = sorted(self.units, key=len, reverse=True)
        self.pattern = "|".join(map(re.escape, longest_first))

    def __call__(self, line: str) -> str:
        out = self.tokenizer(line)
        if not self.pattern or out is None:
            return out
        return re.sub(rf"(?<!\S)(?:{self.pattern})(?!\S)", lambda m: self.units[m.group()].replace(" ", self.joiner), out)
