"""Annotations of texts as columns: tokens with blanks, rejection reasons, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import cleaner
from lexloom.operators.align import split_tokens, token_glue, token_starts


def token_structs(raw: Column, tokenized: Column, first_of_sentence: Column | None = None) -> Column:
    """array<struct<text, start, space_after, is_sent_start>>; null where tokens don't align."""
    tokens = split_tokens(tokenized)
    starts = token_starts(raw, tokens)
    glue = token_glue(tokens, starts)
    firsts = first_of_sentence if first_of_sentence is not None else F.array(F.lit(0))
    # the last token has no blank behind it, as if it touched the next
    zipped = F.arrays_zip(tokens.alias("t"), starts.alias("s"), F.concat(glue, F.array(F.lit(True))).alias("g"))
    made = F.transform(zipped, lambda x, i: F.struct(x["t"].alias("text"), x["s"].alias("start"), (~x["g"]).alias("space_after"), F.array_contains(firsts, i).alias("is_sent_start")))
    return F.when(starts.isNotNull(), made)


def annotate_cleaning(df: DataFrame, rules: list[cleaner.Rule], column: str = "sentence") -> DataFrame:
    """``df`` with filtered and filter_reasons, the results of all rules that reject."""
    found = F.filter(cleaner.results(F.col(column), rules), lambda r: r["filtered"])
    return df.withColumn("filter_reasons", found).withColumn("filtered", F.size("filter_reasons") > 0)


def language_struct(best: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and language struct<code, prob>; null where the language is unknown."""
    known = F.col("language") != "unknown"
    return best.select(*key, F.when(known, F.struct(F.col("language").alias("code"), (F.col("probability") / 100).alias("prob"))).alias("language"))
