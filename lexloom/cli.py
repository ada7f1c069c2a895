"""Command line: ``python -m lexloom.cli MODE ...``, or through spark-submit."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from lexloom.operators import cleaner, lani, segmenter, tokenizer
from lexloom.plans import workflows

CONVERT = {"convert-source2jsonl": ("source", "jsonl"), "convert-medusa2jsonl": ("medusa", "jsonl"), "convert-warc2jsonl": ("warc", "jsonl"), "convert-source2warc": ("source", "warc"), "convert-source2medusa": ("source", "medusa"), "convert-warc2source": ("warc", "source")}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexloom")
    modes = p.add_subparsers(dest="mode", required=True)

    def mode(name: str, files: bool = True) -> argparse.ArgumentParser:
        m = modes.add_parser(name)
        if files:
            m.add_argument("input")
            m.add_argument("output")
            m.add_argument("--input-format")
            m.add_argument("--output-format")
            m.add_argument("--single-file", action="store_true")
        m.add_argument("--cpus", type=int, default=None)
        return m

    for name in ("tokenize", "tokenize-loop"):
        m = mode(name, name == "tokenize")
        for flag in ("abbrev-list", "fixed-tokens", "char-actions"):
            m.add_argument(f"--{flag}")
    for name in ("cleaner", "cleaner-loop"):
        m = mode(name, name == "cleaner")
        m.add_argument("--dn-rules", default=str(cleaner.RESOURCES))
        for flag in ("text-type", "lang-code", "fn-replacements"):
            m.add_argument(f"--{flag}")
    for name in ("segmentize", "segmentize-loop"):
        m = mode(name, name == "segmentize")
        for flag in ("boundaries-file", "pre-boundary-list-file", "post-boundary-list-file", "pre-boundary-rules-file", "post-boundary-rules-file"):
            m.add_argument(f"--{flag}")
        for flag in ("no-uppercase-pre-list-first-letter", "no-carriage-return", "no-empty-line", "no-trim"):
            m.add_argument(f"--{flag}", action="store_true")
    for name in ("lani", "lani-loop"):
        m = mode(name, name == "lani")
        m.add_argument("--dn-wordlists", required=True)
        m.add_argument("--special-chars", default=lani.SPECIAL_CHARS)
        m.add_argument("--fn-filterlist")
        m.add_argument("--max-words", type=int)
        m.add_argument("--reduced", action="store_true")
        m.add_argument("--language", action="append")
    for name in CONVERT:
        mode(name)
    m = mode("split-source")
    m.add_argument("--max-bytes", type=int)
    m.add_argument("--max-documents", type=int)
    m = mode("slice-source")
    m.add_argument("--start", type=int)
    m.add_argument("--stop", type=int)
    m = mode("stats")
    return p


def make_segmenter(a) -> segmenter.Segmenter:
    given = [a.boundaries_file, a.pre_boundary_list_file, a.post_boundary_list_file, a.pre_boundary_rules_file, a.post_boundary_rules_file]
    flags = {"capitalise": not a.no_uppercase_pre_list_first_letter, "line_feed": not a.no_carriage_return, "empty_line": not a.no_empty_line, "trim": not a.no_trim}
    return segmenter.Segmenter.from_files(*given, **flags) if any(given) else segmenter.Segmenter.default(**flags)


def make_tokenizer(a) -> tokenizer.Tokenizer:
    d = tokenizer.RESOURCES
    return tokenizer.Tokenizer(tokenizer.read_actions(a.char_actions or d / "actions.tsv"), tokenizer.read_abbreviations(a.abbrev_list or d / "abbreviations.txt"), frozenset(segmenter.read_entries(a.fixed_tokens or d / "fixed.txt")))


def make_session(cpus: int | None):
    """A session; outside a cluster with so many threads, all but one by default, one for 0 or less."""
    import os

    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("lexloom").config("spark.sql.session.timeZone", "UTC")
    if not os.environ.get("SPARK_ENV_LOADED"):
        n = (os.cpu_count() or 2) - 1 if cpus is None else cpus
        builder = builder.master(f"local[{max(1, n)}]")
    return builder.getOrCreate()


def _loop(step) -> int:
    for line in sys.stdin:
        for out in step(line.rstrip("\n")):
            print(out, flush=True)
    return 0


def _sentence_filter(rules: list[cleaner.Rule], spark):
    from pyspark.sql import functions as F

    def step(line: str) -> list[str]:
        row = spark.createDataFrame([(line,)], "sentence string").select(cleaner.reasons(F.col("sentence"), rules).alias("r")).first()
        return [f"{'-' if row['r'] else '+'}\t{','.join(map(str, row['r']))}\t{line}"]

    return step


def _language(a, spark):
    words = lani.read_wordlists(spark, a.dn_wordlists, a.language).cache()
    filtered = None
    if a.fn_filterlist:
        filtered = spark.createDataFrame([(w,) for w in segmenter.read_entries(a.fn_filterlist)], "word string")

    def step(line: str) -> list[str]:
        df = spark.createDataFrame([(0, line)], "id int, sentence string")
        r = lani.best(lani.scores(df, words, ["id"], filter_list=filtered, special=a.special_chars, max_words=a.max_words, reduced=a.reduced), ["id"]).first()
        return [f"{r['language']}\t{r['probability']}\t{r['language_nextbest']}\t{r['probability_nextbest']}\t{line}"]

    return step


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.mode == "segmentize-loop":
        return _loop(make_segmenter(a))
    if a.mode == "tokenize-loop":
        words = make_tokenizer(a)
        return _loop(lambda line: [words(line)])
    spark = make_session(a.cpus)
    if a.mode in ("cleaner", "cleaner-loop"):
        rules = cleaner.load_rules(a.dn_rules, a.text_type, a.lang_code)
        if a.mode == "cleaner-loop":
            return _loop(_sentence_filter(rules, spark))
        pairs = cleaner.load_replacements(a.fn_replacements) if a.fn_replacements else []
        workflows.clean_files(spark, a.input, a.output, rules, pairs, a.input_format, a.output_format, a.single_file)
    elif a.mode == "tokenize":
        workflows.tokenize_files(spark, a.input, a.output, make_tokenizer(a), a.input_format, a.output_format, a.single_file)
    elif a.mode == "segmentize":
        workflows.segment_files(spark, a.input, a.output, make_segmenter(a), a.input_format, a.output_format, a.single_file)
    elif a.mode == "lani-loop":
        return _loop(_language(a, spark))
    elif a.mode == "lani":
        workflows.identify_files(spark, a.input, a.output, lani.read_wordlists(spark, a.dn_wordlists, a.language))
    elif a.mode in CONVERT:
        kind_in, kind_out = CONVERT[a.mode]
        workflows.convert_files(spark, a.input, a.output, a.input_format or kind_in, a.output_format or kind_out, a.single_file)
    elif a.mode == "split-source":
        workflows.split_files(spark, a.input, a.output, a.max_documents, a.max_bytes)
    elif a.mode == "slice-source":
        workflows.slice_files(spark, a.input, a.output, a.start, a.stop)
    elif a.mode == "stats":
        if (a.input_format or Path(a.input).suffix[1:]) == "medusa":
            workflows.sentence_stats(spark, a.input).write.json(a.output)
        else:
            workflows.document_stats(spark, a.input, a.input_format).write.json(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
