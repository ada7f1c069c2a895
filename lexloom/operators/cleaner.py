"""Sentence cleaner: a rule language compiled to column expressions.

A rule rejects a sentence if all of its conditions hold. Rules come from text files in layers
(general, then text type, then language): a later rule replaces an earlier one of its number and goes
to the end, and a disabled one removes it. Everything is one projection and one filter in generated
code; the number of the first rejecting rule, or the hits of all, come from the same expressions.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
RESOURCES = Path(__file__).resolve().parent.parent / "resources" / "cleaner"
#: A pattern of this text disables its rule, like the keyword DISABLE.
DISABLED = "$UNMATCHABLE"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Rule:
    """One rule; conditions that are None aren't checked."""

    number: int
    description: str = ""
    pattern: str | None = None
    hex_pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    replace_chars: str | None = None
    replace_ratio: float | None = None
    replace_count: int | None = None
    disabled: bool = False

    def has_condition(self) -> bool:
        return any(x is not None for x in (self.pattern, self.hex_pattern, self.min_length, self.max_length)) or (self.replace_chars is not None and (self.replace_ratio is not None or self.replace_count is not None))

    def fires(self, s: Column) -> Column:
        """Whether the rule rejects the sentence."""
        checks = []
        if self.min_length is not None:
            checks.append(F.length(s) < self.min_length)
        if self.max_length is not None:
            checks.append(F.length(s) > self.max_length)
        if self.replace_chars is not None:
            without = F.length(F.translate(s, self.replace_chars, ""))
            if self.replace_ratio is not None:
                checks.append(F.length(s) / (without + 1) > self.replace_ratio)
            elif self.replace_count is not None:
                checks.append(F.length(s) - without >= self.replace_count)
        if self.pattern is not None:
            checks.append(s.rlike("(?d)" + self.pattern))
        if self.hex_pattern is not None:
            checks.append(F.exists(F.split(s, ""), lambda c: F.lower(F.hex(F.encode(c, "UTF-8"))).rlike(self.hex_pattern)))
        return reduce(lambda a, b: a & b, checks)

    def sql(self, s: str) -> str:
        """The same condition in DuckDB's SQL."""
        checks = []
        if self.min_length is not None:
            checks.append(f"length({s}) < {self.min_length}")
        if self.max_length is not None:
            checks.append(f"length({s}) > {self.max_length}")
        if self.replace_chars is not None:
            without = f"length(translate({s}, {_sql(self.replace_chars)}, ''))"
            if self.replace_ratio is not None:
                checks.append(f"length({s})::DOUBLE / ({without} + 1) > {self.replace_ratio}")
            elif self.replace_count is not None:
                checks.append(f"length({s}) - {without} >= {self.replace_count}")
        if self.pattern is not None:
            checks.append(f"regexp_matches({s}, {_sql(self.pattern)})")
        return "(" + " AND ".join(checks) + ")"


def parse_rules(text: str, category: str = "") -> dict[int, Rule]:
    """Rules of a file by number; a rule without number or condition is passed over."""
    found: dict[int, Rule] = {}
    fields: dict = {}

    def close() -> None:
        if "number" in fields:
            rule = Rule(**fields)
            if rule.pattern == DISABLED:
                rule = Rule(rule.number, rule.description, disabled=True)
            if rule.disabled or rule.has_condition():
                found[rule.number] = rule
            else:
                LOG.warning("rule %s has no condition", rule.number)
        fields.clear()

    keys = {
        "DESC:": ("description", lambda v: f"{category}: {v.strip()}" if category else v.strip()),
        "REGEXP:": ("pattern", str),
        "HEX_REGEXP:": ("hex_pattern", str),
        "MINLENGTH:": ("min_length", int),
        "MAXLENGTH:": ("max_length", int),
        "REPLACE_CHARS:": ("replace_chars", str),
        "REPLACE_RATIO:": ("replace_ratio", float),
        "REPLACE_COUNT:": ("replace_count", int),
    }
    for line in text.removeprefix("﻿").split("\n"):
        line = line.rstrip("\r")
        if not line.strip() or line.startswith(("#", "//")):
            continue
        upper = line.upper()
        if m := re.match(r"RULE\s+(\d+)", upper):
            close()
            fields["number"] = int(m[1])
        elif upper.startswith("DISABLE"):
            fields["disabled"] = True
        else:
            for key, (name, kind) in keys.items():
                if upper.startswith(key):
                    fields[name] = kind(line[len(key) :])
                    break
            else:
                LOG.warning("not a rule line: %s", line)
    close()
    return found


def read_rules(path: str | Path) -> dict[int, Rule]:
    path = Path(path)
    if not path.exists():
        LOG.warning("no rule file %s", path)
        return {}
    return parse_rules(path.read_text(encoding="utf-8"), path.stem)


def layered(layers: Iterable[dict[int, Rule]]) -> list[Rule]:
    """Rules in force, in order of evaluation."""
    merged: dict[int, Rule] = {}
    for layer in layers:
        for number, rule in layer.items():
            merged.pop(number, None)
            if not rule.disabled:
                merged[number] = rule
    return list(merged.values())


def load_rules(folder: str | Path = RESOURCES, text_type: str | None = None, lang_code: str | None = None) -> list[Rule]:
    """General rules, those of the text type, those of the language."""
    folder = Path(folder)
    names = ["general.rules"] + [f"texttype_{text_type}.rules"] * bool(text_type) + [f"lang_{lang_code}.rules"] * bool(lang_code)
    return layered(read_rules(folder / n) for n in names)


def parse_replacements(text: str) -> list[tuple[str, str]]:
    """Ordered literal replacements; lines that don't have one tab after their right end is stripped
    (comments, and targets of only white space) are passed over."""
    rows = [line.rstrip().split("\t") for line in text.removeprefix("﻿").split("\n")]
    return [(r[0], r[1]) for r in rows if len(r) == 2 and not r[0].startswith("#")]


def load_replacements(path: str | Path = RESOURCES / "replacements.list") -> list[tuple[str, str]]:
    return parse_replacements(Path(path).read_text(encoding="utf-8"))


def replaced(s: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def first_rule(s: Column, rules: Iterable[Rule]) -> Column:
    """Number of the first rule that rejects the sentence; null if none does."""
    return F.coalesce(*[F.when(r.fires(s), F.lit(r.number)) for r in rules], F.lit(None).cast("int"))


def rejected(s: Column, rules: Iterable[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [r.fires(s) for r in rules], F.lit(False))


def results(s: Column, rules: Iterable[Rule]) -> Column:
    """array<struct<id, description, filtered>> of all rules."""
    return F.array(*[F.struct(F.lit(r.number).alias("id"), F.lit(r.description).alias("description"), r.fires(s).alias("filtered")) for r in rules])


def reasons(s: Column, rules: Iterable[Rule]) -> Column:
    """Numbers of all rejecting rules, in order of evaluation."""
    return F.array_compact(F.array(*[F.when(r.fires(s), F.lit(r.number)) for r in rules]))


def clean(df: DataFrame, rules: list[Rule], column: str = "sentence", replacements: Iterable[tuple[str, str]] = (), custom: Callable[[str], bool] | None = None) -> DataFrame:
    """Rows whose sentence no rule rejects, after replacements; null and empty ones go.

    ``custom`` is a further filter, any picklable function of a sentence that says whether it stays;
    it sees only what the rules leave."""
    pairs = list(replacements)
    out = df.withColumn(column, replaced(F.col(column), pairs)) if pairs else df
    out = out.where(F.col(column).isNotNull() & (F.col(column) != "") & ~rejected(F.col(column), rules))
    if custom is not None:
        @F.pandas_udf("boolean")
        def stays(s: pd.Series) -> pd.Series:
            return s.map(custom).astype(bool)

        out = out.where(stays(F.col(column)))
    return out


def clean_arrays(df: DataFrame, rules: list[Rule], column: str = "sentences", replacements: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """The same for arrays of sentences, without exploding them."""
    pairs = list(replacements)
    changed = F.transform(F.col(column), lambda s: replaced(s, pairs)) if pairs else F.col(column)
    return df.withColumn(column, F.filter(changed, lambda s: s.isNotNull() & (s != "") & ~rejected(s, rules)))


def rule_hits(df: DataFrame, rules: list[Rule], column: str = "sentence", first_only: bool = True) -> DataFrame:
    """rule, hits: by the first rejecting rule of a sentence, or by all."""
    found = F.array_compact(F.array(first_rule(F.col(column), rules))) if first_only else reasons(F.col(column), rules)
    return df.select(F.explode(found).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))
