"""Sentence segmentation.

Candidates are the leftmost hits of a boundary list, the order of the list deciding between hits at
one place. A line feed always ends a sentence; any other candidate can be vetoed by the lists and
rules about the tokens before and after it. What an accepted boundary cuts off is never looked at
again. This is sequential in a document, so it runs in an Arrow-batched function over whole texts; a
configuration without lists and rules is a column expression.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from lexloom.functions.text import collapse, lines

LOG = logging.getLogger(__name__)
RESOURCES = Path(__file__).resolve().parent.parent / "resources" / "segmenter"
DEFAULT_BOUNDARIES = (".", "!", "?")
#: Bytes of text that are Python's strings at a time.
PIECE_BYTES = 1_000_000


def read_entries(path: str | Path | None) -> list[str]:
    """Lines of a list file; no path or no file is an empty list."""
    if path is None:
        return []
    if not Path(path).exists():
        LOG.warning("no list file %s", path)
        return []
    found = (line.rstrip() for line in Path(path).read_text(encoding="utf-8").split("\n"))
    return [x for x in found if x]


def read_decisions(path: str | Path | None) -> list[tuple[str, bool]]:
    """Rules ``+ pattern`` (boundary) and ``- pattern`` (none), in order; bad ones are passed over."""
    rules = []
    for line in read_entries(path):
        if line.startswith("#"):
            continue
        if line[:2] not in ("+ ", "- "):
            LOG.warning("a rule starts with '+ ' or '- ': %s", line)
            continue
        try:
            re.compile(line[2:])
        except re.error as e:
            LOG.error("bad pattern %s: %s", line, e)
            continue
        rules.append((line[2:], line[0] == "+"))
    return rules


@dataclass
class Segmenter:
    """Callable ``str -> list[str]``; picklable, so that it can be sent to workers.

    ``before``: entries, boundary included, after which there is no boundary (abbreviations);
    ``after``: tokens before which there is none; ``before_rules`` and ``after_rules``: patterns for
    the whole token before and after, the first that matches decides."""

    boundaries: tuple[str, ...] = DEFAULT_BOUNDARIES
    before: frozenset[str] = frozenset()
    after: frozenset[str] = frozenset()
    before_rules: tuple[tuple[str, bool], ...] = ()
    after_rules: tuple[tuple[str, bool], ...] = ()
    capitalise: bool = True
    trim: bool = True
    line_feed: bool = True
    empty_line: bool = True
    _ready: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def from_files(cls, boundaries=None, before=None, after=None, before_rules=None, after_rules=None, **flags) -> Segmenter:
        return cls(tuple(read_entries(boundaries)) or DEFAULT_BOUNDARIES, frozenset(read_entries(before)), frozenset(read_entries(after)), tuple(read_decisions(before_rules)), tuple(read_decisions(after_rules)), **flags)

    @classmethod
    def default(cls, folder: str | Path = RESOURCES, **flags) -> Segmenter:
        f = Path(folder)
        return cls.from_files(f / "boundaries.txt", f / "before.txt", f / "after.txt", f / "before.rules", f / "after.rules", **flags)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    def plain(self) -> bool:
        return not (self.before or self.after or self.before_rules or self.after_rules)

    def _prepare(self) -> dict:
        if not self._ready:
            marks = list(dict.fromkeys([*self.boundaries, "\n"]))
            extra = {w[0].upper() + w[1:] for w in self.before if self.capitalise and not w[0].isupper()}
            self._ready.update(
                marks=marks,
                find=re.compile("|".join(map(re.escape, marks))),
                before=self.before | extra,
                after=self.after,
                window=max(map(len, self.before), default=0),
                before_rules=[(re.compile(p), yes) for p, yes in self.before_rules],
                after_rules=[(re.compile(p), yes) for p, yes in self.after_rules],
            )
        return self._ready

    def _arranged(self, text: str) -> str:
        """Lines joined by line feeds or blanks, as the flags say."""
        out = []
        for line in text.splitlines():
            if line.strip():
                out.append(line + ("\n" if self.line_feed else " "))
            else:
                out.append("\n" if self.empty_line else line + " ")
        return "".join(out)

    def _vetoed(self, text: str, base: int, start: int, stop: int) -> bool:
        """Whether the candidate ``text[start:stop]`` is no boundary; ``base`` is the sentence's start."""
        r = self._ready
        if r["before"]:
            low = max(base, start - r["window"])
            cut = text.rfind(" ", low, start)
            if text[low if cut < 0 else cut + 1 : stop].strip() in r["before"]:
                return True
        # the token after ends at the next blank but one character; without one there is none
        blank = text.find(" ", stop + 1)
        if r["after"] and blank >= 0:
            token = text[stop:blank]
            for mark in r["marks"]:
                if token.endswith(mark):
                    token = token[: -len(mark)]
                    break
            if token.strip() in r["after"]:
                return True
        if r["before_rules"]:
            cut = text.rfind(" ", base, start)
            # with a blank right before the mark, all of the sentence so far is the token
            token = text[(cut + 1 if 0 <= cut < start - 1 else base) : start].strip()
            for pattern, yes in r["before_rules"]:
                if pattern.fullmatch(token):
                    if not yes:
                        return True
                    break
        if r["after_rules"] and blank >= 0:
            token = text[stop:blank]
            for pattern, yes in r["after_rules"]:
                if pattern.fullmatch(token):
                    return not yes
        return False

    def split(self, text: str) -> list[str]:
        """Sentences with their boundaries and blanks; the rest after the last one is always there."""
        r, out, base = self._prepare(), [], 0
        for m in r["find"].finditer(text):
            if m.group() == "\n" or not self._vetoed(text, base, m.start(), m.end()):
                out.append(text[base : m.end()])
                base = m.end()
        out.append(text[base:])
        return out

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        found = self.split(self._arranged(text))
        if self.trim:
            found = [" ".join(s.split()) for s in found]
        return [s for s in found if s]


def plain_sentences(text: Column, marks: str = ".!?") -> Column:
    """array<string>: sentences where every mark and line break is a boundary, blanks folded."""
    whole = F.concat(F.array_join(lines(text), "\n"), F.lit("\n"))
    parts = F.regexp_extract_all(whole, F.lit(rf"(?d)[^{re.escape(marks)}\n]*[{re.escape(marks)}\n]"), F.lit(0))
    return F.filter(F.transform(parts, collapse), lambda s: s != "")


def segment(df: DataFrame, segmenter: Segmenter, column: str = "content", into: str = "sentences") -> DataFrame:
    """``df`` with an array of the sentences of each text; null has none."""
    standard = segmenter.plain() and segmenter.trim and segmenter.line_feed and segmenter.empty_line
    if standard and all(len(b) == 1 for b in segmenter.boundaries):
        return df.withColumn(into, plain_sentences(F.coalesce(F.col(column), F.lit("")), "".join(segmenter.boundaries)))
    return df.withColumn(into, text_function(segmenter, "array<string>")(F.col(column)))


def text_function(function, kind: str):
    """Any picklable function of a text as an Arrow-batched column function. Texts are strings of
    Python for about ``PIECE_BYTES`` of a batch at a time, as is what is made of them."""
    made = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast("int64")).to_numpy()
        out, at = [pa.array([], made)], 0
        while at < len(texts):
            stop = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + PIECE_BYTES, "right")))
            out.append(pa.array([function(t) for t in texts.slice(at, stop - at).to_pylist()], made))
            at = stop
        return pa.concat_arrays(out)

    return run.asNondeterministic()  # else a filter that explode infers runs it a second time


def sentence_rows(df: DataFrame, column: str = "sentences") -> DataFrame:
    """One row a sentence, numbered from 0 in its document."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("sent_ord", "sentence"))
