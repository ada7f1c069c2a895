"""Word tokenizer: separates marks from words by a table of characters.

A character has an action at the start, in the middle and at the end of a word, and at the end of a
sentence. Words are rewritten until nothing changes any more, what comes out of a rewriting being
treated as a line of its own. Fixed tokens and abbreviations stay whole. A word's tokens depend on
the word and on whether it ends the line, so each worker remembers them.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.segmenter import read_entries, text_function

RESOURCES = Path(__file__).resolve().parent.parent / "resources" / "tokenizer"
SENT_START, SENT_END, NUMBER, TAB = "%^%", "%$%", "%N%", "%TAB%"
SENTINELS = frozenset((SENT_START, SENT_END, NUMBER, TAB))
KEEP, SPLIT, DELETE, OTHER = 0, 1, 2, 3
_ACTIONS = {"nothing": KEEP, "whitespace": SPLIT, "delete": DELETE}
#: Quotes that count as belonging to the mark before them at the end of a line.
CLOSERS, MARKS = "\"'“”„,«»", ".!?;:-"
#: Rewritings of a word at most; the table of a sane configuration needs a handful.
MOST_ROUNDS = 200
#: Words that a worker remembers.
REMEMBERED = 200_000


def read_actions(path: str | Path | None) -> dict[str, tuple[int, int, int, int]]:
    """Character table: a header, then id, character, start, middle, end, sentence end by tabs."""
    out = {}
    for line in read_entries(path)[1:]:
        parts = line.strip().split("\t")
        if len(parts) == 6:
            out[parts[1]] = tuple(_ACTIONS.get(a, OTHER) for a in parts[2:])
    return out


def read_abbreviations(path: str | Path | None) -> frozenset[str]:
    """Entries with a dot each, whether or not the list has it."""
    return frozenset(x.strip().lstrip("﻿").rstrip(".") + "." for x in read_entries(path))


def _is_number(word: str) -> bool:
    return all(c.isdigit() or c == "-" or unicodedata.category(c) == "Po" for c in word)


@dataclass
class Tokenizer:
    """Callable ``str -> str`` of tokens joined by blanks; picklable."""

    actions: dict[str, tuple[int, int, int, int]]
    abbreviations: frozenset[str] = frozenset()
    fixed: frozenset[str] = frozenset()
    replace_numbers: bool = False
    _memory: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def default(cls, folder: str | Path = RESOURCES, **flags) -> Tokenizer:
        f = Path(folder)
        return cls(read_actions(f / "actions.tsv"), read_abbreviations(f / "abbreviations.txt"), frozenset(x.strip() for x in read_entries(f / "fixed.txt")), **flags)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memory": {}}

    # characters in table order; a scan that hits one goes on at the second entry of the table

    def _start(self, word: str, last: bool) -> str:
        if len(word) <= 1:
            return self._single(word)
        out, at, i, chars = [], 0, 0, list(self.actions)
        while i < len(chars):
            c = chars[i]
            if word.startswith(c, at):
                action = self.actions[c][0 if at == 0 else 1]
                if action != DELETE:
                    out.append(word[at : at + len(c)])
                if action == SPLIT:
                    out.append(" ")
                at += len(c)
                i = 0
            i += 1
        return ("".join(out) + self._end(word[at:], last)).strip()

    def _end(self, word: str, last: bool) -> str:
        if len(word) == 1:
            return self._single(word)
        tail, final = "", last
        for c, action in self.actions.items():
            if word.endswith(c):
                what = action[3 if final else 2]
                final = False
                kept = "" if what == DELETE else word[-len(c) :]
                tail = (" " if what == SPLIT else "") + kept + tail
                word = word[: -len(c)]
        return (self._dots(word, last) + tail).strip()

    def _dots(self, word: str, last: bool) -> str:
        if len(word) == 1 or not word.strip("."):
            return self._single(word)
        if not word.startswith("."):
            return self._final_dot(word, last).strip()
        action = self.actions["."][0] if "." in self.actions else KEEP
        lead = {SPLIT: ". ", DELETE: ""}.get(action, ".")
        return (lead + self._final_dot(word[1:], last)).strip()

    def _final_dot(self, word: str, last: bool) -> str:
        if len(word) == 1 or word in self.abbreviations:
            return self._single(word)
        if not word.endswith("."):
            return self._number(word)
        bare = word.rstrip(".")
        dots = len(word) - len(bare) if bare else 0
        if dots > 1:
            return f"{self._number(bare)} {'.' * dots}".strip()
        if "." not in self.actions:
            return self._number(word[:-1]) + " ."
        action = self.actions["."][3 if last else 2]
        return self._number(word[:-1]) + {SPLIT: ". ", DELETE: ""}.get(action, ".")

    def _single(self, word: str) -> str:
        return NUMBER if self.replace_numbers and word[:1].isdigit() else word

    def _number(self, word: str) -> str:
        return NUMBER if self.replace_numbers and _is_number(word) else word

    def _inside(self, word: str) -> str:
        """Marks within a word; those at its ends have been dealt with."""
        if len(word.strip()) == 1 or word in self.fixed:
            return word
        rest, done = word, ""
        for c, action in self.actions.items():
            while (at := rest.find(c)) >= 0:
                if at in (0, len(rest) - 1):
                    if c in done:
                        return done + rest
                    break
                done += {SPLIT: f"{rest[:at]} {c} ", DELETE: rest[:at]}.get(action[1], rest[: at + len(c)])
                rest = rest[at + len(c) :]
                if c not in rest:
                    rest, done = done + rest, ""
                    break
        return rest

    def _inside_line(self, line: str) -> str:
        out = []
        for word in line.split():
            if word not in SENTINELS:
                new = self._inside(word)
                for _ in range(MOST_ROUNDS):
                    if new == word:
                        break
                    word, new = new, self._inside_line(new)
            out.append(word)
        return " ".join(out)

    def _word(self, word: str, last: bool) -> str:
        found = self._memory.get((word, last))
        if found is None:
            now, new = word, self._start(word, last)
            for _ in range(MOST_ROUNDS):
                if new == now:
                    break
                now, new = new, self(new)
            new = self._inside_line(now)
            for _ in range(MOST_ROUNDS):
                if new == now:
                    break
                now, new = new, self(new)
            if len(self._memory) >= REMEMBERED:
                self._memory.clear()
            found = self._memory[word, last] = now
        return found

    def __call__(self, line: str | None) -> str | None:
        if line is None:
            return None
        if len(line) > 1 and line[-1] in CLOSERS and line[-2] in MARKS:
            line = f"{line[:-2]} {line[-2:]}"
        words = line.split()
        open_end = bool(line) and line[-1].isspace()
        n = len(words) - 1
        return " ".join(filter(None, (w if w in SENTINELS else self._word(w, i == n and not open_end) for i, w in enumerate(words)))).strip()


def tokenize(df: DataFrame, tokenizer, column: str = "sentence", into: str = "tokenized") -> DataFrame:
    """``df`` with the tokenized sentence; ``tokenizer`` is any picklable ``str -> str``."""
    return df.withColumn(into, text_function(tokenizer, "string")(F.col(column)))


def simple_tokens(sentence: Column) -> Column:
    """A tokenizer in plain columns: words and numbers, and every other sign by itself."""
    return F.regexp_extract_all(sentence, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))


def number_replaced(token: Column) -> Column:
    """``%N%`` for tokens of only digits, other punctuation and hyphens."""
    return F.when(token.rlike(r"^[\p{Nd}\p{Po}-]+$"), F.lit(NUMBER)).otherwise(token)
