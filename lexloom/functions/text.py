"""Columns that treat text as Python's str and bytes methods do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where str.splitlines breaks, and where bytes.splitlines does.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
BYTE_LINE_BREAK = r"\r\n|[\n\r]"
#: What str.split and str.strip take as white space, and what bytes.split does.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BYTE_SPACE = r"[\x09-\x0d\x20]"


def lines(text: Column, pattern: str = LINE_BREAK) -> Column:
    """array<string> like ``splitlines``: no empty last line after a final break, none for ''."""
    parts = F.split(text, pattern, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column, space: str = SPACE) -> Column:
    return F.regexp_replace(text, f"^{space}+|{space}+$", "")


def rstrip(text: Column, space: str = SPACE) -> Column:
    return F.regexp_replace(text, f"{space}+$", "")


def tokens(text: Column, space: str = SPACE) -> Column:
    """array<string> like ``split()`` without arguments."""
    return F.filter(F.split(text, f"{space}+"), lambda t: t != "")


def collapse(text: Column) -> Column:
    """All runs of white space as one blank, none at the ends."""
    return F.array_join(tokens(text), " ")


def code_point(char: Column) -> Column:
    return F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("long")


def is_blank(text: Column) -> Column:
    return strip(text) == ""
