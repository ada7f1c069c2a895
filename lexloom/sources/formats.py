"""Choice of formats, and the checks that workflows make before they run."""

from __future__ import annotations

import logging
from pathlib import Path

from lexloom.schemas import CONVERSIONS, WORKFLOW_FORMATS

LOG = logging.getLogger(__name__)
_BY_EXTENSION = {"warc": "warc", "arc": "warc", "wet": "warc", "jsonl": "jsonl", "jsonlines": "jsonl", "source": "source", "medusa": "medusa"}


def detect_format(name: str | None) -> str | None:
    """Format by the last extension, whatever its case; None if it is unknown."""
    return _BY_EXTENSION.get(Path(name or "").suffix[1:].lower())


def check_format(workflow: str, name: str, given: str | None = None, output: bool = False) -> str:
    """The format of a file of a workflow; an error if the workflow doesn't take it."""
    found = given or detect_format(name)
    allowed = WORKFLOW_FORMATS[workflow][output]
    if found is None:
        raise ValueError(f"no format known for {name}; one of {sorted(allowed)} is needed")
    if found not in allowed:
        raise ValueError(f"{workflow} doesn't {'write' if output else 'read'} {found}, only {sorted(allowed)}")
    return found


def check_conversion(source: str, target: str) -> None:
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"no conversion from {source} to {target}; there are {sorted(CONVERSIONS)}")


def find_files(folder: str | Path, pattern: str, recursive: bool = False, files_only: bool = True) -> list[str]:
    """Sorted paths in ``folder`` that match; the pattern can't leave the folder, and ``**`` needs
    ``recursive``."""
    if ".." in pattern.split("/"):
        raise ValueError("a pattern can't go up")
    if "**" in pattern and not recursive:
        raise ValueError("** needs recursive")
    folder = Path(folder)
    found = folder.rglob(pattern) if recursive and "**" not in pattern else folder.glob(pattern)
    return sorted(str(p) for p in found if not files_only or p.is_file())
