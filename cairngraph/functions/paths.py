"""What a path or the head of a file says about it."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairngraph.functions.text import col

# Patterns and names the classification goes by.
TEST_DIR = r"(^|[/\\])tests?([/\\]|$)"
TEST_FILE = r"(^|[/\\])(test_[^/\\]*|[^/\\]*_test|conftest|tests?)\.pyi?$"
SKIPPED_DIRS = ["venv", ".venv", "__pycache__", "node_modules", "build", "dist"]
MARK, MADE, NO_EDIT = "@generated", "(?i)generated by|auto[- ]?generated|generated with", "(?i)do not edit"
HEAD_LINES, HEAD_CHARS = 15, 4096


def is_test(path: Column | str) -> Column:
    return col(path).rlike(TEST_DIR) | col(path).rlike(TEST_FILE)


def is_generated(text: Column | str) -> Column:
    """Told from the first lines: a machine mark, or who made it together with a ban on edits."""
    head = F.array_join(F.slice(F.split(F.substring(col(text), 1, HEAD_CHARS), "\n"), 1, HEAD_LINES), "\n")
    return head.contains(MARK) | (head.rlike(MADE) & head.rlike(NO_EDIT))


def is_skipped(path: Column | str) -> Column:
    """Below a directory that holds no source: a hidden one, or one by name."""
    return F.exists(F.slice(F.split(col(path), "/"), 1, F.greatest(F.size(F.split(col(path), "/")) - 1, F.lit(0))), lambda d: d.startswith(".") & ~d.isin(".", "..") | d.isin(*SKIPPED_DIRS))


def module_of(path: Column | str) -> Column:
    """The dotted id of a Python file."""
    return F.regexp_replace(F.translate(F.regexp_replace(col(path), r"(/__init__)?\.pyi?$", ""), "/", "."), r"^\.+", "")


def matches_any(c: Column | str, globs: list[str]) -> Column:
    """The whole value matches one of the globs."""
    found = F.lit(False)
    for g in globs:
        found = found | col(c).rlike("^" + fnmatch.translate(g).replace(r"\Z", "$").replace(r"\z", "$"))
    return found
