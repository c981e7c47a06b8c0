"""Spelling rules for keys and paths, as JVM-side column expressions and as DuckDB SQL.

Null stays null everywhere; an empty or blank value becomes the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space.
WHITE = "".join(map(chr, [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))

# Prefixes of names that stand for code, not for a node.
NAME_PATTERN = r"^(raw_[A-Za-z]*:|self\.)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITE))


def upper_word(c: Column | str) -> Column:
    return F.upper(trimmed(c))


def lower_word(c: Column | str) -> Column:
    return F.lower(trimmed(c))


def clean_path(c: Column | str) -> Column:
    """Backslashes are slashes, repeated slashes are one, one leading ``./`` goes."""
    slashed = F.regexp_replace(F.translate(col(c), "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(slashed, r"^\./", "")


def is_name(c: Column | str) -> Column:
    """True for unresolved names, which are not references to nodes."""
    return col(c).rlike(NAME_PATTERN)


def under(c: Column | str, prefix: str) -> Column:
    """``c`` is ``prefix`` itself or lies below it at a dot; an empty prefix holds nothing."""
    if not prefix:
        return F.lit(False)
    return (col(c) == prefix) | col(c).startswith(prefix + ".")


def sql_trim(c: str) -> str:
    return f"trim({c}, '{WHITE}')"


def sql_path(c: str) -> str:
    return f"regexp_replace(regexp_replace(replace({c}, chr(92), '/'), '/{{2,}}', '/', 'g'), '^\\./', '')"
