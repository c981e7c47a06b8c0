"""What a build leaves out, and when the way sources are read has changed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The systems and processors a Go file's name can end with, and the tags the default build has.
SYSTEMS = frozenset("aix android darwin dragonfly freebsd hurd illumos ios js linux nacl netbsd openbsd plan9 solaris wasip1 windows zos".split())
PROCESSORS = frozenset("386 amd64 arm arm64 loong64 mips mips64 mips64le mipsle ppc64 ppc64le riscv64 s390x wasm".split())
TAGS = frozenset(["linux", "amd64", "unix", "gc", "cgo"])

_TOKEN = re.compile(r"\s*(&&|\|\||!|\(|\)|[\w.]+)")


def holds(expression: str, tags: frozenset[str] = TAGS) -> bool:
    """Is a build expression of tags, !, &&, || and parentheses true? One that cannot be read is."""
    words, at = _TOKEN.findall(expression), 0
    if "".join(words) != re.sub(r"\s+", "", expression) or not words:
        return True

    def either() -> bool:
        nonlocal at
        found = both()
        while at < len(words) and words[at] == "||":
            at += 1
            found = both() or found
        return found

    def both() -> bool:
        nonlocal at
        found = single()
        while at < len(words) and words[at] == "&&":
            at += 1
            found = single() and found
        return found

    def single() -> bool:
        nonlocal at
        word, at = words[at], at + 1
        if word == "!":
            return not single()
        if word == "(":
            found = either()
            at += 1
            return found
        return word in tags or bool(re.fullmatch(r"go1(\.\d+)?", word))

    try:
        return either() if at == 0 else True
    except (IndexError, RecursionError):
        return True


def go_exclusion(path: str, text: str | None, tags: frozenset[str] = TAGS) -> str | None:
    """Why the default build leaves a Go file out: its name's system or processor, or the build line before its package; None if it does not."""
    parts = re.sub(r"(_test)?\.go$", "", path.rsplit("/", 1)[-1]).split("_")[1:]
    ends = parts[-2:] if len(parts) > 1 and parts[-2] in SYSTEMS and parts[-1] in PROCESSORS else parts[-1:]
    for part in ends:
        if part in SYSTEMS | PROCESSORS and part not in tags:
            return part
    for line in (text or "").splitlines():
        if line.startswith("//go:build "):
            said = line[len("//go:build ") :].strip()
            return None if holds(said, tags) else said
        if line.strip() and not line.lstrip().startswith(("//", "/*", "*")):
            break
    return None


def build_excluded(path: Column | str, text: Column | str) -> Column:
    """``go_exclusion`` of each row; null for files of other languages."""

    @F.pandas_udf("string")
    def excluded(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([go_exclusion(p, t) if p and p.endswith(".go") else None for p, t in zip(paths, texts)], index=paths.index)

    return excluded(path, text)


def fingerprint(sources: Iterable[tuple[str, bytes]]) -> str:
    """One hash of all (name, content), whatever their order: another one means that files must be read anew."""
    h = hashlib.sha256()
    for name, content in sorted(sources):
        h.update(name.encode() + b"\x00" + len(content).to_bytes(8, "big") + content)
    return h.hexdigest()
