"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary of ranks (``.tiktoken``), or a whole tokenizer (``.json``).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut before pairs are merged.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters given to a tokenizer of a whole file at once.
BATCH_CHARS = 2_000_000


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their sizes. Strings of special tokens count as ordinary text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True

    def sizes(texts: list[str]) -> list[int]:
        out, batch, held = [], [], 0
        for text in [*texts, None]:
            if text is None or held > BATCH_CHARS:
                out.extend(len(e) for e in t.encode_batch(batch, add_special_tokens=False))
                batch, held = [], 0
            if text is not None:
                batch.append(text)
                held += len(text)
        return out

    return sizes


def count_tokens(texts: list[str], path: str = TOKENIZER) -> list[int]:
    return counter(path)(texts)


def document_sizes(documents: DataFrame, *columns: str, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens (long) and ``columns`` of each document; null texts and ids are left out, an empty text has 0."""

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(texts.tolist(), path), index=texts.index)

    return documents.where("doc_id is not null and text is not null").select("doc_id", size("text").alias("n_tokens"), *columns)
