"""Token counts and offsets with a public tokenizer whose vocabulary file is given by path."""

from __future__ import annotations

import base64
import os

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Pre-tokenizer pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    """The vocabulary file: $NEARFOLD_TOKENIZER, else byte_bpe_50k.tiktoken of the installed public files."""
    return os.environ.get("NEARFOLD_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def encoding(path: str):
    """The byte-level BPE of a file of base64 tokens and ranks; kept once per worker process.

    This module travels inside the jobs, so what a process keeps is held by the tokenizer's own module.
    """
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_nearfold_kept", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def count(text: str | None, path: str) -> int:
    """Tokens of a text; 0 for null."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def token_starts(text: str, path: str) -> np.ndarray:
    """The character offset at which each token starts; tokens inside one character share its offset."""
    enc = encoding(path)
    ids = enc.encode_ordinary(text)
    if not ids:
        return np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, enc.decode_tokens_bytes(ids)), np.int64, len(ids))
    begins = np.cumsum(lengths) - lengths
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    return np.cumsum((raw & 0xC0) != 0x80)[begins] - 1


def with_tokens(rows: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """Adds ``_tokens``, the token count of ``text`` (0 for null or empty); other columns pass through."""
    where = path or default_path()

    @F.pandas_udf("long")
    def counted(t):
        return t.map(lambda x: count(x, where)).astype("int64")

    column: Column = F.when(F.length(text) > 0, counted(text)).otherwise(F.lit(0))
    return rows.withColumn("_tokens", column)
