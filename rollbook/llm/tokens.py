"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder-independent default: a rank file installed on every executor, named by path and never copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file, read once by each Python worker. Text that looks like a special token is ordinary text."""
    if path not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _ENCODINGS[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with the number of tokens of each whole text; 0 for null and empty texts."""

    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(tokenizer).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(out, F.pandas_udf(count, "bigint")(F.col(text)))
