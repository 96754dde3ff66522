"""Sizes in tokens of a public byte-level BPE tokenizer, given by the path of its ranks."""

from __future__ import annotations

import base64

import pandas as pd
import tiktoken
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

#: Where the default tokenizer's ranks lie; every caller may pass another path.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE of this family splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_open: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = TOKENIZER) -> tiktoken.Encoding:
    """The tokenizer, read once a process."""
    if path not in _open:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _open[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _open[path]


def count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; null and empty texts have none."""

    @F.pandas_udf(LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return tokens(F.coalesce(text, F.lit("")))
