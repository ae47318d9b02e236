"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A ranks file in tiktoken's format; any other byte-level BPE vocabulary can be named instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a ranks file, loaded once per worker."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text as bigint; a null or empty text has 0."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
