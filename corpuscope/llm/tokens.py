"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from . import bpe


def token_count(text: Column, content: str, pattern: str) -> Column:
    """The number of byte-level BPE tokens of ``text``, without added tokens.

    The vocabulary strings that are encoded alone as one token are proved once in each worker; a
    pre-token among them counts one, and only the others are merged. Whole texts are counted at
    any length; a null or empty text has 0 tokens. Strings of special tokens inside a text are
    one token each, which is the library's default.
    """
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(bpe.load(content, pattern).count(texts.fillna("").tolist()), dtype="int64")

    return count(text)
