"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_FILE = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Where the installed public vocabulary file lies; pass any other path to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text; null and empty texts have none. Whole texts are counted, however long."""
    path = path or tokenizer_path()

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path)
        return pd.Series([len(x) for x in encoding.encode_ordinary_batch(texts.fillna("").tolist(), num_threads=1)], dtype="int64")

    return count(text)


def sized(documents: DataFrame, path: str | None = None, *keep: str) -> DataFrame:
    """(doc_id, tokens, *keep) of the documents; texts do not travel further."""
    return documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), token_count(F.col("text"), path).alias("tokens"), *keep)
