"""Byte-pair token counts and prefixes, over a vocabulary file for the tokenizers library.

The strings of special tokens in a text are ordinary text here. A worker loads a vocabulary once.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCAB = "byte_bpe_50k.json"
#: What ends a text that was cut.
ELLIPSIS = "\n…\n"


@lru_cache(maxsize=4)
def tokenizer(vocab: str = VOCAB):
    """The tokenizer of a path, or of a name among the installed public ones."""
    from tokenizers import Tokenizer

    if os.sep not in vocab:
        import public_tokenizers

        vocab = public_tokenizers.path(vocab)
    out = Tokenizer.from_file(vocab)
    out.encode_special_tokens = True
    return out


def encode(text: str, vocab: str = VOCAB) -> list[int]:
    return tokenizer(vocab).encode(text, add_special_tokens=False).ids


def prefix(text: str, most: int, vocab: str = VOCAB) -> str:
    """text if it has at most `most` tokens, else as many as leave room for the ellipsis and then that, as far as it goes."""
    ids, mark = encode(text, vocab), encode(ELLIPSIS, vocab)
    if len(ids) <= most:
        return text
    head = ids[: max(most - len(mark), 0)]
    return tokenizer(vocab).decode(head + mark[: most - len(head)], skip_special_tokens=False)


def token_count(text: Column, vocab: str = VOCAB) -> Column:
    """How many tokens a text has; null for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        got = tokenizer(vocab).encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(x.ids) for x in got], index=texts.index).where(texts.notna())

    return count(text)


def cut(text: Column, most: Column, vocab: str = VOCAB) -> Column:
    """prefix() of each text; null for null."""

    @F.pandas_udf("string")
    def take(texts: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or n is None or n != n else prefix(t, int(n), vocab) for t, n in zip(texts, limits)])

    return take(text, most)


def windows(text: Column, most: int, overlap: int, vocab: str = VOCAB) -> Column:
    """array<struct<content, tokens>>: windows of `most` tokens, each beginning `overlap` before the last one's end; a text that fits is one."""
    overlap = min(overlap, most - 1)

    @F.pandas_udf("array<struct<content: string, tokens: bigint>>")
    def split(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ids = encode(t or "", vocab)
            last = max(len(ids) - overlap, 1) if len(ids) > most else 1
            parts = [t or ""] if len(ids) <= most else [tokenizer(vocab).decode(ids[i : i + most], skip_special_tokens=False) for i in range(0, last, most - overlap)]
            out.append([{"content": p, "tokens": len(encode(p, vocab))} for p in parts])
        return pd.Series(out)

    return split(text)
