import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanloom.llm import packing, tokenfile, tokens

TEXTS = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n", "<|endof", "text|>", "plain", "", "͸ <|endoftext|>"]


def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCAB))


def test_added_tokens_match_an_untouched_tokenizer():
    ids, at = tokens.TokenEncoder().encode(TEXTS, 0)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*x.ids, 0] for x in library().encode_batch(TEXTS, add_special_tokens=False)]
    assert ids[: at[1]].tolist() == [50256, 0]


def test_added_tokens_in_tables(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    expected = {i: library().encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    got = tokenfile.token_table(docs).collect()
    assert len(got) == len(TEXTS) and all(tuple(r)[2:] == (len(expected[r.doc_id]) + 1, zlib.crc32(np.array([*expected[r.doc_id], 0], "<u4").tobytes())) for r in got)
    packed = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(docs, with_ids=True).collect()}
    assert packed == {i: [*x, 2] for i, x in expected.items()}
