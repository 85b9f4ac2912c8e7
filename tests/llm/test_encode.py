import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphrill.llm.encode import default_vocabulary, encode, encoder

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True

TEXTS = [
    "a", " ", "   ", "\n\n \t x", "Hello, world's 12345 don't", "<|endoftext|>", "é́ ﬀ ½ ٣", "日本語のテキスト", "\x1c\x1d\x85  x", "\x00\x07",
    "😀👩‍👩‍👧‍👦" * 5, "=" * 5000, " " * 3000 + "x", "aA" * 4000, "ß" * 999, "​﻿", "'s't're've'm'll'd", "ı İ ſ", "\U0010ffff",
]


def ids(texts):
    return [np.frombuffer(x, np.int32).tolist() for x in encoder(default_vocabulary()).encode(texts)]


def test_against_the_library():
    assert ids(TEXTS) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids([text]) == [LIBRARY.encode(text, add_special_tokens=False).ids]


def test_random_bytes_of_letters():
    r = random.Random(0)
    texts = ["".join(r.choice("etaoin shrdlu.,ETA01\n") for _ in range(r.randrange(400))) for _ in range(300)]
    assert ids(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [LIBRARY.decode(i) for i in ids(texts)] == texts


def test_every_character():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x" + "".join(f"a{c}1 {c} " for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    assert ids(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_frame(spark):
    given_ = [(1, None), (2, ""), (3, " "), (3, " "), (None, "x"), (4, "long " * 200_000)]
    df = spark.createDataFrame([(*g, [9]) for g in given_], "doc_id bigint, text string, ids array<int>")
    out = encode(df, "doc_id", "text")
    got = sorted(((r["doc_id"], len(r["ids"])) for r in out.collect()), key=str)
    want = sorted(((d, len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for d, t in given_), key=str)
    assert got == want and out.columns == ["doc_id", "ids"]
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_unknown_vocabulary(spark):
    with pytest.raises(Exception, match="no such file|No such file"):
        encode(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "doc_id", "text", "/nowhere.json").collect()
