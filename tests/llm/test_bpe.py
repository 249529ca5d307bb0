import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import bpe

VOCABULARY = bpe.DEFAULT_VOCABULARY


@pytest.fixture(scope="module")
def pair():
    with open(VOCABULARY, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.ByteBpe(raw), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(pair, texts):
    ours, theirs = pair
    offsets, ids = ours.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == (theirs.encode_ordinary(t) if t else []), t


def test_odd_texts(pair):
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefgh") for _ in range(3000))
    check(pair, ["", None, " ", "\n\n\t x", "<|endoftext|>", "it's We'RE", "日本語" * 200, "a" * 5000, "=" * 700, "👩‍💻🇪🇺" * 20, letters, "x́é", "0" * 999, "tab\there  and"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text(pair, texts):
    check(pair, texts)


def test_pair_table_finds_all_and_no_more(pair):
    table = pair[0].pairs
    import numpy as np

    stored = table.keys[table.keys >= 0]
    left, right = (stored >> 32).astype(np.int32), (stored & 0xFFFFFFFF).astype(np.int32)
    assert (table.get(left, right) != bpe._NONE).all()
    assert (table.get(np.array([-1, 5]), np.array([3, -1])) == bpe._NONE).all()


def test_encode_column(spark, pair):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode(df, "doc_id", "text").collect()), key=repr)
    assert got == sorted([(i, pair[1].encode_ordinary(t) if t else []) for i, t, _ in rows], key=repr)
    counts = sorted(((r.doc_id, r.n_tokens) for r in bpe.token_counts(df, "doc_id", "text").collect()), key=repr)
    assert counts == sorted([(i, len(pair[1].encode_ordinary(t)) if t else 0) for i, t, _ in rows], key=repr)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
