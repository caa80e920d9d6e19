"""Token counts and BPE by tree reduction, against the libraries."""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from likerec.llm import bpe, tokencounts
from tests.llm import edge

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_counts_like_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rows = edge.rows(4)
    want = Counter()
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 512)] += 1
    got = tokencounts.count_tokens(edge.documents(spark, 4), JSON)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    assert tokencounts.count_tokens(edge.empty(spark), JSON).count() == 0


@pytest.fixture(scope="module")
def encoders():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return bpe.TreeEncoder(ranks, public_tokenizers.PATTERN, leaf_chars=8), bpe.TreeEncoder(ranks, public_tokenizers.PATTERN, leaf_chars=1 << 30)


SAMPLES = st.one_of(
    st.text(max_size=200),
    st.text(alphabet="ab 's\n\t.1é你", max_size=200),
    st.text(alphabet="abcdefgh", max_size=200),
    st.text(alphabet=" \n\x1c\x85　x", max_size=100),
    st.lists(st.sampled_from(["the", " of", "'s", "'ll", "  ", "!!", "12", "ation", "\n\n"]), max_size=80).map("".join),
)


@given(SAMPLES)
@settings(max_examples=500, deadline=None)
def test_tree_like_the_library(encoders, text):
    tree, plain = encoders
    assert tree.encode(text) == plain.leaf.encode_ordinary(text)


@pytest.mark.parametrize("text", [t for t in edge.texts(5) if t])
def test_tree_on_edge_texts(encoders, text):
    tree, plain = encoders
    ids = tree.encode(text)
    assert ids == plain.leaf.encode_ordinary(text)
    assert bpe.decode(np.array(ids, "<u4"), tree.bytes_of) == text.encode()


def test_encode_and_decode_tables(spark, encoders):
    library = encoders[1].leaf
    rows = edge.rows(6)
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), np.array(ids, "<u4").tobytes(), (r[1] or "").encode())] += 1
    vocabulary = (RANKS, public_tokenizers.PATTERN)
    got = bpe.decode_ids(bpe.encode_texts(edge.documents(spark, 6), *vocabulary), RANKS)
    assert Counter((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in got.select("doc_id", "n_tokens", "ids", "decoded").collect()) == want
    assert bpe.decode_ids(bpe.encode_texts(edge.empty(spark), *vocabulary), RANKS).count() == 0
