from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from echolake.llm.op3_packing import WordEncoder, op3_packing, shortest_pack_first, tokenizer_json


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, sf_dir, documents, plain):
    rows = op3_packing(spark, sf_dir).collect()
    want = defaultdict(list)
    for d in documents:
        ids = np.array([*plain.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want[d["doc_id"]].append(ids)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(want)
    for doc_id, docs in want.items():
        assert {r["doc_tokens"] for r in pieces[doc_id]} <= {len(x) for x in docs}
        assert sum(r["length"] for r in pieces[doc_id]) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
                assert r["start"] == at
                assert r["ids_crc32"] == zlib.crc32(docs[0][at : at + r["length"]].tobytes())
                at += r["length"]
    packs = defaultdict(list)
    for r in rows:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in packs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(packs) == list(range(len(packs)))
    total = sum(r["length"] for r in rows)
    assert len(packs) <= -(-total // 2048) * 1.05 + 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_words_give_the_ids_of_the_text(text):
    t, own = _both()
    assert np.frombuffer(own([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["Straße,", "don't", "CAFÉ!", "<|endoftext|>", "a1b2", "x\u0301", "İst", "\u00a0", "naïve.", "...", "'s", "ﬁne", "ß", "１２"]), max_size=12), st.sampled_from([" ", "\n", "", "\t", "\u2003"]))
def test_awkward_words(words, gap):
    t, own = _both()
    text = gap.join(words)
    assert np.frombuffer(own([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def _both(cache=[]):  # noqa: B006
    if not cache:
        cache.extend([Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), WordEncoder(tokenizer_json())])
    return cache


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_patterns_hold_every_length(histogram):
    patterns = shortest_pack_first(histogram, 64)
    held = defaultdict(int)
    for p in patterns:
        assert p.used == sum(n * k for n, k, _ in p.items) <= 64
        for n, k, _ in p.items:
            held[n] += k * p.count
    assert dict(held) == histogram
