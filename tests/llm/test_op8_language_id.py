from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest

from echolake.llm.op8_language_id import BUCKETS, ngram_buckets, ngram_counts, op8_language_id, quota, train


def test_query(spark, sf_dir, documents):
    rows = op8_language_id(spark, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d["doc_id"]) for d in documents)
    text = {d["doc_id"]: d["text"] for d in documents}
    langs = {d["lang"] for d in documents} - {None} | {"und"}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["lang_pred"] in langs and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]] or ""))


def test_held_out_accuracy(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = [r for r in op8_language_id(spark, d).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert len(rows) > 100
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) / len(rows) >= 0.9


def test_long_texts_are_counted_whole():
    text = "abc d\u00e9fg " * 40_000
    for n in (text, "ab"):
        s = " " + " ".join(n.split()) + " "
        assert ngram_counts(n).sum() == 3 * len(s) - 3
    assert len(ngram_buckets(text)) == 3 * (len(text) + 1) - 3  # a last blank is stripped, one put on both ends


def test_scores_are_those_of_plain_naive_bayes(spark):
    """Counts, smoothing, priors and argmax in plain Python, over the same buckets."""
    texts = [("the cat and the dog", "en"), ("el gato y el perro", "es"), ("the end", "en"), ("der hund und die katze", "de")]
    model = train(spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    held = {x: Counter() for _, x in texts}
    for t, x in texts:
        held[x].update(ngram_buckets(t).tolist())
    langs = sorted(held)
    prior = {x: math.log(sum(y == x for _, y in texts) / len(texts)) for x in langs}
    asked = ["a dog and a cat", "la katze", None, "12 3", "", "e", "und so weiter " * 30, "perro 99 " + "7 " * 500, "12 \u00b2", "\u00bd", "\u2167 \u2460 _"]  # the last three: numbers, not letters
    for t, lang, score in zip(asked, *model.score_batch(asked), strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0.0)
            continue
        grams = ngram_buckets(t).tolist()
        ll = {x: sum(math.log((held[x][g] + 0.5) / (sum(held[x].values()) + 0.5 * BUCKETS)) for g in grams) for x in langs}
        assert lang == max(langs, key=lambda x: ll[x] + prior[x])
        w = {x: math.exp(ll[x] * min(1, 60 / len(grams)) + prior[x]) for x in langs}
        assert score == pytest.approx(w[lang] / sum(w.values()))
        assert model.score(t)[0] == lang


def test_small_languages_are_learned(spark, monkeypatch):
    import echolake.llm.op8_language_id as op8

    monkeypatch.setattr(op8, "quota", lambda sizes: quota(sizes, 60, 10))
    rows = [(k, f"the cat and the dog {k}", "en") for k in range(20_000)]
    rows += [(None, "\u043a\u043e\u0442 \u0438 \u043f\u0451\u0441", "ru")] * 3  # one draw for all
    rows += [(30_000 + k, f"{chr(0x4E00 + 2 * k)}{chr(0x4E01 + 2 * k)}" * 5, f"x{k:03}") for k in range(250)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 252 and len(set(model.at.tolist())) == 252  # a column for each, none without rows
    assert model.score("\u043f\u0451\u0441 \u0438 \u043a\u043e\u0442")[0] == "ru" and model.score("a dog and a cat")[0] == "en"
    assert all(model.score(t)[0] == x for _, t, x in rows[-250:])


def test_quota_takes_small_languages_whole():
    assert quota([20, 1_000_000, 5], 20_000, 100) == 19_975
    assert quota([30, 40], 20_000, 100) == 100 and quota([300, 400], 20_000, 100) == 400
    assert quota([1000] * 1000, 20_000, 100) == 100
