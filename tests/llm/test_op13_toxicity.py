"""Toxicity: the index against brute force, the fit against its definition, planted labels held out."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from echolake.llm import op13_toxicity as M


def random_index(rng, n: int, n_terms: int):
    rows = []
    for _ in range(n):
        t = np.sort(rng.choice(n_terms, size=rng.integers(1, 9), replace=False))
        v = rng.random(len(t)).round(1) + 0.1
        rows.append((t, v / np.sqrt(v @ v)))
    ids = rng.permutation(n)
    index = M.BlockMaxIndex(ids, (ids % 3 == 0).astype(float), np.ones(n), np.array([len(t) for t, _ in rows]), np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]), n_terms)
    return {int(i): r for i, r in zip(ids, rows, strict=True)}, index


def test_search_is_exact_and_skips_blocks(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows, index = random_index(rng, 700, 60)
    scored = 0
    for _ in range(120):
        t = np.sort(rng.choice(60, size=rng.integers(1, 6), replace=False))
        q = rng.random(len(t))
        q /= np.sqrt(q @ q)
        dense = np.zeros(60)
        dense[t] = q
        want = np.array([dense[rows[int(i)][0]] @ rows[int(i)][1] for i in index.ids]).round(12)
        order = [k for k in np.lexsort((np.arange(700), -want)) if want[k] > 0][:9]
        place, cosine, blocks = index.search(t, q, 9)
        assert np.allclose(cosine, want[order], atol=1e-11) and place.tolist() == order
        scored += blocks
    assert scored < 0.8 * 120 * index.n_blocks


def test_many_queries_meet_a_block_at_once_and_each_gets_its_exact_neighbours(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 32)
    rng = np.random.default_rng(2)
    rows, index = random_index(rng, 500, 40)
    dense = np.zeros((500, 40))
    for place, i in enumerate(index.ids):
        dense[place, rows[int(i)][0]] = rows[int(i)][1]
    left_out = np.where(np.arange(400) % 2 == 0, np.arange(400), -1)  # examples themselves, each second without itself
    queries = [rows[int(i)] for i in index.ids[:400]] + [(np.zeros(0, int), np.zeros(0))]
    built = []
    block = M.BlockMaxIndex._block
    monkeypatch.setattr(M.BlockMaxIndex, "_block", lambda self, b, *more: built.append(b) or block(self, b, *more))
    found, scored = index.search_all(queries, 9, np.append(left_out, -1))
    assert len(built) == len(set(built)) <= index.n_blocks and scored <= 400 * index.n_blocks
    for j, (place, cosine) in enumerate(found[:-1]):
        want = (dense @ dense[j]).round(12)
        if left_out[j] >= 0:
            want[j] = 0
        order = [k for k in np.lexsort((np.arange(500), -want)) if want[k] > 0][:9]
        assert place.tolist() == order and np.allclose(cosine, want[order], atol=1e-11)
        alone = index.search(*queries[j], 9)
        assert left_out[j] >= 0 or (alone[0].tolist() == place.tolist() and alone[1].tolist() == cosine.tolist())
    assert len(found[-1][0]) == 0


def test_the_fit_searches_each_example_once(spark, monkeypatch):
    docs, labels, _ = planted(spark)
    names, examples = M.train(docs, labels)
    examples = M.materialize(examples, "examples")
    searched = spark.sparkContext.accumulator(0)
    votes = M.own_votes

    def counted(examples, model):
        def run(batches):
            for batch in batches:
                searched.add(batch.num_rows)
                yield batch

        out = votes(examples, model)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(M, "own_votes", counted)
    M.fit(names, examples, M.with_terms(docs, names))
    assert 0 < searched.value <= examples.count()


def test_no_examples():
    none = np.zeros(0)
    index = M.BlockMaxIndex(none.astype(int), none, none, none.astype(int), none.astype(int), none, 5)
    assert index.search(np.array([1]), np.array([1.0]), 3)[0].tolist() == []


def test_monotone_fit():
    x, y = np.array([0.1, 0.2, 0.2, 0.4, 0.9]), np.array([0.0, 1.0, 0.0, 0.0, 1.0])
    knots, means = M.monotone(x, y, np.ones(5), 0.2)
    assert (np.diff(knots) > 0).all() and (np.diff(means) >= 0).all() and 0 <= means.min() and means.max() <= 1


def test_held_out_accuracy_on_supplied_documents(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in M.op13_toxicity(spark, d).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert len(got) == pq.read_table(f"{d}/documents.parquet", columns=["doc_id"]).num_rows
    toxic, clean = [got[i]["score"] for i, y in labels.items() if y], [got[i]["score"] for i, y in labels.items() if not y]
    assert np.mean([s >= 0.5 for s in toxic]) > 0.9 and np.mean([s >= 0.5 for s in clean]) < 0.01
    mean = np.mean(toxic + clean)
    assert abs(mean - len(toxic) / (len(toxic) + len(clean))) < 0.03  # calibrated as a whole
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())


def planted(spark):
    rng = np.random.default_rng(4)
    rows, labels = [(None, "lost", "x"), (3, None, "x"), (5, "", "x"), (7, "12 3", "x"), (9, "vile " * 3000, "x"), (9, "vile " * 3000, "x")], [(None, 1), (5, None), (9, 1), (9, 0)]
    for k in range(100, 400):
        bad = k % 4 == 0
        rows.append((k, " ".join([f"word{x}" for x in rng.integers(0, 50, 12)] + ["vile", "rotten"][: 2 * bad]), "x"))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), {i for i, y in labels if y and i is not None}


def test_planted_words_and_awkward_rows(spark):
    docs, labels, bad = planted(spark)
    got = M.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and "score" in got[0].asDict()
    for r in got:
        assert (r["__el_score"] >= 0.5) == (r["doc_id"] in bad), r
    example = next(r for r in got if r["doc_id"] == 104)
    assert len(example["__el_evidence"]) == M.NEIGHBOURS and all(e["toxic"] == 1 and e["cosine"] > 0.9 for e in example["__el_evidence"])
    assert all(zlib.crc32(str(e["doc_id"]).encode()) % 5 for r in got for e in r["__el_evidence"])  # held-out labels teach nothing


@pytest.mark.parametrize("label", [None, 0, 1])
def test_labels_of_one_kind(spark, label):
    docs, labels, _ = planted(spark)
    some = labels.where(F.lit(False) if label is None else F.col("toxic") == label)
    scores = {round(r["__el_score"], 9) for r in M.toxicity(docs, some).collect()}
    assert len(scores) == 1 and all(0 <= s <= 1 for s in scores) and (min(scores) > 0.5) == (label == 1)
