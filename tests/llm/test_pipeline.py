"""Each stage on its own input against plain Python, and the whole on awkward and on supplied documents."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from echolake.plans.shared import materialize
from test_op1_ngram_jaccard import brute as jaccard
from test_op5_line_dedup import key


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    assert P.ORACLE_SQL is None


def test_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    letters = Counter(r["doc_id"] for r in rows if re.search(r"[^\W\d_]", r["text"] or ""))

    docs = materialize(P.language_id(spark, docs, sf_dir), "test")
    kept = [r.asDict() for r in docs.collect()]
    assert docs.columns == columns and not Counter(r["doc_id"] for r in kept) - letters
    assert len(kept) >= 0.9 * sum(letters.values())

    held = defaultdict(set)
    for r in kept:
        for line in r["text"].split("\n"):
            if len(key(line)) >= 40 and r["doc_id"] is not None:
                held[key(line)].add(r["doc_id"])
    want = Counter()
    for r in kept:
        d = r["doc_id"]
        want[d, "\n".join(x for x in r["text"].split("\n") if d is None or len(held.get(key(x), ())) < 5 or d == max(held[key(x)]))] += 1
    docs = materialize(P.line_dedup(spark, docs, sf_dir), "test")
    kept = [r.asDict() for r in docs.collect()]
    assert docs.columns == columns and Counter((r["doc_id"], r["text"]) for r in kept) == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept)

    first = {d for d, _, c in jaccard([(r["doc_id"], r["text"]) for r in kept], 5, 80) if d == c and d is not None}
    docs = materialize(P.ngram_jaccard(spark, docs, sf_dir), "test")
    kept = [r.asDict() for r in docs.collect()]
    assert docs.columns == columns and Counter(r["doc_id"] for r in kept if r["doc_id"] is not None) == Counter(dict.fromkeys(first, 1))

    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in kept}
    docs = materialize(P.mixing(spark, docs, sf_dir), "test")
    mixed = [r.asDict() for r in docs.collect()]
    assert docs.columns == columns and max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    total = sum(words[r["doc_id"]] for r in mixed)
    assert 0.9 * 1.5 * sum(words.values()) <= total <= 1.5 * sum(words.values()) or max(words.values()) > 0.1 * sum(words.values())

    packs = defaultdict(list)
    for r in P.packing(spark, docs, sf_dir).collect():
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in packs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_whole(spark, edge_dir):
    rows = P.run(spark, edge_dir).collect()
    assert rows and {r["length"] for r in rows} <= set(range(1, 2049))
