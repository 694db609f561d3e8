from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pyarrow.parquet as pq
import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.llm.op4_url_filter import holds_rule, mine_rules, op4_url_filter, shortest_rules, url_tokens

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def parts(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_hosts_paths_and_rules(spark, sf_dir):
    rows = op4_url_filter(spark, sf_dir).collect()
    pages = pq.read_table(f"{sf_dir}/pages.parquet", columns=["page_id", "url"]).to_pylist()
    want, verdicts = Counter(), {}
    for p in pages:
        host, path = parts(p["url"])
        fits = [(len(h + q), h + q, v) for v, h, q in RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        _, rule, verdict = max(fits, default=(0, None, None))
        want[p["page_id"], host, path, rule] += 1
        verdicts[p["page_id"]] = verdict
    assert Counter(tuple(r)[:4] for r in rows) == want
    for r in rows:
        assert r["verdict"] == verdicts[r["page_id"]] if verdicts[r["page_id"]] else r["verdict"] in ("allow", "block")


def test_mined_rules_block_what_labels_call_bad(spark, edge_dir):
    verdict = {r["page_id"]: r["verdict"] for r in op4_url_filter(spark, edge_dir).collect()}
    assert {verdict[100 + k] for k in range(80)} == {"block"}  # also those without a label
    assert {verdict[300 + k] for k in range(80)} == {"allow"}


def tokens_of(spark, *urls):
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k long, url string")
    return [set(r[1]) for r in sorted(rows.select("k", url_tokens(F.col("url"))).collect())]


def test_tokens_of_all_parts(spark):
    a, b, c, d = tokens_of(spark, "https://a.casino.b.Example.com/en/2024/bigWin-now/x.html?affid=3&ref=x;lang=en#t?no=1", None, "http://", "http://localhost")
    assert a >= {"tld=com", "domain=example.com", "label=casino", "label=a", "segment=en", "segment=#", "segment=bigWin-now", "key=affid", "key=ref", "key=lang", "ending=html", "word=casino", "word=big", "word=win", "word=now"}
    assert "key=no" not in a and b == c == set() and d == {"tld=localhost", "domain=localhost", "label=localhost", "word=localhost"}


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        t = {x for x in "abcdefg" if rng.random() < 0.4}
        rows.append((sorted(t), rng.random() < (0.9 if {"a", "b"} <= t else 0.8 if "g" in t else 0.15)))
    rows += [([], True), (["a", "b"], None)] * 5
    known = [(set(t), y) for t, y in rows if t and y is not None]
    base = sum(y for _, y in known) / len(known)
    want = {}
    for k in range(1, 8):
        for c in combinations("abcdefg", k):
            held = [y for t, y in known if set(c) <= t]
            hit = sum(held)
            if hit >= 20 and hit / len(held) >= 0.5 and hit / len(held) >= 1.5 * base and hit / len(held) - base >= 2 * (base * (1 - base) / len(held)) ** 0.5:
                want[c] = (hit / len(held), hit / len(held) / base, hit / len(known))
    found = {tuple(r[0]): tuple(r)[1:] for r in mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    assert len(want) > 5 and set(found) == set(want)
    assert all(found[c] == pytest.approx(want[c]) for c in want)
    for mined in (3, 6):  # more tokens than a piece holds
        few = {tuple(r[0]): tuple(r)[1:] for r in mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), mined_tokens=mined).collect()}
        assert set(few) == set(want) and all(few[c] == pytest.approx(want[c]) for c in want)
    short = shortest_rules(list(want))
    assert ("a", "b") in short and ("g",) in short and not any("g" in c and len(c) > 1 for c in short)
    held = spark.createDataFrame(rows, "tokens array<string>, bad boolean").select("tokens", holds_rule(F.col("tokens"), [(c[-1], c) for c in short]).alias("hit"))
    assert all(r["hit"] == any(set(c) <= set(r["tokens"]) for c in short) for r in held.collect())


def test_rules_of_urls_of_many_tokens(spark):
    rng, names = np.random.default_rng(8), [f"t{k:02}" for k in range(26)]
    held = np.zeros((1200, 26), bool)
    for r in held:
        r[rng.choice(26, 15, replace=False)] = True
    bad = rng.random(1200) < np.where(held[:, [0, 9, 23]].all(1), 0.95, np.where(held[:, [5, 6]].all(1), 0.6, 0.03))
    rows = [([n for n, x in zip(names, r, strict=True) if x], bool(y)) for r, y in zip(held, bad, strict=True)]
    base, want = bad.mean(), {}
    for k in (1, 2, 3, 4):
        for c in combinations(range(26), k):
            of = held[:, c].all(1)
            every, hit = int(of.sum()), int(bad[of].sum())
            if hit >= 20 and hit / every >= 0.5 and hit / every >= 1.5 * base and hit / every - base >= 2 * (base * (1 - base) / every) ** 0.5:
                want[tuple(names[i] for i in c)] = (hit / every, hit / every / base, hit / 1200)
    found = {tuple(r[0]): tuple(r)[1:] for r in mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    assert {("t05", "t06"), ("t00", "t09", "t23")} <= set(want) and any(len(c) == 4 for c in want) and set(found) == set(want)
    assert all(found[c] == pytest.approx(want[c]) for c in want)


def test_joined_index_gives_the_same(spark, edge_dir, monkeypatch):
    import echolake.llm.op4_url_filter as op4

    want = Counter(map(tuple, op4_url_filter(spark, edge_dir).collect()))
    monkeypatch.setattr(op4, "MAX_RULES", 0)
    assert Counter(map(tuple, op4_url_filter(spark, edge_dir).collect())) == want
