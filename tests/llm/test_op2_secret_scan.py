from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from echolake.llm.op2_secret_scan import ENCODINGS, battery, discovery_thresholds, find_spans, op2_secret_scan, scan

KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def brute(text: str | None) -> list[tuple[int, int, str, int]]:
    out = []
    for k, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def test_base_spans(spark, sf_dir, documents):
    want = Counter()
    for d in documents:
        spans = brute(d["text"])
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        n = Counter(s[2] for s in spans)
        want[d["doc_id"], n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()] += 1
    rows = op2_secret_scan(spark, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    for r in rows:  # the base spans stay among all, in order
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = ",".join(":".join(s) for s in spans if s[0] != "random")
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)


def test_battery_finds_random_tokens_and_leaves_text(spark, tmp_path):
    rng = random.Random(4)
    rows, planted = [], {}
    for k in range(200):
        token = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(48))
        word = "_".join(rng.choice(["internationalisation", "telecommunication", "the_rest_of_it", "representation"]) for _ in range(3))
        rows.append((k, f"é {word} then {token if k % 2 else word} end"))
        planted[k] = (f"random:{rows[-1][1].index(token)}:{rows[-1][1].index(token) + 48}" if k % 2 else "")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["spans"] for r in op2_secret_scan(spark, str(tmp_path)).collect()}
    assert sum(found[k] == s for k, s in planted.items() if k % 2) >= 90
    assert sum(found[k] != "" for k in planted if not k % 2) <= 5


def test_battery_finds_tokens_joined_to_text(spark, tmp_path):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(200):
        token = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
        before = ("https://hooks.example.com/services/T00000000/B00000000/", "live_key_", "https://example.com/api/v1/users/settings/confirm/email/")[k % 3]
        rows.append((k, f"see {before}{token} end"))
        want[k] = f"random:{4 + len(before)}:{52 + len(before)}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["spans"] for r in op2_secret_scan(spark, str(tmp_path)).collect()}
    assert sum(found[i] == s for i, s in want.items() if i % 3 == 0) >= 60
    assert sum(found[i].endswith(":" + s.split(":")[2]) for i, s in want.items() if i % 3 == 2) >= 60  # some with the path
    for spans in found.values():
        ends = [tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_many_spans_of_one_text(spark):
    pattern = r"[a-f]{2,}(x*)"
    texts = ["\u00e9 " + "ab! cdxx\U0001f600" * n + tail for n in (0, 1, 127, 128, 129, 256, 1000) for tail in ("", " zz", "aa")] + ["", "abab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", find_spans(F.col("text"), pattern, 1).alias("s"))
    found = {r["k"]: [tuple(x) for x in r["s"]] for r in rows.collect()}
    assert found == {k: [(m.start(), m.end(), m[0], m[1]) for m in re.finditer(pattern, t)] for k, t in enumerate(texts)}


def plain_battery(t: str) -> tuple[float, ...]:
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    a = next(e[2] for e in ENCODINGS if re.search(e[1], t))
    x, n, size = [a.index(c) for c in t], len(t), len(a)
    chi = sum((x.count(k) - n / size) ** 2 / (n / size) for k in range(size))
    df = size - 1
    uniform = tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [c > (size - 1) / 2 for c in x]
    expected = 2 * sum(high) * (n - sum(high)) / n
    spread = expected * (expected - 1) / (n - 1)
    runs = 2 * tail(abs(sum(p != q for p, q in zip(high, high[1:], strict=False)) - expected) / math.sqrt(spread)) if spread > 0 else 0
    mean = sum(x) / n
    var = sum((c - mean) ** 2 for c in x)
    serial = 2 * tail(abs(sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False)) / var + 1 / n) * math.sqrt(n)) if var else 2 * tail((1 + 1 / n) * math.sqrt(n))
    excess = n * max(size * 0.065 - 1, 0.5)
    text = 1 - tail((chi - df - excess) / math.sqrt(2 * (df + 2 * excess)))
    return chi, uniform, runs, serial, min(1, 3 * min(uniform, runs, serial)), text


def test_battery_against_plain_python(spark):
    rng = random.Random(8)
    alphabet = {e[0]: e[2] for e in ENCODINGS}
    tokens = ["".join(rng.choice(alphabet[e]) for _ in range(n)) for e in alphabet for n in (20, 33, 64)]
    tokens += ["internationalisation", "a" * 30, "01" * 20, "TelecommunicationEquipment/Representation"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", battery(F.col("t")).alias("b")).collect()
    for r in rows:
        assert tuple(r["b"]) == pytest.approx(plain_battery(r["t"]), abs=1e-5, rel=1e-6)


def plain_spans(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """The random spans of each text, every span held against every other."""
    candidates = []
    for text in texts:
        spans = {(m.start(), m.end()) for p in (r"[A-Za-z0-9+/_-]{20,}", r"[A-Za-z0-9]{20,}") for m in re.finditer(p, text or "")}
        base = [(a, b) for a, _, _, b in brute(text)]
        candidates.append({s: plain_battery(text[s[0] : s[1]])[4:] for s in spans if not any(a <= s[0] and b >= s[1] for a, b in base)})
    place = lambda p: min(math.floor(-math.log10(max(p, 1e-30)) / 0.05), 400)
    classes = defaultdict(list)
    for found in candidates:
        for (a, b), (_, p) in found.items():
            classes[int(math.log2(b - a))].append(place(p))
    limits = {c: max((10 ** (-k * 0.05) for k in set(bins) if 10 ** (-k * 0.05) <= 0.05 * sum(x >= k for x in bins) / len(bins)), default=0.0) for c, bins in classes.items()}
    out = []
    for found in candidates:
        passed = {s: p for s, (r, p) in found.items() if r >= 0.001 and p <= limits[int(math.log2(s[1] - s[0]))]}
        holds = lambda c, s: c != s and c[0] <= s[0] and c[1] >= s[1]
        outer = [c for c in passed if not any(holds(c, s) and passed[s] < passed[c] for s in passed)]
        out.append(sorted(s for s in outer if not any(holds(c, s) for c in outer)))
    return out


def test_choice_of_spans_against_plain_python(spark):
    rng = random.Random(12)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alphanumeric, words = ENCODINGS[7][2], ["internationalisation", "telecommunications", "representatives", "settings", "users", "aaaaaaaaaaaaaaaaaaaaaaaa"]

    def token() -> str:
        parts = [rng.choice(words) if rng.random() < 0.5 else some(rng.choice([alphanumeric, "0123456789abcdef"]), rng.choice([12, 20, 24, 40, 64])) for _ in range(rng.randrange(1, 5))]
        return rng.choice(["", "", "token=", "password: ", "AKIA", "secret='"]) + rng.choice("/-_+").join(parts)

    texts = ["\u00e9\U0001f600 " + " then ".join(token() for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", "AKIA" + some(alphanumeric.upper(), 600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit("x")).withColumn("spans", F.lit(1))
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 3] for r in scan(docs).collect()}
    want = dict(enumerate(plain_spans(texts)))
    assert sum(map(len, want.values())) > 200
    assert found == want


def test_text_of_many_candidates(spark):
    """Twice the candidates cost about twice the time, not four times."""
    rng = random.Random(13)
    token = lambda: "".join(rng.choice(ENCODINGS[7][2]) for _ in range(12)) + "/" + "".join(rng.choice(ENCODINGS[7][2]) for _ in range(24))
    many = [token() for _ in range(10_000)]
    text = " ".join(t if k % 10 else f"token={t}" for k, t in enumerate(many))
    began = time.monotonic()
    long = "".join(rng.choice(ENCODINGS[7][2]) for _ in range(200_000))
    row, other = sorted(scan(spark.createDataFrame([(1, text), (2, f"a {long} b")], "doc_id long, text string")).collect())
    assert time.monotonic() - began < 60
    assert [(s["start"], s["end"]) for s in other["spans"]] == [(2, 200_002)]
    assert len(row["base"]) >= 1000
    spans = [(s["start"], s["end"]) for s in row["spans"] if s["kind"] == 3]
    assert len(spans) > 8000
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_discoveries_against_the_exact_rule(spark):
    """Binned upwards: never looser than Benjamini-Hochberg, and stricter by a bin at most."""
    rng = random.Random(9)
    rows = [(rng.choice([20, 40, 70]), 10 ** -(rng.random() * 12 if rng.random() < 0.3 else rng.random())) for _ in range(900)]
    found = discovery_thresholds(spark.createDataFrame(rows, "length int, p_text double"))
    held = defaultdict(list)
    for n, p in rows:
        held[int(math.log2(n))].append(p)
    for cls, ps in held.items():
        ps.sort()
        passed = [p for k, p in enumerate(ps, 1) if p <= 0.05 * k / len(ps)]
        mine = [p for p in ps if p <= found.get(cls, 0)]
        strict = [p for k, p in enumerate(ps, 1) if p * 10**0.05 <= 0.05 * k / len(ps)]
        assert len(strict) - 1 <= len(mine) <= len(passed)
