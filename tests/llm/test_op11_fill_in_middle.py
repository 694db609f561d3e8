"""Fill-in-middle against plain Python, over edge texts and supplied ones; other units than code points."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from echolake.llm import op11_fill_in_middle as M


def plain_python(doc_id, text) -> tuple:
    text = text or ""
    n = len(text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, a, b = "plain", text, None, None
    else:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        pre, mid, suf = text[:a], text[a:b], text[b:]
        form = "spm" if h[3] % 100 < 20 else "psm"
        out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, n, form, a, None if a is None else b - a, sha(out), sha(text)


def key(r: tuple) -> tuple:
    return tuple((x is not None, x) for x in r)


def test_query_equals_plain_python(spark, sf_dir, documents):
    got = M.op11_fill_in_middle(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=key) == sorted((plain_python(d["doc_id"], d["text"]) for d in documents), key=key)


def test_awkward_texts(spark):
    texts = ["<P>", "a<S>b", "<", "<P", "P><S", "é😀" * 700, "\n\r \x00x", " ", "<<<<M", "a" * 64, "b" * 65, "😀" * 128]
    rows = [(k, t) for k in range(40) for t in texts] + [(None, "null id"), (7, None), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("turn", F.lit(1)).withColumn("run", F.lit("x"))
    made = M.fill_in_middle(docs).select("doc_id", "text", "turn", "run", "__el_form", "__el_output", M.restored(F.col("__el_output"), F.col("__el_form"))).collect()
    assert all(r[6] == (r[1] or "") for r in made)
    want = [plain_python(i, t) for i, t in rows]
    assert sorted(key((r[0], r[4], hashlib.sha256(r[5].encode()).hexdigest())) for r in made) == sorted(key((w[0], w[2], w[5])) for w in want)


@pytest.mark.parametrize("unit", [M.CODE_POINT, M.WORD, r"(?s:.{1,3})"])
@pytest.mark.parametrize("run", [1, 3, 64])
def test_offsets_of_units(spark, unit, run):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        text = "".join(rng.choice(["a", "é", "😀", " ", "\n", "bc "]) for _ in range(rng.randrange(200)))
        rows.append((k, text, [rng.randrange(-1, 220) for _ in range(rng.randrange(4))]))
    rows += [(90, None, [0, 5]), (91, "", [0, 1]), (92, "abc", None), (93, "abc", [1, 1, 0])]
    got = M.with_offsets(spark.createDataFrame(rows, "k long, t string, c array<long>"), "t", "c", "o", unit, run).collect()
    assert len(got) == len(rows)
    for _, t, c, o in got:
        units = re.findall(unit, t or "")
        assert o == [sum(map(len, units[: max(0, x)])) for x in c or []]
