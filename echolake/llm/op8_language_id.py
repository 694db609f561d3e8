"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are gathered by Spark from labelled documents;
those above zero are broadcast, at most as many as the drawn documents have
n-grams, and numpy multiplies the sparse n-gram counts of a batch of whole texts
with them.

The only bound: training draws about ``TRAIN_DOCS`` labelled documents by a hash
of their id.  Languages of up to a quota are taken whole, and of each larger one
about the quota is drawn, which is ``LEAST_DOCS`` at least.  Every label has
documents in the draw, however many labels there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.llm.groups import own_columns

BUCKETS = 1 << 15
TRAIN_DOCS = 20_000
LEAST_DOCS = 100
_HELD = 32  # languages counted in a task at a time
_CHARS = 1 << 16  # of a batch
ALPHA = 0.5
#: The reported posterior counts the evidence as that of this many n-grams at most, so that
#: the score of a long text stays a measure of how clear the choice is; the choice itself weighs all.
EVIDENCE = 60
UNKNOWN = "und"
_SPACE = re.compile(r"\s+")
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)
# Odd multipliers, one for each place in an n-gram.
_M = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def ngram_buckets(text: str) -> np.ndarray:
    """Hash buckets of all 1-, 2- and 3-grams of the lower-cased text."""
    s = " " + _SPACE.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * _M[0]
    two = one[:-1] + c[1:] * _M[1]
    three = two[:-1] + c[2:] * _M[2]
    return np.concatenate([((h ^ (h >> np.uint32(15))) * _M[k]) >> _SHIFT for k, h in enumerate((one, two, three))])


def ngram_counts(text: str) -> np.ndarray:
    """Counts by bucket of the whole text."""
    return np.bincount(ngram_buckets(text), minlength=BUCKETS)


def incidence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse counts of a batch: rows, buckets and counts of the entries above zero, row by row."""
    found = []
    for t in texts:
        if len(t) < BUCKETS // 8:
            found.append(np.unique(ngram_buckets(t), return_counts=True))
        else:  # the counts take less room than the n-grams
            counts = ngram_counts(t)
            hit = np.flatnonzero(counts)
            found.append((hit, counts[hit]))
    rows = np.repeat(np.arange(len(texts)), [len(b) for b, _ in found])
    return rows, np.concatenate([b for b, _ in found]).astype(np.int64), np.concatenate([n for _, n in found]).astype(float)


@dataclass(frozen=True)
class NaiveBayes:
    langs: tuple[str, ...]
    log_prior: np.ndarray
    log_rest: np.ndarray  # by language, the log-probability of a bucket without counts
    starts: np.ndarray  # by bucket, where its entries begin in the next two
    at: np.ndarray  # the place of a language
    gain: np.ndarray  # its log-probability of the bucket above log_rest

    def log_likelihood(self, rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """The product of a batch's sparse counts (``n`` rows) with the log-probability matrix, itself held sparse."""
        long = self.starts[buckets + 1] - self.starts[buckets]
        place = np.repeat(self.starts[buckets] - np.cumsum(long) + long, long) + np.arange(long.sum())
        size = len(self.langs)
        gained = np.bincount(np.repeat(rows, long) * size + self.at[place], np.repeat(counts, long) * self.gain[place], n * size)
        return np.bincount(rows, counts, n)[:, None] * self.log_rest + gained.reshape(n, size)

    def score_batch(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, ties by code point, and its posterior.

        The posterior tempers the evidence; the choice doesn't.
        """
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        if some:
            entries = incidence([texts[i] for i in some])
            ll = self.log_likelihood(*entries, len(some))
            best = np.argmax(ll + self.log_prior, axis=1)
            seen = np.bincount(entries[0], entries[2], len(some))
            tempered = ll * np.minimum(1.0, EVIDENCE / seen)[:, None] + self.log_prior
            p = np.exp(tempered - tempered.max(axis=1, keepdims=True))
            p = p[np.arange(len(some)), best] / p.sum(axis=1)
            for i, b, x in zip(some, best.tolist(), p.tolist(), strict=True):
                langs[i], scores[i] = self.langs[b], x
        return langs, scores

    def score(self, text: str | None) -> tuple[str, float]:
        langs, scores = self.score_batch([text])
        return langs[0], scores[0]


def quota(sizes: list[int], total: int = TRAIN_DOCS, least: int = LEAST_DOCS) -> int:
    """The largest number, ``least`` at least, of which taking so many of each language at most gives ``total`` or fewer."""
    left = total
    for k, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if n > share:
            return max(share, least)
        left -= n
    return max([least, *sizes])


def train(labelled: DataFrame, seed: int = 8) -> NaiveBayes:
    """Fit on rows (doc_id, text, lang); rows with a null text or lang are left out."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)).alias("draw"))
    sizes = sorted(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first")).collect())
    langs = tuple(r["lang"] for r in sizes)
    if not langs:
        none = np.zeros(0)
        return NaiveBayes((), none, none, np.zeros(BUCKETS + 1, np.int64), np.zeros(0, np.int64), none)
    most = quota([r["n"] for r in sizes])
    # the first of a language is always drawn
    limits = [(r["lang"], k, max(r["first"], (1 << 30) * most // r["n"])) for k, r in enumerate(sizes)]
    limits = labelled.sparkSession.createDataFrame(limits, "lang string, at int, limit long")
    drawn = usable.join(F.broadcast(limits), "lang").where("draw <= limit")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}

        def packed() -> pd.DataFrame:
            hit = [np.flatnonzero(s) for s in sums.values()]
            at, n = np.repeat(list(sums), [len(b) for b in hit]), [s[b] for s, b in zip(sums.values(), hit, strict=True)]
            return pd.DataFrame({"at": at.astype(np.int32), "bucket": np.concatenate(hit).astype(np.int32), "n": np.concatenate(n).astype(np.int64)})

        for f in frames:
            for text, at in zip(f["text"], f["at"], strict=True):
                if at not in sums and len(sums) == _HELD:
                    yield packed()
                    sums.clear()
                sums[at] = sums.get(at, 0) + ngram_counts(text)
        if sums:
            yield packed()

    parts = drawn.select("text", "at").mapInPandas(count, "at int, bucket int, n long")
    rows = parts.groupBy("at", "bucket").agg(F.sum("n").alias("n")).toPandas().sort_values(["bucket", "at"])  # n-grams drawn at most
    at, n = rows["at"].to_numpy(np.int64), rows["n"].to_numpy(float)
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows["bucket"].to_numpy(np.int64), minlength=BUCKETS))])
    docs = np.array([r["n"] for r in sizes], float)
    log_rest = np.log(ALPHA) - np.log(np.bincount(at, n, len(langs)) + ALPHA * BUCKETS)
    return NaiveBayes(langs, np.log(docs / docs.sum()), log_rest, starts, at, np.log1p(n / ALPHA))


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``_CHARS`` characters, one text at least, which bounds a product's memory."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > _CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def predict(docs: DataFrame, model: NaiveBayes, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of ``text`` and its score from 0 to 1.

    A null text, or one without a letter, is ``und`` with score 0.
    """
    if clash := {lang, score} & set(docs.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def best(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        nb = shared.value
        for batch in texts:
            parts = [nb.score_batch(part) for part in _parts(batch.tolist())]
            yield pd.DataFrame({"lang": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]]})

    found = docs.withColumn("__el_lang", best("text"))
    return found.select(*own_columns(docs), F.col("__el_lang.lang").alias(lang), F.col("__el_lang.score").alias(score))


def held_out() -> Column:
    """Whether a document is kept from training: its id's checksum is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
