"""Toxicity by the nearest labelled examples.

Terms are character n-grams of words, and n-grams that a text repeats or is
dense with, as a cosine alone forgets how often.  A bounded sample of labelled
documents chooses the terms that go with the label, by chi-squared; document frequencies
of these are counted over all documents.  Examples are unit TF-IDF vectors in a
block-max index: a block of examples has the largest weight of each term, so
blocks whose bound is below the k-th best cosine are never scored, others meet
many queries at once, and the k nearest are exact.  Neighbours vote by
closeness; a monotone fit over the examples, each without its own vote, turns
votes into calibrated scores.  The neighbours are the evidence.

Bounds of the fit (documented parameters): ``PER_LABEL`` labelled documents of
each label, ``MAX_TERMS`` terms and ``MAX_POSTINGS`` weights of examples, which
bound the broadcast index.  Everything else covers all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.llm.groups import own_columns
from echolake.plans.shared import materialize

GRAM = 5
PER_LABEL, MAX_TERMS, MAX_POSTINGS = 8192, 4096, 4_000_000
#: A term must be in so many labelled documents and have such a chi-squared (p = 0.0001).
MIN_DOCS, MIN_CHI2 = 3, 15.14
#: An n-gram found so often is a term of its own; so is a repeated one that is in one of so many words.
REPEATS, SPARSEST = (2, 3, 5), (200, 60)
#: Examples of a block, and queries that meet a block at once.
BLOCK, SEARCHED = 256, 1024
#: Like examples share blocks: clusters, and rounds to find them.
CLUSTERS, CLUSTER_ROUNDS = 4, 6
NEIGHBOURS = 15
#: Weight of the share of toxic documents among those without a term.
PRIOR_VOTES = 0.2
HELD_OUT = 5
_WORD, _ASCII_WORD = re.compile(r"[^\W\d_]+"), re.compile(r"[a-z]+")
_LONG, _KEPT_WORDS, _KEPT_GRAMS, _KEPT_VECTORS = 1 << 20, 1 << 18, 1 << 14, 1 << 12


def grams(word: str) -> set[str]:
    """Character n-grams of a word between its marked ends; a shorter word is one."""
    x = f"^{word}$"
    return {x[k : k + GRAM] for k in range(max(1, len(x) - GRAM + 1))}


def _known_grams(word: str, known: dict[str, int]) -> tuple[int, ...]:
    """Numbers of those of a word's n-grams that are known."""
    x = f"^{word}$"
    if len(x) <= GRAM:
        return (known[x],) if x in known else ()
    found = {*map(known.get, [x[k : k + GRAM] for k in range(len(x) - GRAM + 1)])}
    found.discard(None)
    return tuple(found)


def words(text: str) -> Counter:
    low = text.lower()
    word = _ASCII_WORD if low.isascii() else _WORD  # equal on ASCII, and faster
    return Counter(m[0] for m in word.finditer(low)) if len(low) > _LONG else Counter(word.findall(low))


def levels(count: int, n_words: int) -> list[int]:
    """The levels that an n-gram reaches with so many finds among so many words; 0 is to be there."""
    out = [0, *[k for k, n in enumerate(REPEATS, 1) if count >= n]]
    return out + [k for k, n in enumerate(SPARSEST, 1 + len(REPEATS)) if count >= REPEATS[0] and count * n >= n_words]


@dataclass(frozen=True)
class Terms:
    """Chosen terms by number, with their inverse document frequencies."""

    names: list[str]
    idf: np.ndarray


class BlockMaxIndex:
    """Unit vectors in blocks, with each term's largest weight in a block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int):
        """``ids``, ``labels`` and vote ``weights`` by example; its ``sizes`` many terms and values are concatenated."""
        heaviest = np.array([int(t[np.argmax(v)]) if len(t) else -1 for t, v in zip(np.split(terms, np.cumsum(sizes)[:-1]), np.split(values, np.cumsum(sizes)[:-1]), strict=True)]) if len(sizes) else np.zeros(0, int)
        order = np.lexsort((ids, heaviest))
        self.ids, self.labels, self.votes = ids[order], labels[order], weights[order]
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n_terms, self.n_blocks, self.block = n_terms, -(-len(order) // BLOCK), BLOCK
        self.centres, cluster = _clusters(np.repeat(np.arange(len(sizes)), sizes), terms, values, len(sizes), n_terms)
        self.place = np.lexsort((sizes[order], cluster[order]))  # by slot: like examples share blocks
        self.slot = np.argsort(self.place)
        stored = order[self.place]
        picked = _ranges(begin[stored], begin[stored + 1]) if len(order) else np.zeros(0, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes[stored])]).astype(np.int64)
        self.terms, self.values = terms[picked].astype(np.int32), values[picked]  # an example's, by slot
        self.largest = np.zeros((self.n_blocks, n_terms), np.float32)
        np.maximum.at(self.largest, (np.repeat(np.arange(len(order)) // BLOCK, sizes[stored]), self.terms), self.values.astype(np.float32))

    def likeness(self, terms: np.ndarray, values: np.ndarray) -> tuple[int, int]:
        """Queries next to each other in this order need much the same blocks and terms."""
        return int((self.centres[:, terms] @ values).argmax()), len(terms)

    def _block(self, b: int, used: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The first slot of a block, those of the ``used`` terms that it holds, and its weights, terms x examples."""
        first, last = b * self.block, min((b + 1) * self.block, len(self.ids))
        here = slice(self.begin[first], self.begin[last])
        held = np.flatnonzero((self.largest[b] > 0) & used)
        row = np.full(self.n_terms, len(held), np.int32)
        row[held] = np.arange(len(held))
        weights = np.zeros((len(held) + 1, last - first), np.float32)  # the last row takes the terms that are not used
        weights[row[self.terms[here]], np.repeat(np.arange(last - first), np.diff(self.begin[first : last + 1]))] = self.values[here]
        return first, held, weights[:-1]

    def _exact(self, slots: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Cosines of the examples in these slots with a query that has all terms."""
        begin, end = self.begin[slots], self.begin[slots + 1]
        at = _ranges(begin, end)
        return np.bincount(np.repeat(np.arange(len(slots)), end - begin), query[self.terms[at]] * self.values[at], minlength=len(slots)).round(12)

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query of (terms, values) the k examples of the largest positive cosines (ties: smaller place) and the cosines; and how many blocks were scored for a query.

        Blocks go by falling bounds; a block is scored for those queries whose
        bound reaches their k-th best cosine so far.  Products of a block with
        queries are of single precision; whatever their error lets be among
        the k is scored again in double precision, so the k are exact.
        ``without`` has a place for each query that is left out, -1 for none.
        """
        n, error = len(queries), (self.n_terms + 2) * 2.0**-23  # twice that of a sum of so many terms
        by_term = np.zeros((self.n_terms, n), np.float32)
        for j, (terms, values) in enumerate(queries):
            by_term[terms, j] = values
        used = by_term.any(1)
        bound = self.largest @ by_term * (1 + error)
        mine = np.full(n, -1) if without is None else np.where(without >= 0, np.append(self.slot, -1)[without], -1)
        best, least = np.zeros((n, k), np.float32), np.zeros(n, np.float32)  # the k largest products so far, and the smallest of these
        owners, slots, products, scored = [], [], [], 0
        for b in np.argsort(-bound.sum(1), kind="stable").tolist():
            need = np.flatnonzero((bound[b] > 0) & (bound[b] >= least - error))
            if not len(need):
                continue
            scored += len(need)
            first, held, weights = self._block(b, used)
            of_held = by_term[held]
            product = (of_held if len(need) == n else np.take(of_held, need, axis=1, mode="clip")).T @ weights
            own = np.flatnonzero((mine[need] >= first) & (mine[need] < first + weights.shape[1]))
            product[own, mine[need][own] - first] = 0
            better = np.flatnonzero(product.max(1) > least[need])
            at = need[better]
            best[at] = np.partition(np.concatenate([best[at], product[better]], 1), -k, axis=1)[:, -k:]
            least[at] = best[at].min(1)
            q, at = np.nonzero((product > 0) & (product >= (least[need] - error)[:, None]))
            owners.append(need[q])
            slots.append(first + at)
            products.append(product[q, at])
        owner, slot, product = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, owners), (np.int64, slots), (np.float32, products)))
        near = np.flatnonzero(product >= least[owner] - error)
        near = near[np.argsort(owner[near], kind="stable")]
        end = np.searchsorted(owner[near], np.arange(n + 1))
        found, query = [], np.zeros(self.n_terms)
        for j, (terms, values) in enumerate(queries):
            here = np.sort(self.place[slot[near[end[j] : end[j + 1]]]])
            query[terms] = values
            cosine = self._exact(self.slot[here], query)
            query[terms] = 0
            top = np.lexsort((here, -cosine))[: min(k, np.count_nonzero(cosine > 0))]
            found.append((here[top], cosine[top]))
        return found, scored

    def search(self, terms: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """``search_all`` for one query: places, cosines, blocks scored."""
        [(place, cosine)], scored = self.search_all([(terms, values)], k)
        return place, cosine, scored


def _clusters(own: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of ``CLUSTERS`` clusters of ``n`` unit vectors by cosine, and the cluster of each; they only order the index."""
    cluster = np.arange(n) * CLUSTERS // max(1, n)
    for _ in range(CLUSTER_ROUNDS):
        centres = np.bincount(cluster[own] * n_terms + terms, values, minlength=CLUSTERS * n_terms).reshape(CLUSTERS, n_terms)
        centres = centres / np.maximum(np.sqrt((centres**2).sum(1, keepdims=True)), 1e-12)
        cluster = np.array([np.bincount(own, c[terms] * values, minlength=n) for c in centres]).argmax(0)
    return centres, cluster


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one after another."""
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


@dataclass(frozen=True)
class Model:
    """The index, the terms and the calibration: votes at its knots and what they mean."""

    terms: Terms
    index: BlockMaxIndex
    knots: np.ndarray
    means: np.ndarray
    prior: float

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each query the vote, and the places and cosines of its neighbours."""
        order = sorted(range(len(queries)), key=lambda j: self.index.likeness(*queries[j]))
        found: list = [None] * len(queries)
        for start in range(0, len(order), SEARCHED):
            here = order[start : start + SEARCHED]
            near, _ = self.index.search_all([queries[j] for j in here], NEIGHBOURS, None if without is None else without[here])
            for j, x in zip(here, near, strict=True):
                found[j] = x
        for place, cosine in found:
            w = self.index.votes[place] * cosine**2
            yield float((w @ self.index.labels[place] + PRIOR_VOTES * self.prior) / (w.sum() + PRIOR_VOTES)), place, cosine

    def score(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, self.knots, self.means), 0.0, 1.0))


def unit_vector(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln count) x idf, of length 1."""
    v = (1 + np.log(counts)) * idf[terms]
    return v / math.sqrt(v @ v) if len(v) else v


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing fit of y to x by pooling; every pool also holds the prior with weight 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, weight
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2]):
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    means = np.maximum.accumulate([(p[1] + prior) / (p[2] + 1) for p in pools]) if pools else np.array([])
    return np.array([p[0] / p[2] for p in pools] or [0.0]), means if pools else np.array([prior])


def _labelled(docs: DataFrame, labels: DataFrame, seed_rows: int) -> DataFrame:
    """Up to ``seed_rows`` documents of each label that may be learned from: doc_id, text, toxic and the vote weight of one."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT != 0).where("toxic IN (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").agg(F.count(F.lit(1))).collect()}  # two rows
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = known.where("toxic = 0").orderBy(*by_hash).limit(seed_rows).unionByName(known.where("toxic = 1").orderBy(*by_hash).limit(seed_rows))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")  # at most 2 x seed_rows rows
    texts = texts.dropDuplicates(["doc_id"])  # of an id with several texts, one
    weight = F.lit(0.0)
    for label, n in counts.items():
        weight = F.when(F.col("toxic") == label, n / min(n, seed_rows)).otherwise(weight)
    return texts.withColumn("vote", weight.cast("double"))


def choose_terms(examples: DataFrame) -> list[str]:
    """The terms that go with the label: at most ``MAX_TERMS``, by chi-squared, then by name."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        of: dict[str, set[str]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *[pa.array([c[k] for c in n.values()], pa.int64()) for k in (0, 1)]], names=["term", "n0", "n1"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, seen = words(text), {}
                for w, c in found.items():
                    own = of.get(w)
                    if own is None:
                        if len(of) >= _KEPT_GRAMS:
                            of.clear()
                        own = of[w] = grams(w)
                    for g in own:
                        seen[g] = seen.get(g, 0) + c
                total_words = found.total()
                for g, c in seen.items():
                    for level in levels(c, total_words) if c > 1 else (0,):
                        n.setdefault(f"{g} {level}", [0, 0])[toxic] += 1
                if len(n) > 500_000:
                    yield out()
                    n.clear()
        yield out()

    total = {r[0]: r[1] for r in examples.groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    n0, n1 = float(total.get(0, 0)), float(total.get(1, 0))
    if not n0 or not n1:
        return []
    sums = examples.select("text", "toxic").mapInArrow(counted, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    a, b = F.col("a"), F.col("b")
    n = n0 + n1
    chi2 = n * (b * (n0 - a) - a * (n1 - b)) ** 2 / (n0 * n1 * (a + b) * (n - a - b))
    ranked = sums.where((a + b >= MIN_DOCS) & (a + b < n)).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2)
    return [r[0] for r in ranked.orderBy(F.desc("chi2"), "term").limit(MAX_TERMS).collect()]


def _by_gram(names: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the n-grams, and for each the numbers of its terms by level, -1 for none."""
    number: dict[str, int] = {}
    pairs = [name.rsplit(" ", 1) for name in names]
    for g, _ in pairs:
        number.setdefault(g, len(number))
    table = np.full((len(number), 1 + len(REPEATS) + len(SPARSEST)), -1, np.int32)
    for k, (g, level) in enumerate(pairs):
        table[number[g], int(level)] = k
    return number, table


def _terms_of(table: np.ndarray, row: np.ndarray, of_gram: np.ndarray, counts: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and counts, by row and term, of n-grams found so often in rows of so many words; as ``levels`` says, for all at once."""
    out = []
    words_there = n_words[row]
    for level, reached in enumerate([None, *[counts >= n for n in REPEATS], *[(counts >= REPEATS[0]) & (counts * n >= words_there) for n in SPARSEST]]):
        own = table[of_gram, level]
        at = np.flatnonzero(own >= 0 if reached is None else (own >= 0) & reached)
        out.append((row[at], own[at], counts[at]))
    rows, terms, found = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(rows * np.int64(1 + table.max(initial=0)) + terms)
    return rows[order], terms[order], np.minimum(found[order], 2**31 - 1)


def _vectors(terms: pa.ListArray, counts: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of each row."""
    for t, c in zip(terms, counts, strict=True):
        yield np.asarray(t.values, np.int64), np.asarray(c.values)


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    """``values`` as one list a part, of the part's length."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), values)


def with_terms(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` (whose ``text`` goes) with __el_terms and __el_counts, the chosen terms of each whole text."""
    rest = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(_by_gram(names))
    schema = docs.select(*[F.col(f"`{c}`") for c in rest], F.array().cast("array<smallint>").alias("__el_terms"), F.array().cast("array<int>").alias("__el_counts")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, table), of = shared.value, {}
        for batch in batches:
            of_gram, counts, sizes, n_words = [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found, seen = words(text or ""), {}
                for w, c in found.items():
                    own = of.get(w)
                    if own is None:
                        if len(of) >= _KEPT_WORDS:
                            of.clear()
                        own = of[w] = _known_grams(w, known)
                    for g in own:
                        seen[g] = seen.get(g, 0) + c
                of_gram.extend(seen)
                counts.extend(seen.values())
                sizes.append(len(seen))
                n_words.append(found.total())
            rows, terms, counts = _terms_of(table, np.repeat(np.arange(len(sizes)), sizes), np.array(of_gram, np.int64), np.array(counts, np.int64), np.array(n_words, np.int64))
            begin = pa.array(np.searchsorted(rows, np.arange(len(sizes) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(begin, pa.array(terms, pa.int16())), pa.ListArray.from_arrays(begin, pa.array(counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*rest, "__el_terms", "__el_counts"])

    return docs.select(*[F.col(f"`{c}`") for c in rest], "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, seed_rows: int = PER_LABEL) -> tuple[list[str], DataFrame]:
    """The terms, and the sampled examples with theirs."""
    examples = materialize(_labelled(docs, labels, seed_rows).repartition(64, F.xxhash64("doc_id")), "examples")
    names = choose_terms(examples)
    return names, with_terms(examples, names)


def document_frequencies(vectors: DataFrame, n_terms: int) -> DataFrame:
    """Rows (t, n): how many rows of ``vectors`` hold each term; tasks send a row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64())], names=["t", "n"])

    return vectors.select("__el_terms").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))


def fit(names: list[str], examples: DataFrame, vectors: DataFrame) -> Model:
    """The model of examples, with document frequencies from ``vectors``, all documents with their terms."""
    n, df = vectors.count(), np.zeros(len(names))
    for t, c in document_frequencies(vectors, len(names)).collect():  # a row a term
        df[t] = c
    idf = np.log((1 + n) / (1 + df)) + 1
    blank = examples.groupBy(F.size("__el_terms") == 0, "toxic").agg(F.sum("vote")).collect()  # four rows
    bare = {r[1]: r[2] for r in blank if r[0]} or {r[1]: r[2] for r in blank}
    prior = (bare.get(1, 0.0) + 0.5) / (sum(bare.values()) + 1) if blank else 0.0
    kept = examples.where(F.size("__el_terms") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "toxic", "vote", "__el_terms", "__el_counts").toArrow()
    ids, labels, votes = (kept.column(c).to_numpy() for c in ("doc_id", "toxic", "vote"))
    sizes = np.array([len(x) for x in kept.column("__el_terms")], np.int64)
    few = int(np.searchsorted(np.cumsum(sizes), MAX_POSTINGS, "right"))  # in order of the hash, as many as the bound allows
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *[x.flatten().to_numpy() for x in kept.column(c).slice(0, few).chunks]])
    terms, counts = flat("__el_terms"), flat("__el_counts")
    ids, labels, votes, sizes = ids[:few], labels[:few].astype(float), votes[:few], sizes[:few]
    parts = np.cumsum(sizes)[:-1]
    values = np.concatenate([unit_vector(t, c, idf) for t, c in zip(np.split(terms, parts), np.split(counts, parts), strict=True)]) if few else np.zeros(0)
    index = BlockMaxIndex(ids, labels, votes, sizes, terms, values, len(names))
    raw = Model(Terms(names, idf), index, np.array([0.0, 1.0]), np.array([0.0, 1.0]), prior)
    shared = examples.sparkSession.sparkContext.broadcast(raw)
    own = own_votes(examples, shared).toArrow()  # a row an example; Spark's sort would search all twice
    shared.destroy()  # its copies are as large as the model's
    rank = {i: k for k, i in enumerate(ids.tolist())}
    own = own.take(np.argsort([rank[i] for i in own.column("doc_id").to_pylist()]))
    x, y, w = (own.column(c).to_numpy() for c in ("own", "toxic", "vote"))
    knots, means = monotone(np.append(x, prior), np.append(y.astype(float), prior), np.append(w, 1.0), prior)
    return Model(raw.terms, index, knots, means, prior)


def own_votes(examples: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows (doc_id, toxic, vote, own): the vote that each example of the index of a shared ``Model`` gets from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {i: k for k, i in enumerate(m.index.ids.tolist())}
        for batch in batches:
            at = np.array([place.get(i, -1) for i in batch.column(0).to_pylist()], np.int64)
            rows = batch.take(pa.array(np.flatnonzero(at >= 0)))
            queries = [(t, unit_vector(t, c, m.terms.idf)) for t, c in _vectors(rows.column(3), rows.column(4))]
            own = [vote for vote, *_ in m.votes(queries, at[at >= 0])]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(own, pa.float64())], names=["doc_id", "toxic", "vote", "own"])

    dealt = examples.select("doc_id", "toxic", "vote", "__el_terms", "__el_counts").repartition(2 * PER_LABEL // SEARCHED, F.xxhash64("doc_id"))  # a block meets many at once
    return dealt.mapInArrow(run, "doc_id long, toxic int, vote double, own double")


def scored(vectors: DataFrame, model: Model) -> DataFrame:
    """``vectors`` without their terms, with __el_score and __el_evidence (doc_id, toxic, cosine of the neighbours)."""
    rest = [c for c in vectors.columns if c not in ("__el_terms", "__el_counts")]
    evidence = F.array().cast("array<struct<doc_id:bigint,toxic:int,cosine:double>>").alias("__el_evidence")
    schema = vectors.select(*[F.col(f"`{c}`") for c in rest], F.lit(0.0).alias("__el_score"), evidence).schema
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for batch in batches:
            keys, new = [], {}
            for terms, counts in _vectors(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                keys.append((terms.tobytes(), counts.tobytes()))
                if keys[-1] not in known and keys[-1] not in new:
                    new[keys[-1]] = terms, unit_vector(terms, counts, m.terms.idf)
            here = {of: known[of] for of in keys if of in known}
            here |= {of: (m.score(vote), place, cosine) for of, (vote, place, cosine) in zip(new, m.votes(list(new.values())), strict=True)}
            known = dict(list((known | here).items())[-_KEPT_VECTORS:])
            scores, places, cosines = [], [np.zeros(0, np.int64)], [np.zeros(0)]
            for of in keys:
                score, place, cosine = here[of]
                scores.append(score)
                places.append(place)
                cosines.append(cosine)
            at = np.concatenate(places)
            columns = [pa.array(m.index.ids[at], pa.int64()), pa.array(m.index.labels[at].astype(np.int32)), pa.array(np.concatenate(cosines))]
            found = _lists(places[1:], pa.StructArray.from_arrays(columns, names=["doc_id", "toxic", "cosine"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(scores, pa.float64()), found], names=[*rest, "__el_score", "__el_evidence"])

    tasks = max(64, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # small rows, long searches: a file's split is too much for one task
    alike = F.when(F.size("__el_terms") > 0, F.xxhash64("__el_terms", "__el_counts"))
    dealt = vectors.repartition(tasks, alike, F.xxhash64(*[F.col(f"`{c}`") for c in rest]) % F.when(alike.isNotNull(), 4).otherwise(1 << 20))
    return dealt.select(*[F.col(f"`{c}`") for c in rest], "__el_terms", "__el_counts").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, seed_rows: int = PER_LABEL) -> DataFrame:
    """``docs`` (whose ``text`` goes) with __el_score and __el_evidence.

    Labels of rows whose crc32(doc_id as text) mod 5 is 0, null labels and ids
    teach nothing; of several labels of an id the largest counts, and of several
    texts of an id one.  Texts without a chosen term, null and empty ones among
    them, get the share of toxic documents among such.  Without labels, or with
    one label only, no term is chosen and every score is that share (0 without
    any).  Repeated rows get equal scores; equal cosines go by place in the
    index; an empty table stays empty; very long texts are one row's work.
    """
    names, examples = train(docs, labels, seed_rows)
    examples = materialize(examples, "examples")
    vectors = materialize(with_terms(docs.select(*own_columns(docs)), names), "vectors")
    return scored(vectors, fit(names, examples, vectors))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(False)).alias("held_out")
    score = F.col("__el_score").alias("score")
    return toxicity(docs, labels).select("doc_id", held, score, (F.col("__el_score") >= 0.5).cast("int").alias("predicted"), F.col("__el_evidence").alias("evidence"))
