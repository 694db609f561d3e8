"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length.  A source's target is filled
with whole passes over its documents and, for the budget that remains, a
subset whose lengths add up to it as nearly as possible without going over:
each length gives its even share first, then bounded-knapsack dynamic
programming fits the rest.  The documents of each length are chosen by a
seeded hash of their id, so reruns agree.

Only the histogram (length, count) of a source meets in one task, never documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolake.llm.groups import own_columns
from echolake.plans.ranking import exact_rank
from echolake.plans.shared import materialize

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2.0
#: The budget left to dynamic programming is of this size, or of one document.
DP_BUDGET = 1 << 15
_CODE, _SIZE = "__el_source", "__el_size"


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int) -> np.ndarray:
    """How many documents of each positive length to take: sum near ``budget`` from below.

    It is near and not always nearest, as even shares bind most documents first;
    less than one document is missing.  ``budget`` is below the sum of all lengths.  An even share of each length
    first, the longest of the others while the rest is large, and dynamic
    programming over what remains.
    """
    size, have = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((size * have).sum())
    if budget <= 0 or not total:
        return np.zeros_like(have)
    if budget >= total:
        return have.copy()
    take = (have * (budget / total)).astype(np.int64)
    rest = budget - int((size * take).sum())
    order = np.argsort(-size, kind="stable")
    for i in order:
        more = min(int(have[i] - take[i]), max(0, rest - DP_BUDGET) // int(size[i]))
        take[i] += more
        rest -= more * int(size[i])
    # items: binary shares of what is left of each length; first[s]: the item that first reached sum s
    first = np.full(rest + 1, -1, np.int32)
    first[0] = 0
    items: list[tuple[int, int]] = [(-1, 0)]
    for i in order:
        spare, k = int(have[i] - take[i]), 1
        while spare > 0 and first[rest] < 0:
            n = min(k, spare)
            w = n * int(size[i])
            if w > rest:
                if n == 1:
                    break
                spare, k = min(spare, rest // int(size[i])), 1
                if spare == 0:
                    break
                continue
            new = (first[:-w] >= 0) & (first[w:] < 0)
            items.append((int(i), n))
            first[w:][new] = len(items) - 1
            spare -= n
            k *= 2
        if first[rest] >= 0:
            break
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, n = items[first[at]]
        take[i] += n
        at -= n * int(size[i])
    return take


def _ordered(totals: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``totals`` with ``w``: weights in turn by the rank of the source's code.

    Codes are cut into ranges; the counts of ranges give the offsets, so ranks need no single task.
    """
    ranges = materialize(totals.repartitionByRange(_CODE).withColumn("__el_range", F.spark_partition_id()), "sources")
    before = Window.orderBy("__el_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("__el_range").agg(F.count(F.lit(1)).alias("__el_n"))  # a row a range
    offsets = counts.withColumn("__el_at", F.coalesce(F.sum("__el_n").over(before), F.lit(0))).drop("__el_n")
    rank = F.row_number().over(Window.partitionBy("__el_range").orderBy(_CODE)) - 1 + F.col("__el_at")
    turn = F.pmod(rank, F.lit(len(weights))).cast("int")
    return ranges.join(F.broadcast(offsets), "__el_range").withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)).drop("__el_range", "__el_at")


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source code, source_size) with ``target``: weights share ``TOTAL_SHARE`` of all.

    No target is above ``MAX_REPEATS`` times its source's size; the excess goes
    to the others by weight, round after round until none is above.  A round is
    one aggregate over the sources.
    """
    t = materialize(_ordered(totals, weights).withColumn("cap", F.col("source_size") * F.lit(MAX_REPEATS)), "weights")
    goal = float(t.agg(F.sum("source_size")).first()[0] or 0) * TOTAL_SHARE
    level, n_full = 0.0, -1
    while True:
        full = F.col("cap") < F.col("w") * F.lit(level)
        row = t.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if row[0] == n_full or not row[2]:
            break
        n_full, level = row[0], (goal - (row[1] or 0.0)) / row[2]
    return t.select(_CODE, "source_size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def mix(df: DataFrame, size: str, source: str, key: str, seed: int = 7, out: Sequence[str] = ("source_size", "target", "times")) -> DataFrame:
    """``df`` with ``out``: the source's size, its target, and how often the mix takes the row.

    Sources are ordered by code point, null last.  Rows of size 0 are taken as
    often as a whole pass; an empty table gives an empty one.  Rows equal in
    ``key`` may swap places; a column of ``out`` that is there already raises an
    error, other columns never matter.  ``df`` is read more than once.
    """
    if clash := set(out) & set(df.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    coded = df.withColumn(_CODE, F.concat(F.when(F.col(source).isNull(), "1").otherwise("0"), F.coalesce(F.col(source), F.lit(""))))
    histogram = materialize(coded.groupBy(_CODE, F.col(size).alias(_SIZE)).agg(F.count(F.lit(1)).alias("n")), "lengths")
    total = histogram.agg(F.sum("n")).first()[0] or 0
    totals = histogram.groupBy(_CODE).agg(F.sum(F.col(_SIZE) * F.col("n")).alias("source_size"))
    targets = source_targets(totals)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, goal = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = int(goal // whole) if whole else 0
        pdf = pdf.sort_values(_SIZE, ignore_index=True)
        some = (pdf[_SIZE] > 0).to_numpy()
        extra = np.zeros(len(pdf), np.int64)
        extra[some] = fit_budget(pdf[_SIZE][some].tolist(), pdf["n"][some].tolist(), int(goal + 1e-6) - passes * whole)
        return pdf.assign(passes=passes, extra=extra)[[_CODE, _SIZE, "source_size", "target", "passes", "extra"]].set_axis(chosen_names, axis=1)

    chosen_names = [_CODE, _SIZE, "__el_whole", "__el_target", "__el_passes", "__el_extra"]
    schema = ", ".join(f"{c} {t}" for c, t in zip(chosen_names, ("string", "long", "long", "double", "int", "long"), strict=True))
    chosen = materialize(histogram.join(targets, _CODE).groupBy(_CODE).applyInPandas(fit, schema), "chosen")
    ranked = exact_rank(
        coded.withColumn(_SIZE, F.col(size).cast("long")),
        [_CODE, _SIZE],
        F.xxhash64(F.col(key), F.lit(seed)),
        [key],
        "__el_rank",
        total,
        key_values=chosen,
    )
    times = F.col("__el_passes") + F.when(F.col("__el_rank") < F.col("__el_extra"), 1).otherwise(0)
    found = (F.col("__el_whole"), F.col("__el_target"), times.cast("int"))
    return ranked.select(*own_columns(df), *[c.alias(n) for c, n in zip(found, out, strict=True)])


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no space, tab or line break; null: 0."""
    found = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(found, F.lit(0)).cast("long")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each, in words, repeats counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "words")
    out = mix(rows, "size", "source", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
