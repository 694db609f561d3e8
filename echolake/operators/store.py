"""State store: history, current state, retention and monitoring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.plans.ranking import with_running_total

MAX_ENTITIES = 32
ROW_BUDGET = 100_000


def between(df: DataFrame, time: str, start: str | None, end: str | None) -> DataFrame:
    """Rows of the closed range; a null bound is open."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return df


def history(df: DataFrame, entity: str, entities: Sequence, time: str, start: str | None, end: str | None) -> DataFrame:
    """State changes of up to ``MAX_ENTITIES`` named entities in a closed range."""
    if len(entities) > MAX_ENTITIES:
        raise ValueError(f"{len(entities)} entities; at most {MAX_ENTITIES} may be named")
    return between(df.where(F.col(entity).isin(list(entities))), time, start, end)


def significant(df: DataFrame, entity: str, state: str, order: Sequence[str]) -> DataFrame:
    """Rows whose state differs from the entity's row before; the first always."""
    before = F.lag(state).over(Window.partitionBy(entity).orderBy(*order))
    return df.withColumn("__el_before", before).where(F.col("__el_before").isNull() | (F.col(state) != F.col("__el_before"))).drop("__el_before")


def row_budget(df: DataFrame, entity: str, order: Sequence[str], budget: int = ROW_BUDGET) -> DataFrame:
    """The first ``budget`` rows, entity by entity.

    Only the counts by entity meet in one window; rows are ranked within theirs.
    """
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__el_n"))
    before = F.sum("__el_n").over(Window.orderBy(entity).rowsBetween(Window.unboundedPreceding, -1))
    room = counts.select(entity, (F.lit(budget) - F.coalesce(before, F.lit(0))).alias("__el_room")).where("__el_room > 0")
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    return df.join(room, entity).withColumn("__el_rank", rank).where("__el_rank <= __el_room").drop("__el_rank", "__el_room")


def latest(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last row of each entity, by partial aggregation."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(entity).agg(newest.alias("__el_row")).select(entity, "__el_row.*")


def upsert_events(df: DataFrame, entity: str, state: str, attributes: str, order: Sequence[str]) -> DataFrame:
    """Rows that change state or attributes, with ``state_changed``; the rest are no events."""
    w = Window.partitionBy(entity).orderBy(*order)
    same_state = F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1)
    same_attributes = F.lag(attributes).over(w).eqNullSafe(F.col(attributes))
    marked = df.withColumn("state_changed", ~same_state).withColumn("__el_same", same_state & same_attributes)
    return marked.where(~F.col("__el_same")).drop("__el_same")


def dedup_attributes(df: DataFrame, attributes: str) -> tuple[DataFrame, DataFrame]:
    """(rows with attributes_id, the distinct attributes): the normal form of a log."""
    keyed = df.withColumn("attributes_id", F.md5(F.col(attributes)))
    return keyed.drop(attributes), keyed.select("attributes_id", attributes).distinct()


def retention(df: DataFrame, time: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row with how many are older than the cutoff)."""
    old = F.col(time) < F.lit(cutoff).cast("timestamp")
    return df.where(~old), df.agg(F.count_if(old).alias("deleted"))


def without_matches(df: DataFrame, others: Sequence[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows of ``df`` whose key is in none of ``others``: anti joins, so nulls there hide nothing."""
    for other, column in others:
        df = df.join(other.select(F.col(column).alias(key)), key, "left_anti")
    return df


def counts_by_table(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _at_places(df: DataFrame, keys: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """By key, the values at places (from 0, made of ``n``): values are counted, and the counts summed up range by range."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__el_c"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    upto = with_running_total(counts, keys, value, "__el_c", "__el_upto").join(F.broadcast(sizes), list(keys))
    hits = [F.max(F.when((p < F.col("__el_upto")) & (p >= F.col("__el_upto") - F.col("__el_c")), F.col(value))).alias(name) for name, p in places.items()]
    return upto.groupBy(*keys).agg(*hits)


def floor_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Percentiles at ``sorted[int(n * p)]`` of the non-null values, with count, sum, least, most and mean."""
    some = df.where(F.col(value).isNotNull())
    places = {f"p{round(100 * p)}": F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1) for p in shares}
    whole = some.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return whole.join(_at_places(some, keys, value, places), list(keys))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Percentiles at rank ceil(p n) of the finite values."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    return _at_places(finite, keys, value, {f"p{round(100 * p)}": F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)) - 1 for p in shares})


def time_bins(df: DataFrame, keys: Sequence[str], seconds: str, width: int) -> DataFrame:
    """``df`` with ``bin``, the start of its bin of ``width`` seconds since the epoch."""
    if not 60 <= width <= 3600:
        raise ValueError("bins are of 60 to 3600 seconds")
    return df.withColumn("bin", (F.floor(F.col(seconds) / width) * width).cast("long"))
