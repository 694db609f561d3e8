"""Cutting lineage with tables in the folder that driver and executors share.

``materialize`` writes Parquet under ``spark.checkpoint.dir`` (columnar and
compressed, so far smaller than RDD checkpoint files) and returns a DataFrame
that reads it back.  Lost executors cost nothing: the files are in shared
storage.  The folder is the cluster's; its retention policy removes old runs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local runs that leave it unset, an own folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="echolake-")
    return _own[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/echolake-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """Write all of ``parts``, of one schema and one after the other, and return a reader of them together."""
    path, first = None, None
    for df in parts:
        if path is None:
            path, first = f"{shared_dir(df.sparkSession)}/echolake-{tag}-{uuid.uuid4().hex}", df
        df.write.mode("append").option("compression", "zstd").parquet(path)
    if first is None:
        raise ValueError("nothing to write")
    return first.sparkSession.read.schema(first.schema).parquet(path)
