"""Fill-in-middle: texts cut at unit ordinals by relational operations.

A unit is a match of a pattern, a code point by default.  ``with_offsets``
turns ordinals of units into character offsets:

* the matches of every text are exploded with their positions; one match takes
  up to ``run`` adjacent units, so an ordinal also tells the match it lies in,
* a window sums the lengths of the matches before each one,
* the cut requests, a row each, join the matches by ordinal,
* the offsets are aggregated by document and the text is cut by substring.

Only lengths, and the few matches that a cut falls into, leave the scan; the
text itself moves once, compressed, to meet its offsets.  Rows are known by the hashes of
text and cuts, so a lost task finds the same keys again.
"""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


CODE_POINT = "(?s:.)"
#: Words with the white space before them, and the white space at the end.
WORD = r"(?:\s*\S+|\s+)"
#: Units of one exploded match.
UNITS_PER_RUN = 128
#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

_KEY = ["__el_k1", "__el_k2"]


@F.pandas_udf(BinaryType())
def _packed(s: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=1)
    return s.map(lambda x: pack.compress(x.encode()), na_action="ignore")


@F.pandas_udf(StringType())
def _unpacked(s: pd.Series) -> pd.Series:
    pack = zstandard.ZstdDecompressor()
    return s.map(lambda x: pack.decompress(x).decode(), na_action="ignore")


def with_offsets(docs: DataFrame, text: str, cuts: str, out: str, unit: str = CODE_POINT, run: int = UNITS_PER_RUN) -> DataFrame:
    """``docs`` with ``out``: for each ordinal of the array ``cuts`` the number of characters of so many first units.

    ``unit`` must match at every place of a text, so that matches abut.  An
    ordinal beyond the last unit gives the length of the text, one below 1 gives
    0; null or empty texts have no units.  Null cuts give an empty array.
    Repeated rows, ties of cuts and other columns of any name are fine; an empty
    table gives an empty one; a long text is many rows of one window.
    """
    wanted = F.coalesce(F.col(f"`{cuts}`"), F.array().cast("array<long>"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.withColumn("__el_cuts", wanted).withColumns({"__el_k1": F.xxhash64(whole, "__el_cuts"), "__el_k2": F.xxhash64("__el_cuts", F.lit(1), whole)})
    asked = keyed.where(F.size("__el_cuts") > 0).select(*_KEY, whole.alias("__el_text"), "__el_cuts")
    place = lambda o: F.floor((F.greatest(o, F.lit(1)) - 1) / run).cast("int")
    runs = asked.withColumn("row", F.monotonically_increasing_id())  # tells equal rows apart, no more
    runs = runs.select(*_KEY, "row", F.transform("__el_cuts", place).alias("hit"), F.posexplode(F.regexp_extract_all("__el_text", F.lit(f"(?:{unit}){{1,{run}}}"), F.lit(0))).alias("run", "piece"))
    # a match that no cut falls into is its length
    runs = runs.select(*_KEY, "row", "run", F.char_length("piece").alias("chars"), F.when(F.array_contains("hit", F.col("run")), F.col("piece")).alias("piece"))
    before = Window.partitionBy("__el_k1", "row").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("begin", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(F.col("piece").isNotNull()).select(*_KEY, "run", "begin", "piece").distinct()
    requests = asked.select(*_KEY, F.posexplode("__el_cuts").alias("turn", "ordinal")).distinct().withColumn("run", place(F.col("ordinal")))
    rest = F.greatest(F.col("ordinal") - F.col("run") * run, F.lit(0)).cast("int")
    inside = F.aggregate(F.slice(F.regexp_extract_all("piece", F.lit(unit), F.lit(0)), F.lit(1), rest), F.lit(0), lambda n, u: n + F.char_length(u))
    found = requests.join(runs, [*_KEY, "run"], "left")
    offset = F.when(F.col("ordinal") < 1, F.lit(0)).otherwise(F.col("begin") + inside).cast("long")
    offsets = found.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("turn", offset.alias("offset")))).alias("__el_found"))  # a few a document
    kept = keyed.select(*[_packed(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *_KEY, F.char_length(whole).cast("long").alias("__el_whole"))
    joined = kept.join(offsets, _KEY, "left")
    filled = F.transform(F.coalesce(F.col("__el_found.offset"), F.array().cast("array<long>")), lambda o: F.coalesce(o, F.col("__el_whole")))
    return joined.select(*[_unpacked(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], filled.alias(out))


def draws(doc_id: Column) -> list[Column]:
    """Four unsigned integers of 32 bits from an id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = CODE_POINT) -> DataFrame:
    """``docs`` with __el_form (plain, psm or spm), __el_offsets (of the two cuts) and __el_output.

    A text that is empty or holds one of the marks stays plain, as do those
    that the id draws.  Cuts are drawn over the units of the text.  Null texts
    are empty; repeated rows give repeated results; an empty table stays empty.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"`{doc_id}`"))
    n = (F.char_length(t) if unit == CODE_POINT else F.size(F.regexp_extract_all(t, F.lit(unit), F.lit(0)))).cast("long")
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = F.when((n == 0) | marked | (h3 % 100 >= PLAIN_FROM), "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")
    cuts = F.when(F.col("__el_form") != "plain", F.array(F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))))
    found = with_offsets(docs.withColumn("__el_form", form).withColumn("__el_asked", cuts), text, "__el_asked", "__el_offsets", unit).drop("__el_asked")
    a, b = (F.get("__el_offsets", F.lit(k)).cast("int") for k in (0, 1))
    prefix, middle, suffix = F.substr(t, F.lit(1), a), F.substr(t, a + 1, b - a), F.substr(t, b + 1)
    mark = F.lit
    psm = F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    spm = F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    return found.withColumn("__el_output", F.when(F.col("__el_form") == "psm", psm).when(F.col("__el_form") == "spm", spm).otherwise(t))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: marks can stand only where they were put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill-in-middle form of every whole text, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    a, b = (F.get("__el_offsets", F.lit(k)) for k in (0, 1))
    return made.select(
        "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.col("__el_form").alias("form"), a.alias("prefix_chars"), (b - a).alias("middle_chars"),
        F.sha2("__el_output", 256).alias("output_sha256"), F.sha2(restored(F.col("__el_output"), F.col("__el_form")), 256).alias("restored_sha256"),
    )
