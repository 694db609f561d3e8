"""URL filters by association rules.

A URL's tokens are every label of its host, every segment of its path, every
query key, and the words that these are made of.  Spark FP-growth mines
combinations that go with bad labels; rules are pruned by support, by
confidence, by lift against the share of bad labels, and where a shorter rule
says the same.  An inverted index holds each rule under its rarest token: a
URL's tokens are looked up there, and only rules found that way are tested
whole.  Explicit host and path rules come first.

Everything is DataFrame work.  Antecedents have ``MAX_ANTECEDENT`` tokens at
most, and all such rules are found whatever a URL's number of tokens: FP-growth
mines bad URLs, of which those of many frequent tokens are dealt to pieces that
hold every combination of that length.  What it finds are candidates, as a
combination may lie in several pieces of a URL; each is counted anew over the
whole token sets of all labelled URLs, and those counts alone decide.
"""

from __future__ import annotations

import json
import string
import zlib
from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.llm.groups import own_columns
from echolake.plans.shared import materialize

#: Tokens of a rule, and of a piece that FP-growth mines; itemsets of a piece grow with two to the power of its tokens.
MAX_ANTECEDENT, MINED_TOKENS = 4, 12
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT = 0.001, 20, 0.5, 1.5
#: The confidence must be above the share of bad labels by so many standard errors.
DEVIATIONS = 2.0
#: An index of up to so many rules is part of the plan; a larger one is joined.
MAX_RULES = 10_000
_SLOTS = 4096
#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _words(text: Column) -> Column:
    """Runs of letters, cut where a capital follows a small letter, of three letters or more, in lower case."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(\p{Ll})(?=\p{Lu})", "$1 "), F.lit(r"(\p{L}{3,})"), F.lit(1)), F.lower)


def _named(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(name + "="), v))


def url_tokens(url: Column) -> Column:
    """The distinct tokens, sorted; none for a null URL or one without a host."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.when(p.rlike(r"^\d+$"), "#").otherwise(p))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "[&;]"), lambda x: F.substring_index(x, "=", 1)), lambda k: k != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})/?$", 1)
    tokens = F.concat(
        F.array(F.concat(F.lit("tld="), F.try_element_at(labels, F.lit(-1))), F.concat(F.lit("domain="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))),
        _named("label", labels),
        _named("segment", segments),
        _named("key", keys),
        _named("ending", F.filter(F.array(ending), lambda e: e != "")),
        _named("word", _words(F.concat_ws(" ", host, path))),
    )
    return F.when(F.size(labels) > 0, F.array_sort(F.array_distinct(F.array_compact(tokens)))).otherwise(F.array().cast("array<string>"))


def _pieces(items: Column, antecedent: int, piece: int) -> Column:
    """Arrays of ``piece`` items at most such that any ``antecedent`` items are together in one."""
    wide = max(1, piece // antecedent)
    groups = F.ceil(F.size(items) / wide).cast("int")

    def choose(first: Column, left: int, got: Column) -> Column:
        if left == 0:
            return F.array(got)
        return F.flatten(F.transform(F.sequence(first, groups - left), lambda k: choose(k + 1, left - 1, F.concat(got, F.slice(items, k * wide + 1, F.lit(wide))))))

    few = F.size(items) <= wide * antecedent
    return F.when(few, F.array(items)).otherwise(choose(F.lit(0), antecedent, F.array().cast("array<string>")))


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_rows: int = MIN_ROWS,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    max_antecedent: int = MAX_ANTECEDENT,
    mined_tokens: int = MINED_TOKENS,
) -> DataFrame:
    """Rules (antecedent sorted, confidence, lift, support) from rows (tokens, bad boolean): all of ``max_antecedent`` tokens at most.

    Support is the share of labelled URLs that hold the antecedent and are bad,
    ``min_rows`` of them at least.  Rows with a null label or without tokens
    tell nothing and are left out; fewer than ``min_rows`` bad ones, or none at all, give no rule.
    Repeated rows count each.  ``mined_tokens`` bounds what is mined at once, not the result.
    """
    known = labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "bad")
    known = materialize(known.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")), "labelled")  # copies are one row
    n, bad = known.agg(F.sum("n"), F.sum("bad")).first()
    none = labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, lift double, support double")
    if (bad or 0) < min_rows:
        return none
    least = max(min_support * n, min_rows)
    counts = known.select(F.explode("tokens").alias("token"), "n", "bad").groupBy("token").agg(F.sum("n").alias("all"), F.sum("bad").alias("hit"))
    # at most as many as an average URL's tokens over the support, whatever the input
    frequent = materialize(counts.where(F.col("hit") >= least), "tokens")
    rows = known.where("bad > 0").select(F.monotonically_increasing_id().alias("row"), "tokens", "bad")
    rows = materialize(rows, "bad")  # fixes the row numbers
    held = rows.select("row", "bad", F.explode("tokens").alias("token")).join(F.broadcast(frequent.select("token")), "token")
    items = held.groupBy("row", "bad").agg(F.array_sort(F.collect_list("token")).alias("items")).where(F.size("items") > 1)  # a URL's own tokens
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("bad")))
    pieces = materialize(items.select("items", copies.alias("copy")).select(F.explode(_pieces(F.col("items"), max_antecedent, mined_tokens)).alias("items")), "items")
    mined, parts = none.select("antecedent"), pieces.count()
    if parts and max_antecedent > 1:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / parts)).fit(pieces)
        mined = model.freqItemsets.where(F.size("items").between(2, max_antecedent)).select(F.array_sort("items").alias("antecedent"))
    several = recounted(materialize(mined, "mined"), known)
    counted = frequent.select(F.array("token").alias("antecedent"), "all", "hit").unionByName(several).where(F.col("hit") >= least)
    rules = counted.withColumn("confidence", F.col("hit") / F.col("all")).withColumn("lift", F.col("confidence") / (bad / n))
    error = F.sqrt(F.lit(bad / n * (1 - bad / n)) / F.col("all"))
    sure = F.col("confidence") - bad / n >= DEVIATIONS * error
    return rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift) & sure).select("antecedent", "confidence", "lift", (F.col("hit") / n).alias("support"))


def recounted(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(antecedent, all, hit): labelled URLs that hold each candidate whole, and the bad ones, from distinct sets (tokens, n, bad)."""
    met = known.select("tokens", "n", "bad", F.explode("tokens").alias("token")).join(inverted_index(candidates, known), "token")
    return met.where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("antecedent").agg(F.sum("n").alias("all"), F.sum("bad").alias("hit"))


def shortest_rules(antecedents: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    """Those that hold no other one."""
    every = {tuple(sorted(a)) for a in antecedents}
    return sorted(a for a in every if not any(c in every for k in range(1, len(a)) for c in combinations(a, k)))


def inverted_index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rules under their rarest token (ties by name): (token, antecedent)."""
    ids = rules.select(F.xxhash64("antecedent").alias("id"), "antecedent")
    used = ids.select("id", F.explode("antecedent").alias("token"))
    counts = labelled.select(F.explode("tokens").alias("token")).join(used.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = used.join(counts, "token").groupBy("id").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return rarest.join(ids, "id").select("token", "antecedent")


def holds_rule(tokens: Column, index: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Whether some rule's antecedent is among ``tokens``; the index is a constant, in slots by the token's checksum."""
    slots: list[list[dict]] = [[] for _ in range(_SLOTS)]
    for token, antecedent in index:
        slots[zlib.crc32(token.encode()) % _SLOTS].append({"token": token, "rule": list(antecedent)})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<token:string,rule:array<string>>>>")

    def found(t: Column) -> Column:
        slot = F.get(table, F.pmod(F.crc32(t.cast("binary")), F.lit(_SLOTS)).cast("int"))
        return F.exists(slot, lambda r: (r["token"] == t) & (F.size(F.array_except(r["rule"], tokens)) == 0))

    return F.exists(tokens, found)


def match_rules(token_sets: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``token_sets`` (distinct ``tokens``) that hold some rule's antecedent."""
    looked = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    hit = looked.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hit.select("tokens").distinct()


def explicit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], field: int | None = None) -> Column:
    """The longest rule that fits, as host and path, or its field; null if none."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
        out = F.when(fits, F.lit(r[1] + r[2] if field is None else r[field])).otherwise(out)
    return out


def judge_urls(pages: DataFrame, labels: DataFrame, url: str, page: str, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    ``labels``: rows (``page``, bad boolean).  A URL that no rule fits is
    blocked where a mined rule holds, else allowed; so are null URLs.  Repeated
    pages stay as they are; each of a page's labels counts in mining.  Empty
    tables mine nothing, and URLs of any length are read whole.
    """
    if clash := {"host", "path", "rule", "verdict"} & set(pages.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    rows = pages.withColumn("__el_tokens", url_tokens(F.col(url)))
    known = rows.select(F.col(page).alias("__el_page"), F.col("__el_tokens").alias("tokens"))
    labelled = known.join(labels.select(F.col(page).alias("__el_page"), "bad"), "__el_page").select("tokens", "bad")
    mined = materialize(mine_rules(labelled), "rules")
    n_rules = mined.count()
    blocked = F.lit(False)
    if 0 < n_rules <= MAX_RULES:
        short = [(list(r),) for r in shortest_rules([r[0] for r in mined.select("antecedent").collect()])]  # MAX_RULES rows
        index = inverted_index(rows.sparkSession.createDataFrame(short, "antecedent array<string>"), labelled).collect()
        blocked = holds_rule(F.col("__el_tokens"), [(r["token"], r["antecedent"]) for r in index])
    elif n_rules:
        sets = known.select("tokens").where(F.size("tokens") > 0).distinct()
        hits = match_rules(sets, inverted_index(mined.select("antecedent"), labelled)).select(F.col("tokens").alias("__el_set"), F.lit(True).alias("__el_hit"))
        rows = rows.join(hits, F.col("__el_tokens") == F.col("__el_set"), "left")
        blocked = F.coalesce(F.col("__el_hit"), F.lit(False))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    return rows.select(
        *own_columns(pages),
        host.alias("host"),
        path.alias("path"),
        explicit_rule(host, path, rules).alias("rule"),
        F.coalesce(explicit_rule(host, path, rules, 0), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; a page is bad if the label of the same number says poor or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(pages, bad, "url", "page_id").select("page_id", "host", "path", "rule", "verdict")
