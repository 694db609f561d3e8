r"""Secret scans: patterns, and a randomness test battery with false-discovery control.

Base spans come from three patterns.  The battery adds long unbroken tokens
that look drawn at random, whole and by the segments between ``/``, ``-``, ``_``
and ``+``, as in URL paths and after prefixes.  For each candidate the encoding is inferred, and
its symbols are tested three ways: chi-squared for a uniform alphabet, runs
above and below the middle, and serial correlation.

* A token that fails any of the three (Bonferroni) isn't random.
* Its chi-squared statistic also gives the chance that text, whose letters are
  far from uniform, would look as even: the lower tail of a non-central
  chi-squared distribution, whose non-centrality grows with length.  These
  chances are held by the Benjamini-Hochberg rule within each length class,
  so that of the tokens added, a share of ``FDR`` at most is text.
* Where a token and segments of it pass, those of the least chance are kept and
  no two overlap.

Everything is DataFrame work; per document, spans are found from the lengths
of what ``split`` and ``regexp_extract_all`` return.  The rule's threshold by
length class comes from a histogram of bounded size.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolake.plans.shared import materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
SEGMENT = r"[A-Za-z0-9]{20,}"
_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: name, pattern, alphabet; the first that fits is the encoding
ENCODINGS = (
    ("decimal", r"^[0-9]+$", _DIGITS),
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex upper", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", r"^[a-z]+$", _LOWER),
    ("upper", r"^[A-Z]+$", _UPPER),
    ("base32", r"^[A-Z2-7]+$", _UPPER + "234567"),
    ("letters", r"^[A-Za-z]+$", _UPPER + _LOWER),
    ("alphanumeric", r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64 url", r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("other", r"", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
FDR = 0.05
REJECT = 0.001
#: Sum of squared letter frequencies of running text.
TEXT_COINCIDENCE = 0.065
_BIN = 0.05  # of -log10 p
_BINS = 400
_MAX_CLASS = 24
_CHUNK = 256
_SPAN = "array<struct<start:int,end:int,hit:string,part:string>>"


def find_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that don't overlap: (start, end, hit, part), in code points.

    Places are running sums over gaps and matches, taken in chunks of ``_CHUNK``
    and then over the chunks, so a text of many matches costs no square of them.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        part = x["1"] if group == 0 else F.regexp_extract(x["1"], pattern, group)
        span = F.struct(start.alias("start"), end.alias("end"), x["1"].alias("hit"), part.alias("part"))
        more = F.struct(end.alias("at"), F.array_append(acc["found"], span).cast(_SPAN).alias("found"))
        return F.when(x["1"].isNull(), acc).otherwise(more)

    def spans(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("found")), step, lambda a: a["found"])

    def chunked(z: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _CHUNK).cast("int")), lambda k: F.slice(z, k * _CHUNK + 1, F.lit(_CHUNK)))
        return _let(chunks, lambda c: F.flatten(F.zip_with(c, _offsets(c), spans)))

    found = _let(zipped, lambda z: F.when(F.size(z) <= _CHUNK, spans(z, F.lit(0))).otherwise(chunked(z)))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _offsets(chunks: Column) -> Column:
    """Where each chunk of (gap, hit) begins."""
    long = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x["0"]) + F.coalesce(F.length(x["1"]), F.lit(0))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(long, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_tail(z: Column) -> Column:
    """P(Z > z), within 1e-7 (rational approximation of the error function)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _encoding(token: Column, field: int) -> Column:
    out = F.lit(ENCODINGS[-1][field])
    for e in reversed(ENCODINGS[:-1]):
        out = F.when(token.rlike(e[1]), F.lit(e[field])).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """Struct (chi_squared, p_uniform, p_runs, p_serial, p_random, p_text) of a token."""

    def centred(v: Column) -> Column:
        mean = F.aggregate(v["codes"], F.lit(0.0), lambda s, c: s + c) / F.size(v["codes"])
        return F.struct(v["alphabet"].alias("alphabet"), v["codes"].alias("codes"), mean.alias("mean"))

    def tests(v: Column) -> Column:
        a, x = v["alphabet"], v["codes"]
        size, n = F.length(a).cast("double"), F.size(x).cast("double")
        chi = F.aggregate(
            F.sequence(F.lit(0), F.length(a) - 1), F.lit(0.0),
            lambda acc, k: acc + F.pow(F.size(F.filter(x, lambda c: c == k)).cast("double"), F.lit(2.0)),
            lambda s: s * size / n - n,
        )
        middle = (size - 1) / 2
        mean = v["mean"]  # computed once, not once a symbol
        spread = F.aggregate(x, F.lit(0.0), lambda s, c: s + (c - mean) * (c - mean))
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, w: s + (w["p"] - mean) * (w["q"] - mean))
        high = F.size(F.filter(x, lambda c: c > middle)).cast("double")
        runs = F.size(F.filter(pairs, lambda w: (w["p"] > middle) != (w["q"] > middle))) + F.lit(1.0)
        return F.struct(
            size.alias("size"), n.alias("n"), chi.alias("chi"), high.alias("high"), runs.alias("runs"),
            F.when(spread > 0, serial / spread).otherwise(1.0).alias("r"),
        )

    def chances(v: Column) -> Column:
        df, n, chi = v["size"] - 1, v["n"], v["chi"]
        cube = F.pow(chi / df, F.lit(1 / 3))
        uniform = normal_tail((cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        expected = 2 * v["high"] * (n - v["high"]) / n
        spread = expected * (expected - 1) / (n - 1)
        runs = F.when(spread > 0, 2 * normal_tail(F.abs(v["runs"] - 1 - expected) / F.sqrt(spread))).otherwise(0.0)
        serial = 2 * normal_tail(F.abs(v["r"] + 1 / n) * F.sqrt(n))
        excess = n * F.greatest(v["size"] * TEXT_COINCIDENCE - 1, F.lit(0.5))
        text = 1 - normal_tail((chi - df - excess) / F.sqrt(2 * (df + 2 * excess)))
        return F.struct(
            chi.alias("chi_squared"), uniform.alias("p_uniform"), runs.alias("p_runs"), serial.alias("p_serial"),
            F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial)).alias("p_random"), text.alias("p_text"),
        )

    alphabet = _encoding(token, 2)
    codes = _let(alphabet, lambda a: F.struct(a.alias("alphabet"), F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.position(c, a) - 1).alias("codes")))
    return _let(_let(_let(codes, centred), tests), chances)


def length_class(length: Column) -> Column:
    return F.least(F.floor(F.log2(length.cast("double"))).cast("int"), F.lit(_MAX_CLASS))


def discovery_thresholds(candidates: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """By length class, the largest p_text that the Benjamini-Hochberg rule lets pass.

    ``candidates``: rows (length, p_text).  Chances are binned upwards, so the
    rule is never looser than the exact one.
    """
    place = F.least(F.floor(-F.log10(F.greatest("p_text", F.lit(1e-30))) / _BIN), F.lit(_BINS)).cast("int")
    binned = candidates.groupBy(length_class(F.col("length")).alias("cls"), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("cls").orderBy(F.desc("bin"))
    ranked = binned.withColumn("found", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("cls")))
    edge = F.pow(F.lit(10.0), -F.col("bin") * _BIN)
    passed = ranked.where(edge <= fdr * F.col("found") / F.col("all"))
    return {r["cls"]: r["edge"] for r in passed.groupBy("cls").agg(F.max(edge).alias("edge")).collect()}  # _MAX_CLASS rows


def _last_from(spans: Column, at: Column) -> Column:
    """Number (from 1) of the last of sorted spans that starts at or before ``at``, by halving; 0 if none does."""

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        before = F.get(spans, middle - 1)["start"] <= at
        narrowed = F.struct(F.when(before, middle).otherwise(a["low"]).alias("low"), F.when(before, a["high"]).otherwise(middle).alias("high"))
        return F.when(a["high"] - a["low"] > 1, narrowed).otherwise(a)

    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(spans))))
    start = F.struct(F.lit(0).alias("low"), (F.size(spans) + 1).alias("high"))
    return F.aggregate(rounds, start, halve, lambda a: a["low"])


def _inside(spans: Column, c: Column) -> Column:
    """Whether one of sorted spans that don't overlap covers span ``c``."""
    last = _last_from(spans, c["start"])
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, last - 1)["end"] >= c["end"], F.lit(False))


def tokens(text: Column) -> Column:
    """Array of (start, end, hit) for each unbroken token: the token, then its segments if it isn't one itself."""
    part = lambda s, at: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["hit"].alias("hit"))

    def parts(w: Column) -> Column:
        inner = F.transform(find_spans(w["hit"], SEGMENT), lambda s: part(s, w["start"]))
        return F.concat(F.array(part(w, F.lit(0))), F.filter(inner, lambda s: s["end"] - s["start"] < w["end"] - w["start"]))

    return F.transform(find_spans(text, CANDIDATE), parts)


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, base, spans): arrays of (start, kind number, end), sorted.

    Null texts count as empty.  Rows are scanned each for itself; only the
    thresholds depend on all of them.  Repeated rows get equal spans and each
    counts for the thresholds; spans of one start go by kind, then end; other
    columns are left out whatever their names; an empty table stays empty.  A
    text of n matches costs in proportion to n log n: spans of a kind don't
    overlap, so a span that could cover a token is found by halving, and a
    token's segments are held with it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bases = (("__el_assign", ASSIGN, 2, 6), ("__el_access", ACCESS, 0, 20), ("__el_hex", HEX, 0, 24))

    def base(pattern: str, group: int, least: int) -> Column:
        kept = F.filter(find_spans(text, pattern, group), lambda s: F.length(s["part"]) >= least)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def tested(s: Column) -> Column:
        span = lambda b: F.struct(s["start"].alias("start"), s["end"].alias("end"), b["p_random"].alias("p_random"), b["p_text"].alias("p_text"))
        return _let(battery(s["hit"]), span)

    def unknown(c: Column) -> Column:
        return ~(_inside(F.col("__el_assign"), c) | _inside(F.col("__el_access"), c) | _inside(F.col("__el_hex"), c))

    def of_kind(name: str, kind: int) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    found = docs.select("doc_id", *[base(*how).alias(name) for name, *how in bases], tokens(text).alias("__el_tokens"))
    left = F.filter(F.transform("__el_tokens", lambda t: F.filter(t, unknown)), lambda t: F.size(t) > 0)  # a covered token's segments are covered
    found = materialize(
        found.select(
            "doc_id",
            F.array_sort(F.concat(*[of_kind(name, k) for k, (name, *_) in enumerate(bases)])).alias("base"),
            F.transform(left, lambda t: F.transform(t, tested)).alias("candidates"),
        ),
        "secrets",
    )
    each = found.where(F.size("candidates") > 0).select(F.explode(F.flatten("candidates")).alias("c"))
    thresholds = discovery_thresholds(each.select((F.col("c.end") - F.col("c.start")).alias("length"), F.col("c.p_text").alias("p_text")))
    random = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if thresholds:
        table = F.create_map(*[F.lit(x) for cls, p in sorted(thresholds.items()) for x in (cls, p)])

        def added(c: Column) -> Column:
            limit = F.coalesce(F.try_element_at(table, length_class(c["end"] - c["start"])), F.lit(0.0))
            return (c["p_text"] <= limit) & (c["p_random"] >= REJECT)

        def chosen(t: Column) -> Column:
            """The whole token if it passes and no passing segment is less likely to be text, else its passing segments."""
            whole, segments = F.get(t, F.lit(0)), F.filter(F.slice(t, F.lit(2), F.size(t)), added)
            return F.when(added(whole) & ~F.exists(segments, lambda s: s["p_text"] < whole["p_text"]), F.array(whole)).otherwise(segments)

        random = F.transform(
            F.flatten(F.transform("candidates", chosen)),
            lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
        )
    return found.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
