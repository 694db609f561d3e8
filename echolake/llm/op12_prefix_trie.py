"""Prefix trie of conversations: nodes are the distinct sequences of first turns.

A node is known by its depth and a digest of its turns; its owner is the
smallest conversation that starts with it.  Owners never fall along a path, so
a conversation owns the nodes from some depth to its end: its chain.

* prefix digests are running sums of position-mixed turn hashes,
* their minima by (depth, digest) give owners and members,
* each conversation's first owned depth is found by binary search: a round asks
  one depth of every conversation and joins the answers,
* chains form a tree by the node above their first one; totals go up that tree
  with pointers that double in length, so a tree of height h takes log h rounds,
* within a chain they are running sums from its end.

Running sums are cut into ranges, so one conversation of any length is many
tasks' work.  No group is collected: the ids that end at a node are hashed in
order from chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolake.plans.shared import materialize

#: Ids of one chunk of text on the way to a node's hash.
IDS_PER_CHUNK = 4096
#: Rounds of the search between two written tables.
ROUNDS_PER_TABLE = 4
#: Fixed values of the rebuilding.
FAMILY, MOST_SHARED = 100, 5

_RANGE = "__el_range"


def cut_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df``, written, with the number of its range of keys and order."""
    return materialize(df.repartitionByRange(*keys, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")


def running(cut: DataFrame, keys: list[str], order: list[str], amounts: dict[str, str], xor: bool = False) -> DataFrame:
    """``cut`` with a running sum (or exclusive or) of each amount within its keys, this row included.

    Only keys that lie in several ranges need what came before: at most two a
    range, so these rows are broadcast.
    """
    total = F.bit_xor if xor else F.sum
    sums = cut.groupBy(*keys, _RANGE).agg(*[total(a).alias(f"__el_{o}") for o, a in amounts.items()])
    spread = Window.partitionBy(*keys)
    before = spread.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__el_n", F.count(F.lit(1)).over(spread)).where("__el_n > 1")
    carried = sums.select(*keys, _RANGE, *[total(f"__el_{o}").over(before).alias(f"__el_{o}") for o in amounts])
    here = Window.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.select("*", *[total(a).over(here).alias(o) for o, a in amounts.items()]).join(F.broadcast(carried), [*keys, _RANGE], "left")
    add = lambda o: F.col(o).bitwiseXOR(F.coalesce(F.col(f"__el_{o}"), F.lit(0).cast("long"))) if xor else F.col(o) + F.coalesce(F.col(f"__el_{o}"), F.lit(0))
    return rows.select(*cut.columns, *[add(o).alias(o) for o in amounts])


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % (MOST_SHARED + 1)


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv) and rows (conv, depth, digest, chars, range) of the rebuilt conversations."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    order = ["turn", "digest"]
    ranked = running(cut_ranges(rows.withColumn("one", F.lit(1)), ["conv"], order), ["conv"], order, {"rank": "one"}).select("conv", "rank", "digest", "chars")
    convs = materialize(ranked.where("rank = 1").select("conv").withColumns({"base": F.col("conv") - F.col("conv") % FAMILY, "h": shared_turns(F.col("conv"))}), "conversations")
    heads = ranked.where(F.col("rank") <= MOST_SHARED).select(F.col("conv").alias("base"), "rank", "digest", "chars")
    first = convs.join(heads, "base").where("rank <= h").select("conv", F.lit(0).alias("part"), "rank", "digest", "chars")
    own = ranked.where(F.col("rank") > shared_turns(F.col("conv"))).select("conv", F.lit(1).alias("part"), "rank", "digest", "chars")
    cut = cut_ranges(first.unionByName(own).withColumn("one", F.lit(1)), ["conv"], ["part", "rank"])
    return convs.select("conv"), running(cut, ["conv"], ["part", "rank"], {"depth": "one"})


def prefix_digests(turns: DataFrame) -> DataFrame:
    """Rows (conv, depth, p1, p2, chars): 128 bits that tell the first ``depth`` turns apart."""
    mixed = turns.withColumns({"x1": F.xxhash64("depth", "digest"), "x2": F.xxhash64("digest", F.lit(1), "depth")})
    return running(mixed, ["conv"], ["part", "rank"], {"p1": "x1", "p2": "x2"}, xor=True).select("conv", "depth", "p1", "p2", "chars")


def first_owned(lengths: DataFrame, prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv, last, first): the least depth from 1 whose node the conversation owns; last + 1 if there is none."""
    longest = lengths.agg(F.max("last")).first()[0] or 0
    state = lengths.select("conv", "last", F.lit(1).cast("long").alias("lo"), (F.col("last") + 1).alias("hi"))
    for k in range(int(longest).bit_length()):
        asked = state.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2))
        known = asked.join(prefixes.select("conv", "depth", "p1", "p2"), ["conv", "depth"], "left").join(minima.select("depth", "p1", "p2", "owner"), ["depth", "p1", "p2"], "left")
        open_, mine = F.col("lo") < F.col("hi"), F.col("owner") == F.col("conv")
        state = known.select("conv", "last", F.when(open_ & ~mine, F.col("depth") + 1).otherwise(F.col("lo")).alias("lo"), F.when(open_ & mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        if k % ROUNDS_PER_TABLE == ROUNDS_PER_TABLE - 1:
            state = materialize(state, "search")
    return state.select("conv", "last", F.col("lo").alias("first"))


def chain_totals(chains: DataFrame, amounts: list[str]) -> DataFrame:
    """Sums of the amounts over each chain and all chains below it; ``up`` is the chain above, null at the root.

    Round k adds what the descendants 2^k chains below have gathered.
    """
    now = materialize(chains, "chains")
    while now.where("up IS NOT NULL").limit(1).count():
        gain = now.where("up IS NOT NULL").groupBy(F.col("up").alias("conv")).agg(*[F.sum(a).alias(f"__el_{a}") for a in amounts])
        jump = now.select(F.col("conv").alias("up"), F.col("up").alias("__el_up"))
        added = now.join(gain, "conv", "left").join(jump, "up", "left")
        now = materialize(added.select("conv", F.col("__el_up").alias("up"), *[(F.col(a) + F.coalesce(F.col(f"__el_{a}"), F.lit(0))).alias(a) for a in amounts]), "chains")
    return now.select("conv", *amounts)


def ids_sha256(rows: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of rows (conv, depth, id): the hash of the ids in order, comma-joined."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, depth, i in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out and out[-1][:2] == (conv, depth) and len(out[-1][3]) < IDS_PER_CHUNK:
                    out[-1][3].append(str(i))
                else:
                    out.append((conv, depth, i, [str(i)]))
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in out], pa.int64()) for k in range(3)], pa.array([",".join(r[3]) for r in out], pa.string())], names=["conv", "depth", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            out = []
            for conv, depth, _, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key == (conv, depth):
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield _hashed(out)
        if key is not None:
            yield _hashed([(*key, digest.hexdigest())])

    order = ["conv", "depth", "id"]
    joined = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "conv long, depth long, first long, ids string")
    return joined.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first").mapInArrow(hashes, "conv long, depth long, ends_sha256 string")


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv": pa.int64(), "depth": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns of one conversation go by turn, nulls first, and ties by the MD5 of
    role and text; repeated rows are turns like others.  Null roles and texts
    are empty; rows without a conv_id belong to no conversation.  No
    conversations give no nodes.  Other columns are not read.
    """
    convs, turns = rebuilt_turns(conversations)
    prefixes = materialize(prefix_digests(turns), "prefixes")
    minima = materialize(prefixes.groupBy("depth", "p1", "p2").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars")), "minima")
    root, members = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    lasts = prefixes.groupBy("conv").agg(F.max("depth").alias("last"))
    lengths = convs.join(lasts, "conv", "left").select("conv", F.coalesce("last", F.lit(0)).cast("long").alias("last"))
    found = first_owned(lengths, prefixes, minima)
    # the node above the first owned one, or the one where a conversation without own nodes ends
    above = found.join(prefixes.select("conv", (F.col("depth") + 1).alias("first"), "p1", "p2"), ["conv", "first"], "left")
    above = above.join(minima.select((F.col("depth") + 1).alias("first"), "p1", "p2", F.col("owner").alias("up")), ["first", "p1", "p2"], "left")
    found = materialize(above.select("conv", "last", "first", F.coalesce("up", F.lit(root)).cast("long").alias("up")), "owned")

    is_root = F.col("conv") == F.lit(root)
    chains = found.where((F.col("first") <= F.col("last")) | is_root).withColumn("up", F.when(~is_root, F.col("up")))
    places = chains.where("up IS NOT NULL").groupBy(F.col("up").alias("conv"), (F.col("first") - 1).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    saved = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    nodes = minima.select(F.col("owner").alias("conv"), "depth", "n_convs", saved.alias("saved"))
    top = convs.sparkSession.range(1 if members else 0).select(F.lit(root).cast("long").alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(members).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved"))
    nodes = nodes.unionByName(top)
    own = chains.join(places, ["conv", "last"], "left").join(nodes.groupBy("conv").agg(F.sum("saved").alias("saved")), "conv")
    own = materialize(own.select("conv", "first", "last", "up", F.when(F.col("n").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved"), "chains")
    below = own.where("up IS NOT NULL").select("conv", "first", F.col("up").alias("at")).join(chain_totals(own.select("conv", "up", "leaves", "saved"), ["leaves", "saved"]), "conv")

    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")

    def part(df: DataFrame, conv: str, depth: Column, **columns: Column) -> DataFrame:
        empty = {"n_convs": none, "parent": none, "children": zero, "leaves": zero, "saved": zero}
        return df.select(F.col(conv).alias("conv"), depth.alias("depth"), *[columns.get(c, e).alias(c) for c, e in empty.items()])

    parts = [
        part(nodes, "conv", F.col("depth"), n_convs=F.col("n_convs"), saved=F.col("saved")),
        part(nodes, "conv", F.col("depth") - 1, children=zero + 1),  # the next node of the chain
        part(below, "at", F.col("first") - 1, children=zero + 1, leaves=F.col("leaves"), saved=F.col("saved")),
        part(own, "conv", F.col("last"), leaves=F.col("leaves")),
        part(own.where("up IS NOT NULL"), "conv", F.col("first"), parent=F.col("up")),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    sums = union.groupBy("conv", "depth").agg(F.max("n_convs").alias("n_convs"), F.max("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    sums = sums.where("n_convs IS NOT NULL").withColumn("rise", -F.col("depth"))
    summed = running(cut_ranges(sums, ["conv"], ["rise"]), ["conv"], ["rise"], {"n_leaves": "leaves", "saved_tokens": "saved"})
    mine = F.col("first") <= F.col("last")
    ends = ids_sha256(found.select(F.when(mine, F.col("conv")).otherwise(F.col("up")).alias("conv"), F.col("last").alias("depth"), F.col("conv").alias("id")))
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv"))
    return summed.join(ends, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii({0}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"
_BODY = "length(role) || ':' || role || text"
ORACLE_SQL = f"""WITH v AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5({_BODY})) AS r FROM v),
i AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM v), k AS (SELECT c, c - c % 100 AS base, {_CRC.format("s")} % 6 AS h FROM i),
b AS (SELECT k.c, 0 AS part, r, role, text FROM k JOIN t ON t.c = k.base WHERE r <= h UNION ALL SELECT k.c, 1, r, role, text FROM k JOIN t ON t.c = k.c WHERE r > h),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, r) AS depth FROM b),
p AS (SELECT c, depth, length(text) AS chars, md5(string_agg(md5({_BODY}), '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS p FROM o
  UNION ALL SELECT c, 0, 0, '' FROM k),
q AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY c) AS ends FROM p),
n AS (SELECT p, depth, min(c) AS owner, count(*) AS n_convs, max(above) AS above, (count(*) - 1) * min(chars) AS saved, string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ids FROM q GROUP BY p, depth),
m AS (SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.above = n.p AND x.depth = n.depth + 1) AS n_children FROM n),
u AS (SELECT q.p, q.depth, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(m.saved) AS saved_tokens FROM m JOIN q ON q.c = m.owner AND q.depth <= m.depth GROUP BY q.p, q.depth)
SELECT m.owner AS conv_id, CAST(m.depth AS BIGINT) AS depth, a.owner AS parent_conv_id, m.n_convs, m.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ids, '')) AS ends_sha256
FROM m JOIN u ON u.p = m.p AND u.depth = m.depth LEFT JOIN n AS a ON a.p = m.above AND a.depth = m.depth - 1"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
