"""Conversation prefix trie by van Emde Boas recursion (operator 13).

A node is a distinct sequence of first turns; its members are the
conversations that start with it.

1. Every conversation becomes one path of entries, depth 0 (the root) to its
   last turn.  An entry's name is a 128-bit digest chained over the turns, so
   a prefix has one name wherever it occurs.
2. The trie is built by cutting in half.  In the round for span 2 * half the
   paths of all tries of that span, which start at multiples of it, are cut at
   half depth: the upper part stays a path of the upper trie, the lower part
   belongs to the lower forest and its top, the cut prefix, takes along the
   names of the upper part as those above it.  Parts with one name are one
   part: members and the smallest member are summed up.  All upper tries and
   lower forests of a round go through one shuffle, so copies and shared
   beginnings collapse in the first rounds, before they are spread out; after
   log2(depth) rounds every part is one node.
3. Totals are grafted upwards in the same order backwards.  Once the tries of
   span ``half`` are summed up, each cut prefix at an odd multiple of half adds
   the total of its lower trie to the nodes above it in the upper trie: that
   completes the tries of span 2 * half.  Sums are combined before the shuffle.
   A node at depth d adds to as many nodes as the largest power of two that
   divides d: log2(depth) / 2 on average over all depths.
4. The ids of conversations that end in a node are put in order by a range
   sort over (name, id), joined to pieces there, and a node's pieces are
   hashed in order: no group is gathered, however many end in it.

One conversation is one row (20 bytes a turn); its texts are read once.

Defined results: turns are in order of turn (null first; ties by role, then
a hash of the text); null role or text counts as empty; rows with null conv_id belong to no
conversation and are ignored; a conversation without turns is a member of the
root; repeated rows are turns of their own; an empty table has no node; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import map_arrow, saved

ENTRY = "struct<name:binary,points:int>"
PIECE = 1 << 16  # ids in one piece of a node's list


def conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, turns array<struct<sign,points>> in order: a 128-bit digest of role
    and text and the code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sign = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("tie"),
                 sign.alias("sign"), F.char_length(text).alias("points")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["sign"].alias("sign"),
                                                                               t["points"].alias("points"))).alias("turns"))


def with_shared_starts(convs: DataFrame) -> DataFrame:
    """The registered query's conversations: the first h turns come from conversation conv_id - conv_id % 100 (none
    if it is absent), the rest are the own ones after the first h; h = crc32(conv_id) % 6."""
    convs = saved(convs, "conversations")
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    heads = convs.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("t"), F.slice("turns", 1, 5).alias("start"))
    rows = convs.withColumn("t", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h).join(heads, "t", "left")
    none = F.array().cast(dict(convs.dtypes)["turns"])
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), none)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(start, own).alias("turns"))


def _paths(convs: DataFrame) -> DataFrame:
    """conv_id, path: entries of all prefixes, the root first."""
    entries = pa.list_(pa.struct([("name", pa.binary()), ("points", pa.int32())]))

    def chain(batches):
        root = hashlib.md5(b"").digest()
        for b in batches:
            turns = b.column(1)
            signs, points = turns.values.field("sign").to_pylist(), turns.values.field("points").to_numpy()
            names, sizes, at = [], [], [0]
            ends = turns.offsets.to_pylist()
            for lo, hi in zip(ends[:-1], ends[1:]):
                name = root
                names.append(name)
                sizes.append(0)
                for sign in signs[lo:hi]:
                    name = hashlib.md5(name + sign).digest()
                    names.append(name)
                sizes += points[lo:hi].tolist()
                at.append(len(names))
            path = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(names, pa.binary()), pa.array(sizes, pa.int32())], ["name", "points"]))
            yield pa.RecordBatch.from_arrays([b.column(0), path.cast(entries)], ["conv_id", "path"])

    return map_arrow(convs.select("conv_id", "turns"), chain, f"conv_id long, path array<{ENTRY}>")


def _nodes(paths: DataFrame, rounds: int) -> DataFrame:
    """(conv_id, path) -> name, depth, points, above (names from the top of the upper trie down to the parent), conv_id
    (smallest member), n_convs."""
    none = F.array().cast("array<binary>")
    parts = paths.select(F.lit(0).alias("depth"), "path", none.alias("above"), F.col("conv_id").cast("long").alias("conv_id"),
                         F.lit(1).cast("long").alias("n_convs"))
    for k in range(rounds - 1, -1, -1):
        half = 1 << k
        size = F.size("path")
        upper = F.struct(F.col("depth"), F.slice("path", 1, half).alias("path"), F.col("above"))
        names = F.transform(F.slice("path", 1, half), lambda e: e["name"])
        lower = F.struct((F.col("depth") + half).alias("depth"), F.slice("path", F.lit(half + 1), F.greatest(size - half, F.lit(0)))
                         .alias("path"), names.alias("above"))
        cut = F.when(size > half, F.array(upper, lower)).otherwise(F.array(upper))
        parts = (parts.select(F.explode(cut).alias("x"), "conv_id", "n_convs").select("x.*", "conv_id", "n_convs")
                 .groupBy("depth", F.get("path", F.size("path") - 1)["name"].alias("last"))
                 .agg(F.any_value("path").alias("path"), F.any_value("above").alias("above"),
                      F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
                 .select("depth", "path", "above", "conv_id", "n_convs"))
    entry = F.get("path", 0)
    return parts.select(entry["name"].alias("name"), "depth", entry["points"].alias("points"), "above", "conv_id", "n_convs")


def _summed(rows: DataFrame, kept: list[str], sums: list[str]) -> DataFrame:
    """One row a name: ``sums`` added up, the ``kept`` columns as in the row of the node itself (null in all others)."""
    own = F.when(F.col("own"), F.struct(*kept))
    return (rows.groupBy("name").agg(F.any_value(own, F.lit(True)).alias("k"), *[F.sum(c).alias(c) for c in sums])
            .select("name", *[F.col("k")[c].alias(c) for c in kept], *sums))


def _totals(nodes: DataFrame, rounds: int) -> DataFrame:
    """nodes -> name, parent, depth, conv_id, n_convs, n_children, n_leaves, saved."""
    base = ["depth", "points", "above", "conv_id", "n_convs"]
    zero = F.lit(0).cast("long")
    parent = F.element_at("above", -1)
    both = F.when(F.col("depth") > 0, F.array(F.struct(F.col("name").alias("to"), F.lit(True).alias("own"), zero.alias("child")),
                                              F.struct(parent.alias("to"), F.lit(False).alias("own"), F.lit(1).cast("long").alias("child")))
                  ).otherwise(F.array(F.struct(F.col("name").alias("to"), F.lit(True).alias("own"), zero.alias("child"))))
    rows = nodes.select(F.explode(both).alias("x"), *base).select(F.col("x.to").alias("name"), "x.own",
                                                                  F.col("x.child").alias("n_children"), *base)
    rows = _summed(rows, base, ["n_children"])
    rows = rows.select("name", "depth", "above", F.try_element_at("above", F.lit(-1)).alias("parent"), "conv_id", "n_convs",
                       "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    kept, sums = ["depth", "above", "parent", "conv_id", "n_convs", "n_children"], ["n_leaves", "saved"]
    for k in range(rounds):
        half = 1 << k
        to = F.when(F.col("depth").bitwiseAND(2 * half - 1) == half, F.concat(F.array("name"), F.col("above"))) \
            .otherwise(F.array("name"))
        spread = rows.select(F.posexplode(to).alias("i", "to"), *kept, *sums)
        rows = _summed(spread.withColumn("own", F.col("i") == 0).drop("i").withColumnRenamed("to", "name"), kept, sums)
    return rows.drop("above")


def _ends(paths: DataFrame) -> DataFrame:
    """name -> ends_sha256 of the decimal ids of the conversations that end there, ascending, comma-joined."""
    def pieces(batches):
        now, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()),
                                               pa.array([",".join(map(str, ids))], pa.string())], ["name", "first", "ids"])

        for b in batches:
            for name, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (name != now or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                now = name
                ids.append(i)
        if ids:
            yield piece()

    def hashed(batches):
        now, sha = None, None
        out = []
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if name == now:
                    sha.update(b"," + text.encode())
                    continue
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = name, hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["name", "ends_sha256"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["name", "ends_sha256"])

    last = paths.select(F.element_at("path", -1)["name"].alias("name"), "conv_id")
    ranged = last.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    parts = map_arrow(ranged, pieces, "name binary, first long, ids string")
    return map_arrow(parts.repartition("name").sortWithinPartitions("name", "first"), hashed, "name binary, ends_sha256 string")


def build_trie(convs: DataFrame) -> DataFrame:
    """convs(conv_id, turns of conversations()) -> one row a node: name (binary), parent (name), conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (summed over the subtree, (n_convs - 1)
    times the code points of the last text), ends_sha256."""
    paths = saved(_paths(convs), "paths")
    longest = paths.agg(F.max(F.size("path"))).first()[0] or 1
    rounds = (longest - 1).bit_length()
    nodes = saved(_totals(_nodes(paths, rounds), rounds), "nodes")
    # a node with a great share of all children is one of at most 4096: those are broadcast, the others joined by shuffle
    total = nodes.count()
    tops = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                (F.col("n_children") * 4096 > total).alias("wide"))
    wide, few = tops.where("wide").drop("wide"), tops.where("not wide").drop("wide")
    rows = (nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
            .unionByName(nodes.join(F.broadcast(wide), "parent"))
            .unionByName(nodes.join(few, "parent")))
    nothing = hashlib.sha256(b"").hexdigest()
    rows = rows.join(_ends(paths), "name", "left")
    return rows.select("name", "parent", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
                       "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                       F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
