"""Exact dedup by deterministic block naming (operator 7); DataFrame functions only.

A text (A-Z lower-cased) is cut into blocks of ``block_chars`` characters.
Distinct blocks are sorted and their places in that order are their integer
names, so equal names mean equal blocks.  Then adjacent names are paired and
the distinct pairs sorted into new integers, level by level, until each text
is one integer: its identity together with its number of blocks.  No hash
decides: 64-bit fingerprints of whole texts are used only to set aside texts
that cannot have an equal (a fingerprint that occurs once); naming runs on the
rest.

A text shared by a third of all rows stays harmless: counts and names are
map-side combined aggregates, and the joins on block, pair and identity have
both sides shuffled for the join alone, so that AQE splits their hot keys.

Defined results: null counts as empty; of equal texts the row with the
largest doc_id stays (null doc_id counts as smallest); repeated rows with one
doc_id and one text share the answer, also if it is kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import lower_az, saved


def _named(values: DataFrame, key: list[str], tag: str) -> DataFrame:
    """Distinct ``key`` -> integer ``name``: its place in the order (hash, key).

    Sorting by the hash first keeps long blocks out of the range partitioner's
    sample (only hashes reach the driver); equal hashes are told apart by the
    key itself.  Written once so that names cannot change.
    """
    ordered = (values.select(*key).distinct().withColumn("h", F.xxhash64(*key))
               .repartitionByRange("h").sortWithinPartitions("h", *key))
    return saved(ordered.select(*key, F.monotonically_increasing_id().alias("name")), f"names-{tag}")


def identities(docs: DataFrame, block_chars: int = 32768) -> DataFrame:
    """(rid, text) -> (rid, n_blocks, name): equal (n_blocks, name) if and only if equal texts."""
    blocks = docs.select("rid", F.posexplode(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))).alias("i", "block"))
    blocks = saved(blocks, "blocks")  # read twice below; written once instead of cutting and shuffling twice
    names = _named(blocks, ["block"], "blocks")
    level = saved(blocks.join(names, "block").select("rid", "i", "name"), "level")
    sizes = level.groupBy("rid").agg((F.max("i") + 1).alias("n_blocks"))
    most = sizes.agg(F.max("n_blocks")).first()[0] or 0
    while most > 1:
        half = (level.groupBy("rid", F.floor(F.col("i") / 2).cast("int").alias("i"))
                .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                     F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")))
        half = saved(half, "pairs")
        level = saved(half.join(_named(half, ["a", "b"], "pairs"), ["a", "b"]).select("rid", "i", "name"), "level")
        most = (most + 1) // 2
    return level.join(sizes, "rid").select("rid", "n_blocks", "name")


def exact_groups(docs: DataFrame, block_chars: int = 32768) -> DataFrame:
    """docs(doc_id, text) -> one row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_az(F.coalesce("text", F.lit(""))).alias("text"))
    rows = norm.select("doc_id", F.xxhash64("text").alias("fp"), F.char_length("text").alias("n"),
                       F.sha2("text", 256).alias("text_sha256"))
    rows = saved(rows, "fingerprints")
    shared = rows.groupBy("fp", "n").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fp", "n")
    # one text per (doc_id, fingerprint) is enough for naming: repeated rows share it
    several = norm.withColumn("fp", F.xxhash64("text")).withColumn("n", F.char_length("text")) \
        .join(shared, ["fp", "n"], "left_semi") \
        .select(F.struct("doc_id", "fp", "n").alias("rid"), "text")
    named = identities(several, block_chars)
    named = saved(named.distinct().select("rid.*", "n_blocks", "name"), "identities")
    keyed = rows.join(named.withColumn("hit", F.lit(True)),
                      rows["doc_id"].eqNullSafe(named["doc_id"]) & (rows["fp"] == named["fp"]) & (rows["n"] == named["n"]),
                      "left").select(rows["doc_id"], rows["text_sha256"], "n_blocks", "name", "hit")
    keyed = saved(keyed, "keyed")
    groups = keyed.where("hit").groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"),
                                                               F.count(F.lit(1)).alias("group_size"))
    copies = keyed.where("hit").join(groups, ["n_blocks", "name"])
    alone = keyed.where("hit is null").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"),
                                              F.lit(1).cast("long").alias("group_size"))
    out = copies.select("doc_id", "text_sha256", "keep_id", "group_size").unionByName(alone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")
