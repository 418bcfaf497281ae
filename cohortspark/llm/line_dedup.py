"""Line dedup by fingerprints of line hashes (operator 3); DataFrame functions only.

A line ends at a line feed or after a sentence mark and a blank.  Each line
has a 64-bit hash (trimmed, lower case) and a number of words.

1. Fingerprints.  The shortest stretch of lines with at least ``min_words``
   words that starts at a line, and the shortest that ends at it, are its
   fingerprints (96-bit hash of the line hashes).  Winnowing would keep only
   the least of several neighbours; that is complete only if a fingerprint is
   compared with every place where it stands, which for frequent lines is all
   pairs.  A fingerprint that holds a whole shortest run needs no comparison
   but with its first place, so all are kept and none is extended.
2. The first place of each fingerprint (least doc_id, then least line) keeps
   its lines, all others lose them.  A maximal stretch that stood before is
   the union of its fingerprints: a line of it lies in the shortest stretch
   from that line on, if that ends within, or else in the shortest stretch
   that ends where it ends.

Fingerprints in more than one of HOT occurrences are broadcast, at most HOT of
them; first places are combined before the shuffle.

Defined results: null and empty text have no lines; blank lines are ignored by
matching; repeated rows count as one text; rows with null doc_id are reported
and never matched; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import let, saved

HOT = 4096
#: One line with what ends it; possessive, so that long lines need no stack.
LINE = r"[^\n.!?]*+(?:[.!?](?!\x20)[^\n.!?]*+)*+(?:[.!?]\x20|\n|$)"


def _pieces(text):
    """The lines of a text, with their ends: joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def lines_of(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, p (line numbers from 0), h (hashes), w (words) of the lines that are not blank."""
    def entry(line, i):
        return let(F.btrim(line, F.lit(" \n\r\t")), lambda t: F.struct(
            i.alias("p"), F.xxhash64(t).alias("h"),
            F.when(t == "", 0).otherwise(F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).alias("w")))

    found = F.filter(F.transform(_pieces(F.lower(F.coalesce("text", F.lit("")))), entry), lambda x: x["w"] > 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("x"))
    return rows.select("doc_id", *[F.col("x").getField(k).alias(k) for k in ("p", "h", "w")])


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, k1, k2 (hash), i, n (lines i to i + n): the shortest stretches of min_words words from and to each line.

    Lines are rows here, ordered by the words before (from) and through (to)
    them: every line has a word, so a stretch is a range of min_words of these
    numbers, and no row carries more than its stretch.
    """
    rows = (lines.where("doc_id is not null").withColumn("u", F.monotonically_increasing_id())  # repeated rows stay apart
            .select("u", "doc_id", F.posexplode(F.arrays_zip("h", "w")).alias("i", "x")).select("u", "doc_id", "i", "x.h", "x.w"))
    text = Window.partitionBy("u")
    rows = rows.withColumn("e", F.sum("w").over(text.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("c", F.col("e") - F.col("w"))
    ahead, behind = text.orderBy("c").rangeBetween(0, min_words - 1), text.orderBy("e").rangeBetween(1 - min_words, 0)
    rows = rows.withColumns({"f": F.collect_list("h").over(ahead), "fs": F.sum("w").over(ahead)})
    rows = rows.withColumns({"b": F.collect_list("h").over(behind), "bs": F.sum("w").over(behind)})
    found = F.array(
        F.when(F.col("fs") >= min_words, F.struct(F.col("i"), F.col("f").alias("part"))),
        # without its last line it must make min_words still, else it is the shortest stretch from its first line too
        F.when(F.col("bs") - F.col("w") >= min_words, F.struct((F.col("i") + 1 - F.size("b")).alias("i"), F.col("b").alias("part"))))
    rows = rows.select("doc_id", F.explode(found).alias("x")).where("x is not null")
    part = F.col("x.part")
    return rows.select("doc_id", F.xxhash64(part).alias("k1"), F.hash(part).alias("k2"), "x.i", F.size(part).alias("n"))


def repeated_runs(lines: DataFrame, min_words: int = 50) -> DataFrame:
    """lines_of() -> doc_id, start, end (places among the lines, end exclusive) that stood before."""
    marks = saved(fingerprints(lines, min_words), "line-marks")
    firsts = marks.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "i")).alias("first"),
                                           F.max(F.struct("doc_id", "i")).alias("last"), F.count(F.lit(1)).alias("c"))
    firsts = saved(firsts.where("first <> last").select("k1", "k2", "first", "c"), "line-firsts")
    total = firsts.agg(F.sum("c")).first()[0] or 0
    hot, rest = firsts.where(F.col("c") * HOT > total), firsts.where(F.col("c") * HOT <= total)
    found = (marks.join(F.broadcast(hot), ["k1", "k2"])
             .unionByName(marks.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti").join(rest, ["k1", "k2"])))
    return found.where(F.struct("doc_id", "i") > F.col("first")).select(
        "doc_id", F.col("i").alias("start"), (F.col("i") + F.col("n")).alias("end"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs(doc_id, text) -> per document: doc_id, n_lines, n_removed, removed_words, removed (line numbers)."""
    lines = saved(lines_of(docs), "lines")
    # stretches are cut where the next one starts, so that a line is listed once
    spans = repeated_runs(lines, min_words).repartition("doc_id").groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    text = Window.partitionBy("doc_id").orderBy("start")
    upto = F.least(F.max("end").over(text.rowsBetween(Window.unboundedPreceding, 0)), F.lead("start").over(text))
    parts = spans.select("doc_id", F.sequence("start", upto - 1).alias("at"))
    gone = parts.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    rows = lines.join(gone, "doc_id", "left")
    at = F.coalesce("at", F.array().cast("array<int>"))
    return rows.select("doc_id", F.size("h").cast("long").alias("n_lines"), F.size(at).cast("long").alias("n_removed"),
                       F.aggregate(at, F.lit(0), lambda a, i: a + F.get("w", i)).cast("long").alias("removed_words"),
                       F.transform(at, lambda i: F.get("p", i)).alias("removed"))


def clean_text(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with the lines listed in dedup_lines()'s ``removed`` cut out of text."""
    gone = removed.where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("removed").alias("__at"))
    kept = F.array_join(F.filter(_pieces(F.col("text")), lambda x, i: ~F.array_contains("__at", i)), "")
    joined = docs.join(gone.dropDuplicates(["__id"]), docs["doc_id"] == F.col("__id"), "left")
    return joined.withColumn("text", F.when(F.col("__at").isNotNull(), kept).otherwise(F.col("text"))).select(*docs.columns)
