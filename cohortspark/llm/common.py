"""Helpers shared by the text operators: scratch tables, input columns, Arrow batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cohortspark.session import checkpoint_dir, ship_package

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table; Python workers get the package first."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet folder under the shared checkpoint
    folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_az(text):
    """Lower-case A-Z only.  Pure ASCII text takes the plain ``lower``, which
    is the same function there and several times faster."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER)))


def by_text_chars(batches: Iterator[pa.RecordBatch], max_chars: int, max_rows: int = 4096,
                  text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that one slice holds at most ``max_chars`` bytes
    of text, or a single row: bounds the memory of the numpy work behind it."""
    import numpy as np
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(b.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < b.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = int(np.searchsorted(ends, base + max_chars, side="right"))
            hi = min(max(hi, lo + 1), lo + max_rows, b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


#: of a batch to and from a worker; the executor holds one up to four times (column and stream buffers, doubled as they grow)
ARROW_BYTES = 4 << 20
#: bytes of text that numpy works on at once, some 50 to 100 bytes of memory each; with their separators less than
#: the 1 << 18 powers that the hashes of words keep
BATCH_CHARS = 250_000
#: operator -> what drops the models and memos it keeps between the tasks of one worker
RELEASE: dict[str, Callable[[], None]] = {}


def map_arrow(df: DataFrame, fn: Callable, schema: str, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers and memory kept
    small: batches of at most ARROW_BYTES, and what a finished task has freed
    goes back to the system, as Spark keeps the worker for later tasks; a
    worker that turns to another operator drops the models of the one before
    (all in RELEASE but ``keeps``)."""
    spark = df.sparkSession
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))

    def task(batches):
        from cohortspark.llm import common  # the worker's own module, not what was shipped with the task
        for name, drop in common.RELEASE.items():
            if name != keeps:
                drop()
        common.trim()
        try:
            yield from fn(batches)
        finally:
            common.give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def trim() -> None:
    import ctypes
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU libc
    if malloc_trim:
        malloc_trim(0)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of (src long, dst long) edges.

    Returns (node, label) for every node that has an edge to another node;
    label is the smallest node of its component.  Alternates the two star
    operations (neighbours hook to the smallest neighbour), so that chains
    shrink geometrically; each round is cut by a written table and checked
    for a fixed point by one aggregate.  A hub is the smaller end of its
    edges, so grouping by the larger end never gathers a hub's neighbours:
    the minimum per node is a map-side combined aggregate and the hooks are a
    join on the node.
    """
    cur = saved(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
                .distinct(), name)

    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(cur)
    while before[0]:
        # large star: every larger neighbour hooks to the smallest node next to u (or u itself)
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = saved(large, name)
        # small star: u and its smaller neighbours hook to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooks = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        cur = saved(hooks, name)
        after = state(cur)
        if after == before:
            break
        before = after
    label = cur.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return label.union(roots).groupBy("node").agg(F.min("label").alias("label"))


__all__ = ["read_documents", "saved", "lower_az", "by_text_chars", "map_arrow", "components", "StorageLevel"]


def let(value, body):
    """``body(value)`` with ``value`` evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def match_spans(text, regex, length=F.char_length):
    """All leftmost, non-overlapping matches as array<struct<start,end,match>>.

    What stands between the matches and the matches themselves give the
    offsets; ``length`` measures both (characters by default).
    """
    regex = F.lit(regex) if isinstance(regex, str) else regex

    def total(lengths):
        return F.aggregate(lengths, F.lit(0), lambda a, v: a + v)

    def sums(x):
        """Length of all pieces (a gap and the match after it) before each block of pieces."""
        step = F.zip_with(F.slice(x["gap_n"], F.lit(1), F.size(x["m_n"])), x["m_n"], lambda g, n: g + n)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(x["m_n"]) / BLOCK).cast("int")),
                             lambda b: total(F.slice(step, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda bs: F.struct(
            x["m"].alias("m"), x["m_n"].alias("m_n"), x["gap_n"].alias("gap_n"), step.alias("step"),
            F.transform(bs, lambda n, b: total(F.slice(bs, F.lit(1), b))).alias("before")))

    def place(x):
        def span(hit, k):
            block = F.floor(k / BLOCK).cast("int")
            start = (F.get(x["before"], block) + total(F.slice(x["step"], block * BLOCK + 1, k - block * BLOCK))
                     + F.get(x["gap_n"], k))
            return F.struct(start.cast("long").alias("start"), (start + F.get(x["m_n"], k)).cast("long").alias("end"),
                            hit.alias("match"))

        return F.transform(x["m"], span)

    def measured(x):
        return F.struct(x["m"].alias("m"), x["gap"].alias("gap"),
                        F.transform(x["m"], lambda s: length(s).cast("int")).alias("m_n"),
                        F.transform(x["gap"], lambda s: length(s).cast("int")).alias("gap_n"))

    pieces = F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("m"), F.split(text, regex, -1).alias("gap"))
    return let(pieces, lambda x: let(measured(x), lambda y: let(sums(y), place)))


BLOCK = 256  # match_spans sums lengths block by block: linear in the matches up to some hundred thousand of them


BROADCAST_IDS = 4_000_000  # 32 MB of ids; beyond, the join is shuffled


def without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (one column); rows with null doc_id stay."""
    gone = saved(ids.toDF("__gone").where("__gone is not null").distinct(), name)
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs["doc_id"] == side["__gone"], "left_anti")
