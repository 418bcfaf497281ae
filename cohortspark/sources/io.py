"""Readers, writers and the data fingerprint (ops 2-5, 9-14).

Readers are plain ``spark.read``: Parquet keeps predicate pushdown and column
pruning; CSV/TSV infer a schema unless one is given (pass one in production).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.columns import make_unique_columns, q

# Extension -> format, unknown extensions read as csv.
_EXTENSIONS = {
    ".csv": "csv",
    ".parquet": "parquet",
    ".tsv": "tsv",
    ".txt": "tsv",
}

# Encodings tried in order when none is given.
_FALLBACK_ENCODING = "ISO-8859-1"  # decodes every byte


def detect_file_type(path: str) -> str:
    low = path.lower().rstrip("/")
    for ext, fmt in _EXTENSIONS.items():
        if low.endswith(ext):
            return fmt
    return "csv"


def _dedupe_header(df: DataFrame) -> DataFrame:
    names = make_unique_columns(df.columns)
    return df.toDF(*names) if names != df.columns else df


def _is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every raw line, the header too, is valid UTF-8: the bytes
    decide, as a file may well hold the replacement character itself."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).isEmpty()


def _read_delimited(spark: SparkSession, path: str, sep: str, encoding: str | None,
                    schema: T.StructType | None, infer: bool) -> DataFrame:
    enc = encoding or ("UTF-8" if _is_utf8(spark, path) else _FALLBACK_ENCODING)
    reader = (spark.read.option("header", True).option("sep", sep)
              .option("encoding", enc).option("mode", "PERMISSIVE"))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)
    return _dedupe_header(reader.csv(path))


def load_csv(spark: SparkSession, path: str, encoding: str | None = None,
             schema: T.StructType | None = None, infer_schema: bool = True) -> DataFrame:
    """CSV with header; UTF-8, or Latin-1 where a line is not valid UTF-8;
    other encodings (cp1252) on request (op 2)."""
    return _read_delimited(spark, path, ",", encoding, schema, infer_schema)


def load_tsv(spark: SparkSession, path: str, encoding: str | None = None,
             schema: T.StructType | None = None, infer_schema: bool = True) -> DataFrame:
    """Tab-separated variant (op 3)."""
    return _read_delimited(spark, path, "\t", encoding, schema, infer_schema)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan (op 4): pushdown and pruning come from Catalyst."""
    return spark.read.parquet(path)


def load_table(spark: SparkSession, path: str, fmt: str | None = None,
               transpose: bool = False, index_col: str | None = None) -> DataFrame:
    """Unified loader (op 5); format from the extension, unknown -> csv."""
    fmt = fmt or detect_file_type(path)
    if fmt == "parquet":
        df = load_parquet(spark, path)
    elif fmt == "tsv":
        df = load_tsv(spark, path)
    else:
        df = load_csv(spark, path)
    if transpose:
        df = transpose_table(df, index_col)
    return df


def transpose_table(df: DataFrame, index_col: str | None = None) -> DataFrame:
    """Rows <-> columns (op 14).

    Uses Spark's ``DataFrame.transpose`` (bounded by
    ``spark.sql.transposeMaxValues``; a wide result is inherently small in
    rows).  The first column's values become the new header; duplicates are
    renamed a, a_1, a_2.
    """
    index_col = index_col or df.columns[0]
    others = [c for c in df.columns if c != index_col]
    # transpose needs one common value type
    as_str = df.select(q(index_col).cast("string").alias(index_col),
                       *[q(c).cast("string").alias(c) for c in others])
    t = as_str.transpose(indexColumn=F.col(f"`{index_col}`"))
    return _dedupe_header(t)


def transpose_long(df: DataFrame, index_col: str) -> DataFrame:
    """Scale-safe long form of a transpose: (row key, column, value)."""
    others = [c for c in df.columns if c != index_col]
    return df.select(q(index_col), *[q(c).cast("string").alias(c) for c in others]).unpivot(
        index_col, others, "column", "value")


# ------------------------------------------------------------------ sinks

def save_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Parquet sink / cache (op 9)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header (op 10): result tables, metrics, predictions."""
    df.write.mode(mode).option("header", True).csv(path)


def export_predictions(pred: DataFrame, path: str, key: str, label: str,
                       prediction: str = "prediction") -> None:
    """Per model: key, Actual, Predicted (op 11)."""
    save_csv(pred.select(q(key), q(label).alias("Actual"), q(prediction).alias("Predicted")), path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free data fingerprint (op 12).

    count, bit-xor and wrapped sum of a 64-bit row hash over all columns; the
    12-hex text is built from both aggregates.  Row order does not matter
    (unlike a sequential digest), so it is stable across partitionings.
    """
    h = F.xxhash64(*[q(c) for c in df.columns])
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("hash_xor"),
                 F.sum(h.cast("decimal(38,0)")).alias("hash_sum"))
    return agg.select(
        "n_rows", "hash_xor", F.col("hash_sum").cast("string").alias("hash_sum"),
        F.substring(F.sha2(F.concat_ws(":", F.col("n_rows"), F.col("hash_xor"),
                                       F.col("hash_sum").cast("string")), 256), 1, 12)
         .alias("fingerprint"))


# ------------------------------------------------------------- model persistence (op 13)

def save_model(model, path: str) -> None:
    """Persist a fitted model, preprocessing step or pipeline (see ``sources/saved.py``)."""
    from cohortspark.sources.saved import save
    save(model, path)


def load_model(path: str):
    """What ``save_model`` wrote."""
    from cohortspark.sources.saved import load
    return load(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint location: the shared one on a cluster,
    a local folder only in local mode with spark.checkpoint.dir unset."""
    import uuid

    from cohortspark.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex[:12]}"


def balance_partitions(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has cores
    (e.g. one large single-row-group file) over ``defaultParallelism`` tasks.
    Scans with at least that many splits are left alone; a table with fewer
    splits than the cluster has cores is shuffled once, round-robin."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
