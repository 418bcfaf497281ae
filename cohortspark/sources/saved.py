"""Fitted objects (models, preprocessing steps, whole pipelines) as versioned records that any session can reload.

A fitted object is a dataclass of this package.  Its fields are written as one
JSON record: numbers, texts, lists, tuples, dicts, arrays and other fitted
objects in place; what grows with the data (tables, arrays above INLINE
numbers) as Parquet next to it; MLlib models by their own writer.  Reloaded
objects transform batches and streams as before.
"""

from __future__ import annotations

import dataclasses
import importlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

VERSION = 1
INLINE = 10_000
#: fields that belong to the fitting session and are not kept
NOT_KEPT = {("FittedPipeline", "train")}


def save(obj, path: str) -> None:
    """Write a fitted object below ``path`` (replaces what was saved there)."""
    spark = SparkSession.getActiveSession()
    names = iter(range(1 << 30))

    def encode(x):
        if dataclasses.is_dataclass(x) and not isinstance(x, type):
            kind = type(x)
            if not kind.__module__.startswith("cohortspark."):
                raise TypeError(f"cannot save {kind.__name__}")
            fields = {f.name: encode(getattr(x, f.name)) for f in dataclasses.fields(x)
                      if (kind.__name__, f.name) not in NOT_KEPT}
            return {"object": f"{kind.__module__}:{kind.__qualname__}", "fields": fields}
        if isinstance(x, DataFrame):
            part = f"table-{next(names)}"
            x.write.mode("overwrite").parquet(f"{path}/{part}")
            return {"table": part}
        if isinstance(x, np.ndarray):
            if x.size <= INLINE:
                return {"array": x.tolist(), "dtype": str(x.dtype)}
            part, flat = f"array-{next(names)}", x.reshape(len(x), -1)
            rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(flat)], "i long, v array<double>")
            rows.write.mode("overwrite").parquet(f"{path}/{part}")
            return {"stored": part, "dtype": str(x.dtype), "shape": list(x.shape)}
        if isinstance(x, np.generic):
            return x.item()
        if isinstance(x, dict):
            return {"dict": [[encode(k), encode(v)] for k, v in x.items()]}
        if isinstance(x, tuple):
            return {"tuple": [encode(v) for v in x]}
        if isinstance(x, list):
            return [encode(v) for v in x]
        if x is None or isinstance(x, (bool, int, float, str)):
            return x
        if type(x).__module__.startswith("pyspark.ml.") and hasattr(x, "write"):
            part = f"mllib-{next(names)}"
            x.write().overwrite().save(f"{path}/{part}")
            return {"mllib": f"{type(x).__module__}:{type(x).__qualname__}", "path": part}
        raise TypeError(f"cannot save {type(x).__name__}")

    record = json.dumps({"version": VERSION, "root": encode(obj)})
    spark.createDataFrame([(record,)], "record string").coalesce(1).write.mode("overwrite").json(f"{path}/record")


def load(path: str):
    """The object that ``save`` wrote below ``path``."""
    spark = SparkSession.getActiveSession()
    record = json.loads(spark.read.json(f"{path}/record").first()["record"])
    if record["version"] > VERSION:
        raise ValueError(f"saved by a newer version ({record['version']})")

    def named(name: str, package: str):
        module, cls = name.split(":")
        if not module.startswith(package):
            raise ValueError(f"not a fitted object: {name}")
        return getattr(importlib.import_module(module), cls)

    def decode(x):
        if isinstance(x, list):
            return [decode(v) for v in x]
        if not isinstance(x, dict):
            return x
        if "object" in x:
            return named(x["object"], "cohortspark.")(**{k: decode(v) for k, v in x["fields"].items()})
        if "table" in x:
            return spark.read.parquet(f"{path}/{x['table']}")
        if "array" in x:
            return np.array(x["array"], dtype=x["dtype"])
        if "stored" in x:
            rows = spark.read.parquet(f"{path}/{x['stored']}").orderBy("i").toPandas()["v"]
            return np.array(rows.tolist(), dtype=x["dtype"]).reshape(x["shape"])
        if "dict" in x:
            return {decode(k): decode(v) for k, v in x["dict"]}
        if "tuple" in x:
            return tuple(decode(v) for v in x["tuple"])
        return named(x["mllib"], "pyspark.ml.").load(f"{path}/{x['path']}")

    return decode(record["root"])
