"""Registered table computations over the driver tables.

Each entry is (callable(spark, sf_dir) -> DataFrame, DuckDB SQL or None).
A ``None`` SQL marks an operator whose result is random or iterative; those
are covered by unit tests instead of an SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # import for side effect: each module registers its queries
    from cohortspark.plans.suite import (audit_q, diag_q, eval_q, featsel_q, htest_q, merge_q, models_q,  # noqa: F401
                                          explain_q, io_q, prep_q, profile_q,
                                          table1_q)
    return REGISTRY
