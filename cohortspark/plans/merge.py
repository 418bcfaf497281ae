"""Merge plan: an ordered list of equi-join steps folded over named tables
(ops 29-32).

Semantics kept from the original tool: missing keys match missing keys
(NULL-safe equality), a same-named key yields one output column (coalesced for
right/outer joins), ``left_on``/``right_on`` keep both columns, and overlapping
non-key names get suffixes.  The physical strategy is Catalyst's: a side is
broadcast only when its measured size is under the broadcast threshold (AQE
re-plans at runtime from actual shuffle sizes), otherwise sort-merge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import q

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


@dataclass(frozen=True)
class MergeStep:
    left: str
    right: str
    on: Sequence[str] | str | None = None
    how: str = "inner"
    left_on: str | None = None
    right_on: str | None = None
    suffixes: tuple[str, str] = ("_x", "_y")


@dataclass
class MergePlan:
    steps: list[MergeStep] = field(default_factory=list)
    broadcast_max_rows: int | None = None

    def add(self, *args, **kwargs) -> MergePlan:
        self.steps.append(MergeStep(*args, **kwargs))
        return self

    def apply(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        if not self.steps:
            return next(iter(tables.values()))
        result: DataFrame | None = None
        for i, st in enumerate(self.steps):
            if st.left == "result":
                if result is None:
                    raise ValueError("'result' cannot be the left table of the first step")
                left = result
            else:
                left = tables[st.left]
            right = tables[st.right]
            result = merge(left, right, on=st.on, how=st.how, left_on=st.left_on,
                           right_on=st.right_on, suffixes=st.suffixes,
                           broadcast_max_rows=self.broadcast_max_rows)
        return result


def _rename_overlap(left: DataFrame, right: DataFrame, keep: set[str],
                    suffixes: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    overlap = (set(left.columns) & set(right.columns)) - keep
    if not overlap:
        return left, right
    ls, rs = suffixes
    left = left.select(*[q(c).alias(c + ls) if c in overlap else q(c) for c in left.columns])
    right = right.select(*[q(c).alias(c + rs) if c in overlap else q(c) for c in right.columns])
    return left, right


def merge(left: DataFrame, right: DataFrame, on: Sequence[str] | str | None = None,
          how: str = "inner", left_on: str | None = None, right_on: str | None = None,
          suffixes: tuple[str, str] = ("_x", "_y"),
          broadcast_max_rows: int | None = None) -> DataFrame:
    """One merge step with pandas-like naming and NULL-safe key matching."""
    jt = _HOW[how]
    if broadcast_max_rows is not None and jt in ("inner", "left"):
        # explicit size check before hinting; Catalyst/AQE decide otherwise
        if right.limit(broadcast_max_rows + 1).count() <= broadcast_max_rows:
            right = F.broadcast(right)
    if left_on and right_on and left_on != right_on:
        l2, r2 = _rename_overlap(left, right, set(), suffixes)
        lk = left_on + suffixes[0] if left_on in right.columns and left_on not in l2.columns else left_on
        rk = right_on + suffixes[1] if right_on in left.columns and right_on not in r2.columns else right_on
        a, b = l2.alias("__l"), r2.alias("__r")
        return a.join(b, F.col(f"__l.`{lk}`").eqNullSafe(F.col(f"__r.`{rk}`")), jt).select(
            *[F.col(f"__l.`{c}`") for c in l2.columns], *[F.col(f"__r.`{c}`") for c in r2.columns])
    if left_on and right_on:
        on = [left_on]
    if on is None:
        raise ValueError("merge needs 'on' or both 'left_on' and 'right_on'")
    keys = [on] if isinstance(on, str) else list(on)
    l2, r2 = _rename_overlap(left, right, set(keys), suffixes)
    a, b = l2.alias("__l"), r2.alias("__r")
    cond = None
    for k in keys:
        c = F.col(f"__l.`{k}`").eqNullSafe(F.col(f"__r.`{k}`"))
        cond = c if cond is None else (cond & c)
    joined = a.join(b, cond, jt)
    if jt == "inner" or jt == "left":
        key_cols = [F.col(f"__l.`{k}`").alias(k) for k in keys]
    elif jt == "right":
        key_cols = [F.col(f"__r.`{k}`").alias(k) for k in keys]
    else:
        key_cols = [F.coalesce(F.col(f"__l.`{k}`"), F.col(f"__r.`{k}`")).alias(k) for k in keys]
    lo = [F.col(f"__l.`{c}`") for c in l2.columns if c not in keys]
    ro = [F.col(f"__r.`{c}`") for c in r2.columns if c not in keys]
    # pandas order: left columns (keys in place), then right non-keys
    out = []
    for c in l2.columns:
        out.append(key_cols[keys.index(c)] if c in keys else F.col(f"__l.`{c}`"))
    return joined.select(*out, *ro) if lo is not None else joined
