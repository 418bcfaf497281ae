"""Driver contract: entry(), queries() and oracle_sql()."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tests.oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "column"


def test_every_oracle_has_a_query_and_parses():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    con = duck(SF)
    for name, s in sql.items():
        con.execute(f"EXPLAIN {s}")


@pytest.mark.parametrize("name", ["audit_numeric_summary", "profile_features", "htest_kruskal", "table1_continuous",
                                  "merge_chain_inner", "eval_roc_auc", "calib_decision_curve", "split_time",
                                  "prep_standard_scale", "diag_correlation_matrix"])
def test_oracle_matches_small(spark, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dk = duck(SF).execute(E.oracle_sql()[name]).df()
    assert compare(sp, dk) is None
