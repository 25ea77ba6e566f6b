"""A sample of registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tesserae.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["describe_numeric", "describe_categorical", "correlation_pairs", "vif", "filter_comparison", "drop_duplicates", "forward_fill", "anova", "mann_whitney", "chi_square", "multiple_comparison", "impute_by_group", "standard_scale", "target_encode", "regression_metrics", "roc_auc", "threshold_costs", "subgroup_errors", "drift_report", "check_contract", "structural_break", "forecast_ses", "backtest", "fit_ols_inference", "anomaly_iqr", "association_rules", "profile_columns", "partial_dependence", "explain_rows"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}")
    return v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are needed")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()], key=str)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    assert got == want
