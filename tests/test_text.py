"""Text features on odd texts, and the eight digits that results are compared at."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.scalar import sig
from tesserae.plans import registry

TEXTS = [None, "", " ", "a\x0bb C1", "\x0b", "x y z\u0085w", "a\x1cb\x1fc", "\tA\r\nb\x0cc ", "é\U0001f600 Ä1٣", "a\x00b 0", "12345678 AbcdefGh", "word word word"]


def test_text_features_equal_their_sql_on_odd_texts(spark, tmp_path):
    """a vertical tab parted words, a null text had no characters instead of none known, an empty one a share."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["text_features"]).fetchall())
    got = sorted(tuple(r) for r in registry.queries()["text_features"](spark, str(tmp_path)).collect())
    assert len(got) == len(TEXTS)
    for a, b in zip(got, want, strict=True):
        assert [None if v is None else "nan" if math.isnan(v) else v for v in a] == [None if v is None else "nan" if math.isnan(v) else pytest.approx(v, rel=1e-12) for v in b]


def test_eight_digits_are_those_of_c_next_to_a_tie(spark):
    """2 capitals in 56,884 characters: the factor ends next to a tie, where Java went by the shortest decimal."""
    rng = np.random.default_rng(3)
    values = [2 / 56884, 0.0, 1e-12, 5e-12, 1e300, math.inf, math.nan]
    for e in range(-19, 6):
        for k in rng.integers(10**7, 10**8, 40).tolist():
            v = float(f"{k}5e{e}") / 1.000000000003
            values += [v, float(np.nextafter(v, 0)), float(np.nextafter(v, math.inf))]
    values += [-v for v in values]
    got = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", sig(F.col("v")).alias("w")).collect()
    assert [r.w for r in got if r.v is None] == [None]
    for v, w in ((r.v, r.w) for r in got if r.v is not None):
        want = 0.0 if abs(v) < 1e-11 else float(f"{v * 1.000000000003:.7e}")
        assert w == want or math.isnan(w) and math.isnan(want), v
