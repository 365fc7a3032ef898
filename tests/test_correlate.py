"""Correlations from blocks of co-moments against one aggregate a pair."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pointerflow.operators import preprocess as pr
from pointerflow.operators.correlate import correlations


def test_blocks_equal_pairs(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(500):
        a = rnd.gauss(1e8, 3)
        rows.append((a, a + rnd.gauss(0, 1), rnd.random() if rnd.random() < 0.7 else None, a * -2 if rnd.random() < 0.5 else None, 5.0, rnd.gauss(0, 1e-6), int(a) % 7))
    names = ["a", "b", "c", "d", "e", "f", "g"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names[:-1]) + ", g int").repartition(6)
    got = {(r.column_a, r.column_b): r for r in correlations(df, names).collect()}
    assert len(got) == 21
    for (a, b), r in got.items():
        both = df.where(f"{a} is not null and {b} is not null")
        assert r.n == both.count()
        if "e" in (a, b):
            assert r.r is None  # a constant column
            continue
        want = both.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).first()[0]
        assert math.isclose(r.r, want, rel_tol=1e-9, abs_tol=1e-9)
    assert pr.correlation_filter(df, names, blocks=True).where("dropped").count() == pr.correlation_filter(df, [c for c in names if c != "e"]).where("dropped").count()


def test_odd_columns(spark):
    rows = [(1.0, None, float("nan"), 1.0), (2.0, None, 1.0, 2.0), (3.0, 1.0, 2.0, float("inf"))]
    df = spark.createDataFrame(rows, "a double, b double, `c.d` double, e double")
    got = {(r.column_a, r.column_b): (r.n, r.r) for r in correlations(df, ["a", "b", "c.d", "e"]).collect()}
    assert got["a", "b"] == (1, None) and got["a", "c.d"] == (3, None) and got["a", "e"] == (3, None)
    assert correlations(df.where("a > 9"), ["a", "b"]).count() == 0


def test_hundreds_of_columns(spark):
    names = [f"v{i}" for i in range(300)]
    df = spark.range(400).select(*((F.randn(seed=i) + (F.col("id") if i % 150 == 0 else F.lit(0))).alias(c) for i, c in enumerate(names)))
    got = correlations(df, names)
    assert got.count() == 300 * 299 // 2
    close = [(r.column_a, r.column_b) for r in got.where("abs(r) > 0.9").collect()]
    assert close == [("v0", "v150")]
    x = np.array(df.select("v0", "v150").collect())
    assert math.isclose(got.where("column_a = 'v0' and column_b = 'v150'").first().r, np.corrcoef(x.T)[0, 1], rel_tol=1e-9)
