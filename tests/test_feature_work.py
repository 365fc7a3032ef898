"""The work of features on short, many and long paths."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointerflow.functions import scalar
from pointerflow.operators import features as fe
from pointerflow.operators import pieces


def test_crossings_of_each_path():
    rng = np.random.default_rng(3)
    paths = [rng.normal(size=(n, 2)) for n in (0, 1, 3, 4, 4, 5, 9, 9, 9, 40, 60)] + [None, rng.normal(size=(4, 2))]
    xs, ys = (pa.array([None if p is None else p[:, k] for p in paths], pa.list_(pa.float64())) for k in (0, 1))
    want = [0 if p is None else scalar.count_crossings(p[:, 0], p[:, 1]) for p in paths]
    assert sum(want) > 0
    for few, block in ((1024, 1 << 18), (1024, 5), (6, 40)):
        assert scalar.crossings_of_each(xs, ys, few, block).to_pylist() == want
    assert scalar.crossings_of_each(xs.slice(5), ys.slice(5)).to_pylist() == want[5:]


def test_crossings_of_short_paths(spark):
    path = F.transform(F.sequence(F.lit(1), F.col("id")), lambda i: F.struct((i % 3 * 1.0).alias("x"), (i % 2 * 1.0).alias("y"), (i * 1.0).alias("t")))
    rows = spark.range(1, 9).select("id", path.alias("path"))
    got = [r.n for r in rows.orderBy("id").select(scalar.self_intersections("path").alias("n")).collect()]
    want = [scalar.count_crossings(np.arange(1, n + 1) % 3 * 1.0, np.arange(1, n + 1) % 2 * 1.0) for n in range(1, 9)]
    assert got == want


def test_jitter_of_a_long_path(spark):
    n = 20_000
    path = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct((i * i * 1.0).alias("x"), F.lit(0.0).alias("y"), (i * 1.0).alias("t")))
    none = {c: F.lit(None).cast(t) for c, t in (("start", "double"), ("end", "double"), ("node", "string"))}
    row = spark.range(1).select(F.lit("P1|1|m").alias("session_key"), F.lit(0).alias("action_idx"), F.lit("mouse_movement").alias("type"), path.alias("path"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("double").alias("timestamp")).withColumns(none)
    stats = spark.createDataFrame([("P1|1|m", 0.0, 1.0, 0.0, 1.0)], "session_key string, x_center double, x_scale double, y_center double, y_scale double")
    began = time.monotonic()
    got = fe.movement_features(row, stats).drop("self_intersections").collect()[0].jitter
    assert time.monotonic() - began < 20  # a sum over all steps for each of them takes minutes
    assert got == pytest.approx(np.diff(np.arange(1.0, n + 1) ** 2).std(), rel=1e-9)


def test_lengths_are_counted_on_keys_alone(spark):
    rows = spark.range(60).selectExpr("if(id % 3 = 0, 'a', 'b') session_key", "cast(id as double) t", "1.0D x", "2.0D y", "id % 2 = 0 is_click", "id ord")
    bare = rows.select("session_key")
    ways = [pieces.deltas_of(rows, lambda: F.lit(False), most, counted) for most, counted in ((30, bare), (30, None), (100, bare))]
    assert [len(w) for w in ways] == [2, 2, 1]
