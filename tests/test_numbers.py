"""Splits, scaling, sequences and statistics against small exact values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointerflow.functions import scalar
from pointerflow.operators import metrics as rm
from pointerflow.operators import preprocess as pr
from pointerflow.operators import sequences as sq
from pointerflow.operators import split as sp
from pointerflow.operators import stats as st


def people(spark, n):
    return spark.createDataFrame([(f"P{i:03}", "ab"[i % 3 == 0]) for i in range(n)], "participant_id string, stratum string")


@pytest.mark.parametrize(("n", "k", "seed"), [(2, 2, 0), (11, 3, 1), (30, 5, 9)])
def test_folds_are_disjoint_and_cover(spark, n, k, seed):
    folds = sp.group_folds(people(spark, n), k, seed).collect()
    sizes = [sum(r.fold == i for r in folds) for i in range(k)]
    assert len({r.participant_id for r in folds}) == len(folds) == n and max(sizes) - min(sizes) <= 1
    sides = sp.fold_sides(sp.group_folds(people(spark, n), k, seed), k).where("side = 'validate'")
    assert sides.count() == n


def test_stratified_split(spark):
    p = people(spark, 30)
    got = sp.split_participants(p.select("participant_id"), 0.75, 3, p)
    assert got.where("split = 'train'").count() == 22
    with pytest.raises(ValueError):
        sp.split_participants(p, 1.0, 1)
    assert sp.check_coverage([got], p).count() == 0


def test_split_needs_two(spark):
    with pytest.raises(Exception, match="fewer than two"):
        sp.split_participants(people(spark, 1), 0.5, 1).collect()


def test_scalar_edges(spark):
    df = spark.createDataFrame([("x",), ("2.5",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(scalar.safe_float("v")).collect()] == [None, 2.5, None, None]
    tags = spark.createDataFrame([("<!-- <b> --><Div id=1>",), ("none",), ("",), (None,)], "v string")
    assert [r[0] for r in tags.select(scalar.dom_tag("v")).collect()] == ["div", None, None, None]
    angle = spark.range(1).select(scalar.turn_angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)), scalar.turn_angle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()
    assert angle[0] == pytest.approx(math.pi / 2) and angle[1] == 0
    named = spark.createDataFrame([(1, 2)], " `Session ID` int, `my participant` int")
    assert scalar.find_column(named, ["participant"]) == "my participant"
    with pytest.raises(ValueError):
        scalar.find_column(named, ["zzz"])


def test_crossings():
    assert scalar.count_crossings(np.array([0.0, 2, 2, 0]), np.array([0.0, 2, 0, 2])) == 1
    x, y = np.random.default_rng(0).normal(size=(2, 60))
    assert scalar.count_crossings(x, y, block=7) == scalar.count_crossings(x, y)


def test_categories(spark):
    df = spark.createDataFrame([("b",)] * 3 + [("a",)] * 2 + [("c",)], "dom_element_type string")
    assert sorted(map(tuple, pr.fit_categories(df, min_count=2).collect())) == [("Other", 0), ("a", 1), ("b", 2)]
    assert sorted(map(tuple, pr.fit_categories(df, min_count=1).collect())) == [("Other", 3), ("a", 0), ("b", 1), ("c", 2)]


def test_padding(spark):
    df = spark.createDataFrame([("k", i, float(i), i) for i in range(3)] + [("m", i, float(i), 0) for i in range(5)], "session_key string, action_idx int, v double, c int")
    post = {r.session_key: r for r in sq.prepare_sequences(df, 4, ["v"], ["c"]).collect()}
    assert post["k"].v == [0, 1, 2, 0] and post["k"].c == [1, 2, 3, 0] and post["m"].v == [0, 1, 2, 3] and post["m"].length_raw == 5
    pre = {r.session_key: r for r in sq.prepare_sequences(df, 4, ["v"], ["c"], "pre", "pre").collect()}
    assert pre["k"].v == [0, 0, 1, 2] and pre["m"].v == [1, 2, 3, 4]


def test_length_bins_with_ties(spark):
    m = spark.createDataFrame([(5, 1.0, 2.0)] * 9 + [(7, 1.0, 4.0)], "length int, mse_model double, improvement_pct double")
    got = {r.bin: r.n for r in rm.metrics_by_length_bin(m, rm.fit_length_bins(m)).collect()}
    assert got == {1: 9, 2: 0, 3: 0, 4: 0, 5: 1}


@pytest.mark.parametrize("n", [5, 8, 11])
def test_signed_rank_exact(n):
    sums = [sum(s) for s in itertools.product(*((0, k) for k in range(1, n + 1)))]
    for r in (0, n, n * (n + 1) // 2):
        low, high = np.mean([s <= r for s in sums]), np.mean([s >= r for s in sums])
        assert st.signed_rank_p(n, r, 0, False) == pytest.approx(min(1, 2 * min(low, high)))
        assert st.signed_rank_p(n, r, 0, False, "greater") == pytest.approx(high)
    assert st.signed_rank_p(4, 3, 0, False) is None


def test_wilcoxon_with_zeros_and_ties(spark):
    d = spark.createDataFrame([(v,) for v in (0.0, 1.0, -1.0, 2.0, 3.0, 3.0, -4.0, 5.0)], "difference double")
    r = st.wilcoxon_signed_rank(d).first()
    assert (r.n, r.zeros, r.r_plus, r.r_minus) == (7, 1, 20.5, 7.5) and 0.2 < r.p_value < 0.4


def test_mann_whitney_counts(spark):
    g = spark.createDataFrame([("t", float(v), v < 4, v > 6) for v in range(1, 11)] + [("u", 1.0, True, False)], "target string, f double, is_low boolean, is_high boolean")
    got = {r.target: r for r in st.mann_whitney(g, ["f"]).collect()}
    assert got["t"].u_low == 0 and got["t"].effect == 1 and got["t"].p_value == pytest.approx(0.0518, abs=2e-3)
    assert got["u"].u_low is None and got["u"].p_value is None


def test_fdr(spark):
    p = spark.createDataFrame([("t", f"f{i}", v) for i, v in enumerate([0.01, 0.04, 0.03, None, 0.9])], "target string, feature string, p_value double")
    got = {r.feature: r.q_value for r in st.fdr_bh(p).collect()}
    assert got["f0"] == pytest.approx(0.04) and got["f1"] == got["f2"] == pytest.approx(0.04 * 4 / 3) and got["f3"] is None and got["f4"] == 0.9


def test_null_participants_drop(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), ("a", 1.0, 3.0)], "participant_id string, mse_model double, mse_baseline double")
    assert [tuple(r) for r in st.paired_participants(df).collect()] == [("a", 1.0, 3.0, 2.0)]
