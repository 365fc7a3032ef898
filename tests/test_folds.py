"""Fits of all folds at once against a fit of each round by itself."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pointerflow.operators import folds as fo
from pointerflow.operators import preprocess as pr

COLUMNS = [*pr.STANDARD, *pr.DURATIONS, *pr.MINMAX, "self_intersections", "x", "y"]
SCHEMA = "participant_id string, fold int, dom_element_type string, has_kinematics int, has_duration int, " + ", ".join(f"{c} double" for c in COLUMNS)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(600):
        fold = rnd.choice([0, 0, 1, 2, 3, None])
        holes = lambda v: None if rnd.random() < 0.05 else v
        values = [holes(rnd.choice([rnd.gauss(1e6, 1), rnd.random() * 9, 0.0])) for _ in COLUMNS]
        # the third fold has all rows with kinematics but two, and durations stand only in the first
        data.append((f"p{i}", fold, rnd.choice(["a", "a", "b", f"t{fold}", None]), int(fold == 2 or i < 2), int(fold == 0), *values))
    return spark.createDataFrame(data, SCHEMA)


def near(a, b):
    return a is b is None or a is not None and b is not None and (a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_fits_of_all_folds(rows):
    got = {(r["round"], r.feature, r.method): r for r in fo.fit_all_folds(rows, 4).collect()}
    n = 0
    for i in range(4):
        for r in pr.fit_scaling(rows.where(F.col("fold") != i)).collect():
            g = got[i, r.feature, r.method]
            assert all(near(g[c], r[c]) for c in ("center", "scale", "low", "high")), (i, r, g)
            n += 1
    assert n == len(got)


def test_categories_of_all_folds(rows):
    got = sorted(map(tuple, fo.fit_all_categories(rows, 4, min_count=30).collect()))
    want = sorted((i, *r) for i in range(4) for r in map(tuple, pr.fit_categories(rows.where(F.col("fold") != i), min_count=30).collect()))
    assert got == want


def test_sketches_of_folds(rows):
    exact = {(r["round"], r.column_name): r.quantiles for r in fo.fold_quantiles(rows, 4).collect()}
    sketched = {(r["round"], r.column_name): r.quantiles for r in fo.fold_quantiles(rows, 4, sketch=400).collect()}
    assert set(exact) == set(sketched)
    for (i, c), q in sketched.items():
        values = sorted(r[0] for r in rows.where(F.col("fold") != i).select(c).dropna().collect())
        for p, v in zip(fo.POINTS, q):
            low, high = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
            assert low - 0.02 <= p <= high + 0.02
    assert fo.fit_all_folds(rows, 4, sketch=400).count() == fo.fit_all_folds(rows, 4).count()


def test_a_fold_without_rows(spark, rows):
    """Of two folds one is empty: its round fits on the other, the other's on nothing."""
    one = rows.where("fold = 0")
    got = {(r["round"], r.feature, r.method): r for r in fo.fit_all_folds(one, 2).collect()}
    assert got[0, "jitter", "standard"].center is None and got[0, "y", "robust"].scale is None and got[0, "acceleration_mean", "clip"].low is None
    assert got[1, "jitter", "standard"].center is not None
    assert fo.fit_all_folds(rows.where("false"), 2).where("center is not null or low is not null").count() == 0


def test_moments_merge_without_cancelling():
    from pyspark.sql import Row

    values = [1e9 + i % 7 for i in range(1000)]
    states = []
    for part in (values[:3], values[3:500], [], values[500:]):
        mean = math.fsum(part) / len(part) if part else None
        states.append(Row(n=len(part), mean=mean, squares=math.fsum((v - mean) ** 2 for v in part) if part else None))
    n, mean, std = fo._merged_moments(states)
    whole = math.fsum(values) / 1000
    assert n == 1000 and math.isclose(mean, whole) and math.isclose(std, math.sqrt(math.fsum((v - whole) ** 2 for v in values) / 1000), rel_tol=1e-9)


def test_rounds_cover_all_rows_once(spark, sf):
    from pointerflow.operators import actions as ac
    from pointerflow.operators import events as ev
    from pointerflow.operators import features as fe
    from pointerflow.sources import fixtures as fx

    f = ev.with_participant_id(fe.extract_features(ac.group_actions(fx.events(spark, sf))))
    ready = fo.folds_ready(f, 3, 7)
    held, everyone = [], {r.participant_id for r in f.select("participant_id").distinct().collect()}
    for _, train, validation in fo.rounds(ready, 3):
        sides = [{r.participant_id for r in side.select("participant_id").distinct().collect()} for side in (train, validation)]
        assert not sides[0] & sides[1] and sides[0] | sides[1] == everyone
        held += sides[1]
    assert sorted(held) == sorted(everyone)
