"""Session grain, plans, and the forms meant for very many rows."""

import json

import pytest
from pyspark.sql import functions as F

from pointerflow.functions.scalar import quantiles
from pointerflow.operators import actions as ac
from pointerflow.operators import events as ev
from pointerflow.operators import features as fe
from pointerflow.operators import preprocess as pr
from pointerflow.operators import sequences as sq
from pointerflow.operators import split as sp
from pointerflow.sources import fixtures as fx
from pointerflow.sources import io


def test_sessions_without_ids_are_not_mixed(spark, tmp_path):
    """Two objects that share their ids: two movements of 12 px, not one between them."""
    moves = [[{"timestamp": t, "x": x0 + 3 * i, "y": 0} for i, t in enumerate(range(t0, t0 + 50, 10))] for t0, x0 in ((0, 0), (5, 1000))]
    (tmp_path / "s.json").write_text(json.dumps([{"m": {"mouseMovements": m}} for m in moves], indent=2))
    got = ac.group_actions(ev.explode_events(io.read_sessions(spark, str(tmp_path / "s.json"), ("m",)), ["m"])).orderBy("action_idx").collect()
    assert [(r.session_key, r.action_idx, r.type, r.distance, r.path[0].x) for r in got] == [("unknown|unknown|m", 0, "mouse_movement", 12, 0), ("unknown|unknown|m", 1, "mouse_movement", 12, 1000)]


def test_action_sequences_over_many_lines(spark, tmp_path):
    given = {"a|1|m": [{"type": "click", "timestamp": 5, "x": 1, "y": 2, "node": "<a>"}, {"type": "pause", "start": 1, "end": float("nan"), "path": None}], "b|1|m": [{"type": "mouse_movement", "path": [[0, 0, 1], [1, 1, 2]]}]}
    for indent in (None, 2):
        path = tmp_path / f"{indent}.json"
        path.write_text(json.dumps(given, indent=indent))
        got = {(r.session_key, r.action_idx): r for r in io.read_action_sequences(spark, str(path)).collect()}
        assert len(got) == 3 and got["a|1|m", 0].node == "<a>" and got["a|1|m", 1].end is None and got["b|1|m", 0].path[1].t == 2


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("Exchange hashpartitioning"), plan.count("MapInArrow"), plan.count("SortMergeJoin")


@pytest.fixture
def plain(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_events_are_scanned_once(spark, sf, plain, tmp_path):
    actions = ac.group_actions(fx.events(spark, sf))
    assert exchanges(actions)[:2] == (2, 1)
    actions.write.parquet(str(tmp_path / "a"))
    assert exchanges(fe.extract_features(spark.read.parquet(str(tmp_path / "a"))))[::2] == (2, 1)


def test_few_rows_with_durations_are_enough(spark):
    columns = [*pr.STANDARD, *pr.DURATIONS, *pr.MINMAX, "self_intersections", "x", "y"]
    rows = [(*[float(i + j) for j in range(len(columns))], int(i < 3), int(i < 3)) for i in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", has_kinematics int, has_duration int")
    got = {(r.feature, r.method): r for r in pr.fit_scaling(df).collect()}
    at = columns.index("action_duration")
    assert got["action_duration", "standard"].center == at + 1  # the three rows that have one
    assert got["cursor_speed", "standard"].center == columns.index("cursor_speed") + 3.5  # all rows, as three are too few
    none = {(r.feature, r.method): r for r in pr.fit_scaling(df.withColumn("has_duration", F.lit(0))).collect()}
    assert none["action_duration", "standard"].center == at + 3.5
    holes = df.withColumn("jitter", F.when(F.col("x") > columns.index("x") + 3, F.col("jitter")))
    assert {(r.feature, r.method): r for r in pr.fit_scaling(holes).collect()}["cursor_speed", "standard"].center == columns.index("cursor_speed") + 5.5  # rows whole in the block


def test_places_of_the_applied_rows(spark):
    params = spark.createDataFrame([("x", "minmax", 0.0, 10.0, None, None), ("x", "median", 4.0, None, None, None), ("acceleration_mean", "clip", None, None, 0.0, 1.0), ("jitter", "standard", None, None, None, None)], "feature string, method string, center double, scale double, low double, high double")
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0)], "x double, jitter double").withColumn("y", F.lit(0.0))
    assert [r.x for r in pr.apply_scaling(df, params, drop_xy=False).collect()] == [0.1, 0.4, 0.3]
    own = pr.apply_scaling(df, params, drop_xy=False, own_median=True).collect()
    assert [r.x for r in own] == [0.1, 0.2, 0.3] and own[0].jitter == 5.0  # nothing was fitted


def test_splits_by_hash(spark):
    people = spark.range(4000).selectExpr("cast(id as string) participant_id").union(spark.sql("select null"))
    got = {r.participant_id: r.split for r in sp.split_by_hash(people, 0.8, 3).collect()}
    assert len(got) == 4000 and abs(list(got.values()).count("train") - 3200) < 150
    some = {r.participant_id: r.split for r in sp.split_by_hash(people.where("participant_id < '3'"), 0.8, 3).collect()}
    assert all(got[k] == v for k, v in some.items())
    folds = [r.fold for r in sp.folds_by_hash(people, 5, 3).collect()]
    assert set(folds) == set(range(5)) and all(abs(folds.count(k) - 800) < 120 for k in range(5))
    with pytest.raises(ValueError):
        sp.split_by_hash(people, 1.0, 3)


def test_quantiles_from_sketches(spark):
    row = spark.range(100_001).agg(quantiles("id", (0.01, 0.5, 0.99)).alias("exact"), quantiles("id", (0.01, 0.5, 0.99), 1000).alias("near")).first()
    assert row.exact == [1000, 50_000, 99_000] and all(abs(a - b) <= 100 for a, b in zip(row.exact, row.near))


def test_counts_and_lists(spark):
    df = spark.createDataFrame([(-1.0, 1.0, 2.0), (2.0, 2.0, 4.1), (3.0, 3.0, 5.9)], "a double, b double, c double")
    assert pr.uncorrelated(pr.correlation_filter(df, ["b", "c", "a"], 0.99), ["b", "c", "a"]) == ["b", "a"]
    logged = spark.createDataFrame([(-1.0,) * len(pr.LOGGED), (1.0,) * len(pr.LOGGED)], ", ".join(f"{c} double" for c in pr.LOGGED))
    assert {r.negatives for r in pr.negative_values(logged).collect()} == {1}
    a, b = (spark.createDataFrame([(x,) for x in xs], "session_key string") for xs in ("aabc", "bcd"))
    assert sp.shared_sessions(a, b).first().shared_sessions == 2


def test_columns_are_checked_by_name(spark):
    df = spark.createDataFrame([("k", 1.0, 2, "a", 3)], "session_key string, jitter double, turns int, tag string, tag_code int")
    sp.check_columns(df, ["jitter", "tag"])
    with pytest.raises(ValueError, match="missing columns: speed"):
        sp.check_columns(df, ["jitter", "speed"])
    assert sq.continuous_columns(df, ["tag_code"]) == ["jitter", "turns"]
    assert sq.continuous_columns(df, ["tag_code"], ["turns", "jitter"]) == ["turns", "jitter"]
    with pytest.raises(ValueError, match="speed"):
        sq.continuous_columns(df, ["tag_code"], ["speed"])
