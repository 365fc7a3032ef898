"""Orders, ranks, quantiles and sequences divided among tasks equal those of one task."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pointerflow.functions.scalar import count_crossings
from pointerflow.operators import actions as ac
from pointerflow.operators import calibrate as th
from pointerflow.operators import events as ev
from pointerflow.operators import split as sp
from pointerflow.operators import stats as st
from pointerflow.operators.pieces import cut_deltas, numbered_together
from pointerflow.operators.quantiles import exact_quantiles, quantiles_by_column
from pointerflow.operators.ranges import Ranges, before
from pointerflow.sources import io

EVENTS = "session_key string, session_idx long, t double, x double, y double, is_click boolean, node string, ord long"


def walk(rnd, key, place, n):
    """Moves that dwell, jump, pause, click and repeat times."""
    t = x = y = 0.0
    rows = []
    for i in range(n):
        t += rnd.choice([0, 0, 10, 100, 200, 240, 250, 400, 900])
        if rnd.random() < 0.6:
            x, y = x + rnd.choice([-3, -1, 0, 0, 1, 2]), y + rnd.choice([-2, 0, 0, 1])
        elif rnd.random() < 0.3:
            x, y = x + rnd.choice([-30, 12, 50]), y + 9
        click = rnd.random() < 0.05
        rows.append((key, place, t, float(x), float(y), click, "<a>" if click else None, i))
    return rows


@pytest.fixture(scope="module")
def walks(spark):
    rnd = random.Random(9)
    rows = [r for k, n in enumerate((700, 1, 2, 60, 300, 5)) for r in walk(rnd, f"p{k % 3}|1|m", k, n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, EVENTS).repartition(5)


def told(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("with_place", [True, False])
def test_actions_in_pieces(walks, with_place):
    events = walks if with_place else walks.drop("session_idx").where("session_idx in (0, 1, 2)")
    want = told(ac.group_actions(events))
    assert len(want) > 50 and {t for t in ("pause", "click", "hover", "mouse_movement") if any(t in w for w in want)} == {"pause", "click", "hover", "mouse_movement"}
    for long in (0, 50):
        assert told(ac.group_actions(events, long=long)) == want


def test_cut_deltas_equal_deltas(walks):
    plain = ev.with_deltas(walks)
    for parts in (1, 3, 50):
        cut = cut_deltas(walks, ac.is_pause, parts)
        assert told(cut.select(*plain.columns)) == told(plain)
        w = ev.recorded(plain, "event_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pause = ac.is_pause()
        counted = plain.withColumn("piece", F.count_if(pause | F.col("is_click")).over(w) - (pause | F.col("is_click")).cast("int")).withColumn("run", F.count_if(~pause).over(w))
        names = ["session_key", "session_idx", "event_idx", "piece", "run"]
        assert told(cut.select(*names)) == told(counted.select(*names))
    assert cut.select("part").distinct().count() > 5


def test_pauses_and_hovers_of_cut_deltas(walks):
    plain, cut = ev.with_deltas(walks), cut_deltas(walks, ac.is_pause, 20)
    for f in (ac.pauses, ac.hovers, ac.movements):
        assert told(f(cut)) == told(f(plain))


def test_one_sequence_in_many_tasks(spark):
    """No exchange of events by their sequence: ranges and pieces share the work."""
    events = spark.range(200_000).selectExpr("if(id < 0, 'b|1|m', 'a|1|m') session_key", "cast(id * 20 + if(id % 97 = 0, 1000, 0) as double) t", "cast(id % 7 as double) x", "0D y", "id % 501 = 0 is_click", "cast(null as string) node", "id ord")
    cut = cut_deltas(events, ac.is_pause, 16)
    per_part = [r["count"] for r in cut.groupBy("part").count().collect()]
    assert len(per_part) == 16 and max(per_part) < 20_000
    assert cut.select("piece").distinct().count() > 200
    plan = ac.scan_events(cut)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(session_key" in line]
    assert moved and all("part" in line or "piece" in line for line in moved)
    assert ac.group_actions(events, long=1000).count() == ac.group_actions(events).count()


def test_objects_under_one_key_are_numbered_by_runs(spark, monkeypatch):
    from pointerflow.operators import ranges

    monkeypatch.setattr(ranges, "STRIDE", 3)
    rows = [("u|u|m", k * 2, i) for k in range(20) for i in range(k % 4)]
    got = numbered_together(spark.createDataFrame(rows, "session_key string, session_idx long, action_idx long")).orderBy("action_idx").collect()
    assert [r.action_idx for r in got] == list(range(len(rows))) and [r.session_idx for r in got] == [r[1] for r in rows]


def test_objects_that_share_a_key_are_calibrated_apart(spark, tmp_path):
    """Two objects without ids, each with one dwell of 1,200 ms."""
    moves = [[{"timestamp": t + at, "x": x, "y": 0} for t in range(0, 1201, 100)] for at, x in ((0, 0), (50, 3))]
    (tmp_path / "s.json").write_text(json.dumps([{"behavior_m": {"mouseMovements": m}} for m in moves]))
    deltas = ev.with_deltas(ev.valid_events(ev.explode_events(io.read_sessions(spark, str(tmp_path), ("behavior_m",)))))
    runs = th.run_hovers(deltas)
    assert [(r.session_key, r.dwell, r.valid, r.final) for r in runs.collect()] == [("unknown|unknown|behavior_m", 1200.0, True, True)] * 2
    assert th.percentiles_by_module(deltas, "dt").first().sequences == 2
    assert th.hover_percentiles(runs).first().n == 2 and th.hover_percentiles(runs, selected=True).first().p50 == 1200
    assert {r.n for r in th.threshold_sweep(deltas, runs).where("kind = 'dwell' and threshold <= 1000").collect()} == {2}


def test_sums_before(spark, monkeypatch):
    from pointerflow.operators import ranges

    monkeypatch.setattr(ranges, "STRIDE", 4)
    rnd = random.Random(1)
    rows = [(k, p, rnd.randint(0, 9)) for k in "ab" for p in rnd.sample(range(60), 25)]
    got = {(r.k, r.p): r.n_before for r in before(spark.createDataFrame(rows, "k string, p int, n long"), ["k"], "p", ["n"]).collect()}
    assert got == {(k, p): sum(n for j, q, n in rows if j == k and q < p) for k, p, _ in rows}


def test_ranges_keep_ties_and_order(spark):
    rows = [(k, float(v)) for k in (1, None) for v in [5] * 300 + list(range(100)) + [99] * 50]
    df = spark.createDataFrame(rows, "k int, v double")
    got = Ranges(df, ["k"], "v", 12).deal(df).select("k", "v", "part").distinct().orderBy("k", "v").collect()
    assert len(got) == 200 and all(a.part <= b.part for a, b in itertools.pairwise(got) if a.k == b.k) and len({r.part for r in got}) >= 4


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_average_ranks(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["a", "b", None]), float(rnd.choice([0, 0, 0, 1, 2, rnd.randint(-50, 50)])), rnd.randint(0, 1)) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v double, up int")
    got = {(r.k, r.v): (r.n, r.rank, r.ups) for r in st.average_rank(df, ["k"], "v", {"ups": F.col("up")}, parts).collect()}
    for k, v in {(k, v) for k, v, _ in rows}:
        same = [u for j, w, u in rows if j == k and w == v]
        less = sum(1 for j, w, _ in rows if j == k and w < v)
        assert got[k, v] == (len(same), less + (len(same) + 1) / 2, sum(same))
    assert len(got) == len({(k, v) for k, v, _ in rows})


def test_ranks_without_a_key_are_no_single_task(spark):
    pairs = spark.range(50_000).selectExpr("cast((id * 7919) % 50000 - 20000 as double) difference")
    row = st.wilcoxon_signed_rank(pairs).first()
    sizes = sorted(abs(d) for d in range(-20_000, 30_000) if d)
    assert (row.n, row.zeros, row.r_plus + row.r_minus) == (len(sizes), 1, len(sizes) * (len(sizes) + 1) / 2)
    ranks = st.average_rank(pairs, [], "difference", parts=8)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0] and "Window [" in plan
    assert not [line for line in plan.splitlines() if "windowspecdefinition" in line and "part#" not in line and "n_before" not in line and "_run" not in line and "rows" not in line]
    assert ranks.agg(F.max("rank")).first()[0] == 50_000


def test_exact_shares(spark):
    people = spark.range(3001).selectExpr("cast(id as string) participant_id")
    ordered = [r.participant_id for r in people.orderBy(sp.hash_order(5), "participant_id").collect()]
    split = {r.participant_id: r.split for r in sp.split_participants(people, 0.7, 5).collect()}
    assert [split[p] for p in ordered] == ["train"] * 2100 + ["test"] * 901
    for k in (1, 7, 3001, 4000):
        fold = {r.participant_id: r.fold for r in sp.group_folds(people, k, 5).collect()}
        sizes = [3001 // k + (i < 3001 % k) for i in range(k)]
        assert [fold[p] for p in ordered] == [i for i, n in enumerate(sizes) for _ in range(n)]
    assert sp.group_folds(people.where("false"), 3, 5).count() == 0
    with pytest.raises(Exception, match="fewer than two"):
        sp.split_participants(people.limit(1), 0.5, 1).collect()


@pytest.mark.parametrize(("few", "buckets"), [(1, 2), (5, 7), (50, 16), (10_000, 256)])
def test_quantiles_by_selection(spark, few, buckets):
    rnd = random.Random(few)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1.5, 1.5, rnd.gauss(0, 1e6), rnd.random(), None, -0.0]), float(rnd.randint(0, 3))) for _ in range(700)]
    rows += [("c", float("nan"), None), ("c", 2.0, None), ("d", None, None)]
    df = spark.createDataFrame(rows, "k string, u double, v double")
    points = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0)
    got = {(r.k, r.column_name): (r.n, str(r.quantiles)) for r in exact_quantiles(df, ["u", "v"], points, ["k"], buckets, few).collect()}
    shares = F.array(*map(F.lit, points))
    want = {}
    for r in df.groupBy("k").agg(*(f(c).alias(f"{c}{i}") for c in "uv" for i, f in enumerate((F.count, lambda c: F.percentile(c, shares))))).collect():
        want |= {(r.k, c): (r[f"{c}0"], str(r[f"{c}1"])) for c in "uv" if r[f"{c}0"]}
    assert got == want


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "v double")
    assert exact_quantiles(none, ["v"], [0.5]).count() == 0 and quantiles_by_column(none, ["v"], [0.5]) == {"v": [None]}
    with pytest.raises(ValueError, match="shares"):
        exact_quantiles(none, ["v"], [50])


def test_crossings_of_long_paths():
    rng = np.random.default_rng(3)
    for k in range(120):
        n = int(rng.integers(1, 200))
        x, y = (rng.normal(size=n).cumsum(), rng.normal(size=n).cumsum()) if k % 2 else (rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float))
        assert count_crossings(x, y, few=0, block=40) == count_crossings(x, y, few=1000)
    turn = np.arange(100_001) / 50
    assert count_crossings(turn * np.cos(turn), turn * np.sin(turn)) == 0
    assert count_crossings(np.append(np.arange(50_000.0), 25_000.5), np.append(np.zeros(50_000), 1.0)) == 0
