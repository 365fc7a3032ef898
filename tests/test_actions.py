"""Action grouping on hand-traced rows, and its independence of partitioning."""

import pytest
from pyspark.sql import functions as F

from pointerflow.operators import actions as ac
from pointerflow.operators import events as ev
from pointerflow.operators import features as fe
from pointerflow.sources import fixtures as fx

TRACE = [(0, 0, 0), (100, 5, 0), (600, 5, 0), (900, 6, 0), (1000, 6, 4), (1100, 6, 4), (1300, 9, 4), (2000, 12, 8), (2100, 40, 8), (2150, 40, 8, True), (2500, 41, 8)]


def frame(spark, rows, key="p|1|m"):
    data = [(key, float(r[0]), float(r[1]), float(r[2]), len(r) > 3, "<a>" if len(r) > 3 else None, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "session_key string, t double, x double, y double, is_click boolean, node string, ord long")


def test_worked_example(spark):
    got = ac.group_actions(frame(spark, TRACE)).orderBy("action_idx").collect()
    assert [(r.type, r.start, r.end, r.duration, r.distance) for r in got] == [
        ("mouse_movement", 0, 100, 100, 5), ("pause", 100, 900, 800, 1), ("mouse_movement", 900, 2000, 1000, 12), ("hover", 900, 2000, 1100, None), ("mouse_movement", 2000, 2100, 100, 28), ("click", None, None, None, None), ("pause", 2150, 2500, 350, 1),
    ]
    assert [tuple(p) for p in got[2].path] == [(6, 0, 900), (6, 4, 1000), (9, 4, 1300), (12, 8, 2000)]
    assert got[5].timestamp == 2150 and (got[1].x, got[1].y) == (5, 0)


def test_first_click_and_missing_places_give_no_action(spark):
    no_place = frame(spark, [(0, 1, 1), (5, 1, 1)], "q|1|m").withColumn("x", F.lit(None).cast("double"))
    events = frame(spark, [(0, 1, 1, True), (10, 1, 1)]).unionByName(no_place)
    assert ac.group_actions(events).count() == 0


def test_hover_flush_and_pause_discard(spark):
    rows = [(t, (t // 200) % 2, 0) for t in range(0, 1400, 200)]
    got = ac.hovers(ev.with_deltas(frame(spark, rows))).collect()
    assert [(r.start, r.end, r.flushed, r.made_at) for r in got] == [(0, 1200, True, 8)]
    assert ac.hovers(ev.with_deltas(frame(spark, [*rows, (1600, 0, 0)]))).count() == 0


def test_partitioning_and_batches_do_not_matter(spark, sf):
    events = fx.events(spark, sf)
    want = sorted(map(str, ac.group_actions(events.repartition(1)).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, ac.group_actions(events.repartition(7)).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nested_source_gives_the_same_events(spark, sf):
    nested = ev.explode_events(fx.raw_sessions(spark, sf))
    assert nested.count() == fx.events(spark, sf).count()
    assert nested.where("participant = 'unknown'").count() > 0


def test_short_paths_have_no_features(spark):
    a = ac.group_actions(frame(spark, [(0, 0, 0), (10, 3, 4), (20, 3, 8)]))
    row = fe.extract_features(a).collect()
    assert len(row) == 1 and row[0].direction_changes == 1 and row[0].action_duration == 20


def test_malformed_keys_raise(spark):
    df = spark.createDataFrame([("nokey",)], "session_key string")
    with pytest.raises(Exception, match="malformed key"):
        ev.with_participant_id(df).collect()
    assert ev.with_participant_id(df, strict=False).first().participant_id is None
