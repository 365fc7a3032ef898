"""Nested reports hold the tables they are composed of."""

from pyspark.sql import functions as F

from pointerflow.operators import analysis as an
from pointerflow.operators import metrics as rm
from pointerflow.operators import reports as rp
from pointerflow.operators import split as sp
from pointerflow.sources import fixtures as fx


def test_fit_report(spark):
    scores = spark.createDataFrame([(c, f, 0.1 * ((c * 7 + f) % 5), float(3 + c + f)) for c in range(4) for f in range(3)], "config_id int, fold_id int, val_loss double, best_epoch double")
    ranked = rm.rank_search(scores, [0, 1, 2])
    df = spark.createDataFrame([(f"p{i % 5}", f"p{i % 5}|{i}|m") for i in range(20)], "participant_id string, session_key string")
    splits = sp.split_participants(df, 0.6, 1)
    (row,) = rp.fit_report(df, splits, ranked, ranked.limit(1).select(F.lit(7).alias("sessions_truncated"))).collect()
    assert [c.config_id for c in row.configurations] == [r.config_id for r in ranked.orderBy("rank").collect()]
    assert row.best == row.configurations[0] and row.truncation.sessions_truncated == 7
    assert [(s.split, s.participants, s.n_rows) for s in row.sides] == [("test", 2, 8), ("train", 3, 12)]


def test_reports_of_metrics(spark, sf):
    m = fx.session_metrics(spark, sf)
    features = rm.feature_metrics(fx.predictions(spark, sf))
    (row,) = rp.reconstruction_report(m, features, run=spark.createDataFrame([(0.5, 12)], "best_mean_val_loss double, epochs_final int"), top=3).collect()
    assert row.sessions == m.count() and row.run.epochs_final == 12 and row.participant_id_mismatches == 0
    assert [f.feature for f in row.top_features] == [r.feature for r in rm.top_features(features, 3).collect()]
    assert sum(x.sessions for x in row.modules) == row.sessions
    (cut,) = rp.truncation_report(m, 150, top=4).collect()
    per = an.top_truncated(an.truncation_by_participant(an.with_truncation(m, 150)), 4).collect()
    assert [p.participant_id for p in cut.top_participants] == [p.participant_id for p in per] and cut.maxlen == 150
    assert [g.is_truncated for g in cut.session_groups] == [False, True] and sum(g.sessions for g in cut.session_groups) == cut.sessions
    assert sum(g.participants for g in cut.participant_groups) == m.select("participant_id").distinct().count()
