"""How often operators compute the rows they are given."""

import pytest
from pyspark.sql import functions as F

from pointerflow.operators import split as sp
from pointerflow.operators import stats as st
from pointerflow.operators.quantiles import exact_quantiles
from pointerflow.plans import queries as plans
from pointerflow.sources import io


@pytest.fixture
def counted(spark):
    """Rows of a frame, and a counter of how many were computed."""

    def of(df):
        seen = spark.sparkContext.accumulator(0)

        def tell(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(tell, df.schema), seen

    return of


def test_ranks_take_one_pass(spark, counted):
    df, seen = counted(spark.range(1000).selectExpr("id % 3 k", "cast(id % 10 as double) v"))
    got = {(r.k, r.v): (r.n, r["rank"]) for r in st.average_rank(df, ["k"], "v", {"ups": F.col("v")}, 4).collect()}
    assert len(got) == 30 and got[0, 0.0] == (34, 17.5) and seen.value == 1000


@pytest.mark.parametrize("few", [10_000, 10])
def test_quantiles_take_one_pass(spark, counted, few):
    df, seen = counted(spark.range(5000).selectExpr("id % 2 k", "cast(id as double) v", "cast(id % 7 as double) w"))
    got = {(r.k, r.column_name): r.quantiles for r in exact_quantiles(df, ["v", "w", "k"], [0.25, 0.5], ["k"], 8, few).collect()}
    want = df.groupBy("k").agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5))).alias(c) for c in ("v", "w")))
    assert seen.value == 5000 and got[1, "k"] == [1, 1]
    assert {(r.k, c): r[c] for r in want.collect() for c in ("v", "w")} == {k: v for k, v in got.items() if k[1] != "k"}


def test_splits_take_one_pass(spark, counted, tmp_path):
    df, seen = counted(spark.range(900).selectExpr("concat('P', id % 90) participant_id", "concat('P', id % 90, '|', id % 180) session_key"))
    splits = sp.split_participants(df, 0.8, 7)
    assert splits.count() == 90 and seen.value == 900
    io.write_split(df, splits, str(tmp_path / "split"))
    assert seen.value == 1800 and io.read_participants(spark, str(tmp_path / "split" / "train_participants")).count() == 72
    got = {r.split: (r.participants, r.sessions, r.n_rows) for r in spark.read.json(str(tmp_path / "split" / "summary")).collect()}
    assert got == {"train": (72, 144, 720), "test": (18, 36, 180), None: (90, 180, 900)}
    assert {r.split: (r.participants, r.sessions, r.n_rows) for r in sp.split_summary(df, splits).collect()} == got


@pytest.mark.parametrize("name", ["pr1_data_quality_by_selection", "pr6_to_pr9_fit_scaling", "pr11_transform_held_out", "st5_mann_whitney_p"])
def test_features_are_computed_once(spark, sf, counted, monkeypatch, name):
    whole = plans.fe.extract_features
    seen = []

    def extract(actions):
        df, n = counted(whole(actions))
        seen.append(n)
        return df

    monkeypatch.setattr(plans.fe, "extract_features", extract)
    plans.QUERIES[name](spark, sf).collect()
    assert [n.value for n in seen] == [plans.features_of(spark, sf).count()]
