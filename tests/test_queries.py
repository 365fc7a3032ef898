"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ("pf1_explode_events", "ac2_pauses", "ac4_hovers", "ac6_actions", "ac7_collapse_hovers", "th2_run_hovers", "th6_threshold_sweep", "fe5_fe6_features", "sp2_split_stratified", "pr6_to_pr9_fit_scaling", "sq2_prepare_sequences_pre", "rm3_session_metrics", "rm7_metrics_by_length_bin", "an5_link_scores", "an13_truncation_by_participant", "st2_wilcoxon", "st5_st6_mann_whitney", "st7_fdr_bh", "io2_io3_action_sequences")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("-" if r[i] is None else f"{r[i] + 0.0:.5f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    twin = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, twin.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_twins_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
