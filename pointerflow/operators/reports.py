"""Nested reports of one row, composed of the tables of the analyses (T13).

Lists hold groups, bins, top rows: tables whose size does not follow the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analysis as an
from .metrics import top_features
from .split import participant_mismatch, split_summary


def _list(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """One row with the rows of ``df`` as a list of structs in ``order``."""
    keyed = df.select(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))).alias("key"), F.struct(*df.columns).alias("row"))
    ordered = F.array_sort(F.collect_list(F.struct("key", "row")))
    return keyed.agg(F.transform(ordered, lambda r: r["row"]).alias(name))


def _beside(*tables: DataFrame) -> DataFrame:
    """Tables of one row, side by side."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(t)
    return out


def reconstruction_report(m: DataFrame, feature_metrics: DataFrame | None = None, length_bins: DataFrame | None = None, run: DataFrame | None = None, top: int = 5) -> DataFrame:
    """What is said of a run's test sessions: the numbers of ``overall_summary``,
    rows whose participant is not that of their session, the modules and, where
    given, the bins of length, the ``top`` features by error and the ``run``'s
    own row, each in a field of its own."""
    mismatched = participant_mismatch(m).select(F.col("mismatches").alias("participant_id_mismatches"))
    parts = [an.overall_summary(m), mismatched, _list(an.by_module(m), "modules", F.col("module"))]
    if length_bins is not None:
        parts.append(_list(length_bins, "length_bins", F.col(length_bins.columns[0])))
    if feature_metrics is not None:
        best = top_features(feature_metrics, top)
        parts.append(_list(best, "top_features", F.col("nrmse_std").isNull(), -F.col("nrmse_std"), F.col("feature")))
    if run is not None:
        parts.append(run.limit(1).select(F.struct(*run.columns).alias("run")))
    return _beside(*parts)


def truncation_report(m: DataFrame, maxlen: int, top: int = 10) -> DataFrame:
    """What sequences cut at ``maxlen`` lose: totals, sessions cut or whole,
    participants with and without cut sessions, and the ``top`` participants."""
    cut = an.with_truncation(m, maxlen)
    per = an.truncation_by_participant(cut)
    totals = an.truncation_summary(cut).withColumn("maxlen", F.lit(maxlen))
    most = _list(an.top_truncated(per, top), "top_participants", -F.col("steps_removed"), -F.col("truncated"), F.col("participant_id"))
    groups = _list(an.truncation_groups(cut), "session_groups", F.col("is_truncated"))
    people = _list(an.truncation_participant_groups(per), "participant_groups", F.col("has_truncation"))
    return _beside(totals, groups, people, most)


def fit_report(df: DataFrame, splits: DataFrame, inner: DataFrame, truncation: DataFrame | None = None) -> DataFrame:
    """What is said of a run: the configuration that ``rank_search`` puts first
    (``best``) and all of them, both sides' participants, sessions and rows, and,
    where given, the truncation of the train sessions."""
    ranked = _list(inner, "configurations", F.col("rank"))
    best = ranked.select(F.get("configurations", F.lit(0)).alias("best"), "configurations")
    sides = _list(split_summary(df, splits).where("split is not null"), "sides", F.col("split"))
    return _beside(best, sides, *([truncation.limit(1).select(F.struct(*truncation.columns).alias("truncation"))] if truncation is not None else []))
