"""Analysis of session metrics and questionnaires (AN1-AN16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import find_column, parse_sessnum, safe_float
from .events import with_session_parts

SCORES = ("EADS_Depressao", "EADS_Ansiedade", "EADS_Stress")


def _sessions() -> list[Column]:
    return [
        F.count("session_id").alias("sessions"), F.avg("mse_model").alias("mse_model_mean"), F.avg("mse_baseline").alias("mse_baseline_mean"), F.avg("improvement_pct").alias("improvement_mean"), F.median("improvement_pct").alias("improvement_median"),
        (100.0 * F.count_if(F.col("mse_model") < F.col("mse_baseline")) / F.count("*")).alias("pct_improved"), F.avg("length").alias("length_mean"), F.avg("length_raw").alias("length_raw_mean"),
    ]


def by_participant(m: DataFrame) -> DataFrame:
    return m.where("participant_id is not null").groupBy("participant_id").agg(*_sessions())


def by_module(m: DataFrame) -> DataFrame:
    keyed = with_session_parts(m, "session_id").where("key_module <> ''")
    return keyed.groupBy(F.col("key_module").alias("module")).agg(*_sessions())


def overall_summary(m: DataFrame) -> DataFrame:
    """One row: over sessions, and over the means of participants."""
    people = by_participant(m).agg(F.count("*").alias("participants"), F.avg("improvement_mean").alias("participant_improvement_mean"), F.median("improvement_mean").alias("participant_improvement_median"), F.count_if(F.col("improvement_mean") > 0).alias("participants_improved"))
    return m.agg(*_sessions()).crossJoin(people)


def questionnaire_scores(q: DataFrame, scale: float = 1.0) -> DataFrame:
    """participant_id, sessnum and the mean of each score, rows with none left
    out.  Columns are found by name, ids trimmed, scores cast leniently."""
    pid, sess = find_column(q, ["anonymized id", "participant", "processnumber"]), find_column(q, ["session id", "session"])
    names = [find_column(q, [s]) for s in SCORES]
    rows = q.select(F.trim(F.col(f"`{pid}`").cast("string")).alias("participant_id"), parse_sessnum(f"`{sess}`").alias("sessnum"), *((safe_float(f"`{n}`") * scale).alias(s) for n, s in zip(names, SCORES)))
    return rows.dropna("all", subset=list(SCORES)).groupBy("participant_id", "sessnum").agg(*(F.avg(s).alias(s) for s in SCORES))


def link_scores(m: DataFrame, scores: DataFrame) -> DataFrame:
    """Session metrics with the scores of the same participant and session."""
    keyed = with_session_parts(m, "session_id").withColumn("sessnum", parse_sessnum("key_session")).drop("key_participant", "key_session", "key_module")
    has = F.col(SCORES[0]).isNotNull() & F.col(SCORES[1]).isNotNull() & F.col(SCORES[2]).isNotNull()
    return keyed.join(scores, ["participant_id", "sessnum"], "left").withColumn("has_eads", has)


def participant_scores(linked: DataFrame) -> DataFrame:
    return linked.groupBy("participant_id").agg(F.count("*").alias("sessions"), F.count_if("has_eads").alias("linked"), F.avg("improvement_pct").alias("improvement_mean"), F.avg("mse_model").alias("mse_model_mean"), *(F.avg(s).alias(s) for s in SCORES))


def link_summary(linked: DataFrame) -> DataFrame:
    people = linked.groupBy("participant_id").agg(F.max("has_eads").alias("some")).agg(F.count("*").alias("participants"), F.count_if("some").alias("participants_linked"))
    return linked.agg(F.count("*").alias("sessions"), F.count_if("has_eads").alias("matched"), (100.0 * F.count_if("has_eads") / F.count("*")).alias("pct_matched")).crossJoin(people)


def participant_eads(scores: DataFrame) -> DataFrame:
    return scores.groupBy("participant_id").agg(*(F.avg(s).alias(s) for s in SCORES))


def behavior_profiles(features: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each feature over a session, then over a participant's sessions."""
    keyed = with_session_parts(features)
    per = keyed.groupBy("key_participant", "key_session").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns))
    return per.groupBy(F.col("key_participant").alias("participant_id")).agg(F.count("*").alias("sessions"), *(F.avg(c).alias(c) for c in columns))


def join_profiles(profiles: DataFrame, scores: DataFrame) -> DataFrame:
    """Profiles with the scores of their participants; an error if none match."""
    joined = profiles.join(scores, "participant_id")
    if joined.isEmpty():
        raise ValueError("no participant has both a profile and scores")
    return joined


def with_truncation(m: DataFrame, maxlen: int) -> DataFrame:
    over = F.greatest(F.col("length_raw") - maxlen, F.lit(0))
    return m.withColumns({"is_truncated": F.col("length_raw") > maxlen, "steps_removed": over})


def truncation_groups(m: DataFrame) -> DataFrame:
    i = "improvement_pct"
    return m.groupBy("is_truncated").agg(F.count("*").alias("sessions"), F.avg(i).alias("improvement_mean"), F.median(i).alias("improvement_median"), F.stddev_samp(i).alias("improvement_std"), F.avg("mse_model").alias("mse_model_mean"), F.avg("mse_baseline").alias("mse_baseline_mean"), F.sum("steps_removed").alias("steps_removed"))


def truncation_by_participant(m: DataFrame) -> DataFrame:
    """One pass of conditional means instead of a join of filtered groups."""
    i, cut = F.col("improvement_pct"), F.col("is_truncated")
    out = m.groupBy("participant_id").agg(F.count("*").alias("sessions"), F.count_if(cut).alias("truncated"), F.sum("steps_removed").alias("steps_removed"), F.avg(i).alias("improvement_mean"), F.median(i).alias("improvement_median"), F.avg(F.when(cut, i)).alias("truncated_mean"), F.avg(F.when(~cut, i)).alias("whole_mean"))
    return out.withColumns({"rate": F.col("truncated") / F.col("sessions"), "difference": F.col("truncated_mean") - F.col("whole_mean")})


def truncation_participant_groups(per: DataFrame) -> DataFrame:
    return per.groupBy((F.col("truncated") > 0).alias("has_truncation")).agg(F.count("*").alias("participants"), F.avg("improvement_mean").alias("mean_of_means"), F.median("improvement_mean").alias("median_of_means"), F.avg("rate").alias("rate_mean"))


def top_truncated(per: DataFrame, n: int = 10) -> DataFrame:
    return per.orderBy(F.desc("steps_removed"), F.desc("truncated"), "participant_id").limit(n)


def truncation_summary(m: DataFrame) -> DataFrame:
    cut = F.count_if("is_truncated")
    return m.agg(F.count("*").alias("sessions"), cut.alias("truncated"), (100.0 * cut / F.count("*")).alias("pct_truncated"), F.sum("length_raw").alias("steps"), F.sum("steps_removed").alias("steps_removed"), (100.0 * F.sum("steps_removed") / F.sum("length_raw")).alias("pct_removed"))
