"""Reconstruction metrics over the long form (RM1-RM11).

Long form: session, participant, step, feature, y_true, y_pred, valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quantiles
from .quantiles import exact_quantiles

BINS = ("Q1 (shortest)", "Q2", "Q3", "Q4", "Q5 (longest)")


def improvement_pct(baseline: str = "mse_baseline", model: str = "mse_model") -> Column:
    return 100 * (F.col(baseline) - F.col(model)) / (F.col(baseline) + 1e-12)


def with_improved(m: DataFrame) -> DataFrame:
    return m.withColumn("improved", F.col("mse_model") < F.col("mse_baseline"))


def mean_baseline(train: DataFrame) -> DataFrame:
    return train.where("valid").groupBy("feature").agg(F.avg("y_true").alias("mean"))


def _square(a: str = "y_true", b: str = "y_pred") -> Column:
    return (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))


def session_mse(long: DataFrame, name: str = "mse", predicted: str = "y_pred") -> DataFrame:
    """Squared error over valid steps and all features; no valid step counts 1."""
    steps = F.greatest(F.count_if("valid"), F.lit(1))
    return long.groupBy("session").agg((F.coalesce(F.sum(F.when(F.col("valid"), _square(b=predicted))), F.lit(0.0)) / steps).alias(name))


def session_metrics(long: DataFrame, baseline: DataFrame) -> DataFrame:
    """Both errors, the improvement and the lengths of every session: one
    aggregation, as model and baseline share their rows."""
    both = long.join(baseline, "feature")
    steps = F.greatest(F.count_if("valid"), F.lit(1))
    error = lambda p: F.coalesce(F.sum(F.when(F.col("valid"), _square(b=p))), F.lit(0.0)) / steps
    out = both.groupBy("session", "participant").agg(error("y_pred").alias("mse_model"), error("mean").alias("mse_baseline"), F.count_distinct(F.when(F.col("valid"), F.col("step"))).alias("length"), F.count_distinct("step").alias("length_raw"))
    return out.withColumn("improvement_pct", improvement_pct())


def feature_metrics(long: DataFrame, accuracy: int | None = None, selected: bool = False) -> DataFrame:
    """Errors of each feature over valid steps, also relative to its spread; for
    very many steps, with ``accuracy`` of ``quantiles`` or, exactly, quartiles
    ``selected`` by rounds of counting."""
    d = F.col("y_true") - F.col("y_pred")
    q = [F.lit(None).cast("double")] * 2 if selected else quantiles("y_true", (0.25, 0.75), accuracy)
    per = long.where("valid").groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.avg("y_true").alias("mean"), F.stddev_pop("y_true").alias("std"), (F.max("y_true") - F.min("y_true")).alias("value_range"), (q[1] - q[0]).alias("iqr"))
    if selected:
        quartiles = exact_quantiles(long.where("valid"), ["y_true"], (0.25, 0.75), ["feature"])
        per = per.drop("iqr").join(quartiles.select("feature", (F.col("quantiles")[1] - F.col("quantiles")[0]).alias("iqr")), "feature", "left")
    per = per.withColumn("rmse", F.sqrt("mse"))
    per = per.withColumns({f"nrmse_{s}": F.when(F.col(c) > 0, F.col("rmse") / F.col(c)) for s, c in (("std", "std"), ("range", "value_range"), ("iqr", "iqr"))})
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("nrmse_std"), "feature")))  # one row a feature


def top_features(metrics: DataFrame, n: int = 5) -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last("nrmse_std"), "feature").limit(n)


def fit_length_bins(lengths: DataFrame, length: str = "length") -> DataFrame:
    """bin, low, high: quintiles of train lengths, the outer ends open.

    An inner edge not above the one before is moved 1e-6 beyond it.
    """
    q = F.percentile(length, F.array(*(F.lit(i / 5) for i in range(6))))
    moved = lambda before, e: F.when(e > before, e).otherwise(before + 1e-6)
    one = lengths.agg(q.alias("q")).select(F.col("q")[1].alias("e1"), F.col("q"))
    for i in (2, 3, 4):
        one = one.withColumn(f"e{i}", moved(F.col(f"e{i - 1}"), F.col("q")[i]))
    edges = [F.lit(float("-inf")), *(F.col(f"e{i}") for i in range(1, 5)), F.lit(float("inf"))]
    rows = F.array(*(F.struct(F.lit(i + 1).alias("bin"), F.lit(BINS[i]).alias("label"), edges[i].alias("low"), edges[i + 1].alias("high")) for i in range(5)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def metrics_by_length_bin(m: DataFrame, bins: DataFrame, length: str = "length") -> DataFrame:
    """Summary of the sessions in each (low, high] bin; empty bins stay."""
    joined = F.broadcast(bins).alias("b").join(m.alias("m"), (F.col(f"m.{length}") > F.col("b.low")) & (F.col(f"m.{length}") <= F.col("b.high")), "right")  # five rows
    per = joined.groupBy("bin").agg(F.count("*").alias("n"), F.avg("mse_model").alias("mse_mean"), F.stddev_samp("mse_model").alias("mse_std"), F.avg("improvement_pct").alias("improvement_mean"))
    return bins.select("bin", "label").join(per, "bin", "left").fillna(0, ["n"])


def reference_std(long: DataFrame, train_sessions: DataFrame) -> DataFrame:
    """Population std, mean and count of each feature over the valid steps of
    train sessions, or of all sessions if those have none."""
    marks = train_sessions.select("session").distinct().withColumn("train", F.lit(True))
    rows = long.where("valid").join(marks, "session", "left").withColumn("v", F.when(F.col("train"), F.col("y_true")))
    pick = lambda f: F.coalesce(f("v"), f("y_true"))
    n = F.count("v")
    return rows.groupBy("feature").agg(pick(F.stddev_pop).alias("std"), pick(F.avg).alias("mean"), F.when(n > 0, n).otherwise(F.count("y_true")).alias("n"))


def grouped_nrmse(long: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """Root mean squared error over the reference std for each group and
    feature, with the group's sessions and valid steps; wide by ``widen``."""
    per = long.where("valid").groupBy(by, "feature").agg(F.sqrt(F.sum(_square()) / F.count("*")).alias("rmse"), F.count("*").alias("n"), F.count_distinct("session").alias("sessions"))
    return per.join(reference.select("feature", F.col("std").alias("ref_std")), "feature").withColumn("nrmse", F.when(F.col("ref_std") > 1e-12, F.col("rmse") / F.col("ref_std"))).select(by, "feature", "n", "sessions", "nrmse")


def participant_nrmse(long: DataFrame, reference: DataFrame) -> DataFrame:
    return grouped_nrmse(long, reference, "participant")


def session_nrmse(long: DataFrame, reference: DataFrame) -> DataFrame:
    return grouped_nrmse(long, reference, "session")


def widen(rows: DataFrame, by: str, features: list[str], value: str = "nrmse") -> DataFrame:
    return rows.groupBy(by).pivot("feature", features).agg(F.first(value))


def rank_search(scores: DataFrame, folds: list[int]) -> DataFrame:
    """Configurations by mean loss, its spread and id, with the epochs that a
    final fit should take (median of the best ones, rounded half to even)."""
    finite = F.when(~F.isnan("best_epoch") & (F.abs("best_epoch") != float("inf")), F.col("best_epoch"))
    per = scores.groupBy("config_id").agg(F.avg("val_loss").alias("mean_loss"), F.stddev_pop("val_loss").alias("std_loss"), F.median(finite).alias("median_epoch"), *(F.max(F.when(F.col("fold_id") == f, F.col("val_loss"))).alias(f"fold_{f}") for f in folds))
    per = per.withColumn("final_epochs", F.greatest(F.lit(1), F.bround("median_epoch").cast("int")))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.round("mean_loss", 12), F.round("std_loss", 12), "config_id")))  # one row a configuration
