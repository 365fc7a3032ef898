"""Rank tests and false-discovery control (ST1-ST8).

Ranks, sums and counts are Spark aggregates over distinct values; only the
probabilities of the few test rows are computed by a helper, as neither Spark
nor SQL has the error function.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .quantiles import exact_quantiles, quantiles_by_column
from .ranges import Ranges, before


def paired_participants(m: DataFrame) -> DataFrame:
    per = m.where("participant_id is not null").groupBy("participant_id").agg(F.avg("mse_model").alias("model"), F.avg("mse_baseline").alias("baseline"))
    return per.withColumn("difference", F.col("baseline") - F.col("model"))


def paired_summary(pairs: DataFrame, selected: bool = False) -> DataFrame:
    """Means, the median of the differences (for very many pairs ``selected`` by
    rounds of counting) and the share that improved."""
    median = F.lit(quantiles_by_column(pairs, ["difference"], [0.5])["difference"][0]).cast("double") if selected else F.median("difference")
    return pairs.agg(F.count("*").alias("n"), F.avg("model").alias("model_mean"), F.avg("baseline").alias("baseline_mean"), F.avg("difference").alias("difference_mean"), median.alias("difference_median"), (100.0 * F.count_if(F.col("difference") > 0) / F.count("*")).alias("pct_improved"))


def average_rank(df: DataFrame, by: list[str], value: str, weights: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """by, value, n (rows tied), rank (their mean rank) and the summed weights.

    Rows are first counted by distinct value, in the only pass over ``df``, and
    the counts written.  The values of a key are dealt out by ranges (``parts`` of them, as many as shuffle partitions by default), so a
    key with very many values is no single task: a range ranks its own values,
    and the rows in the ranges before it are added.  Ties share a range.
    """
    weights = weights or {}
    counts = saved(df.groupBy(*by, value).agg(F.count("*").alias("n"), *(F.sum(w).alias(k) for k, w in weights.items())), "rank-counts")
    ranges = Ranges(counts, by, value, parts)
    counts = ranges.deal(counts)
    totals = counts.groupBy("range_key", "part").agg(F.sum("n").alias("rows"))
    totals = before(totals, ["range_key"], "part", ["rows"]).select("range_key", "part", "rows_before")
    within = Window.partitionBy("range_key", "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("n").over(within), F.lit(0))
    ranked = counts.withColumn("earlier", earlier).join(totals, ["range_key", "part"])
    return ranked.withColumn("rank", F.col("rows_before") + F.col("earlier") + (F.col("n") + 1) / 2).select(*by, value, "n", *weights, "rank")


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def signed_rank_counts(n: int) -> list[int]:
    """How many subsets of 1..n have each sum."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for s in range(len(counts) - 1, k - 1, -1):
            counts[s] += counts[s - k]
    return counts


def signed_rank_p(n: int, r_plus: float, ties: float, dropped: bool, alternative: str = "two-sided") -> float | None:
    """Exact up to 50 pairs without zeros or ties, else the normal limit with
    tie correction."""
    if n < 5:
        return None
    if n <= 50 and not ties and not dropped:
        counts = signed_rank_counts(n)
        r = int(round(r_plus))
        low, high = sum(counts[: r + 1]) / 2**n, sum(counts[r:]) / 2**n
    else:
        mean, sd = n * (n + 1) / 4, math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
        if not sd:
            return None
        z = (r_plus - mean) / sd
        low, high = _upper(-z), _upper(z)
    return min(1.0, {"two-sided": 2 * min(low, high), "greater": high, "less": low}[alternative])


def wilcoxon_signed_rank(pairs: DataFrame, difference: str = "difference", alternative: str = "two-sided") -> DataFrame:
    """One row: n, zeros, r_plus, r_minus, statistic, p_value."""
    d = F.col(difference)
    zeros = pairs.agg(F.count_if(d == 0).alias("zeros"))
    sizes = pairs.where(d.isNotNull() & (d != 0)).select(F.abs(d).alias("size"), (d > 0).cast("int").alias("up"))
    ranks = average_rank(sizes, [], "size", {"ups": F.col("up")})
    sums = ranks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("ups")), F.lit(0.0)).alias("r_plus"), F.coalesce(F.sum(F.col("rank") * (F.col("n") - F.col("ups"))), F.lit(0.0)).alias("r_minus"), F.coalesce(F.sum(F.pow("n", F.lit(3)) - F.col("n")), F.lit(0.0)).alias("ties"))
    one = sums.crossJoin(zeros).withColumn("statistic", F.least("r_plus", "r_minus") if alternative == "two-sided" else F.col("r_plus"))

    @F.pandas_udf("double")
    def p(n: pd.Series, r: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(int(a), b, c, bool(z), alternative) for a, b, c, z in zip(n, r, ties, zeros)], dtype="float64")

    return one.withColumn("p_value", p("n", "r_plus", "ties", "zeros")).drop("ties")


def high_low_groups(df: DataFrame, targets: list[str], low: float = 0.25, high: float = 0.75, selected: bool = False) -> DataFrame:
    """Long form target, value and the other columns, with ``is_low`` and
    ``is_high``; ties at both bounds belong, so a row may be both.  For very
    many rows the bounds are ``selected`` by rounds of counting."""
    others = [c for c in df.columns if c not in targets]
    long = df.select(*others, F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("score")) for t in targets))).alias("t")).select(*others, "t.*").where("score is not null")
    if selected:
        at = exact_quantiles(df, targets, (low, high)).select(F.col("column_name").alias("target"), F.col("quantiles")[0].alias("q_low"), F.col("quantiles")[1].alias("q_high"))
        q = F.broadcast(at)  # a row a target
    else:
        q = long.groupBy("target").agg(F.percentile("score", F.lit(low)).alias("q_low"), F.percentile("score", F.lit(high)).alias("q_high"))
    return long.join(q, "target").withColumns({"is_low": F.col("score") <= F.col("q_low"), "is_high": F.col("score") >= F.col("q_high")})


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("target").agg(F.count("*").alias("n"), F.count_if("is_low").alias("n_low"), F.count_if("is_high").alias("n_high"), F.max("q_low").alias("q_low"), F.max("q_high").alias("q_high"))


def mann_whitney_p(u: float, a: int, b: int, ties: float) -> float | None:
    """Two-sided normal limit with tie and continuity correction."""
    n = a + b
    var = a * b / 12 * ((n + 1) - ties / (n * (n - 1))) if n > 1 else 0
    if var <= 0:
        return 1.0 if n > 1 else None
    z = (max(u, a * b - u) - a * b / 2 - 0.5) / math.sqrt(var)
    return min(1.0, 2 * _upper(z))


def rank_biserial(u: str, a: str, b: str) -> Column:
    n = F.col(a) * F.col(b)
    return F.when(n > 0, 1 - 2 * F.col(u) / n)


def mann_whitney(groups: DataFrame, features: list[str], least: int = 3) -> DataFrame:
    """Low against high for each target and feature: sizes, means, medians, U of
    the low side, rank-biserial effect and p.

    Statistics are null if a side has fewer than ``least`` values.
    """
    sides = groups.select("target", F.explode(F.filter(F.array(F.when(F.col("is_low"), F.lit(1)), F.when(F.col("is_high"), F.lit(0))), lambda s: s.isNotNull())).alias("low"), *features)
    long = sides.select("target", "low", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("f")).select("target", "low", "f.*").where("v is not null")
    side = lambda s, f, name: f(F.when(F.col("low") == s, F.col("v"))).alias(name)
    shape = long.groupBy("target", "feature").agg(side(1, F.count, "n_low"), side(0, F.count, "n_high"), side(1, F.avg, "mean_low"), side(0, F.avg, "mean_high"), side(1, F.median, "median_low"), side(0, F.median, "median_high"))
    ranks = average_rank(long, ["target", "feature"], "v", {"lows": F.col("low")})
    sums = ranks.groupBy("target", "feature").agg(F.sum(F.col("rank") * F.col("lows")).alias("rank_sum"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    enough = (F.col("n_low") >= least) & (F.col("n_high") >= least)
    u = F.col("rank_sum") - F.col("n_low") * (F.col("n_low") + 1) / 2

    @F.pandas_udf("double")
    def p(u: pd.Series, a: pd.Series, b: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(w) else mann_whitney_p(w, int(x), int(y), t) for w, x, y, t in zip(u, a, b, ties)], dtype="float64")

    out = shape.join(sums, ["target", "feature"]).withColumn("u_low", F.when(enough, u)).withColumn("effect", rank_biserial("u_low", "n_low", "n_high"))
    return out.withColumn("p_value", p("u_low", "n_low", "n_high", "ties")).drop("rank_sum", "ties")


def fdr_bh(df: DataFrame, by: str = "target", p: str = "p_value", level: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg within each group over the p values that are there."""
    known = F.col(p).isNotNull()
    rank = F.row_number().over(Window.partitionBy(by, known).orderBy(p, "feature"))
    n = F.count(p).over(Window.partitionBy(by))
    raw = df.withColumn("raw", F.when(known, F.col(p) * n / rank))
    down = Window.partitionBy(by, F.col(p).isNotNull()).orderBy(F.desc(p), F.desc("feature")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.when(F.col(p).isNotNull(), F.least(F.greatest(F.min("raw").over(down), F.lit(0.0)), F.lit(1.0)))
    return raw.withColumn("q_value", q).withColumn("significant", F.coalesce(F.col("q_value") < level, F.lit(False))).drop("raw")
