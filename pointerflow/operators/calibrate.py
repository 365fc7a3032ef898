"""Threshold calibration over gaps and dwells (TH1-TH6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quantiles
from .events import recorded, recorded_by
from .quantiles import exact_quantiles

POINTS = (50, 75, 90, 95, 99)


def percentiles(c: str, accuracy: int | None = None) -> list:
    q = quantiles(c, [p / 100 for p in POINTS], accuracy)
    return [q[i].alias(f"p{p}") for i, p in enumerate(POINTS)]


def _summary(rows: DataFrame, c: str, accuracy: int | None, selected: bool) -> DataFrame:
    """n and the percentiles of all rows, in one of three ways: exact in one
    task, from sketches of an ``accuracy``, or exact by ``exact_quantiles``."""
    if not selected:
        return rows.agg(F.count("*").alias("n"), *percentiles(c, accuracy))
    q = exact_quantiles(rows, [c], [p / 100 for p in POINTS]).select(*(F.col("quantiles")[i].alias(f"p{p}") for i, p in enumerate(POINTS)))
    return rows.agg(F.count("*").alias("n")).join(q, F.lit(True), "left")  # one row each


def gap_percentiles(deltas: DataFrame, accuracy: int | None = None, selected: bool = False) -> DataFrame:
    """Percentiles of all gaps; for very many, with ``accuracy`` of ``quantiles``
    or, exactly, ``selected`` by rounds of counting."""
    return _summary(deltas.where("dt is not null"), "dt", accuracy, selected)


def run_hovers(deltas: DataFrame, radius: float = 10.0, least_ms: float = 1000.0) -> DataFrame:
    """Dwells by the distance from event to event, ended by a far move (before
    it), a click (at it) or the sequence's end; ``valid`` if long enough.

    ``final`` marks a dwell that the end closes.  Session objects that share a
    key are sequences of their own.
    """
    keys = recorded_by(deltas)
    steps = deltas.where("event_idx > 1").withColumn("near", F.col("dist") < radius)
    # a near click ends its run; a far event stands between runs
    ends = F.when(~F.col("near") | F.col("is_click"), 1).otherwise(0)
    run = F.coalesce(F.sum(ends).over(recorded(deltas, "event_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = steps.withColumn("run", run).withColumn("last_idx", F.max("event_idx").over(Window.partitionBy(*keys)))
    runs = marked.where("near").groupBy(*keys, "run").agg(F.min("prev_t").alias("start"), F.max("t").alias("end"), F.max("event_idx").alias("at"), F.max("last_idx").alias("last_idx"), F.max_by("is_click", "event_idx").alias("clicked"))
    final = (F.col("at") == F.col("last_idx")) & ~F.col("clicked")
    dwell = F.col("end") - F.col("start")
    return runs.select(*keys, "start", "end", dwell.alias("dwell"), (dwell >= least_ms).alias("valid"), final.alias("final"))


def hover_percentiles(runs: DataFrame, legacy_double_count: bool = False, accuracy: int | None = None, selected: bool = False) -> DataFrame:
    """Percentiles of all candidates; the older count takes a valid dwell that
    the sequence's end closes twice."""
    if legacy_double_count:
        runs = runs.unionByName(runs.where("valid and final"))
    return _summary(runs, "dwell", accuracy, selected)


def valid_hover_ratio(runs: DataFrame, legacy_double_count: bool = False) -> DataFrame:
    n = F.count("*") + (F.count_if(F.col("valid") & F.col("final")) if legacy_double_count else 0)
    return runs.agg(F.count_if("valid").alias("valid"), n.alias("candidates"), F.try_divide(F.count_if("valid"), n).alias("ratio"))


def percentiles_by_module(rows: DataFrame, value: str) -> DataFrame:
    """Percentiles of each recorded sequence, averaged over the sequences of a module."""
    each = rows.where(F.col(value).isNotNull()).groupBy(*recorded_by(rows)).agg(*percentiles(value))
    return each.groupBy(F.get(F.split("session_key", r"\|"), F.lit(2)).alias("module")).agg(F.count("*").alias("sequences"), *(F.avg(f"p{p}").alias(f"p{p}") for p in POINTS))


def threshold_sweep(deltas: DataFrame, runs: DataFrame, gaps=range(100, 1100, 100), dwells=range(500, 2500, 250)) -> DataFrame:
    """Gaps over, and valid dwells of at least, each threshold; one pass each."""
    def counts(df: DataFrame, kind: str, c: str, values, over) -> DataFrame:
        wide = df.agg(*(F.count_if(over(F.col(c), v)).alias(str(v)) for v in values))
        return wide.select(F.lit(kind).alias("kind"), F.explode(F.array(*(F.struct(F.lit(v).alias("threshold"), F.col(str(v)).alias("n")) for v in values))).alias("r")).select("kind", "r.*")

    return counts(deltas, "gap", "dt", gaps, lambda c, v: c > v).unionByName(counts(runs.where("valid"), "dwell", "dwell", dwells, lambda c, v: c >= v))
