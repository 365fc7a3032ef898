"""Orders over many tasks: ranges of a value, and sums over the ranges before.

A window over a key with very many rows is one task.  Here the rows of a key are
dealt out by ranges of the ordering value, every range has a window of its own,
and what lies before a range is a sum over few totals.  Equal values always
share a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved

#: Tables of fewer rows are broadcast; beyond, a join shuffles them.
SMALL = 10_000
#: Ranges that are summed up together before their sums are summed up.
STRIDE = 4096


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the written table ``df`` has few rows, by a count."""
    return F.broadcast(df) if df.count() < SMALL else df


def key_of(by: list[str]) -> Column:
    """One column that tells keys apart; nulls are equal to nulls in it."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def splitters_below(cuts: Column, value: Column, parts: int) -> Column:
    """How many of the ascending splitters lie below the value: whole strides of
    about the root of their number first, then those within one."""
    stride = math.isqrt(parts) + 1
    lesser = lambda a: F.greatest(F.size(F.filter(a, lambda c: c < value)), F.lit(0))
    ends = F.transform(F.sequence(F.lit(stride), F.lit(max(parts, stride)), F.lit(stride)), lambda i: F.get(cuts, i - 1))
    whole = F.size(F.filter(ends, lambda c: c < value)) * stride
    return whole + lesser(F.slice(cuts, whole + 1, F.lit(stride)))


class Ranges:
    """Splitters of ``value`` for each key ``by`` from mergeable sketches,
    written once, so that every use deals rows out alike."""

    def __init__(self, df: DataFrame, by: list[str], value: str, parts: int | None = None):
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.by, self.value, self.parts = by, value, parts
        shares = F.array(*(F.lit(i / parts) for i in range(1, parts))) if parts > 1 else F.array(F.lit(1.0))
        cuts = F.percentile_approx(value, shares, F.lit(20 * parts))
        self.cuts = small(saved(df.groupBy(key_of(by).alias("range_key")).agg(cuts.alias("cuts")), "splitters"))

    def deal(self, df: DataFrame) -> DataFrame:
        """``df`` with ``range_key`` and ``part``, the number of splitters below
        the value."""
        part = F.when(F.col("cuts").isNull(), 0).otherwise(splitters_below(F.col("cuts"), F.col(self.value), self.parts))
        rows = df.withColumn("range_key", key_of(self.by))
        return rows.join(self.cuts, "range_key").withColumn("part", part).drop("cuts")


def before(totals: DataFrame, by: list[str], part: str, sums: list[str]) -> DataFrame:
    """``totals`` with, for each of ``sums``, its sum over the key's earlier
    parts as ``<name>_before``.  Runs of ``STRIDE`` parts are summed up apart,
    so even a key with very many parts is no single task."""
    run = totals.withColumn("part_run", F.expr(f"cast({part} as long) div {STRIDE}"))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy(*by, "part_run").orderBy(part)
    across = Window.partitionBy(*by).orderBy("part_run")
    runs = run.groupBy(*by, "part_run").agg(*(F.sum(c).alias(c) for c in sums))
    runs = runs.select(*by, "part_run", *(earlier(across, c).alias(f"{c}_runs") for c in sums))
    both = run.withColumns({f"{c}_before": earlier(within, c) for c in sums}).join(runs, [*by, "part_run"])
    return both.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_runs") for c in sums}).drop("part_run", *(f"{c}_runs" for c in sums))
