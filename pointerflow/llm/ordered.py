"""Ordered ranges of a key, for operators that need a global order."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LONG_SPAN = 2.0**64


@dataclass(frozen=True)
class Ranges:
    """``n`` ranges of nearly equal row counts, in ascending order of a key and,
    where one key fills more than a range, of a tie.

    Null keys come first and have the first ``nulls`` ranges (if none, a part of
    the first one).  ``bounds`` are upper bounds; a key that is ``k`` of them
    is divided into ``k`` ranges of its ties.
    """

    n: int
    nulls: int
    bounds: list[int]

    @classmethod
    def of(cls, df: DataFrame, key: str) -> Ranges:
        """From one mergeable quantile sketch, or two if null keys fill a range."""
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def sketch(parts: int) -> tuple[int, int, list[int]]:
            shares = F.array(*(F.lit(i / parts) for i in range(1, parts))) if parts > 1 else F.array(F.lit(0.5))
            row = df.select(F.count("*").alias("rows"), F.count(key).alias("known"), F.percentile_approx(key, shares, F.lit(20 * max(parts, 1))).alias("q")).first()
            return row.rows, row.known, list(row.q or ())[: max(parts - 1, 0)]

        rows, known, bounds = sketch(n)
        nulls = n * (rows - known) // rows if rows else 0
        return cls(n, nulls, sketch(n - nulls)[2] if nulls else bounds)

    def number(self, key: str, tie: str) -> Column:
        """Which range a row is in.  Bounds below a key are counted in two steps
        of about the root of their number: whole strides, then the rest."""
        part = lambda k: F.least(F.floor((F.col(tie) / F.lit(_LONG_SPAN) + 0.5) * k), k - 1)
        below = F.lit(0)
        if self.bounds:
            stride = math.isqrt(len(self.bounds)) + 1
            lesser = lambda array: F.size(F.filter(array, lambda b: b < F.col(key)))
            whole = lesser(F.lit(self.bounds[stride - 1 :: stride]).cast("array<bigint>")) * stride
            below = whole + lesser(F.slice(F.lit(self.bounds).cast("array<bigint>"), whole + 1, stride))
            hot = {b: k for b, k in Counter(self.bounds).items() if k > 1}
            if hot:
                often = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
                below = below + F.coalesce(part(F.try_element_at(often, F.col(key))), F.lit(0))
        return F.when(F.col(key).isNull(), part(F.lit(self.nulls)) if self.nulls > 1 else F.lit(0)).otherwise(below + self.nulls).cast("int")
