"""Correlations of very many columns from blocks of co-moments (PR12).

An aggregate for each pair of columns is half a million of them for a thousand
columns.  Here a task adds up matrix products of its Arrow batches, one set of
matrices whatever its rows, and tells them row by row of the matrices; rows of
equal number are added in one place each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums over the rows that know both columns: their number, the first column,
#: its squares, the second, its squares, and the products.
SUMS = ("n", "x", "xx", "y", "yy", "xy")


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """place and, for the pairs of that column with each column, the ``SUMS`` of
    the rows that know both, about the columns' means."""
    known = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select(*known)
    means = [0.0 if m is None or not np.isfinite(m) else m for m in rows.agg(*(F.avg(f"c{i}") for i in range(len(columns)))).first()]
    schema = pa.schema([("place", pa.int32()), *((s, pa.list_(pa.float64())) for s in SUMS)])
    fields = "place int, " + ", ".join(f"{s} array<double>" for s in SUMS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(columns)
        n, x, xx, xy = (np.zeros((m, m)) for _ in range(4))
        read = 0
        for batch in batches:
            read += batch.num_rows
            there = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], float)
            values = np.array([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            values = np.where(there > 0, values - np.array(means)[:, None], 0.0)
            with np.errstate(invalid="ignore"):
                n += there @ there.T
                x += values @ there.T
                xx += (values * values) @ there.T
                xy += values @ values.T
        for i in range(m if read else 0):
            arrays = (n[i], x[i], xx[i], x[:, i], xx[:, i], xy[i])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([a], pa.list_(pa.float64())) for a in arrays)], schema=schema)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((i, [batch.column(s)[k].values.to_numpy() for s in SUMS]) for batch in batches for k, i in enumerate(batch.column("place").to_pylist()))
        for i, of in groupby(each, key=lambda e: e[0]):
            total = [np.zeros(len(columns)) for _ in SUMS]
            for _, arrays in of:
                total = [t + a for t, a in zip(total, arrays)]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([t], pa.list_(pa.float64())) for t in total)], schema=schema)

    return rows.mapInArrow(moments, fields).repartition("place").sortWithinPartitions("place").mapInArrow(added, fields)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_a, column_b, n and Pearson's r of each pair in order, over the rows
    that know both.  Without two such rows, or where one of the columns is
    constant on them, there is no r; one with a NaN or an infinity has none with
    any other.  An empty table has no pairs."""
    names = F.array(*map(F.lit, columns))
    sums = F.arrays_zip(*SUMS)
    pairs = pair_moments(df, columns).select("place", F.posexplode(sums).alias("other", "s")).where("other > place").select("place", "other", "s.*")
    spread = lambda one, two: F.col(two) - F.col(one) * F.col(one) / F.col("n")
    # what rounding leaves of a constant column is no spread
    real = lambda one, two: F.when(spread(one, two) > 1e-14 * F.col(two), spread(one, two))
    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(real("x", "xx") * real("y", "yy"))
    known = F.when((F.col("n") > 1) & ~F.isnan("xy") & (F.abs("xy") < float("inf")), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    at = lambda c: F.element_at(names, F.col(c).cast("int") + 1)
    return pairs.select(at("place").alias("column_a"), at("other").alias("column_b"), F.col("n").cast("long").alias("n"), F.when(r.isNotNull(), known).alias("r"))
