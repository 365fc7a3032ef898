"""Padded sequences for a model (SQ1-SQ7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("session_key", "action_idx", "participant_id", "x_raw", "y_raw", "x", "y")


def lengths(df: DataFrame, key: str = "session_key") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("length"))


def fit_maxlen(df: DataFrame, pct: float = 90, key: str = "session_key") -> DataFrame:
    """One row: the percentile of lengths cut to an integer, or the longest if
    that is below 1."""
    q = F.floor(F.percentile("length", F.lit(pct / 100))).cast("int")
    return lengths(df, key).agg(F.when(q >= 1, q).otherwise(F.max("length").cast("int")).alias("maxlen"))


def continuous_columns(df: DataFrame, categorical: list[str], reference: list[str] | None = None) -> list[str]:
    found = [c for c, t in df.dtypes if c not in KEYS and c not in categorical and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if reference is None:
        return found
    missing = [c for c in reference if c not in found]
    if missing:
        raise ValueError(f"columns of the reference are missing: {missing}")
    return list(reference)


def prepare_sequences(df: DataFrame, maxlen: int, continuous: list[str], categorical: list[str], padding: str = "post", truncating: str = "post", key: str = "session_key", order: str = "action_idx") -> DataFrame:
    """key, length (cut), length_raw, one array a continuous column (pad 0.0) and
    one a categorical column (ids + 1, pad 0), each ``maxlen`` long.

    Rows beyond ``maxlen`` are cut before they are collected, so an array is
    never longer than that.
    """
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy(F.col(order) if truncating == "post" else F.desc(order)))
    cut = df.withColumns({"length_raw": F.count("*").over(w), "place": place}).where(F.col("place") <= maxlen)
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in continuous] + [(F.col(c).cast("int") + 1).alias(c) for c in categorical]
    rows = cut.groupBy(key).agg(F.first("length_raw").alias("length_raw"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *values))).alias("s"))

    def padded(c: str, zero: Column) -> Column:
        have = F.transform("s", lambda r: r[c])
        pad = F.array_repeat(zero, F.lit(maxlen) - F.size("s"))
        return (F.concat(have, pad) if padding == "post" else F.concat(pad, have)).alias(c)

    return rows.select(key, F.size("s").alias("length"), "length_raw", *(padded(c, F.lit(0.0)) for c in continuous), *(padded(c, F.lit(0)) for c in categorical))


def mask(ids: str) -> Column:
    """Which steps hold an action."""
    return F.transform(ids, lambda v: v != 0)


def embedding_config(sequences: DataFrame, categorical: list[str]) -> DataFrame:
    """feature, cardinality (largest id + 1) and width of its embedding."""
    top = sequences.agg(*(F.max(F.array_max(c)).alias(c) for c in categorical))
    card = lambda c: F.col(c) + 1
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), card(c).alias("cardinality"), F.least(F.lit(50), F.greatest(F.lit(1), (F.floor(card(c) / 2) + 1).cast("int"))).alias("width")) for c in categorical))
    return top.select(F.explode(rows).alias("r")).select("r.*")


def truncation_stats(df: DataFrame, maxlen: int, key: str = "session_key", participant: str = "participant_id") -> DataFrame:
    """Sessions cut and steps removed for each participant and in all (null)."""
    n = df.groupBy(participant, key).agg(F.count("*").alias("length"))
    over = F.greatest(F.col("length") - maxlen, F.lit(0))
    out = n.rollup(participant).agg(F.count("*").alias("sessions"), F.count_if(over > 0).alias("truncated"), F.sum("length").alias("steps"), F.sum(over).alias("removed"))
    return out.withColumns({"pct_truncated": 100.0 * F.col("truncated") / F.col("sessions"), "pct_removed": 100.0 * F.col("removed") / F.col("steps")})


def train_mean_predictor(means: dict[str, float]) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """The built-in model: every step is the train mean."""
    return lambda batch: {c: np.full_like(v, means[c]) for c, v in batch.items()}


def batch_predict(sequences: DataFrame, predict: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], columns: list[str], key: str = "session_key", batch: int = 32) -> DataFrame:
    """Apply a model to padded arrays, ``batch`` sessions at a time.

    ``predict`` takes and gives [sessions, steps] arrays by column.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                given = {c: np.array(part.column(c).to_pylist(), float) for c in columns}
                got = predict(given)
                yield pa.RecordBatch.from_pydict({key: part.column(key), **{c: pa.array(list(got[c]), pa.list_(pa.float64())) for c in columns}})

    kind = dict(sequences.dtypes)[key]
    return sequences.select(key, *columns).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} array<double>" for c in columns))
