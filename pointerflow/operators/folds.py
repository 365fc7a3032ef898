"""Preprocessing fitted for all folds at once (PR11 over SP5).

Round ``i`` holds fold ``i`` out and fits on the others.  Rows are aggregated
once, into the state of their own fold; the state that a round fits on is
merged from the other folds': moments by their counts, means and squares, ranges
by their ends, quantiles by mergeable sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..sources.scratch import saved
from . import preprocess as pr
from .quantiles import exact_quantiles
from .split import group_folds

POINTS = (0.01, *pr.QUARTILES, 0.99)
MEASURED = ("acceleration_mean", "self_intersections", "x", "y")
PARAMETERS = "round int, feature string, method string, center double, scale double, low double, high double"


def with_folds(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``df`` with the fold of its participant; rows without one have none."""
    return df.join(group_folds(df, k, seed), "participant_id", "left")


def _rounds(df: DataFrame, k: int) -> DataFrame:
    """Each row once for each round that fits on it."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != F.col("fold"))
    return df.where("fold is not null").withColumn("round", F.explode(others))


def fold_quantiles(df: DataFrame, k: int, columns=MEASURED, points=POINTS, sketch: int | None = None) -> DataFrame:
    """round, column_name and quantiles of the rows a round fits on: exact, from
    rows told to each of their rounds; or, with ``sketch``, from one scan that
    fills a KLL sketch of that size a fold, which rounds merge."""
    if not sketch:
        return exact_quantiles(_rounds(df.select("fold", *columns), k), columns, points, ["round"]).select("round", "column_name", "quantiles")
    values = [F.col(c).cast("double") for c in columns]
    per_fold = df.groupBy("fold").agg(*(F.kll_sketch_agg_double(v, sketch).alias(c) for v, c in zip(values, columns)))
    merged = _rounds(per_fold, k).groupBy("round").agg(*(F.kll_merge_agg_double(c).alias(c) for c in columns))  # k rows from k - 1 each
    shares = F.array(*map(F.lit, points))
    known = lambda c: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, shares))
    return merged.select("round", F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), known(F.col(c)).alias("quantiles")) for c in columns))))


def _moments(v: Column) -> Column:
    return F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("squares"))


def _ends(v: Column) -> Column:
    return F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))


def _states(df: DataFrame, bounds: dict[int, tuple[float | None, float | None]]) -> DataFrame:
    """A row a fold: the states of every block, on its own rows and on all."""
    out = []
    for flag, columns, state, least in (("has_kinematics", pr.STANDARD, _moments, 5), ("has_duration", pr.DURATIONS, _moments, 0), ("has_kinematics", pr.MINMAX, _ends, 5)):
        for c in columns:
            v, every, _ = pr._block(flag, columns, c, least)
            # the clipped column differs by round, as the bounds do
            rounds = bounds if c == "acceleration_mean" else {None: None}
            for i, b in rounds.items():
                for name, value in (("own", v), ("all", every)):
                    value = clip(value, F.lit(b[0]).cast("double"), F.lit(b[1]).cast("double")) if b else value
                    out.append(state(value).alias(f"{c}:{name}" + ("" if i is None else f":{i}")))
    out += [F.count_if(F.col("has_duration") == 1).alias("with_duration"), _ends(F.col("x").cast("double")).alias("x:all")]
    return df.where("fold is not null").groupBy("fold").agg(*out)


def _merged_moments(states: list[Row]) -> tuple[int, float | None, float | None]:
    """n, mean and population std of all rows behind the states."""
    states = [s for s in states if s.n]
    n = sum(s.n for s in states)
    if not n:
        return 0, None, None
    mean = math.fsum(s.n * s["mean"] for s in states) / n
    squares = math.fsum(s.squares + s.n * (s["mean"] - mean) ** 2 for s in states)
    return n, mean, math.sqrt(squares / n)


def _merged_ends(states: list[Row]) -> tuple[int, float | None, float | None]:
    states = [s for s in states if s.n]
    if not states:
        return 0, None, None
    low = min(s.low for s in states)
    return sum(s.n for s in states), low, max(s.high for s in states) - low


def _one(x: float | None) -> float | None:
    return 1.0 if x == 0 else x


def fit_all_folds(df: DataFrame, k: int, sketch: int | None = None) -> DataFrame:
    """The parameters of ``fit_scaling`` for each ``round``, from rows with their
    ``fold`` (others count nowhere): one scan for the states of all folds, after
    the quantiles, whose bounds clip a column (one scan with ``sketch``).

    The driver merges a row a fold.  Moments agree with separate fits up to
    rounding, everything else to the bit (quantiles unless from sketches).
    """
    q = {(r["round"], r.column_name): r.quantiles for r in fold_quantiles(df, k, sketch=sketch).collect()}
    none = [None] * len(POINTS)
    known = lambda i, c: dict(zip(POINTS, q.get((i, c)) or none))
    bounds = {i: (known(i, "acceleration_mean")[0.01], known(i, "acceleration_mean")[0.99]) for i in range(k)}
    states = _states(df, bounds).collect()
    rows = []
    for i in range(k):
        train = [s for s in states if s.fold != i]
        of = lambda name, train=train: [s[name] for s in train]
        rows.append((i, "acceleration_mean", "clip", None, None, *bounds[i]))
        for c in pr.STANDARD:
            at = f":{i}" if c == "acceleration_mean" else ""
            own, every = (_merged_moments(of(f"{c}:{name}{at}")) for name in ("own", "all"))
            _, mean, std = own if own[0] >= 5 else every
            rows.append((i, c, "standard", mean, _one(std), None, None))
        for c in pr.DURATIONS:
            _, mean, std = _merged_moments(of(f"{c}:own" if sum(of("with_duration")) else f"{c}:all"))
            rows.append((i, c, "standard", mean, _one(std), None, None))
        for c in pr.MINMAX:
            own, every = (_merged_ends(of(f"{c}:{name}")) for name in ("own", "all"))
            _, low, width = own if own[0] >= 5 else every
            rows.append((i, c, "minmax", low, _one(width), None, None))
        rows.append((i, "x", "minmax", *(lambda e: (e[1], _one(e[2])))(_merged_ends(of("x:all"))), None, None))
        for c in ("self_intersections", "y"):
            low, mid, high = (known(i, c)[p] for p in pr.QUARTILES)
            rows.append((i, c, "robust", mid, None if low is None else _one(high - low), None, None))
        rows += [(i, c, "median", known(i, c)[0.5], None, None, None) for c in "xy"]
    return df.sparkSession.createDataFrame(rows, PARAMETERS)


def fit_all_categories(df: DataFrame, k: int, column: str = "dom_element_type", min_count: int = 20) -> DataFrame:
    """round, category and id, as ``fit_categories`` gives for each round; tags
    are counted a fold at a time, and rounds add counts up."""
    counts = _rounds(df.groupBy("fold", F.col(column).alias("tag")).agg(F.count("*").alias("n")).where("tag is not null"), k)
    train = counts.groupBy("round", "tag").agg(F.sum("n").alias("n"))
    kept = train.select("round", F.when(F.col("n") < min_count, pr.OTHER).otherwise(F.col("tag")).alias("category")).distinct()
    ids = kept.select("round", "category", (F.row_number().over(Window.partitionBy("round").orderBy("category")) - 1).alias("id"))
    n = ids.groupBy("round").agg(F.count("*").cast("int").alias("id"), F.count_if(F.col("category") == pr.OTHER).alias("has"))
    return ids.unionByName(n.where("has = 0").select("round", F.lit(pr.OTHER).alias("category"), "id"))


def folds_ready(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Rows with their folds and missing values and logarithms dealt with, as
    every fit reads them."""
    return pr.transform_features(pr.handle_missing(with_folds(df, k, seed)))


def rounds(ready: DataFrame, k: int, sketch: int | None = None, min_count: int = 20, drop_xy: bool = True) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """For each round its number, train rows and held-out rows, both transformed
    by what the train rows taught."""
    params = fit_all_folds(ready, k, sketch)
    categories = saved(fit_all_categories(ready, k, min_count=min_count), "fold-categories")  # every side reads them
    for i in range(k):
        fitted, tags = params.where(F.col("round") == i).drop("round"), categories.where(F.col("round") == i).drop("round")
        sides = (ready.where(F.col("fold") != i), ready.where(F.col("fold") == i))
        yield i, *(pr.apply_scaling(pr.apply_categories(side, tags), fitted, drop_xy) for side in sides)
