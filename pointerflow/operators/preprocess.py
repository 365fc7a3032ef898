"""Preprocessing fitted on train rows and applied to any (PR1-PR14).

Fitted state is a small frame of parameters: ``(feature, method, center, scale,
low, high)`` for numbers and ``(category, id)`` for tags.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, log1p_clip, null_nonfinite, quantiles
from .correlate import correlations
from .features import KINEMATIC
from .quantiles import quantiles_by_column

LOGGED = ("cursor_speed", "jitter", "direction_changes", "rate_of_curvature", "distance_travelled", "movement_offset", "action_duration", "time_since_last_action")
STANDARD = ("cursor_speed", "acceleration_mean", "jitter", "direction_changes", "curvature_mean", "rate_of_curvature")
DURATIONS = ("action_duration", "time_since_last_action")
MINMAX = ("distance_travelled", "movement_offset", "straightness")
MODULE_IDS = {"behavior_RESS": 0, "behavior_EADS": 1, "behavior_WAI_sr": 2}
ACTION_IDS = {"mouse_movement": 0, "hover": 1, "pause": 2, "click": 3}
OTHER = "Other"


QUARTILES = (0.25, 0.5, 0.75)


def data_quality(df: DataFrame, numeric: list[str], accuracy: int | None = None, selected: bool = False) -> DataFrame:
    """feature, nulls, n, mean, sample std, min, quartiles, max of each column;
    for very many rows, with ``accuracy`` of ``quantiles`` or, exactly,
    quartiles ``selected`` by rounds of counting."""
    known = quantiles_by_column(df, numeric, QUARTILES) if selected else {}

    def stats(c: str) -> Column:
        q = [F.lit(v).cast("double") for v in known[c]] if selected else quantiles(c, QUARTILES, accuracy)
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count(c).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(v).alias("max"))

    return df.agg(F.array(*map(stats, numeric)).alias("all")).select(F.explode("all").alias("r")).select("r.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.*").groupBy("feature", "value").agg(F.count("*").alias("n"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg((F.sum("n") - F.count("*")).alias("duplicates"), F.sum("n").alias("n_rows"))


def handle_missing(df: DataFrame) -> DataFrame:
    """Flags for what is there, then zeros and ``unknown`` for what is not."""
    there = F.lit(True)
    for c in KINEMATIC:
        there = there & F.col(c).isNotNull()
    df = df.withColumns({"has_kinematics": there.cast("int"), "has_duration": F.col("action_duration").isNotNull().cast("int")})
    return df.fillna(0, [*KINEMATIC, "action_duration"]).fillna("unknown", ["dom_element_type"])


def transform_features(df: DataFrame) -> DataFrame:
    """Logarithms of the skewed columns; the reciprocal goes."""
    return df.withColumns({c: log1p_clip(F.col(c).cast("double")) for c in LOGGED}).drop("reciprocal_acceleration")


def negative_values(df: DataFrame) -> DataFrame:
    """feature and how many of its values the logarithm takes for zero."""
    counts = F.array(*(F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c) < 0).alias("negatives")) for c in LOGGED))
    return df.agg(counts.alias("all")).select(F.explode("all").alias("r")).select("r.*")


def fit_categories(df: DataFrame, column: str = "dom_element_type", min_count: int = 20) -> DataFrame:
    """category and id in sorted order; rare ones are ``Other``, which comes
    last if nothing is rare."""
    counts = df.groupBy(F.col(column).alias("category")).count().where("category is not null")
    kept = counts.select(F.when(F.col("count") < min_count, OTHER).otherwise(F.col("category")).alias("category")).distinct()
    ids = kept.select("category", (F.row_number().over(Window.orderBy("category")) - 1).alias("id"))
    n = ids.agg(F.count("*").cast("int").alias("id"), F.count_if(F.col("category") == OTHER).alias("has"))
    return ids.unionByName(n.where("has = 0").select(F.lit(OTHER).alias("category"), "id"))


def apply_categories(df: DataFrame, categories: DataFrame, column: str = "dom_element_type") -> DataFrame:
    """Numbers for module, action and tag; a rare or unseen tag is ``Other``."""
    fixed = lambda c, ids: F.element_at(F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)), F.col(c))
    known = categories.select(F.col("category").alias("known"), F.col("id").alias("tag_id"))
    other = categories.where(F.col("category") == OTHER).select(F.col("id").alias("other_id"))
    out = df.join(known, F.col(column) == F.col("known"), "left").drop("known").crossJoin(other)
    return out.withColumns({"module_code": F.try_element_at(F.create_map(*(F.lit(x) for kv in MODULE_IDS.items() for x in kv)), F.col("module_id")), "action_code": fixed("action_type", ACTION_IDS), "tag_code": F.coalesce("tag_id", "other_id")}).drop("tag_id", "other_id")


def _one(feature: str, method: str, **values: Column) -> Column:
    return F.struct(F.lit(feature).alias("feature"), F.lit(method).alias("method"), *(values.get(k, F.lit(None)).cast("double").alias(k) for k in ("center", "scale", "low", "high")))


def _or_one(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(c)


def _block(flag: str, columns: tuple[str, ...], c: str, least: int) -> tuple[Column, Column, Column]:
    """The column on the rows of a block that are whole in ``columns``, on all
    such rows, and whether the former are to be used: with ``least``, if there
    are so many; with 0, if any row belongs to the block."""
    whole = F.lit(True)
    for b in columns:
        whole = whole & F.col(b).isNotNull()
    inside = F.coalesce(F.col(flag) == 1, F.lit(False))
    value = F.col(c).cast("double")
    return F.when(inside & whole, value), F.when(whole, value), F.count_if(inside & whole) >= least if least else F.count_if(inside) > 0


#: Quantiles of columns that are known before a fit, by column and share.
Known = dict[str, dict[float, float | None]]


def _points(c: str, points: tuple[float, ...], accuracy: int | None, known: Known | None) -> Column | list[Column]:
    return [F.lit(known[c][p]).cast("double") for p in points] if known else quantiles(c, points, accuracy)


def fit_clip(c: str = "acceleration_mean", accuracy: int | None = None, known: Known | None = None) -> Column:
    q = _points(c, (0.01, 0.99), accuracy, known)
    return _one(c, "clip", low=q[0], high=q[1])


def fit_standard(columns: tuple[str, ...], flag: str, least: int = 5) -> list[Column]:
    """Mean and population std; fitted on all rows if the block has fewer than
    ``least`` (0: none).  Without any row there is nothing to fit: nulls."""
    out = []
    for c in columns:
        v, every, enough = _block(flag, columns, c, least)
        mean, std = F.when(enough, F.avg(v)).otherwise(F.avg(every)), F.when(enough, F.stddev_pop(v)).otherwise(F.stddev_pop(every))
        out.append(_one(c, "standard", center=mean, scale=_or_one(std)))
    return out


def fit_robust(c: str, accuracy: int | None = None, known: Known | None = None) -> Column:
    q = _points(c, QUARTILES, accuracy, known)
    return _one(c, "robust", center=q[1], scale=_or_one(q[2] - q[0]))


def fit_minmax(columns: tuple[str, ...], flag: str | None = None) -> list[Column]:
    out = []
    for c in columns:
        value = F.col(c).cast("double")
        v, every, enough = _block(flag, columns, c, 5) if flag else (value, value, F.lit(True))
        low = F.when(enough, F.min(v)).otherwise(F.min(every))
        out.append(_one(c, "minmax", center=low, scale=_or_one(F.when(enough, F.max(v)).otherwise(F.max(every)) - low)))
    return out


def fit_scaling(df: DataFrame, accuracy: int | None = None, selected: bool = False) -> DataFrame:
    """All parameters: the clipping bounds, then the rest on clipped train rows;
    for very many rows, with ``accuracy`` of ``quantiles`` or, exactly,
    quantiles ``selected`` by rounds of counting, all columns at once."""
    known = None
    if selected:
        points = (0.01, *QUARTILES, 0.99)
        known = {c: dict(zip(points, q)) for c, q in quantiles_by_column(df, ["acceleration_mean", "self_intersections", "x", "y"], points).items()}
    bounds = df.agg(fit_clip(accuracy=accuracy, known=known).alias("clip"))
    clipped = df.crossJoin(F.broadcast(bounds)).withColumn("acceleration_mean", clip("acceleration_mean", "clip.low", "clip.high"))  # one row
    parts = [*fit_standard(STANDARD, "has_kinematics"), *fit_standard(DURATIONS, "has_duration", least=0), fit_robust("self_intersections", accuracy, known), *fit_minmax(MINMAX, "has_kinematics"), *fit_minmax(("x",)), fit_robust("y", accuracy, known)]
    medians = [_one(c, "median", center=_points(c, (0.5,), accuracy, known)[0]) for c in "xy"]
    return clipped.agg(F.array(F.first("clip"), *parts, *medians).alias("all")).select(F.explode("all").alias("r")).select("r.*")


def apply_scaling(df: DataFrame, params: DataFrame, drop_xy: bool = True, own_median: bool = False) -> DataFrame:
    """Clip and scale by the fitted parameters, which become literals; columns
    with nothing fitted stay.  Places that are missing take the train rows'
    median or, with ``own_median``, that of ``df``."""
    fitted: dict[str, dict] = {}
    for r in params.collect():  # some twenty rows, one a feature
        fitted.setdefault(r.method, {})[r.feature] = r
    fills = {c: r.center for c, r in fitted["median"].items()}
    if own_median and not drop_xy:
        fills = df.agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in fills)).first().asDict()
    out = {}
    for method in ("standard", "robust", "minmax"):
        for c, r in fitted.get(method, {}).items():
            if r.center is None:
                continue
            v = null_nonfinite(F.col(c).cast("double"))
            if c in fitted["clip"]:
                v = clip(v, F.lit(fitted["clip"][c].low), F.lit(fitted["clip"][c].high))
            fill = fills.get(c, 0.0)
            out[c] = (F.coalesce(v, F.lit(fill if fill is not None else 0.0)) - F.lit(r.center)) / F.lit(r.scale)
    df = df.withColumns(out)
    return df.drop("x", "y") if drop_xy else df


def fit(train: DataFrame, min_count: int = 20) -> tuple[DataFrame, DataFrame]:
    """(parameters, categories) of the train rows."""
    ready = transform_features(handle_missing(train))
    return fit_scaling(ready), fit_categories(ready, min_count=min_count)


def transform(df: DataFrame, params: DataFrame, categories: DataFrame, drop_xy: bool = True) -> DataFrame:
    return apply_scaling(apply_categories(transform_features(handle_missing(df)), categories), params, drop_xy)


def correlation_filter(df: DataFrame, columns: list[str], threshold: float = 0.9, blocks: bool = False) -> DataFrame:
    """column_a, column_b, the size of their correlation, and whether the second
    is too close to the first; for very many columns from ``blocks`` of
    co-moments instead of an aggregate a pair."""
    if blocks:
        found = correlations(df, columns).select("column_a", "column_b", F.abs("r").alias("r"))
    else:
        pairs = list(combinations(columns, 2))
        rows = df.agg(F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.abs(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias("r")) for a, b in pairs)).alias("all"))
        found = rows.select(F.explode("all").alias("p")).select("p.*")
    return found.withColumn("dropped", F.coalesce(F.col("r") > threshold, F.lit(False)))


def uncorrelated(pairs: DataFrame, columns: list[str]) -> list[str]:
    """The columns that ``correlation_filter`` leaves, in their order."""
    dropped = {r.column_b for r in pairs.where("dropped").select("column_b").distinct().collect()}  # names of columns
    return [c for c in columns if c not in dropped]


def standardize_embeddings(train: DataFrame, df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each dimension by the train rows' mean and population std (0: 1)."""
    long = lambda d: d.select(key, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    stats = long(train).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = long(df).join(stats, "dim").withColumn("z", (F.col("v") - F.col("m")) / _or_one(F.col("s")))
    return z.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda p: p["z"]).alias(vector))


def sequence_lengths(df: DataFrame, key: str = "session_key") -> DataFrame:
    """Summary of actions a session."""
    points = (25, 50, 75, 80, 85, 90, 95, 99)
    q = F.percentile("length", F.array(*(F.lit(p / 100) for p in points)))
    n = df.groupBy(key).agg(F.count("*").alias("length"))
    return n.agg(F.count("*").alias("sessions"), F.avg("length").alias("mean"), F.stddev_samp("length").alias("std"), F.min("length").alias("min"), F.max("length").alias("max"), *(q[i].alias(f"p{p}") for i, p in enumerate(points)))


def length_histogram(df: DataFrame, key: str = "session_key", bins: int = 50) -> DataFrame:
    """Sessions in each of ``bins`` equal bins of their length."""
    n = df.groupBy(key).agg(F.count("*").alias("length"))
    ends = n.agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("length") - F.col("lo")) / width), F.lit(bins - 1)))
    return n.crossJoin(ends).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
