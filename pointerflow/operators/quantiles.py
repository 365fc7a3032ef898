"""Exact quantiles of many columns and groups by rounds of counting.

``percentile`` keeps every distinct value of a group in one task.  Here a round
divides the values between mergeable sketches' quantiles, counts the buckets,
and only the buckets that hold a wanted rank are divided again, until a bucket
is one value or few enough to be sorted.  All columns and groups share a round,
and what a task holds is bounded by ``BUCKETS`` and ``FEW``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .ranges import key_of, small, splitters_below

BUCKETS = 256
#: Values of a bucket that are sorted in one row.
FEW = 10_000

_OPEN = ["key", "low", "high", "earlier", "n", "ranks"]


def _position(p: float, n: Column) -> Column:
    return F.lit(p) * (n - 1)


def _ranks(points: Sequence[float], n: Column) -> Column:
    """The places, from 0, that the points lie at or between."""
    ends = [f(_position(p, n)) for p in points for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*ends))


def _inside(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Values of the open buckets; those of a key do not overlap."""
    joined = rows.join(small(open_), "key")
    return joined.where((F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high"))))


def _sorted(rows: DataFrame, few: DataFrame) -> DataFrame:
    """key, rank, value of the ranks in buckets of few values."""
    lists = _inside(rows, few).groupBy("key", "earlier", "ranks").agg(F.sort_array(F.collect_list("value")).alias("values"))
    at = F.transform("ranks", lambda r: F.struct(r.alias("rank"), F.get("values", (r - F.col("earlier")).cast("int")).alias("value")))
    return lists.select("key", F.inline(at))


def _cuts(buckets: int) -> Column:
    """Ascending splitters of ``value`` from a mergeable sketch."""
    shares = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    return F.array_distinct(F.percentile_approx("value", shares, F.lit(20 * buckets))).alias("cuts")


def _divided(rows: DataFrame, many: DataFrame, cuts: DataFrame, buckets: int) -> DataFrame:
    """The buckets, as in ``_OPEN``, of open ones that have a wanted rank, by
    the written splitters ``cuts``: those that count buckets also name them.

    Each splitter is a bucket of its own, so a value that very many rows have is
    found at once, and between two splitters lie few rows of the rest.
    """
    inside = _inside(rows, many)
    below = splitters_below(F.col("cuts"), F.col("value"), buckets)
    equal = F.coalesce(F.get("cuts", F.col("below")) == F.col("value"), F.lit(False)).cast("int")
    counted = inside.join(small(cuts), ["key", "earlier"]).withColumn("below", below).withColumn("bucket", 2 * F.col("below") + equal)
    counted = counted.groupBy("key", "earlier", "bucket").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.first("ranks").alias("ranks"))
    before = Window.partitionBy("key", "earlier").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("start", F.col("earlier") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    held = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    return counted.withColumn("ranks", held).where(F.size("ranks") > 0).select("key", "low", "high", F.col("start").alias("earlier"), "n", "ranks")


def exact_quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str] = (), buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """by, column_name, n and quantiles (in the order of ``points``) of every
    column's known values: the numbers that ``percentile`` gives, to the bit.

    ``df`` is computed once, and its columns written.  They are read three times:
    for sizes and splitters, to count buckets, and for the values of the open
    buckets, about one in ``buckets``, which are written and are all that later
    rounds read.  NaN is the greatest value.  A column without values, or an
    empty table, gives no row.
    """
    if not points or not all(0 <= p <= 1 for p in points):
        raise ValueError("points are shares from 0 to 1")
    by = list(by)
    rows = saved(df.select(*by, *(F.col(c).cast("double").alias(f"values_{i}") for i, c in enumerate(columns))), "quantile-columns")
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"values_{i}").alias("value")) for i, c in enumerate(columns)))
    rows = rows.select(*by, F.inline(pairs)).where("value is not null").select(key_of([*by, "column_name"]).alias("key"), "value")
    sizes = saved(rows.groupBy("key").agg(F.count("*").alias("n"), _cuts(buckets)), "quantile-sizes")
    cuts, sizes = sizes.select("key", F.lit(0).cast("long").alias("earlier"), "cuts"), sizes.drop("cuts")
    none = F.lit(None).cast("double")
    open_ = sizes.select("key", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("earlier"), "n", _ranks(points, F.col("n")).alias("ranks"))
    found = []
    while open_.count():
        one = F.coalesce(F.col("low") == F.col("high"), F.lit(False))
        found.append(open_.where(one).select("key", F.explode("ranks").alias("rank"), F.col("low").alias("value")))
        found.append(saved(_sorted(rows, open_.where(~one & (F.col("n") <= few))), "quantile-values"))
        many = open_.where(~one & (F.col("n") > few))
        if not many.count():
            break
        if cuts is None:
            cuts = saved(_inside(rows, many).groupBy("key", "earlier").agg(_cuts(buckets)), "splitters")
        open_ = saved(_divided(rows, many, cuts, buckets), "quantile-buckets").select(*_OPEN)
        wanted = open_.where(F.col("low") < F.col("high"))
        rows, cuts = saved(_inside(rows, wanted).select("key", "value"), "quantile-rest"), None
    if not found:
        return sizes.select("key.*", "n", F.array().cast("array<double>").alias("quantiles"))
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    known = values.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two a point at most

    def quantile(p: float) -> Column:
        place = _position(p, F.col("n"))
        low, high = F.floor(place), F.ceil(place)
        a, b = F.try_element_at("at", low), F.try_element_at("at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    return sizes.join(known, "key").select("key.*", "n", F.array(*map(quantile, points)).alias("quantiles"))


def quantiles_by_column(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> dict[str, list[float | None]]:
    """The exact quantiles of each column on the driver: one row a column."""
    got = {r.column_name: r.quantiles for r in exact_quantiles(df, columns, points).collect()}
    return {c: got.get(c) or [None] * len(points) for c in columns}
