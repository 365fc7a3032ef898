"""Scalar expressions (SF1-SF12).  All are built-in functions but one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def euclidean(x1, y1, x2, y2) -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return F.sqrt(dx * dx + dy * dy)


def turn_angle(dx1, dy1, dx2, dy2) -> Column:
    """Angle between two vectors; 0 if either has no length."""
    dx1, dy1, dx2, dy2 = map(col, (dx1, dy1, dx2, dy2))
    norm = F.sqrt(dx1 * dx1 + dy1 * dy1) * F.sqrt(dx2 * dx2 + dy2 * dy2)
    cosine = F.try_divide(dx1 * dx2 + dy1 * dy2, norm)
    return F.when(norm == 0, 0.0).otherwise(F.acos(clip(cosine, F.lit(-1.0), F.lit(1.0))))


def safe_float(c) -> Column:
    """Lenient cast: what isn't a number is null."""
    return null_nonfinite(col(c).try_cast("double"))


def null_nonfinite(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def normalize(v, center, scale) -> Column:
    return (col(v) - col(center)) / col(scale)


def log1p_clip(c) -> Column:
    """log(1 + c), values below 0 counted as 0; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def clip(c, low, high) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, col(low)), col(high)))


def dom_tag(html) -> Column:
    """Lower-case name of the first element, comments skipped; null if none."""
    bare = F.regexp_replace(col(html), r"(?s)<!--.*?-->", "")
    return F.nullif(F.lower(F.regexp_extract(bare, r"<([A-Za-z][A-Za-z0-9:-]*)", 1)), F.lit(""))


def parse_sessnum(c) -> Column:
    """First run of digits, or the empty string."""
    return F.coalesce(F.regexp_extract(col(c), r"(\d+)", 1), F.lit(""))


def find_column(df: DataFrame, candidates: list[str]) -> str:
    """Column whose trimmed lower-case name equals a candidate, the candidates in
    turn, or else contains one."""
    names = {c.strip().lower(): c for c in reversed(df.columns)}
    wanted = [c.strip().lower() for c in candidates]
    for w in wanted:
        if w in names:
            return names[w]
    for w in wanted:
        for low, name in reversed(names.items()):
            if w in low:
                return name
    raise ValueError(f"no column like {candidates} in {df.columns}")


# Paths: array<struct<x,y,t>>, in order.


def _pairs(path: Column, f) -> Column:
    """f(previous, next) of neighbouring points."""
    n = F.size(path)
    return F.when(n > 1, F.zip_with(F.slice(path, 1, n - 1), F.slice(path, F.lit(2), n - 1), f)).otherwise(F.array().cast("array<double>"))


def quantiles(c, points, accuracy: int | None = None) -> Column:
    """Array of quantiles of a group: exact and interpolated, which holds every
    distinct value of the group in one task; or, with ``accuracy``, values whose
    rank is off by a share of 1 / accuracy at most, from mergeable sketches of
    bounded size."""
    shares = F.array(*(F.lit(float(p)) for p in points))
    return F.percentile_approx(c, shares, F.lit(accuracy)) if accuracy else F.percentile(c, shares)


def path_steps(path) -> dict[str, Column]:
    """Arrays over the steps of a path: dt, dist, speed, speed_change, angle."""
    first = _steps(col(path))
    speed = _speed(first["dist"], first["dt"])
    return {"dt": first["dt"], "dist": first["dist"], "speed": speed, **_turns(first["vector"], speed)}


def with_path_steps(df: DataFrame, path: str, prefix: str = "s_") -> DataFrame:
    """``path_steps`` as columns, each computed from those before it once."""
    df = df.withColumns({f"{prefix}{k}": c for k, c in _steps(F.col(path)).items()})
    df = df.withColumn(f"{prefix}speed", _speed(F.col(f"{prefix}dist"), F.col(f"{prefix}dt")))
    return df.withColumns({f"{prefix}{k}": c for k, c in _turns(F.col(f"{prefix}vector"), F.col(f"{prefix}speed")).items()})


def _steps(path: Column) -> dict[str, Column]:
    n = F.size(path)
    vector = lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))
    return {
        "dt": _pairs(path, lambda a, b: b["t"] - a["t"]),
        "dist": _pairs(path, lambda a, b: euclidean(a["x"], a["y"], b["x"], b["y"])),
        "vector": F.when(n > 1, F.zip_with(F.slice(path, 1, n - 1), F.slice(path, F.lit(2), n - 1), vector)),
    }


def _speed(dist: Column, dt: Column) -> Column:
    return F.zip_with(dist, dt, lambda d, t: F.when(t > 0, d / t).otherwise(0.0))


def _turns(vector: Column, speed: Column) -> dict[str, Column]:
    """What changes from a step to the next."""
    angle = lambda a, b: turn_angle(a["dx"], a["dy"], b["dx"], b["dy"])
    return {"speed_change": _pairs(speed, lambda a, b: b - a), "angle": _pairs(vector, angle)}


def _side(px, py, qx, qy, rx, ry):
    return (qx - px) * (ry - py) - (qy - py) * (rx - px) > 0


def _cross(ax, ay, bx, by, i, j) -> np.ndarray:
    """Whether segments ``i`` and ``j`` cross, by the sides their ends lie on."""
    a, b, c, d = (ax[i], ay[i]), (bx[i], by[i]), (ax[j], ay[j]), (bx[j], by[j])
    return (_side(*a, *c, *d) != _side(*b, *c, *d)) & (_side(*a, *b, *c) != _side(*a, *b, *d))


class _Boxes:
    """Bounding boxes of the segments of a path, of pairs of neighbours, of
    fours and so on: a path is close to itself along its length, so such boxes
    stay small, and parts whose boxes lie apart need no comparing."""

    def __init__(self, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray):
        level = np.array([np.minimum(ax, bx), np.minimum(ay, by), -np.maximum(ax, bx), -np.maximum(ay, by)])
        self.levels = [level]  # each of left, low, -right, -high
        while level.shape[1] > 1:
            if level.shape[1] % 2:
                level = np.append(level, np.full((4, 1), np.inf), axis=1)
            level = np.minimum(level[:, ::2], level[:, 1::2])
            self.levels.append(level)

    def may_cross(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Boxes that meet, but for those on one horizontal or vertical line,
        whose segments have no sides."""
        a, b = self.levels[level][:, i], self.levels[level][:, j]
        low, high = np.maximum(a[:2], b[:2]), np.minimum(-a[2:], -b[2:])
        flat = np.minimum(a[:2], b[:2]) == np.maximum(-a[2:], -b[2:])
        return (low <= high).all(0) & ~flat.any(0)


def count_crossings(x: np.ndarray, y: np.ndarray, few: int = 1024, block: int = 1 << 18) -> int:
    """Strictly crossing pairs of non-adjacent segments of a polyline.

    Up to ``few`` segments all pairs are compared.  Longer paths are compared
    with themselves down a tree of boxes, ``block`` pairs of boxes a step, so
    the work follows the pairs that are close to each other and memory stays
    bounded.  (Segments of one slanted line that lie apart, which rounding could
    make cross where all pairs are compared, never do so there.)
    """
    n = len(x) - 1
    if n < 3:
        return 0
    ends = ax, ay, bx, by = x[:-1], y[:-1], x[1:], y[1:]
    if n <= few:
        i, j = np.triu_indices(n, 2)
        return int(_cross(*ends, i, j).sum())
    boxes = _Boxes(ax, ay, bx, by)
    zero = np.zeros(1, np.int64)
    total, waiting = 0, [(len(boxes.levels) - 1, zero, zero)]
    while waiting:
        level, i, j = waiting.pop()
        near = boxes.may_cross(level, i, j) | (i == j)
        i, j = i[near], j[near]
        if not level:
            apart = j > i + 1
            total += int(_cross(*ends, i[apart], j[apart]).sum())
            continue
        i, j = np.concatenate([2 * i, 2 * i, 2 * i + 1, 2 * i + 1]), np.concatenate([2 * j, 2 * j + 1, 2 * j, 2 * j + 1])
        there = (i <= j) & (j < boxes.levels[level - 1].shape[1])
        i, j = i[there], j[there]
        waiting += [(level - 1, i[k : k + block], j[k : k + block]) for k in range(0, len(i), block)]
    return total


def crossings_of_each(xs: pa.Array, ys: pa.Array, few: int = 1024, block: int = 1 << 18) -> pa.Array:
    """``count_crossings`` of each row's path, 0 for null; paths of one length
    are counted together, about ``block`` pairs of segments a step."""
    counts = np.zeros(len(xs), np.int32)
    there = xs.is_valid().to_numpy(zero_copy_only=False)
    starts, ends = (np.asarray(xs.offsets)[k : len(xs) + k] for k in (0, 1))
    points = np.where(there, ends - starts, 0)
    x, x_at = xs.values.to_numpy(zero_copy_only=False), starts
    y, y_at = ys.values.to_numpy(zero_copy_only=False), np.asarray(ys.offsets)[: len(ys)]
    for n in np.unique(points[points > 3]).tolist():
        rows = np.flatnonzero(points == n)
        if n - 1 > few:
            for r in rows.tolist():
                counts[r] = count_crossings(x[x_at[r] : x_at[r] + n], y[y_at[r] : y_at[r] + n], few)
            continue
        i, j = np.triu_indices(n - 1, 2)
        for some in np.array_split(rows, -(-len(rows) * len(i) // block)):
            px, py = (v[at[some] + np.arange(n)[:, None]] for v, at in ((x, x_at), (y, y_at)))
            counts[some] = _cross(px[:-1], py[:-1], px[1:], py[1:], i, j).sum(0)
    return pa.array(counts)


def self_intersections(path) -> Column:
    """Crossings of a path; one of fewer than four points has none and isn't sent to Python."""
    path = col(path)
    xs, ys = (F.when(F.size(path) > 3, a) for a in (F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])))

    def counted(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return crossings_of_each(xs, ys)

    return F.arrow_udf(counted, "int")(xs, ys)
