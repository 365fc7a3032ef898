"""Events to actions: pauses, hovers, clicks, movements (AC2-AC8).

Only the hover scan needs order one event at a time; it also numbers the actions
as they arise, so that one aggregation puts all of them together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import recorded, recorded_by, sequence, valid_events
from .pieces import LONG, deltas_of, numbered, numbered_together

TYPES = {"start": "double", "end": "double", "duration": "double", "distance": "double", "x": "double", "y": "double", "timestamp": "double", "node": "string", "path": "array<struct<x:double,y:double,t:double>>"}


@dataclass(frozen=True)
class Thresholds:
    hover_radius: float = 10.0
    hover_ms: float = 1000.0
    pause_ms: float = 250.0
    pause_distance: float = 3.0


DEFAULT = Thresholds()


def is_pause(th: Thresholds = DEFAULT) -> Column:
    return F.coalesce(~F.col("is_click") & (F.col("dt") >= th.pause_ms) & (F.col("dist") < th.pause_distance), F.lit(False))


#: What the scan reads of an event; only a click has a node.
NARROW = ("event_idx", "t", "x", "y", "prev_t", "prev_x", "prev_y", "dt", "dist", "is_click", "node")


class _Open:
    """What the scan keeps between Arrow batches: the anchor of the open hover,
    segments and actions so far, actions before the current sequence, the number
    of the last action begun, the last segment that moved, and the last event's pause."""

    def __init__(self) -> None:
        self.anchor: tuple[float, float, float] | None = None
        self.segments = self.actions = self.earlier = self.own = 0
        self.moved = -1
        self.pause = False


def _scan(held: tuple | None, new: np.ndarray, ends: np.ndarray, near: np.ndarray, pause: np.ndarray, click: np.ndarray, points: list[list], th: Thresholds) -> tuple[dict[int, tuple], tuple | None]:
    """Hovers by the event that ends them, (start, x, y, end, flushed), and the
    one that stays open.

    While no hover is open, the scan goes from one near event to the next.
    """
    t, x, y, prev_t, prev_x, prev_y = points
    opening = np.flatnonzero(near & ~pause & ~click).tolist()
    new, ends, pause, click = (a.tolist() for a in (new, ends, pause, click))
    found: dict[int, tuple] = {}
    i, n, at = 0, len(t), 0
    while i < n:
        if held is not None and new[i]:
            held = None
        if held is None:
            while at < len(opening) and opening[at] < i:
                at += 1
            if at == len(opening):
                break
            i = opening[at]
            held = (prev_t[i], prev_x[i], prev_y[i])
        elif pause[i]:
            held = None
        else:
            dx, dy = x[i] - held[1], y[i] - held[2]
            end = t[i] if click[i] else prev_t[i] if math.sqrt(dx * dx + dy * dy) > th.hover_radius else None
            if end is not None:
                if end - held[0] >= th.hover_ms:
                    found[i] = (*held, end, False)
                held = None
        if held is not None and ends[i]:
            if t[i] - held[0] >= th.hover_ms:
                found[i] = (*held, t[i], True)
            held = None
        i += 1
    return found, held


def _filled(at: np.ndarray, values: np.ndarray, before: int) -> np.ndarray:
    """Rising values at some places, and after each of them until the next."""
    return np.maximum.accumulate(np.append(before, np.where(at, values, -1)))[1:]


def scan_events(deltas: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """The narrow columns of ``deltas`` with ``pause``; ``hover``, the dwell around
    an anchor that an event ends (or, if ``flushed``, the sequence after it); and
    ``own``, which the events of one pause, click or movement share.

    Both are numbered by their place among the actions of the sequence.  Where
    ``deltas`` come in pieces (``cut_deltas``), each piece is scanned by itself
    and numbers only tell its actions apart.  The rows of a sequence, or of a
    piece, stand together and are read once, in order; one anchor and a few
    counters are kept between Arrow batches, so memory stays the same whatever
    their length.
    """
    keys = recorded_by(deltas)
    cut = "piece" in deltas.columns
    groups = [*keys, "piece"] if cut else keys
    hover = pa.struct([("start", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("end", pa.float64()), ("flushed", pa.bool_()), ("number", pa.int64())])
    names = [*groups, *NARROW, *(("part", "run") if cut else ()), "pause"]

    def scanned(table: pa.Table, state: _Open, first_new: bool, last_ends: bool) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        n = batch.num_rows
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        new = np.zeros(n, bool)
        for k in groups:
            new[1:] |= pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
            nulls = batch.column(k).is_null().to_numpy(zero_copy_only=False)
            new[1:] |= nulls[1:] != nulls[:-1]
        new[0] = first_new
        ends = np.append(new[1:], last_ends)
        pause, click, idx = column("pause").astype(bool), column("is_click").astype(bool), column("event_idx").astype(np.int64)
        near, moving = (f(batch.column("dist"), x).fill_null(False).to_numpy(zero_copy_only=False) for f, x in ((pc.less, th.hover_radius), (pc.greater, 0.0)))
        found, state.anchor = _scan(state.anchor, new, ends, near, pause, click, [column(c).tolist() for c in NARROW[1:7]], th)
        closed = np.zeros(n, bool)
        closed[[i for i, h in found.items() if not h[4]]] = True
        moving = moving & ~pause & ~click
        segment = state.segments + np.cumsum(pause | click | closed | new)
        moves = np.flatnonzero(moving)
        starts = click & (idx > 1)
        if len(moves):
            starts[moves] = np.diff(segment[moves], prepend=state.moved) != 0
            state.moved = int(segment[moves[-1]])
        state.segments = int(segment[-1])
        if cut:
            own = np.where(pause, column("run").astype(np.int64), np.where(click, idx, segment))
            numbers = {i: int(idx[i]) for i in found}
        else:
            starts |= pause & (new | ~np.append(state.pause, pause[:-1]))
            begun = closed.astype(np.int64) + starts
            earlier = state.actions + np.cumsum(begun) - begun
            base = _filled(new, earlier, state.earlier)
            placed = _filled(starts, earlier + closed, state.own)
            own = placed - base
            numbers = {i: int(earlier[i] - base[i] + (begun[i] if h[4] else 0)) for i, h in found.items()}
            state.actions, state.earlier, state.own, state.pause = int(earlier[-1] + begun[-1]), int(base[-1]), int(placed[-1]), bool(pause[-1])
        some = pa.array([dict(zip(hover.names, (*h, numbers[i]))) for i, h in found.items()], hover)
        at = np.full(n, -1)
        at[list(found)] = np.arange(len(found))
        hovers = some.take(pa.array(at, mask=at < 0))
        return pa.RecordBatch.from_arrays([*batch.columns, hovers, pa.array(own)], names=[*names, "hover", "own"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first_new = _Open(), True
        held: pa.Table | None = None  # a batch waits until the next shows whether its last row ends a sequence
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                ends = any(held.column(k)[-1].as_py() != table.column(k)[0].as_py() for k in groups)
                yield scanned(held, state, first_new, ends)
                first_new = ends
            held = table
        if held is not None:
            yield scanned(held, state, first_new, True)

    together = deltas.repartition(*groups) if cut else deltas
    ordered = together.withColumn("pause", is_pause(th)).select(*names).sortWithinPartitions(*groups, "event_idx")
    fields = ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes)
    return ordered.mapInArrow(scan, fields + ", hover struct<start:double,x:double,y:double,end:double,flushed:boolean,number:long>, own long")


def _parts() -> Column:
    """The actions that an event has a part in: kind and number."""
    part = lambda kind, number: F.struct(F.lit(kind).alias("type"), F.col(number).alias("number"))
    moving = ~F.col("pause") & ~F.col("is_click") & F.coalesce(F.col("dist") > 0, F.lit(False))
    one = F.when(F.col("pause"), part("pause", "own")).when(F.col("is_click") & (F.col("event_idx") > 1), part("click", "own")).when(moving, part("mouse_movement", "own"))
    hover = part("hover", "hover.number")
    none = F.col("hover").isNull()
    return F.when(none & one.isNotNull(), F.array(one)).when(none, F.array().cast("array<struct<type:string,number:bigint>>")).when(one.isNotNull(), F.array(one, hover)).otherwise(F.array(hover))


def _assembled(scanned: DataFrame) -> DataFrame:
    """One row an action: made_at, type, number and the columns of ``TYPES``,
    added up before they are shuffled by action."""
    keys = recorded_by(scanned)
    cut = "piece" in scanned.columns
    rows = scanned.withColumn("action", F.explode(_parts())).select(*keys, "action.*", *(c for c in scanned.columns if c not in keys))
    moves, hover = F.col("type") == "mouse_movement", F.col("type") == "hover"
    at = F.struct("x", "y", "t")
    # a movement lies in one piece, a pause may go over several
    within = [*keys, "type", "number", *([F.when(moves, F.col("piece")).alias("piece")] if cut else [])]
    grouped = rows.groupBy(*within).agg(
        F.min("event_idx").alias("event_idx"), F.sum("dt").alias("dt"), F.sum("dist").alias("dist"),
        F.min_by(F.struct(F.col("prev_x").alias("x"), F.col("prev_y").alias("y"), F.col("prev_t").alias("t")), "event_idx").alias("first"),
        F.max_by(F.struct("x", "y", "t", "node"), "event_idx").alias("last"), F.first("hover").alias("hover"),
        F.collect_list(F.when(moves, F.struct("event_idx", at.alias("at")))).alias("points"), *([F.min("part").alias("part")] if cut else []),
    )
    path = F.concat(F.array("first"), F.transform(F.array_sort("points"), lambda p: p["at"]))
    pause, click = F.col("type") == "pause", F.col("type") == "click"
    spanned = pause | moves
    values = {
        "start": F.when(hover, F.col("hover.start")).when(spanned, F.col("first.t")),
        "end": F.when(hover, F.col("hover.end")).when(spanned, F.col("last.t")),
        "duration": F.when(hover, F.col("hover.end") - F.col("hover.start")).when(spanned, F.col("dt")),
        "distance": F.when(spanned, F.col("dist")),
        "x": F.when(hover, F.col("hover.x")).when(pause, F.col("first.x")).otherwise(F.col("last.x")),
        "y": F.when(hover, F.col("hover.y")).when(pause, F.col("first.y")).otherwise(F.col("last.y")),
        "timestamp": F.when(click | moves, F.col("last.t")),
        "node": F.when(click, F.col("last.node")),
        "path": F.when(moves, path),
    }
    made_at = F.col("event_idx") + F.when(hover & F.col("hover.flushed"), 1).otherwise(0)
    number = [F.col("part"), F.lit(0).cast("long")] if cut else [F.lit(0), F.col("number")]
    return grouped.select(*keys, made_at.cast("long").alias("made_at"), "type", number[0].alias("part"), number[1].alias("action_idx"), *(v.cast(TYPES[c]).alias(c) for c, v in values.items()))


def pauses(deltas: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Runs of pausing events, each one action from before its first event."""
    keys = recorded_by(deltas)
    marked = deltas.withColumn("pausing", is_pause(th))
    if "run" not in deltas.columns:
        marked = marked.withColumn("run", F.sum(F.when(F.col("pausing"), 0).otherwise(1)).over(recorded(deltas, "event_idx")))
    return marked.where("pausing").groupBy(*keys, "run").agg(
        F.min("event_idx").alias("made_at"), F.min("prev_t").alias("start"), F.max("t").alias("end"), F.sum("dt").alias("duration"), F.sum("dist").alias("distance"), F.min_by("prev_x", "event_idx").alias("x"), F.min_by("prev_y", "event_idx").alias("y")
    ).drop("run")


def clicks(deltas: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Clicks but for a sequence's first event."""
    return deltas.where("is_click and event_idx > 1").select(*recorded_by(deltas), F.col("event_idx").alias("made_at"), F.col("t").alias("timestamp"), "x", "y", "node")


def hovers(deltas: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Dwells around an anchor, with the event that ends each (``made_at``; the
    end of the sequence counts as one more event, ``flushed``)."""
    ended = scan_events(deltas, th).where("hover is not null").select(*recorded_by(deltas), (F.col("event_idx") + F.col("hover.flushed").cast("int")).alias("made_at"), "hover.*").drop("number")
    return ended.withColumn("duration", F.col("end") - F.col("start"))


def movements(deltas: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Moving events in segments that a pause, a click or a hover breaks."""
    made = _assembled(scan_events(deltas, th)).where("type = 'mouse_movement'")
    return made.select(*recorded_by(deltas), "made_at", "start", "end", "duration", "distance", "x", "y", "timestamp", "path")


def group_actions(events: DataFrame, th: Thresholds = DEFAULT, long: int = LONG) -> DataFrame:
    """All actions of all sequences in the order in which they arise.

    Events are shuffled by recorded sequence to be scanned, which numbers the
    actions, and then by action to be put together.  Sequences of more than
    ``long`` events are cut into pieces at pauses and clicks (``pieces``), so
    that one sequence is no single task; what lies between two of these is
    scanned in one task, in constant memory.  Sequences of session objects that
    share a key are numbered one after the other.
    """
    known = recorded_by(events)
    wanted = valid_events(events).select(*known, *(c for c in ("t", "x", "y", "is_click", "node", "ord")))
    made = None
    for deltas in deltas_of(wanted, lambda: is_pause(th), long, events):
        actions = _assembled(scan_events(deltas, th))
        actions = numbered(actions) if "piece" in deltas.columns else actions
        made = actions if made is None else made.unionByName(actions)
    if "session_idx" in known:
        made = numbered_together(made)
    return made.select("session_key", F.col("action_idx").cast("int").alias("action_idx"), "type", *TYPES)


def collapse_duplicate_hovers(actions: DataFrame) -> DataFrame:
    """Of neighbouring hovers with one start and place, the last to end stays."""
    w = sequence("action_idx")
    same = F.coalesce((F.lag("type").over(w) == "hover") & (F.col("type") == "hover"), F.lit(False))
    for c in ("start", "x", "y"):
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    runs = actions.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    best = F.max_by(F.struct(*actions.columns), F.struct(F.coalesce("end", F.lit(-1.0)), "action_idx"))
    return runs.groupBy("session_key", "run").agg(best.alias("a")).select("a.*")


def hover_repair_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count_if(F.col("type") == "hover").alias(name))
    return n(before, "hovers_before").crossJoin(n(after, "hovers_after")).withColumn("removed", F.col("hovers_before") - F.col("hovers_after"))
