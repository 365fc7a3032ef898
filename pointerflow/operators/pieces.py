"""Sequences too long for one task, cut where nothing carries over (AC4, AC6).

A pause and a click end or discard an open hover and break a movement, so what
follows one of them can be scanned without what stands before it.  A long
sequence is dealt out by ranges of time, each range is numbered and compared
with its previous event by itself, the last event and the counts of the ranges
before it are carried over, and the events between two pauses or clicks make a
piece.  Pieces are scanned in any task, and their actions numbered by ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import euclidean
from ..sources.scratch import saved
from .events import ORDER, recorded_by, with_deltas
from .ranges import Ranges, before, key_of, small

#: Events from which a sequence counts as long.
LONG = 1_000_000


def long_sequences(events: DataFrame, most: int = LONG) -> DataFrame | None:
    """The keys of sequences with more than ``most`` events, written once; None
    if there are none, which one count by key tells."""
    keys = recorded_by(events)
    long = events.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key_of(keys).alias("long_key"))
    return None if long.isEmpty() else saved(long, "long-sequences")


def apart(events: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of short and of long sequences."""
    keyed = events.withColumn("long_key", key_of(recorded_by(events)))
    return tuple(keyed.join(small(long), "long_key", how).drop("long_key") for how in ("left_anti", "left_semi"))


def cut_deltas(events: DataFrame, is_pause: Callable[[], Column], parts: int | None = None) -> DataFrame:
    """What ``with_deltas`` gives, without a window over a whole sequence; with
    ``part``, the range of time; ``piece``, the pauses and clicks before an
    event; and ``run``, the events up to it that are no pause.

    Events of one time share a range.  ``is_pause`` reads dt, dist and is_click.
    """
    keys = recorded_by(events)
    dealt = Ranges(events, keys, "t", parts).deal(events).drop("range_key")
    w = Window.partitionBy(*keys, "part").orderBy(*ORDER)

    def judged(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("dt", F.col("t") - F.col("prev_t")).withColumn("dist", euclidean("prev_x", "prev_y", "x", "y"))
        rows = rows.withColumn("pausing", is_pause())
        return rows.withColumns({"cut": (F.col("pausing") | F.col("is_click")).cast("long"), "still": (~F.col("pausing")).cast("long")})

    lags = [F.lag(c).over(w).alias(f"prev_{c}") for c in ("t", "x", "y")]
    local = judged(dealt.select("*", F.row_number().over(w).alias("n"), *lags))
    # the first event of a range is judged once its previous one is known
    follows = F.when(F.col("n") > 1, 1).otherwise(0)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumns({f"{c}s": F.sum(F.col(c) * follows).over(upto) for c in ("cut", "still")})
    place = F.struct("t", "x", "y", "is_click")
    ends = local.groupBy(*keys, "part").agg(
        F.count("*").alias("n"), F.max("cuts").alias("cuts"), F.max("stills").alias("stills"), F.min_by(place, "n").alias("first"), F.max_by(place, "n").alias("last")
    )
    over = Window.partitionBy(*keys).orderBy("part")  # a row a range
    ends = judged(ends.withColumn("last", F.lag("last").over(over)).select(*keys, "part", "n", "cuts", "stills", "first.*", *(F.col(f"last.{c}").alias(f"prev_{c}") for c in ("t", "x", "y"))))
    ends = ends.withColumns({f"{c}s": F.col(f"{c}s") + F.col(c) for c in ("cut", "still")})
    carried = before(ends.select(*keys, "part", "n", "cuts", "stills", "cut", "still", *(f"prev_{c}" for c in ("t", "x", "y"))), keys, "part", ["n", "cuts", "stills"])
    carried = carried.select(key_of([*keys, "part"]).alias("at"), *(F.col(c).alias(f"carried_{c}") for c in ("n_before", "cuts_before", "stills_before", "cut", "still", "prev_t", "prev_x", "prev_y")))
    # written once: what events get must agree with what their ranges count
    rows = local.withColumn("at", key_of([*keys, "part"])).join(small(saved(carried, "carried-events")), "at").drop("at")
    known = {f"prev_{c}": F.when(F.col("n") > 1, F.col(f"prev_{c}")).otherwise(F.col(f"carried_prev_{c}")) for c in ("t", "x", "y")}
    rows = judged(rows.withColumns(known))
    piece = F.col("cuts") + F.col("carried_cuts_before") + F.col("carried_cut") - F.col("cut")
    run = F.col("stills") + F.col("carried_stills_before") + F.col("carried_still")
    rows = rows.withColumns({"event_idx": F.col("n") + F.col("carried_n_before"), "piece": piece, "run": run})
    return rows.drop("n", "pausing", "cut", "still", "cuts", "stills", *(c for c in rows.columns if c.startswith("carried_")))


def deltas_of(events: DataFrame, is_pause: Callable[[], Column], most: int = LONG, counted: DataFrame | None = None) -> list[DataFrame]:
    """Deltas of the short sequences and, if there are any, of the long ones.

    Lengths are counted on ``counted``, if given: rows that may hold more than
    ``events`` and need only the keys to be read.
    """
    long = long_sequences(events if counted is None else counted, most)
    if long is None:
        return [with_deltas(events)]
    short, far = apart(events, long)
    return [with_deltas(short), cut_deltas(far, is_pause)]


def numbered(actions: DataFrame) -> DataFrame:
    """``actions`` of long sequences with ``action_idx``: their place in the range
    of their first event, and the actions of the ranges before."""
    keys = recorded_by(actions)
    w = Window.partitionBy(*keys, "part").orderBy("made_at", F.when(F.col("type") == "hover", 0).otherwise(1))
    placed = actions.withColumn("place", F.row_number().over(w) - 1)
    totals = before(actions.groupBy(*keys, "part").agg(F.count("*").alias("n")), keys, "part", ["n"])
    joined = placed.join(totals.drop("n"), [*keys, "part"])
    return joined.withColumn("action_idx", F.col("place") + F.col("n_before")).drop("place", "n_before")


def numbered_together(actions: DataFrame) -> DataFrame:
    """Actions of session objects that share a key, numbered one object after the
    other; the objects before one count by sums over runs of them."""
    totals = actions.groupBy("session_key", "session_idx").agg((F.max("action_idx") + 1).alias("n"))
    totals = before(totals, ["session_key"], "session_idx", ["n"]).select("session_key", "session_idx", "n_before")
    return actions.join(totals, ["session_key", "session_idx"]).withColumn("action_idx", F.col("action_idx") + F.col("n_before")).drop("n_before")
