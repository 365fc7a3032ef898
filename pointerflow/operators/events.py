"""Raw sessions to ordered events (PF1-PF6, CH1-CH6, AC1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import euclidean

ORDER = ("t", "is_click", "ord")


def modules_of(sessions: DataFrame, prefix: str = "behavior_") -> list[str]:
    return [c for c in sessions.columns if c.startswith(prefix)]


def explode_events(sessions: DataFrame, modules: list[str] | None = None) -> DataFrame:
    """One row an event: moves, then clicks, of every module of every session.

    Missing modules and lists are empty; missing participants and sessions are
    ``unknown``.  Order within a sequence: time, moves first, place in the list.
    ``session_idx``, if there, stays: sessions that share ids, or have none, are
    sequences of their own until their actions are numbered.
    """
    modules = modules or modules_of(sessions)
    point = lambda e, click, node: F.struct(F.lit(click).alias("is_click"), e["timestamp"].cast("double").alias("t"), e["x"].cast("double").alias("x"), e["y"].cast("double").alias("y"), node.alias("node"))
    lists = []
    for m in modules:
        moves = F.transform(F.col(f"{m}.mouseMovements"), lambda e: point(e, False, F.lit(None).cast("string")))
        clicks = F.transform(F.col(f"{m}.clicks.clickDetails"), lambda e: point(e, True, e["node"]))
        both = F.concat(*(F.coalesce(a, F.array().cast("array<struct<is_click:boolean,t:double,x:double,y:double,node:string>>")) for a in (moves, clicks)))
        lists.append(F.struct(F.lit(m).alias("module"), both.alias("events")))
    place = [F.col(c).cast("long").alias(c) for c in sessions.columns if c == "session_idx"]
    kept = [c for c in sessions.columns if c == "session_idx"]
    base = sessions.select(F.coalesce("processNumber", F.lit("unknown")).alias("participant"), F.coalesce("sessionId", F.lit("unknown")).alias("sess"), *place, F.explode(F.array(*lists)).alias("m"))
    rows = base.select("participant", "sess", *kept, "m.module", F.posexplode("m.events").alias("ord", "e"))
    key = F.concat_ws("|", "participant", "sess", "module").alias("session_key")
    return rows.select("participant", "sess", *kept, "module", key, "e.t", "e.x", "e.y", "e.is_click", "e.node", F.col("ord").cast("long").alias("ord"))


def valid_events(events: DataFrame) -> DataFrame:
    return events.dropna(subset=["t", "x", "y"])


def select_sessions(sessions: DataFrame, n: int = 40, position: str = "session_idx") -> DataFrame:
    """The first sessions by their place in the file."""
    return sessions.where(F.col(position) < n)


def sequence(*order: str):
    return Window.partitionBy("session_key").orderBy(*(order or ORDER))


def recorded_by(df: DataFrame) -> list[str]:
    """What tells recorded sequences apart: the key, and the session object's
    place in the file where it is known."""
    return ["session_key", *(c for c in df.columns if c == "session_idx")]


def recorded(df: DataFrame, *order: str):
    return Window.partitionBy(*recorded_by(df)).orderBy(*(order or ORDER))


def with_deltas(events: DataFrame) -> DataFrame:
    """dt and dist to the previous event of the sequence, with its place."""
    w = recorded(events)
    rows = events.select("*", F.row_number().over(w).alias("event_idx"), *(F.lag(c).over(w).alias(f"prev_{c}") for c in ("t", "x", "y")))
    return rows.withColumn("dt", F.col("t") - F.col("prev_t")).withColumn("dist", euclidean("prev_x", "prev_y", "x", "y"))


def _part(key: Column, i: int) -> Column:
    return F.trim(F.coalesce(F.get(F.split(key, r"\|"), F.lit(i)), F.lit("")))


def with_session_parts(df: DataFrame, key: str = "session_key") -> DataFrame:
    k = F.col(key)
    return df.withColumns({"key_participant": _part(k, 0), "key_session": _part(k, 1), "key_module": _part(k, 2)})


def with_participant_id(df: DataFrame, key: str = "session_key", strict: bool = True) -> DataFrame:
    """The key's first part as ``participant_id``; a present column is kept."""
    if "participant_id" in df.columns:
        return df.withColumn("participant_id", F.col("participant_id").cast("string"))
    k = F.col(key)
    bad = k.isNull() | ~k.contains("|") | (_part(k, 0) == "")
    pid = _part(k, 0)
    return df.withColumn("participant_id", F.when(bad, F.raise_error(F.concat(F.lit("malformed key: "), F.coalesce(k, F.lit("null"))))).otherwise(pid) if strict else F.when(~bad, pid))


def count_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("sessions"))


def unique_participants(sessions: DataFrame) -> DataFrame:
    """All participants named by a session or by one of its modules."""
    named = [sessions.select(F.col("processNumber").alias("participant"))]
    named += [sessions.select(F.col(f"{m}.userInfo.participantId").alias("participant")) for m in modules_of(sessions)]
    out = named[0]
    for other in named[1:]:
        out = out.union(other)
    return out.where("participant is not null").distinct()


def participant_sessions(sessions: DataFrame, position: str = "session_idx") -> DataFrame:
    return sessions.groupBy(F.coalesce("processNumber", F.lit("unknown")).alias("participant")).agg(F.array_sort(F.collect_list(position)).alias("sessions"))


def _by_module(sessions: DataFrame, present) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(m).alias("module"), present(m).alias("there")) for m in modules_of(sessions)))
    return sessions.select(F.coalesce("processNumber", F.lit("unknown")).alias("participant"), F.explode(parts).alias("p")).select("participant", "p.*").where("there")


def modules_per_participant(sessions: DataFrame) -> DataFrame:
    return _by_module(sessions, lambda m: F.col(m).isNotNull()).groupBy("participant").agg(F.count_distinct("module").alias("modules"))


def completed_by_module(sessions: DataFrame) -> DataFrame:
    """Sessions with a clicks block for each module, and in all (module null)."""
    return _by_module(sessions, lambda m: F.col(f"{m}.clicks").isNotNull()).rollup("module").agg(F.count("*").alias("completed"))


def check_monotonic(actions: DataFrame) -> DataFrame:
    """Actions whose time lies before that of the action in front of them."""
    now = F.coalesce("timestamp", "end")
    rows = actions.select("session_key", "action_idx", now.alias("current"), F.lag(now).over(sequence("action_idx")).alias("previous"))
    return rows.where("current < previous").withColumn("difference", F.col("current") - F.col("previous"))
