"""The registered queries, each with its SQL twin where SQL can say it.

Doubles are rounded to six places and whole numbers widened on both sides.  A
nudge first keeps means that end in a five from falling to either side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import actions as ac
from ..operators import analysis as an
from ..operators import calibrate as th
from ..operators import events as ev
from ..operators import features as fe
from ..operators import folds as fo
from ..operators import metrics as rm
from ..operators import preprocess as pr
from ..operators import reports as rp
from ..operators import sequences as sq
from ..operators import split as sp
from ..operators import stats as st
from ..sources import fixtures as fx
from ..sources import io
from ..sources.scratch import saved, scratch
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


NUDGE = 3e-10


def normal(df: DataFrame) -> DataFrame:
    def one(c: str, t: str):
        v = F.col(f"`{c}`")
        if t in ("double", "float") or t.startswith("decimal"):
            return F.round(v.cast("double") + NUDGE, 6).alias(c)
        return v.cast("bigint").alias(c) if t in ("int", "smallint", "tinyint", "bigint") else v

    return df.select(*(one(c, t) for c, t in df.dtypes))


def sql(prefix: str, fields: str, rest: str) -> str:
    """``fields`` is ``name=expression`` separated by ``;``: ~ marks a double to
    be rounded, # a whole number."""
    out = []
    for f in fields.split(";"):
        name, _, e = f.strip().partition("=")
        e = e or name.lstrip("~#")
        if name[0] == "~":
            out.append(f'round(CAST({e} AS DOUBLE) + {NUDGE}, 6) AS "{name[1:]}"')
        elif name[0] == "#":
            out.append(f'CAST({e} AS BIGINT) AS "{name[1:]}"')
        else:
            out.append(f'{e} AS "{name}"')
    return f"{prefix} SELECT {', '.join(out)} {rest}"


def query(name: str, twin: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: normal(f(spark, sf_dir))
        if twin:
            ORACLE_SQL[name] = twin
        return f

    return register


def actions_of(s: SparkSession, d: str) -> DataFrame:
    """Actions, written once: what follows reads them several times."""
    path = scratch(s, "actions")
    ac.group_actions(fx.events(s, d)).write.parquet(path)
    return s.read.parquet(path)


def deltas_of(s: SparkSession, d: str) -> DataFrame:
    return ev.with_deltas(ev.valid_events(fx.events(s, d)))


def sessions_of(s: SparkSession, d: str) -> DataFrame:
    """Raw sessions through the JSON source."""
    path = scratch(s, "sessions")
    raw = fx.raw_sessions(s, d)
    io.write_sessions(raw.select(F.xxhash64("file_order").alias("session_idx"), "processNumber", "sessionId", *fx.MODULES), path)
    return io.read_sessions(s, path, fx.MODULES, lines=True)


def placed_sessions_of(s: SparkSession, d: str) -> DataFrame:
    """Raw sessions with their places in the file."""
    return io.with_positions(fx.raw_sessions(s, d), scratch(s, "sessions-ordered"))


def features_of(s: SparkSession, d: str) -> DataFrame:
    return ev.with_participant_id(fe.extract_features(actions_of(s, d)))


def written_features_of(s: SparkSession, d: str) -> DataFrame:
    """Features, written once for what reads them several times."""
    return saved(features_of(s, d), "features")


# -- projections, checks

_EV = "WITH " + o.EVENTS
_WHO = "CASE WHEN CAST(substr(participant, 2) AS INTEGER) % 17 = 0 THEN 'unknown' ELSE participant END"


@query("pf1_explode_events", sql(_EV, f"participant={_WHO};sess;module;~t;~x;~y;is_click;node", "FROM ev"))
def _(s, d):
    return ev.explode_events(sessions_of(s, d)).select("participant", "sess", "module", "t", "x", "y", "is_click", "node")


@query("pf2_valid_events", sql(_EV, "module;#n=count(*);#latest=max(ord)", "FROM ev WHERE ord % 7 <> 0 AND ord % 11 <> 0 AND ord % 13 <> 0 GROUP BY module"))
def _(s, d):
    """Events of which some lack a time or a place."""
    lacking = {c: F.when(F.col("ord") % n != 0, F.col(c)) for c, n in (("t", 7), ("x", 11), ("y", 13))}
    return ev.valid_events(fx.events(s, d).withColumns(lacking)).groupBy("module").agg(F.count("*").alias("n"), F.max("ord").alias("latest"))


@query("pf3_select_sessions", sql(_EV, "#n=least(40, count(DISTINCT participant || '|' || sess))", "FROM ev"))
def _(s, d):
    path = scratch(s, "sessions-lines")
    io.write_sessions(io.with_positions(fx.raw_sessions(s, d), scratch(s, "sessions-ordered")).drop("file_order"), path)
    return ev.select_sessions(io.read_sessions(s, path, fx.MODULES, lines=True)).agg(F.count("*").alias("n"))


@query("pf4_session_parts", sql(o.METRICS, "session_id;key_participant=participant_id;key_session=split_part(session_id, '|', 2);key_module=module", "FROM sm"))
def _(s, d):
    return ev.with_session_parts(fx.session_metrics(s, d), "session_id").select("session_id", "key_participant", "key_session", "key_module")


@query("pf5_participant_id", sql(_EV, "participant_id=participant;#n=count(*)", "FROM ev GROUP BY participant"))
def _(s, d):
    return ev.with_participant_id(fx.events(s, d)).groupBy("participant_id").agg(F.count("*").alias("n"))


@query("pf6_check_monotonic_reversed", sql(o.ACTIONS + ', mo AS (SELECT session_key, action_idx, coalesce("timestamp", "end") AS cur, lag(coalesce("timestamp", "end")) OVER (PARTITION BY session_key ORDER BY action_idx DESC) AS prev FROM ac)', "session_key;#action_idx=-action_idx;~current=cur;~previous=prev;~difference=cur - prev", "FROM mo WHERE cur < prev"))
def _(s, d):
    """The same sequences told backwards, in which times do fall."""
    return ev.check_monotonic(actions_of(s, d).withColumn("action_idx", -F.col("action_idx")))


@query("pf6_check_monotonic", sql(o.ACTIONS + ', mo AS (SELECT session_key, action_idx, coalesce("timestamp", "end") AS cur, lag(coalesce("timestamp", "end")) OVER (PARTITION BY session_key ORDER BY action_idx) AS prev FROM ac)', "session_key;#action_idx;~current=cur;~previous=prev;~difference=cur - prev", "FROM mo WHERE cur < prev"))
def _(s, d):
    return ev.check_monotonic(actions_of(s, d))


_SPLIT = _EV + """, pe AS (SELECT DISTINCT participant AS participant_id FROM ev), sl AS (SELECT participant_id, CASE WHEN row_number() OVER (ORDER BY md5('7|' || participant_id), participant_id) <= floor(0.8 * (SELECT count(*) FROM pe)) THEN 'train' ELSE 'test' END AS split FROM pe)"""


def split_of(s, d):
    return sp.split_participants(ev.with_participant_id(fx.events(s, d)), 0.8, 7)


@query("pf7_check_columns", sql("WITH " + o.EVENTS, "#n=count(*);#clicks=count(*) FILTER (WHERE is_click)", "FROM ev"))
def _(s, d):
    """Events whose required columns are all there."""
    e = fx.events(s, d)
    sp.check_columns(e, ["session_key", "t", "x", "y", "is_click"])
    return e.agg(F.count("*").alias("n"), F.count_if("is_click").alias("clicks"))


@query("pf8_check_disjoint", sql(_SPLIT, "sides='split';#overlap=count(*)", "FROM (SELECT participant_id FROM sl WHERE split = 'train' INTERSECT SELECT participant_id FROM sl WHERE split = 'test') UNION ALL SELECT 'modules', count(*) FROM (SELECT participant FROM ev WHERE module = 'behavior_RESS' INTERSECT SELECT participant FROM ev WHERE module = 'behavior_EADS')"))
def _(s, d):
    """The sides of a split, which share nobody, and two modules, which do."""
    t, e = split_of(s, d), ev.with_participant_id(fx.events(s, d))
    pairs = {"split": [t.where(f"split = '{x}'") for x in ("train", "test")], "modules": [e.where(f"module = 'behavior_{x}'") for x in ("RESS", "EADS")]}
    split, modules = (sp.check_disjoint(*two).agg(F.lit(name).alias("sides"), F.count("*").alias("overlap")) for name, two in pairs.items())
    return split.unionByName(modules)


@query("pf9_check_coverage", sql(_SPLIT, "problem='missing';participant_id", "FROM sl WHERE split = 'test'"))
def _(s, d):
    t = split_of(s, d)
    return sp.check_coverage([t.where("split = 'train'")], t).select("problem", "participant_id")


@query("pf10_one_participant_per_session", sql(_EV, "module;#participants=count(DISTINCT participant)", "FROM ev GROUP BY module HAVING count(DISTINCT participant) > 1"))
def _(s, d):
    return sp.check_one_participant_per_session(ev.with_participant_id(fx.events(s, d)), "module")


@query("pf11_check_finite", sql(o.FEATURES, "column_name='jitter';#bad=count(*) FILTER (WHERE jitter IS NULL)", "FROM ft UNION ALL SELECT 'x', count(*) FILTER (WHERE x IS NULL) FROM ft"))
def _(s, d):
    return sp.check_finite(features_of(s, d), ["jitter", "x"])


@query("pf12_participant_mismatch", sql(o.METRICS, "#mismatches=count(*) FILTER (WHERE participant_id <> split_part(session_id, '|', 1));#n=count(*)", "FROM sm"))
def _(s, d):
    return sp.participant_mismatch(fx.session_metrics(s, d))


@query("pf13_improved", sql(o.METRICS, "session_id;improved=mse_model < mse_baseline;~improvement_pct", "FROM sm"))
def _(s, d):
    return rm.with_improved(fx.session_metrics(s, d)).select("session_id", "improved", rm.improvement_pct().alias("improvement_pct"))


# -- sessions to actions


@query("ac1_deltas", sql("WITH " + o.DELTAS, "session_key;#event_idx;~dt;~dist", "FROM dl"))
def _(s, d):
    return deltas_of(s, d).select("session_key", "event_idx", "dt", "dist")


_SPAN = "session_key;#made_at;~start;~end;~duration;~distance;~x;~y"


@query("ac2_pauses", sql("WITH " + o.DELTAS + o.PAUSES, _SPAN.replace("~start", '~start="start"').replace("~end", '~end="end"'), "FROM pz"))
def _(s, d):
    return ac.pauses(deltas_of(s, d))


@query("ac3_clicks", sql("WITH " + o.DELTAS, "session_key;#made_at=event_idx;~timestamp=t;~x;~y;node", "FROM dl WHERE is_click AND event_idx > 1"))
def _(s, d):
    return ac.clicks(deltas_of(s, d))


@query("ac4_hovers", sql("WITH RECURSIVE " + o.DELTAS + o.HOVERS, 'session_key;#made_at;flushed;~start="start";~end="end";~x;~y', "FROM hv"))
def _(s, d):
    return ac.hovers(deltas_of(s, d)).drop("duration")


@query("ac5_movements", sql("WITH RECURSIVE " + o.DELTAS + o.HOVERS + o.MOVES, 'session_key;#made_at;~start="start";~end="end";~duration;~distance;~x;~y;#points=n_points', "FROM mv"))
def _(s, d):
    return ac.movements(deltas_of(s, d)).select("session_key", "made_at", "start", "end", "duration", "distance", "x", "y", F.size("path").alias("points"))


@query("ac6_actions", sql(o.ACTIONS, 'session_key;#action_idx;type;~start="start";~end="end";~duration;~distance;~x;~y;~timestamp="timestamp";node;#points=n_points', "FROM ac"))
def _(s, d):
    return actions_of(s, d).withColumn("points", F.size("path")).withColumn("points", F.when(F.col("points") >= 0, F.col("points"))).drop("path")


_SHARED = o.ACTIONS + """, sh AS (SELECT ac.*, split_part(session_key, '|', 2) AS sess, CASE WHEN CAST(substr(session_key, 2, 6) AS INTEGER) % 17 = 0 THEN 'unknown' ELSE split_part(session_key, '|', 1) END || '|' || split_part(session_key, '|', 2) || '|' || split_part(session_key, '|', 3) AS shared_key FROM ac)"""


@query("ac6_actions_in_pieces", ORACLE_SQL["ac6_actions"])
def _(s, d):
    """The same actions with every sequence cut into ranges and pieces."""
    a = ac.group_actions(fx.events(s, d), long=1)
    return a.withColumn("points", F.size("path")).withColumn("points", F.when(F.col("points") >= 0, F.col("points"))).drop("path")


@query("ac6_actions_of_shared_keys", sql(_SHARED, 'session_key=shared_key;#action_idx=row_number() OVER (PARTITION BY shared_key ORDER BY session_key, action_idx) - 1;type;~start="start";~end="end";~duration;~distance;~x;~y;~timestamp="timestamp";node;#points=n_points', "FROM sh"))
def _(s, d):
    """Sessions without a participant share a key and stay sequences of their own."""
    a = ac.group_actions(ev.explode_events(placed_sessions_of(s, d)))
    return a.withColumn("points", F.size("path")).withColumn("points", F.when(F.col("points") >= 0, F.col("points"))).drop("path")


_DUP = o.ACTIONS + """, dd AS (SELECT * FROM ac WHERE type <> 'x' UNION ALL SELECT session_key, made_at, rank, type, "start", "end" + 5, duration, distance, x, y, "timestamp", node, n_points, segment, action_idx FROM ac WHERE type = 'hover'),
 di AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY action_idx, "end") - 1 AS idx FROM dd)"""


def doubled(s, d):
    """Actions with every hover told twice, the second ending later."""
    a = actions_of(s, d)
    both = a.unionByName(a.where("type = 'hover'").withColumn("end", F.col("end") + 5))
    return both.withColumn("action_idx", F.row_number().over(ev.sequence("action_idx", "end")) - 1)


@query("ac7_collapse_hovers", sql(_DUP, 'session_key;#action_idx=idx;type;~start="start";~end="end";~duration;~distance;~x;~y;~timestamp="timestamp";node;#points=n_points', """FROM (SELECT *, lead(type) OVER w AS nt, lead("start") OVER w AS ns FROM di WINDOW w AS (PARTITION BY session_key ORDER BY idx)) WHERE NOT (type = 'hover' AND coalesce(nt = 'hover' AND ns = "start", false))"""))
def _(s, d):
    n = F.size("path")
    return ac.collapse_duplicate_hovers(doubled(s, d)).withColumn("points", F.when(n >= 0, n)).drop("path")


@query("ac8_hover_repair", sql(o.ACTIONS, "#hovers_before=2 * count(*);#hovers_after=count(*);#removed=count(*)", "FROM ac WHERE type = 'hover'"))
def _(s, d):
    before = doubled(s, d)
    return ac.hover_repair_summary(before, ac.collapse_duplicate_hovers(before))


# -- raw data and thresholds

_SES = _EV + f", se AS (SELECT {_WHO} AS who, participant, sess, module, max(CASE WHEN CAST(substr(participant, 2) AS INTEGER) % 17 = 0 THEN 0 ELSE 1 END) AS named FROM ev GROUP BY ALL)"


@query("ch1_count_sessions", sql(_SES, "#sessions=count(DISTINCT participant || '|' || sess)", "FROM se"))
def _(s, d):
    return ev.count_sessions(sessions_of(s, d))


@query("ch2_unique_participants", sql(_SES, "participant", "FROM se GROUP BY participant"))
def _(s, d):
    return ev.unique_participants(sessions_of(s, d))


@query("ch3_participant_sessions", sql(_SES + ", si AS (SELECT DISTINCT who, dense_rank() OVER (ORDER BY participant || '|' || sess) - 1 AS i FROM se)", "participant=who;sessions=array_to_string(list_sort(list(i)), ',')", "FROM si GROUP BY who"))
def _(s, d):
    return ev.participant_sessions(placed_sessions_of(s, d)).select("participant", F.array_join("sessions", ",").alias("sessions"))


@query("ch4_modules_per_participant", sql(_SES, "participant=who;#modules=count(DISTINCT module)", "FROM se GROUP BY who"))
def _(s, d):
    return ev.modules_per_participant(sessions_of(s, d))


@query("ch5_ch6_completed", sql(_SES, "module;#completed=count(*)", "FROM se GROUP BY ROLLUP (module)"))
def _(s, d):
    return ev.completed_by_module(sessions_of(s, d))


_PS = "".join(f";~p{p}=quantile_cont({{v}}, {p / 100})" for p in th.POINTS)


@query("th1_gap_percentiles", sql("WITH " + o.DELTAS, "#n=count(dt)" + _PS.format(v="dt"), "FROM dl WHERE dt IS NOT NULL"))
def _(s, d):
    return th.gap_percentiles(deltas_of(s, d))


@query("th1_gap_percentiles_by_selection", ORACLE_SQL["th1_gap_percentiles"])
def _(s, d):
    return th.gap_percentiles(deltas_of(s, d), selected=True)


@query("th2_run_hovers", sql(o.RUNS, 'session_key;~start="start";~end="end";~dwell;valid;final', "FROM rn"))
def _(s, d):
    return th.run_hovers(deltas_of(s, d))


_SHARED_RUNS = o.RUNS + """, sr AS (SELECT rn.*, CASE WHEN CAST(substr(session_key, 2, 6) AS INTEGER) % 17 = 0 THEN 'unknown' ELSE split_part(session_key, '|', 1) END || '|' || split_part(session_key, '|', 2) || '|' || split_part(session_key, '|', 3) AS shared_key FROM rn)"""


def shared_deltas_of(s, d):
    """Deltas of session objects of which some share a key."""
    return ev.with_deltas(ev.valid_events(ev.explode_events(placed_sessions_of(s, d))))


@query("th2_run_hovers_of_shared_keys", sql(_SHARED_RUNS, 'session_key=shared_key;~start="start";~end="end";~dwell;valid;final', "FROM sr"))
def _(s, d):
    return th.run_hovers(shared_deltas_of(s, d)).drop("session_idx")


@query("th3_hover_percentiles", sql(o.RUNS, "#n=count(*)" + _PS.format(v="dwell"), "FROM rn"))
def _(s, d):
    return th.hover_percentiles(th.run_hovers(deltas_of(s, d)))


@query("th3_hover_percentiles_legacy", sql(o.RUNS, "#n=count(*)" + _PS.format(v="dwell"), "FROM (SELECT dwell FROM rn UNION ALL SELECT dwell FROM rn WHERE valid AND final)"))
def _(s, d):
    return th.hover_percentiles(th.run_hovers(deltas_of(s, d)), legacy_double_count=True)


@query("th3_hover_percentiles_by_selection", ORACLE_SQL["th3_hover_percentiles"])
def _(s, d):
    return th.hover_percentiles(th.run_hovers(deltas_of(s, d)), selected=True)


@query("th4_valid_hover_ratio", sql(o.RUNS, "#valid=count(*) FILTER (WHERE valid);#candidates=count(*);~ratio=count(*) FILTER (WHERE valid) / count(*)", "FROM rn"))
def _(s, d):
    return th.valid_hover_ratio(th.run_hovers(deltas_of(s, d)))


_AV = "".join(f";~p{p}=avg(p{p})" for p in th.POINTS)
_PQ = ", ".join(f"quantile_cont({{v}}, {p / 100}) AS p{p}" for p in th.POINTS)


@query("th5_gaps_by_module", sql("WITH " + o.DELTAS + ", pm AS (SELECT session_key, " + _PQ.format(v="dt") + " FROM dl WHERE dt IS NOT NULL GROUP BY session_key)", "module=split_part(session_key, '|', 3);#sequences=count(*)" + _AV, "FROM pm GROUP BY 1"))
def _(s, d):
    return th.percentiles_by_module(deltas_of(s, d), "dt")


@query("th5_hovers_by_module", sql(o.RUNS + ", pm AS (SELECT session_key, " + _PQ.format(v="dwell") + " FROM rn WHERE valid GROUP BY session_key)", "module=split_part(session_key, '|', 3);#sequences=count(*)" + _AV, "FROM pm GROUP BY 1"))
def _(s, d):
    return th.percentiles_by_module(th.run_hovers(deltas_of(s, d)).where("valid"), "dwell")


@query("th6_threshold_sweep", sql(o.RUNS, "kind='gap';#threshold=g;#n=(SELECT count(*) FROM dl WHERE dt > g)", "FROM range(100, 1100, 100) r(g) UNION ALL SELECT 'dwell', g, (SELECT count(*) FROM rn WHERE valid AND dwell >= g) FROM range(500, 2500, 250) r(g)"))
def _(s, d):
    deltas = deltas_of(s, d)
    return th.threshold_sweep(deltas, th.run_hovers(deltas))


# the sequences are those of the plain form, whatever keys they share
for _name in ("th3_hover_percentiles", "th4_valid_hover_ratio", "th5_gaps_by_module", "th5_hovers_by_module", "th6_threshold_sweep"):
    ORACLE_SQL[f"{_name}_of_shared_keys"] = ORACLE_SQL[_name]
QUERIES["th3_hover_percentiles_of_shared_keys"] = lambda s, d: normal(th.hover_percentiles(th.run_hovers(shared_deltas_of(s, d))))
QUERIES["th4_valid_hover_ratio_of_shared_keys"] = lambda s, d: normal(th.valid_hover_ratio(th.run_hovers(shared_deltas_of(s, d))))
QUERIES["th5_gaps_by_module_of_shared_keys"] = lambda s, d: normal(th.percentiles_by_module(shared_deltas_of(s, d), "dt"))
QUERIES["th5_hovers_by_module_of_shared_keys"] = lambda s, d: normal(th.percentiles_by_module(th.run_hovers(shared_deltas_of(s, d)).where("valid"), "dwell"))
QUERIES["th6_threshold_sweep_of_shared_keys"] = lambda s, d: normal(th.threshold_sweep(shared_deltas_of(s, d), th.run_hovers(shared_deltas_of(s, d))))


# -- scalar functions


@query("sf2_turn_angle", sql("WITH " + o.DELTAS + ", vv AS (SELECT *, x - prev_x AS dx, y - prev_y AS dy, prev_x - lag(prev_x) OVER w AS pdx, prev_y - lag(prev_y) OVER w AS pdy FROM dl WINDOW w AS (PARTITION BY session_key ORDER BY event_idx))", "session_key;#event_idx;~angle=CASE WHEN sqrt(dx * dx + dy * dy) * sqrt(pdx * pdx + pdy * pdy) = 0 THEN 0 ELSE acos(greatest(-1.0, least(1.0, (dx * pdx + dy * pdy) / (sqrt(dx * dx + dy * dy) * sqrt(pdx * pdx + pdy * pdy))))) END", "FROM vv WHERE pdx IS NOT NULL"))
def _(s, d):
    w = ev.sequence("event_idx")
    v = deltas_of(s, d).withColumns({"dx": F.col("x") - F.col("prev_x"), "dy": F.col("y") - F.col("prev_y"), "pdx": F.col("prev_x") - F.lag("prev_x").over(w), "pdy": F.col("prev_y") - F.lag("prev_y").over(w)})
    return v.where("pdx is not null").select("session_key", "event_idx", scalar.turn_angle("pdx", "pdy", "dx", "dy").alias("angle"))


@query("sf3_path_steps", sql(o.ACTIONS + ", ps AS (SELECT *, pt - lag(pt) OVER w AS dt, sqrt((px - lag(px) OVER w) * (px - lag(px) OVER w) + (py - lag(py) OVER w) * (py - lag(py) OVER w)) AS dd FROM pt WINDOW w AS (PARTITION BY session_key, action_idx ORDER BY i))", "session_key;#action_idx;#steps=count(dt);~dist=sum(dd);~speed=sum(CASE WHEN dt > 0 THEN dd / dt ELSE 0 END)", "FROM ps WHERE dt IS NOT NULL GROUP BY session_key, action_idx"))
def _(s, d):
    a = actions_of(s, d).where("type = 'mouse_movement'")
    p = scalar.path_steps("path")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v)
    return a.select("session_key", "action_idx", F.size(p["dt"]).alias("steps"), add(p["dist"]).alias("dist"), add(p["speed"]).alias("speed"))


@query("sf4_self_intersections", sql(o.FEATURES, "session_key;#action_idx;#crossings", "FROM km"))
def _(s, d):
    a = actions_of(s, d)
    return fe.movement_features(a, fe.session_xy_stats(a)).select("session_key", "action_idx", F.col("self_intersections").alias("crossings"))


_TAG = "nullif(lower(regexp_extract(regexp_replace({c}, '<!--.*?-->', '', 'gs'), '<([A-Za-z][A-Za-z0-9:-]*)', 1)), '')"


@query("sf5_dom_tag", sql("", "#page_id;tag=" + _TAG.format(c="html"), "FROM pages"))
def _(s, d):
    return fx.table(s, d, "pages").select("page_id", scalar.dom_tag("html").alias("tag"))


@query("sf6_safe_float", sql("", "#n=count(*);#numbers=count(*) FILTER (WHERE event_id % 11 <> 0);~total=sum(CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value) AS BIGINT) % 22 END)", "FROM events WHERE event_type = 'signup'"))
def _(s, d):
    v = scalar.safe_float("EADS_Depressao")
    return fx.questionnaires(s, d).agg(F.count("*").alias("n"), F.count(v).alias("numbers"), F.sum(v).alias("total"))


@query("sf7_normalize_xy", sql(o.STATS, "session_key;#action_idx;~x=(ac.x - x_center) / x_scale;~y=(ac.y - y_center) / y_scale", "FROM ac JOIN st USING (session_key)"))
def _(s, d):
    a = actions_of(s, d)
    j = a.join(fe.session_xy_stats(a), "session_key")
    return j.select("session_key", "action_idx", scalar.normalize("x", "x_center", "x_scale").alias("x"), scalar.normalize("y", "y_center", "y_scale").alias("y"))


@query("sf8_sf9_sf10_number_functions", sql("", "#l_orderkey;#l_linenumber;~logged=ln(1 + greatest(l_quantity - 10, 0));~clipped=least(greatest(l_discount, 0.02), 0.08);~finite=CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END", "FROM lineitem"))
def _(s, d):
    ratio = F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.col("l_discount") / F.col("l_tax"))
    return fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.log1p_clip(F.col("l_quantity") - 10).alias("logged"), scalar.clip("l_discount", F.lit(0.02), F.lit(0.08)).alias("clipped"), scalar.null_nonfinite(ratio).alias("finite"))


@query("sf11_parse_sessnum", sql("", "sessnum=CAST(1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR);#n=count(*)", "FROM events WHERE event_type = 'signup' GROUP BY 1"))
def _(s, d):
    return fx.questionnaires(s, d).groupBy(scalar.parse_sessnum("`Session ID`").alias("sessnum")).agg(F.count("*").alias("n"))


# -- features


@query("fe1_xy_stats", sql(o.STATS, "session_key;~x_center;~x_scale;~y_center;~y_scale", "FROM st"))
def _(s, d):
    return fe.session_xy_stats(actions_of(s, d))


_KIN = ";".join(("~cursor_speed", "~acceleration_mean", "~reciprocal_acceleration", "~jitter", "#direction_changes", "~curvature_mean", "~rate_of_curvature", "~distance_travelled", "~movement_offset", "~straightness", "#self_intersections"))


@query("fe2_movement_features", sql(o.FEATURES, f"session_key;#action_idx;~action_duration;{_KIN};~x;~y;~x_raw;~y_raw", "FROM ft0 WHERE action_type = 'mouse_movement'"))
def _(s, d):
    a = actions_of(s, d)
    return fe.movement_features(a, fe.session_xy_stats(a)).drop("action_type", "dom_element_type", "time")


@query("fe3_click_features", sql(o.FEATURES, 'session_key;#action_idx;dom_element_type;~time="time";~x;~y;~x_raw;~y_raw', "FROM ft0 WHERE action_type = 'click'"))
def _(s, d):
    a = actions_of(s, d)
    return fe.click_features(a, fe.session_xy_stats(a)).drop("action_type")


@query("fe4_dwell_features", sql(o.FEATURES, 'session_key;#action_idx;action_type;~time="time";~action_duration;~x;~y;~x_raw;~y_raw', "FROM ft0 WHERE action_type IN ('hover', 'pause')"))
def _(s, d):
    a = actions_of(s, d)
    return fe.dwell_features(a, fe.session_xy_stats(a)).drop("dom_element_type")


@query("fe5_fe6_features", sql(o.FEATURES, f"session_key;#action_idx;module_id;action_type;dom_element_type;~action_duration;{_KIN};~x;~y;~x_raw;~y_raw;~time_since_last_action", "FROM ft"))
def _(s, d):
    return features_of(s, d).drop("participant_id")


# -- splits


@query("sp1_participant_labels", sql(_EV + ", lc AS (SELECT participant, module, count(*) AS c FROM ev GROUP BY ALL)", "participant_id=participant;stratum=arg_min(module, (-c, module))", "FROM lc GROUP BY participant"))
def _(s, d):
    return sp.participant_labels(ev.with_participant_id(fx.events(s, d)), "module")


@query("sp2_split", sql(_SPLIT, "participant_id;split", "FROM sl"))
def _(s, d):
    return split_of(s, d)


_STRATA = _EV + """, lc AS (SELECT participant, module, count(*) AS c FROM ev GROUP BY ALL), pe AS (SELECT participant AS participant_id, arg_min(module, (-c, module)) AS stratum FROM lc GROUP BY participant),
qu0 AS (SELECT stratum, count(*) AS n, floor(count(*) * 0.8) AS base, round(count(*) * 0.8 - floor(count(*) * 0.8), 9) AS part FROM pe GROUP BY stratum),
qu AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY part DESC, stratum) <= floor((SELECT sum(n) FROM qu0) * 0.8) - (SELECT sum(base) FROM qu0) THEN 1 ELSE 0 END AS quota FROM qu0),
pl AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || participant_id), participant_id) AS place FROM pe)"""


@query("sp2_split_stratified", sql(_STRATA, "participant_id;split=CASE WHEN place <= quota THEN 'train' ELSE 'test' END", "FROM pl JOIN qu USING (stratum)"))
def _(s, d):
    e = ev.with_participant_id(fx.events(s, d))
    return sp.split_participants(e, 0.8, 7, sp.participant_labels(e, "module"))


@query("sp3_apply_split", sql(_SPLIT, "module;#n=count(*)", "FROM ev JOIN sl ON participant_id = participant WHERE split = 'train' GROUP BY module"))
def _(s, d):
    return sp.apply_split(ev.with_participant_id(fx.events(s, d)), split_of(s, d).where("split = 'train'")).groupBy("module").agg(F.count("*").alias("n"))


@query("sp4_split_summary", sql(_SPLIT, "split;#participants=count(DISTINCT participant_id);#sessions=count(DISTINCT session_key);#n_rows=count(*)", "FROM ev JOIN sl ON participant_id = participant GROUP BY ROLLUP (split)"))
def _(s, d):
    return sp.split_summary(ev.with_participant_id(fx.events(s, d)), split_of(s, d))


@query("sp5_group_folds", sql(_SPLIT, "participant_id;#fold=ntile(5) OVER (ORDER BY md5('7|' || participant_id), participant_id) - 1", "FROM pe"))
def _(s, d):
    return sp.group_folds(ev.with_participant_id(fx.events(s, d)), 5, 7)


@query("sp5_fold_sides", sql(_SPLIT + ", fo AS (SELECT participant_id, ntile(5) OVER (ORDER BY md5('7|' || participant_id), participant_id) - 1 AS f FROM pe)", "participant_id;#fold=k;side=CASE WHEN k = f THEN 'validate' ELSE 'train' END", "FROM fo, range(5) r(k)"))
def _(s, d):
    return sp.fold_sides(sp.group_folds(ev.with_participant_id(fx.events(s, d)), 5, 7), 5)


@query("sp6_split_sessions", sql(_EV + ", pe AS (SELECT DISTINCT session_key FROM ev)", "session_key;split=CASE WHEN row_number() OVER (ORDER BY md5('3|' || session_key), session_key) <= floor(0.9 * (SELECT count(*) FROM pe)) THEN 'train' ELSE 'test' END", "FROM pe"))
def _(s, d):
    return sp.split_sessions_random(fx.events(s, d), 0.9, 3)


# -- preprocessing

_NUM = ("cursor_speed", "jitter", "direction_changes", "action_duration", "time_since_last_action")
_DQ = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS nulls, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS mi, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS ma FROM ft" for c in _NUM)


@query("pr1_data_quality", sql(o.FEATURES + f", dq AS ({_DQ})", "feature;#nulls;#n;~mean;~std;~min=mi;~q25;~q50;~q75;~max=ma", "FROM dq"))
def _(s, d):
    return pr.data_quality(features_of(s, d), list(_NUM))


@query("pr1_data_quality_by_selection", ORACLE_SQL["pr1_data_quality"])
def _(s, d):
    return pr.data_quality(written_features_of(s, d), list(_NUM), selected=True)


@query("pr1_value_counts", sql(o.FEATURES, "feature='action_type';value=action_type;#n=count(*)", "FROM ft GROUP BY 2 UNION ALL SELECT 'dom_element_type', dom_element_type, count(*) FROM ft GROUP BY 2"))
def _(s, d):
    return pr.value_counts(features_of(s, d), ["action_type", "dom_element_type"])


@query("pr1_duplicate_rows", sql("", "#duplicates=count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_quantity FROM lineitem));#n_rows=count(*)", "FROM lineitem"))
def _(s, d):
    return pr.duplicate_rows(fx.table(s, d, "lineitem").select("l_partkey", "l_quantity"))


_HM = ", hm AS (SELECT *, CASE WHEN cursor_speed IS NOT NULL THEN 1 ELSE 0 END AS has_kinematics, CASE WHEN action_duration IS NOT NULL THEN 1 ELSE 0 END AS has_duration, coalesce(dom_element_type, 'unknown') AS tag FROM ft)"


@query("pr2_handle_missing", sql(o.FEATURES + _HM, "action_type;#has_kinematics;#has_duration;tag;#n=count(*);~speed=sum(coalesce(cursor_speed, 0))", "FROM hm GROUP BY 1, 2, 3, 4"))
def _(s, d):
    return pr.handle_missing(features_of(s, d)).groupBy("action_type", "has_kinematics", "has_duration", F.col("dom_element_type").alias("tag")).agg(F.count("*").alias("n"), F.sum("cursor_speed").alias("speed"))


_LN = "ln(1 + greatest(coalesce({c}, 0), 0))"
_TF = ", tf AS (SELECT session_key, action_idx, module_id, action_type, tag, has_kinematics, has_duration, x, y, " + ", ".join((_LN if c in pr.LOGGED else "coalesce({c}, 0)").format(c=c) + f" AS {c}" for c in (*pr.STANDARD, *pr.DURATIONS, *pr.MINMAX, "self_intersections")) + " FROM hm)"


@query("pr3_transform_features", sql(o.FEATURES + _HM + _TF, "session_key;#action_idx;~cursor_speed;~jitter;~direction_changes;~action_duration", "FROM tf"))
def _(s, d):
    return pr.transform_features(pr.handle_missing(features_of(s, d))).select("session_key", "action_idx", "cursor_speed", "jitter", "direction_changes", "action_duration")


_CT = ", ct0 AS (SELECT DISTINCT CASE WHEN c < 20 THEN 'Other' ELSE tag END AS category FROM (SELECT tag, count(*) AS c FROM tf GROUP BY tag)), ct AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS id FROM ct0 UNION ALL SELECT 'Other', (SELECT count(*) FROM ct0) WHERE NOT EXISTS (SELECT 1 FROM ct0 WHERE category = 'Other'))"


@query("pr4_fit_categories", sql(o.FEATURES + _HM + _TF + _CT, "category;#id", "FROM ct"))
def _(s, d):
    return pr.fit_categories(pr.handle_missing(features_of(s, d)))


@query("pr5_apply_categories", sql(o.FEATURES + _HM + _TF + _CT, "session_key;#action_idx;#module_code=CASE module_id WHEN 'behavior_RESS' THEN 0 WHEN 'behavior_EADS' THEN 1 ELSE 2 END;#action_code=CASE action_type WHEN 'mouse_movement' THEN 0 WHEN 'hover' THEN 1 WHEN 'pause' THEN 2 ELSE 3 END;#tag_code=coalesce(ct.id, (SELECT id FROM ct WHERE category = 'Other'))", "FROM tf LEFT JOIN ct ON ct.category = tf.tag"))
def _(s, d):
    f = pr.handle_missing(written_features_of(s, d))
    return pr.apply_categories(f, pr.fit_categories(f)).select("session_key", "action_idx", "module_code", "action_code", "tag_code")


_CL = ", cl AS (SELECT quantile_cont(acceleration_mean, 0.01) AS lo, quantile_cont(acceleration_mean, 0.99) AS hi FROM tf), tc AS (SELECT tf.* REPLACE (least(greatest(acceleration_mean, lo), hi) AS acceleration_mean) FROM tf, cl)"
_PARTS = ["SELECT 'acceleration_mean' AS feature, 'clip' AS method, NULL::DOUBLE AS center, NULL::DOUBLE AS scale, lo AS low, hi AS high FROM cl"]
_PARTS += [f"SELECT '{c}', 'standard', avg({c}), CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, NULL, NULL FROM tc WHERE {f} = 1" for cs, f in ((pr.STANDARD, "has_kinematics"), (pr.DURATIONS, "has_duration")) for c in cs]
_PARTS += [f"SELECT '{c}', 'minmax', min({c}), CASE WHEN max({c}) = min({c}) THEN 1 ELSE max({c}) - min({c}) END, NULL, NULL FROM tc {w}" for c, w in (*((c, "WHERE has_kinematics = 1") for c in pr.MINMAX), ("x", ""))]
_PARTS += [f"SELECT '{c}', 'robust', median({c}), CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END, NULL, NULL FROM tc" for c in ("self_intersections", "y")]
_PARTS += [f"SELECT '{c}', 'median', median({c}), NULL, NULL, NULL FROM tc" for c in "xy"]
_SC = _CL + ", sc1 AS (" + " UNION ALL ".join(_PARTS) + ")"


@query("pr6_to_pr9_fit_scaling", sql(o.FEATURES + _HM + _TF + _SC, "feature;method;~center;~scale;~low;~high", "FROM sc1"))
def _(s, d):
    return pr.fit_scaling(pr.transform_features(pr.handle_missing(written_features_of(s, d))))


@query("pr6_to_pr9_fit_scaling_by_selection", ORACLE_SQL["pr6_to_pr9_fit_scaling"])
def _(s, d):
    return pr.fit_scaling(pr.transform_features(pr.handle_missing(written_features_of(s, d))), selected=True)


_FOLD = ", pe AS (SELECT DISTINCT participant AS participant_id FROM ev), fo AS (SELECT participant_id, ntile(3) OVER (ORDER BY md5('7|' || participant_id), participant_id) - 1 AS fold FROM pe)"


def _round_of(i: int, held: str, rest: str) -> str:
    """The fit of one round by itself: fold ``i`` is left out before anything is
    learnt; ``held`` has the rows of ``held``."""
    rows = lambda compare: f"FROM (SELECT ft.* FROM ft JOIN fo USING (participant_id) WHERE fold {compare} {i})"
    held_out = (_HM + _TF).replace("hm AS", "hh AS").replace("FROM hm", "FROM hh").replace("tf AS", "held AS").replace("FROM ft", rows(held))
    return o.FEATURES + _FOLD + _HM.replace("FROM ft", rows("<>")) + _TF + _SC + held_out + " " + rest


def _all_rounds(held: str, rest: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_round_of(i, held, rest.format(i=i))})" for i in range(3))


def folds_of(s, d):
    path = scratch(s, "features-in-folds")
    fo.folds_ready(written_features_of(s, d), 3, 7).write.parquet(path)
    return s.read.parquet(path)


@query("pr11_fit_all_folds", sql("", "#round;feature;method;~center;~scale;~low;~high", f"FROM ({_all_rounds('=', 'SELECT {i} AS round, * FROM sc1')})"))
def _(s, d):
    """Each round's fit from states of the folds, against separate fits."""
    return fo.fit_all_folds(folds_of(s, d), 3)


_CT_ROUNDS = " UNION ALL ".join(f"SELECT * FROM ({o.FEATURES + _FOLD + _HM.replace('FROM ft', f'FROM (SELECT ft.* FROM ft JOIN fo USING (participant_id) WHERE fold <> {i})') + _TF + _CT} SELECT {i} AS round, category, id FROM ct)" for i in range(3))


@query("pr4_fit_all_folds", sql("", "#round;category;#id", f"FROM ({_CT_ROUNDS})"))
def _(s, d):
    return fo.fit_all_categories(folds_of(s, d), 3)


_HELD = "SELECT {i} AS round, session_key, action_idx" + "".join(f", ({c} - (SELECT center FROM sc1 WHERE feature = '{c}' AND method = '{m}')) / (SELECT scale FROM sc1 WHERE feature = '{c}' AND method = '{m}') AS {c}" for c, m in (("cursor_speed", "standard"), ("action_duration", "standard"), ("straightness", "minmax"), ("self_intersections", "robust"))) + " FROM held"


@query("pr11_transform_held_out", sql("", "#round;session_key;#action_idx;~cursor_speed;~action_duration;~straightness;~self_intersections", f"FROM ({_all_rounds('=', _HELD)})"))
def _(s, d):
    """Every row once, in the round that holds it out."""
    names = ("session_key", "action_idx", "cursor_speed", "action_duration", "straightness", "self_intersections")
    held = [h.select(F.lit(i).alias("round"), *names) for i, _, h in fo.rounds(folds_of(s, d), 3)]
    return held[0].union(held[1]).union(held[2])


@query("pr10_pr11_transform", sql(o.FEATURES + _HM + _TF + _SC, "session_key;#action_idx;" + ";".join(f"~{c}=({c} - (SELECT center FROM sc1 WHERE feature = '{c}' AND method = '{m}')) / (SELECT scale FROM sc1 WHERE feature = '{c}' AND method = '{m}')" for c, m in (("cursor_speed", "standard"), ("acceleration_mean", "standard"), ("action_duration", "standard"), ("straightness", "minmax"), ("self_intersections", "robust"))), "FROM tc"))
def _(s, d):
    path = scratch(s, "features")
    features_of(s, d).write.parquet(path)
    f = s.read.parquet(path)
    return pr.transform(f, *pr.fit(f)).select("session_key", "action_idx", "cursor_speed", "acceleration_mean", "action_duration", "straightness", "self_intersections")


_COR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_CP = [(a, b) for i, a in enumerate(_COR) for b in _COR[i + 1 :]]


@query("pr12_correlation_filter", " UNION ALL ".join(sql("", f"column_a='{a}';column_b='{b}';~r=abs(corr({a}, {b}));dropped=abs(corr({a}, {b})) > 0.9", "FROM lineitem") for a, b in _CP))
def _(s, d):
    return pr.correlation_filter(fx.table(s, d, "lineitem"), list(_COR))


@query("pr12_correlation_filter_by_blocks", ORACLE_SQL["pr12_correlation_filter"])
def _(s, d):
    return pr.correlation_filter(fx.table(s, d, "lineitem"), list(_COR), blocks=True)


@query("pr13_standardize_embeddings", sql("WITH lo AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), sd AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM lo WHERE label < 7 GROUP BY dim)", "#vec_id;#dim;~z=(v - m) / CASE WHEN s = 0 THEN 1 ELSE s END", "FROM lo JOIN sd USING (dim)"))
def _(s, d):
    e = fx.table(s, d, "embeddings")
    return pr.standardize_embeddings(e.where("label < 7"), e).select("vec_id", F.posexplode("embedding").alias("dim", "z"))


_LEN = o.FEATURES + ", le AS (SELECT session_key, participant_id, count(*) AS length FROM ft GROUP BY ALL)"


@query("pr14_sequence_lengths", sql(_LEN, "#sessions=count(*);~mean=avg(length);~std=stddev_samp(length);#min=min(length);#max=max(length)" + "".join(f";~p{p}=quantile_cont(length, {p / 100})" for p in (25, 50, 75, 80, 85, 90, 95, 99)), "FROM le"))
def _(s, d):
    return pr.sequence_lengths(features_of(s, d))


@query("pr14_length_histogram", sql(_LEN + ", en2 AS (SELECT min(length) AS lo, max(length) AS hi FROM le)", "#bin=CASE WHEN hi = lo THEN 0 ELSE least(floor((length - lo) / ((hi - lo) / 50)), 49) END;#n=count(*)", "FROM le, en2 GROUP BY 1"))
def _(s, d):
    return pr.length_histogram(features_of(s, d))


# -- sequences


@query("sq1_fit_maxlen", sql(_LEN, "#maxlen=CASE WHEN floor(quantile_cont(length, 0.9)) >= 1 THEN floor(quantile_cont(length, 0.9)) ELSE max(length) END", "FROM le"))
def _(s, d):
    return sq.fit_maxlen(features_of(s, d))


def sequences_of(s, d, padding="post", truncating="post"):
    f = pr.handle_missing(features_of(s, d)).withColumn("action_code", F.element_at(F.create_map(*(F.lit(x) for kv in pr.ACTION_IDS.items() for x in kv)), F.col("action_type")))
    return sq.prepare_sequences(f, 6, ["cursor_speed", "action_duration"], ["action_code"], padding, truncating)


def _flat(q: DataFrame) -> DataFrame:
    return q.select("session_key", "length", "length_raw", F.posexplode(F.arrays_zip("cursor_speed", "action_duration", "action_code")).alias("step", "v")).select("session_key", "length", "length_raw", "step", "v.*")


_SQ = o.FEATURES + """, sq0 AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY action_idx{desc}) AS place, count(*) OVER (PARTITION BY session_key) AS length_raw FROM ft),
sq1 AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY action_idx) - 1 AS pos, count(*) OVER (PARTITION BY session_key) AS length FROM sq0 WHERE place <= 6),
sq2 AS (SELECT DISTINCT session_key, length, length_raw, step FROM sq1, range(6) r(step))"""
_SQ_AT = "session_key;#length;#length_raw;#step;~cursor_speed=coalesce(q.cursor_speed, 0);~action_duration=coalesce(q.action_duration, 0);#action_code=coalesce(CASE q.action_type WHEN 'mouse_movement' THEN 1 WHEN 'hover' THEN 2 WHEN 'pause' THEN 3 WHEN 'click' THEN 4 END, 0)".replace("session_key;#length;#length_raw;#step", "session_key=p.session_key;#length=p.length;#length_raw=p.length_raw;#step=p.step")


@query("sq2_prepare_sequences", sql(_SQ.format(desc=""), _SQ_AT, "FROM sq2 p LEFT JOIN sq1 q ON q.session_key = p.session_key AND q.pos = p.step"))
def _(s, d):
    return _flat(sequences_of(s, d))


@query("sq2_prepare_sequences_pre", sql(_SQ.format(desc=" DESC"), _SQ_AT, "FROM sq2 p LEFT JOIN sq1 q ON q.session_key = p.session_key AND q.pos + 6 - q.length = p.step"))
def _(s, d):
    return _flat(sequences_of(s, d, "pre", "pre"))


_SQ3 = sorted((*(c for c in pr.STANDARD), *pr.DURATIONS, *pr.MINMAX, "self_intersections"))


@query("sq3_continuous_columns", sql(o.FEATURES + _HM + _TF, "column_name=c;#place=p;~total=t", "FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS p, sum({c}) AS t FROM tf" for i, c in enumerate(_SQ3)) + ")"))
def _(s, d):
    """The numbers a model reads, by name, and what they add up to."""
    f = pr.transform_features(pr.handle_missing(features_of(s, d)))
    numbers = f.select(*sorted(c for c in f.columns if c not in ("x", "y", "x_raw", "y_raw", "action_idx", "has_kinematics", "has_duration")))
    names = sq.continuous_columns(numbers, ["module_id", "action_type", "dom_element_type"])
    totals = f.agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("double").alias(c) for c in names))
    return totals.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("place"), F.col(c).alias("total")) for i, c in enumerate(names)))))


@query("sq4_mask", sql(_SQ.format(desc=""), "session_key;#valid=count(*)", "FROM sq1 GROUP BY session_key"))
def _(s, d):
    return sequences_of(s, d).select("session_key", F.size(F.filter(sq.mask("action_code"), lambda v: v)).alias("valid"))


@query("sq5_embedding_config", sql(_SQ.format(desc=""), "feature='action_code';#cardinality=c + 1;#width=least(50, greatest(1, (c + 1) // 2 + 1))", "FROM (SELECT max(CASE action_type WHEN 'mouse_movement' THEN 1 WHEN 'hover' THEN 2 WHEN 'pause' THEN 3 ELSE 4 END) AS c FROM sq1)"))
def _(s, d):
    return sq.embedding_config(sequences_of(s, d), ["action_code"])


@query("sq6_truncation_stats", sql(_LEN, "participant_id;#sessions=count(*);#truncated=count(*) FILTER (WHERE length > 6);#steps=sum(length);#removed=sum(greatest(length - 6, 0));~pct_truncated=100.0 * count(*) FILTER (WHERE length > 6) / count(*);~pct_removed=100.0 * sum(greatest(length - 6, 0)) / sum(length)", "FROM le GROUP BY ROLLUP (participant_id)"))
def _(s, d):
    return sq.truncation_stats(features_of(s, d), 6)


@query("sq7_batch_predict", sql(_SQ.format(desc=""), "session_key;#steps=6;~total=6 * 0.25", "FROM sq1 GROUP BY session_key"))
def _(s, d):
    got = sq.batch_predict(sequences_of(s, d), sq.train_mean_predictor({"cursor_speed": 0.25}), ["cursor_speed"])
    return got.select("session_key", F.size("cursor_speed").alias("steps"), F.aggregate("cursor_speed", F.lit(0.0), lambda a, b: a + b).alias("total"))


# -- reconstruction metrics


def baseline_of(s, d):
    return rm.mean_baseline(fx.predictions(s, d).where("label < 7"))


@query("rm1_mean_baseline", sql(o.LONG, "feature;~mean", "FROM bl"))
def _(s, d):
    return baseline_of(s, d)


@query("rm2_session_mse", sql(o.LONG, "#session;~mse=mse_model", "FROM ses"))
def _(s, d):
    return rm.session_mse(fx.predictions(s, d))


@query("rm3_session_metrics", sql(o.LONG, "#session;participant;~mse_model;~mse_baseline;#length;#length_raw;~improvement_pct=100 * (mse_baseline - mse_model) / (mse_baseline + 1e-12)", "FROM ses"))
def _(s, d):
    return rm.session_metrics(fx.predictions(s, d), baseline_of(s, d))


_FM = o.LONG + """, fm0 AS (SELECT feature, count(*) AS n, avg(abs(y_true - y_pred)) AS mae, avg((y_true - y_pred) * (y_true - y_pred)) AS mse, avg(y_true) AS mean, stddev_pop(y_true) AS std, max(y_true) - min(y_true) AS value_range, quantile_cont(y_true, 0.75) - quantile_cont(y_true, 0.25) AS iqr FROM lf WHERE valid GROUP BY feature),
fm AS (SELECT *, sqrt(mse) AS rmse, sqrt(mse) / std AS nrmse_std, sqrt(mse) / value_range AS nrmse_range, sqrt(mse) / iqr AS nrmse_iqr, row_number() OVER (ORDER BY sqrt(mse) / std DESC NULLS LAST, feature) AS rank FROM fm0)"""
_FMC = "feature;#n;~mae;~mse;~mean;~std;~value_range;~iqr;~rmse;~nrmse_std;~nrmse_range;~nrmse_iqr;#rank"


@query("rm4_feature_metrics", sql(_FM, _FMC, "FROM fm"))
def _(s, d):
    return rm.feature_metrics(fx.predictions(s, d))


@query("rm4_feature_metrics_by_selection", ORACLE_SQL["rm4_feature_metrics"])
def _(s, d):
    return rm.feature_metrics(fx.predictions(s, d), selected=True)


@query("rm5_top_features", sql(_FM, _FMC, "FROM fm WHERE rank <= 5"))
def _(s, d):
    return rm.top_features(rm.feature_metrics(fx.predictions(s, d)))


_LB = o.METRICS + """, le1 AS (SELECT quantile_cont(length, 0.2) AS e1, quantile_cont(length, 0.4) AS q2, quantile_cont(length, 0.6) AS q3, quantile_cont(length, 0.8) AS q4 FROM sm),
le2 AS (SELECT *, CASE WHEN q2 > e1 THEN q2 ELSE e1 + 1e-6 END AS e2 FROM le1), le3 AS (SELECT *, CASE WHEN q3 > e2 THEN q3 ELSE e2 + 1e-6 END AS e3 FROM le2), le4 AS (SELECT *, CASE WHEN q4 > e3 THEN q4 ELSE e3 + 1e-6 END AS e4 FROM le3),
lb AS (SELECT 1 AS bin, 'Q1 (shortest)' AS label, -1e300 AS low, e1 AS high FROM le4 UNION ALL SELECT 2, 'Q2', e1, e2 FROM le4 UNION ALL SELECT 3, 'Q3', e2, e3 FROM le4 UNION ALL SELECT 4, 'Q4', e3, e4 FROM le4 UNION ALL SELECT 5, 'Q5 (longest)', e4, 1e300 FROM le4)"""


@query("rm6_length_bins", sql(_LB, "#bin;label;~low;~high", "FROM lb"))
def _(s, d):
    open_end = lambda c: F.when(F.col(c) == float("inf"), 1e300).when(F.col(c) == float("-inf"), -1e300).otherwise(F.col(c)).alias(c)
    return rm.fit_length_bins(fx.session_metrics(s, d)).select("bin", "label", open_end("low"), open_end("high"))


@query("rm7_metrics_by_length_bin", sql(_LB, "#bin;label;#n=count(session_id);~mse_mean=avg(mse_model);~mse_std=stddev_samp(mse_model);~improvement_mean=avg(improvement_pct)", "FROM lb LEFT JOIN sm ON length > low AND length <= high GROUP BY 1, 2"))
def _(s, d):
    m = fx.session_metrics(s, d)
    return rm.metrics_by_length_bin(m, rm.fit_length_bins(m))


def reference_of(s, d):
    long = fx.predictions(s, d)
    return rm.reference_std(long, long.where("label < 7").select("session").distinct())


@query("rm8_reference_std", sql(o.LONG, "feature;~std;~mean;#n", "FROM rs"))
def _(s, d):
    return reference_of(s, d)


_NR = "~nrmse=sqrt(sum((y_true - y_pred) * (y_true - y_pred)) / count(*)) / max(std)"


@query("rm9_participant_nrmse", sql(o.LONG, "participant;feature;#n=count(*);#sessions=count(DISTINCT session);" + _NR, "FROM lf JOIN rs USING (feature) WHERE valid GROUP BY 1, 2"))
def _(s, d):
    return rm.participant_nrmse(fx.predictions(s, d), reference_of(s, d))


@query("rm10_session_nrmse", sql(o.LONG, "#session;feature;#n=count(*);#sessions=count(DISTINCT session);" + _NR, "FROM lf JOIN rs USING (feature) WHERE valid GROUP BY 1, 2"))
def _(s, d):
    return rm.session_nrmse(fx.predictions(s, d), reference_of(s, d))


_RK = """WITH fs AS (SELECT l_partkey % 18 AS config_id, l_linenumber % 3 AS fold_id, avg(l_discount) AS val_loss, 1 + count(*) % 25 AS best_epoch FROM lineitem GROUP BY 1, 2),
rk0 AS (SELECT config_id, avg(val_loss) AS mean_loss, stddev_pop(val_loss) AS std_loss, median(best_epoch) AS median_epoch, max(val_loss) FILTER (WHERE fold_id = 0) AS fold_0, max(val_loss) FILTER (WHERE fold_id = 1) AS fold_1, max(val_loss) FILTER (WHERE fold_id = 2) AS fold_2 FROM fs GROUP BY config_id)"""


@query("rm11_rank_search", sql(_RK, "#config_id;~mean_loss;~std_loss;~median_epoch;~fold_0;~fold_1;~fold_2;#final_epochs=greatest(1, round_even(median_epoch, 0));#rank=row_number() OVER (ORDER BY round(mean_loss, 12), round(std_loss, 12), config_id)", "FROM rk0"))
def _(s, d):
    return rm.rank_search(fx.fold_scores(s, d), [0, 1, 2])


# -- analysis

_SM = "#sessions=count(session_id);~mse_model_mean=avg(mse_model);~mse_baseline_mean=avg(mse_baseline);~improvement_mean=avg(improvement_pct);~improvement_median=median(improvement_pct);~pct_improved=100.0 * count(*) FILTER (WHERE mse_model < mse_baseline) / count(*);~length_mean=avg(length);~length_raw_mean=avg(length_raw)"


@query("an1_by_participant", sql(o.METRICS, "participant_id;" + _SM, "FROM sm GROUP BY participant_id"))
def _(s, d):
    return an.by_participant(fx.session_metrics(s, d))


@query("an2_by_module", sql(o.METRICS, "module;" + _SM, "FROM sm GROUP BY module"))
def _(s, d):
    return an.by_module(fx.session_metrics(s, d))


@query("an3_overall_summary", sql(o.METRICS + ", pp AS (SELECT participant_id, avg(improvement_pct) AS i FROM sm GROUP BY 1), pq AS (SELECT count(*) AS participants, avg(i) AS a, median(i) AS b, count(*) FILTER (WHERE i > 0) AS c FROM pp)", _SM + ";#participants=max(participants);~participant_improvement_mean=max(a);~participant_improvement_median=max(b);#participants_improved=max(c)", "FROM sm, pq"))
def _(s, d):
    return an.overall_summary(fx.session_metrics(s, d))


_EADS = ';~EADS_Depressao={f}("EADS_Depressao");~EADS_Ansiedade={f}("EADS_Ansiedade");~EADS_Stress={f}("EADS_Stress")'


def scores_of(s, d):
    return an.questionnaire_scores(fx.questionnaires(s, d))


def linked_of(s, d):
    return an.link_scores(fx.session_metrics(s, d), scores_of(s, d))


@query("an4_questionnaire_scores", sql(o.SCORES, "participant_id;sessnum" + _EADS.format(f=""), "FROM qs"))
def _(s, d):
    return scores_of(s, d)


@query("an5_link_scores", sql(o.SCORES, "session_id;sessnum;has_eads" + _EADS.format(f=""), "FROM lk"))
def _(s, d):
    return linked_of(s, d).select("session_id", "sessnum", "has_eads", *an.SCORES)


@query("an6_participant_scores", sql(o.SCORES, "participant_id;#sessions=count(*);#linked=count(*) FILTER (WHERE has_eads);~improvement_mean=avg(improvement_pct);~mse_model_mean=avg(mse_model)" + _EADS.format(f="avg"), "FROM lk GROUP BY participant_id"))
def _(s, d):
    return an.participant_scores(linked_of(s, d))


@query("an7_link_summary", sql(o.SCORES, "#sessions=count(*);#matched=count(*) FILTER (WHERE has_eads);~pct_matched=100.0 * count(*) FILTER (WHERE has_eads) / count(*);#participants=count(DISTINCT participant_id);#participants_linked=count(DISTINCT participant_id) FILTER (WHERE has_eads)", "FROM lk"))
def _(s, d):
    return an.link_summary(linked_of(s, d))


@query("an8_participant_eads", sql(o.SCORES, "participant_id" + _EADS.format(f="avg"), "FROM qs GROUP BY participant_id"))
def _(s, d):
    return an.participant_eads(scores_of(s, d))


_BP = o.FEATURES + ", bp0 AS (SELECT participant_id, split_part(session_key, '|', 2) AS ses, avg(cursor_speed) AS cursor_speed, avg(action_duration) AS action_duration, avg(time_since_last_action) AS time_since_last_action FROM ft GROUP BY 1, 2), bp AS (SELECT participant_id, count(*) AS sessions, avg(cursor_speed) AS cursor_speed, avg(action_duration) AS action_duration, avg(time_since_last_action) AS time_since_last_action FROM bp0 GROUP BY 1)"
_BPC = ["cursor_speed", "action_duration", "time_since_last_action"]


@query("an9_behavior_profiles", sql(_BP, "participant_id;#sessions;~cursor_speed;~action_duration;~time_since_last_action", "FROM bp"))
def _(s, d):
    return an.behavior_profiles(features_of(s, d), _BPC)


_BQ = _BP + o.SCORES[o.SCORES.index("qs0 AS") - 2 : o.SCORES.index("lk AS") - 2] + ', bq AS (SELECT participant_id, avg("EADS_Depressao") AS dep, avg("EADS_Ansiedade") AS anx, avg("EADS_Stress") AS str FROM qs GROUP BY 1), bj AS (SELECT * FROM bp JOIN bq USING (participant_id))'


def profiles_of(s, d):
    """A row a participant, written once: what follows reads them several times."""
    profiles = saved(an.behavior_profiles(features_of(s, d), _BPC), "profiles")
    return saved(an.join_profiles(profiles, an.participant_eads(scores_of(s, d))), "profiles-with-scores")


@query("an10_join_profiles", sql(_BQ, "participant_id;#sessions;~cursor_speed;~action_duration;~time_since_last_action;~EADS_Depressao=dep;~EADS_Ansiedade=anx;~EADS_Stress=str", "FROM bj"))
def _(s, d):
    return profiles_of(s, d)


def cut_of(s, d):
    return an.with_truncation(fx.session_metrics(s, d), 150)


@query("an11_with_truncation", sql(o.METRICS, "session_id;is_truncated;#steps_removed", "FROM sm"))
def _(s, d):
    return cut_of(s, d).select("session_id", "is_truncated", "steps_removed")


@query("an12_truncation_groups", sql(o.METRICS, "is_truncated;#sessions=count(*);~improvement_mean=avg(improvement_pct);~improvement_median=median(improvement_pct);~improvement_std=stddev_samp(improvement_pct);~mse_model_mean=avg(mse_model);~mse_baseline_mean=avg(mse_baseline);#steps_removed=sum(steps_removed)", "FROM sm GROUP BY is_truncated"))
def _(s, d):
    return an.truncation_groups(cut_of(s, d))


_TP = o.METRICS + ", tp AS (SELECT participant_id, count(*) AS sessions, count(*) FILTER (WHERE is_truncated) AS truncated, sum(steps_removed) AS steps_removed, avg(improvement_pct) AS improvement_mean, median(improvement_pct) AS improvement_median, avg(improvement_pct) FILTER (WHERE is_truncated) AS truncated_mean, avg(improvement_pct) FILTER (WHERE NOT is_truncated) AS whole_mean FROM sm GROUP BY 1)"
_TPC = "participant_id;#sessions;#truncated;#steps_removed;~improvement_mean;~improvement_median;~truncated_mean;~whole_mean;~rate=truncated / sessions;~difference=truncated_mean - whole_mean"


@query("an13_truncation_by_participant", sql(_TP, _TPC, "FROM tp"))
def _(s, d):
    return an.truncation_by_participant(cut_of(s, d))


@query("an14_truncation_participant_groups", sql(_TP, "has_truncation=truncated > 0;#participants=count(*);~mean_of_means=avg(improvement_mean);~median_of_means=median(improvement_mean);~rate_mean=avg(truncated / sessions)", "FROM tp GROUP BY 1"))
def _(s, d):
    return an.truncation_participant_groups(an.truncation_by_participant(cut_of(s, d)))


@query("an15_top_truncated", sql(_TP, _TPC, "FROM (SELECT * FROM tp ORDER BY steps_removed DESC, truncated DESC, participant_id LIMIT 10)"))
def _(s, d):
    return an.top_truncated(an.truncation_by_participant(cut_of(s, d)))


@query("an16_truncation_summary", sql(o.METRICS, "#sessions=count(*);#truncated=count(*) FILTER (WHERE is_truncated);~pct_truncated=100.0 * count(*) FILTER (WHERE is_truncated) / count(*);#steps=sum(length_raw);#steps_removed=sum(steps_removed);~pct_removed=100.0 * sum(steps_removed) / sum(length_raw)", "FROM sm"))
def _(s, d):
    return an.truncation_summary(cut_of(s, d))


# -- statistics

_PA = o.METRICS + ", pa AS (SELECT participant_id, avg(mse_model) AS model, avg(mse_baseline) AS baseline, round(avg(mse_baseline) - avg(mse_model), 9) AS difference FROM sm GROUP BY 1)"


def pairs_of(s, d):
    return st.paired_participants(fx.session_metrics(s, d)).withColumn("difference", F.round("difference", 9))


@query("st1_paired_participants", sql(_PA, "participant_id;~model;~baseline;~difference", "FROM pa"))
def _(s, d):
    return pairs_of(s, d)


_WR = _PA + ", wr AS (SELECT difference, abs(difference) AS a, rank() OVER (ORDER BY abs(difference)) + (count(*) OVER (PARTITION BY abs(difference)) - 1) / 2 AS r FROM pa WHERE difference <> 0)"


@query("st2_wilcoxon", sql(_WR, "#n=count(*);#zeros=(SELECT count(*) FROM pa WHERE difference = 0);~r_plus=sum(r) FILTER (WHERE difference > 0);~r_minus=sum(r) FILTER (WHERE difference < 0);~statistic=least(sum(r) FILTER (WHERE difference > 0), sum(r) FILTER (WHERE difference < 0))", "FROM wr"))
def _(s, d):
    return st.wilcoxon_signed_rank(pairs_of(s, d)).drop("p_value")


@query("st2_wilcoxon_p")
def _(s, d):
    return st.wilcoxon_signed_rank(pairs_of(s, d), alternative="greater")


@query("st3_paired_summary", sql(_PA, "#n=count(*);~model_mean=avg(model);~baseline_mean=avg(baseline);~difference_mean=avg(difference);~difference_median=median(difference);~pct_improved=100.0 * count(*) FILTER (WHERE difference > 0) / count(*)", "FROM pa"))
def _(s, d):
    return st.paired_summary(pairs_of(s, d))


@query("st3_paired_summary_by_selection", ORACLE_SQL["st3_paired_summary"])
def _(s, d):
    return st.paired_summary(pairs_of(s, d), selected=True)


_HL = _BQ + """, hl0 AS (SELECT participant_id, cursor_speed, action_duration, time_since_last_action, unnest(['EADS_Depressao', 'EADS_Ansiedade', 'EADS_Stress']) AS target, unnest([round(dep, 9), round(anx, 9), round(str, 9)]) AS score FROM bj),
hq AS (SELECT target, quantile_cont(score, 0.25) AS q_low, quantile_cont(score, 0.75) AS q_high FROM hl0 WHERE score IS NOT NULL GROUP BY 1),
hl AS (SELECT *, score <= q_low AS is_low, score >= q_high AS is_high FROM hl0 JOIN hq USING (target) WHERE score IS NOT NULL)"""


def groups_of(s, d):
    whole = profiles_of(s, d)  # rounded, as ties at the quartiles decide who belongs
    return st.high_low_groups(whole.withColumns({c: F.round(c, 9) for c in an.SCORES}), list(an.SCORES))


@query("st4_high_low_groups", sql(_HL, "target;#n=count(*);#n_low=count(*) FILTER (WHERE is_low);#n_high=count(*) FILTER (WHERE is_high);~q_low=max(q_low);~q_high=max(q_high)", "FROM hl GROUP BY 1"))
def _(s, d):
    return st.group_sizes(groups_of(s, d))


@query("st4_high_low_groups_by_selection", ORACLE_SQL["st4_high_low_groups"])
def _(s, d):
    whole = profiles_of(s, d).withColumns({c: F.round(c, 9) for c in an.SCORES})
    return st.group_sizes(st.high_low_groups(whole, list(an.SCORES), selected=True))


_MW = _HL + """, mw0 AS (SELECT target, participant_id, unnest(['cursor_speed', 'action_duration', 'time_since_last_action']) AS feature, unnest([cursor_speed, action_duration, time_since_last_action]) AS v, is_low, is_high FROM hl),
mw1 AS (SELECT target, feature, round(v, 9) AS v, 1 AS low FROM mw0 WHERE is_low AND v IS NOT NULL UNION ALL SELECT target, feature, round(v, 9), 0 FROM mw0 WHERE is_high AND v IS NOT NULL),
mw2 AS (SELECT *, rank() OVER (PARTITION BY target, feature ORDER BY v) + (count(*) OVER (PARTITION BY target, feature, v) - 1) / 2 AS r FROM mw1),
mw AS (SELECT target, feature, sum(low) AS n_low, count(*) - sum(low) AS n_high, avg(v) FILTER (WHERE low = 1) AS mean_low, avg(v) FILTER (WHERE low = 0) AS mean_high, median(v) FILTER (WHERE low = 1) AS median_low, median(v) FILTER (WHERE low = 0) AS median_high, CASE WHEN sum(low) >= 3 AND count(*) - sum(low) >= 3 THEN sum(r * low) - sum(low) * (sum(low) + 1) / 2 END AS u FROM mw2 GROUP BY 1, 2)"""


def tests_of(s, d):
    g = groups_of(s, d)
    return st.mann_whitney(g.withColumns({c: F.round(c, 9) for c in _BPC}), _BPC)


@query("st5_st6_mann_whitney", sql(_MW, "target;feature;#n_low;#n_high;~mean_low;~mean_high;~median_low;~median_high;~u_low=u;~effect=1 - 2 * u / (n_low * n_high)", "FROM mw"))
def _(s, d):
    return tests_of(s, d).drop("p_value")


@query("st5_mann_whitney_p")
def _(s, d):
    return tests_of(s, d).select("target", "feature", "u_low", "p_value")


_BH = """WITH pv AS (SELECT 'g' || CAST(l_partkey % 4 AS VARCHAR) AS target, 'f' || CAST(l_suppkey AS VARCHAR) AS feature, round(avg(l_discount) * 10 * (l_suppkey % 10) / 10, 9) AS p FROM lineitem GROUP BY l_partkey % 4, l_suppkey),
bh AS (SELECT *, p * count(*) OVER (PARTITION BY target) / row_number() OVER (PARTITION BY target ORDER BY p, feature) AS raw FROM pv),
bi AS (SELECT *, least(1.0, greatest(0.0, min(raw) OVER (PARTITION BY target ORDER BY p DESC, feature DESC ROWS UNBOUNDED PRECEDING))) AS q FROM bh)"""


@query("st7_fdr_bh", sql(_BH, "target;feature;~p_value=p;~q_value=q;significant=q < 0.05", "FROM bi"))
def _(s, d):
    li = fx.table(s, d, "lineitem")
    target, feature = F.concat(F.lit("g"), (F.col("l_partkey") % 4).cast("string")), F.concat(F.lit("f"), F.col("l_suppkey").cast("string"))
    p = li.groupBy(target.alias("target"), feature.alias("feature"), "l_suppkey").agg(F.avg("l_discount").alias("m")).select("target", "feature", F.round(F.col("m") * 10 * (F.col("l_suppkey") % 10) / 10, 9).alias("p_value"))
    return st.fdr_bh(p)


@query("st8_average_rank", sql("", "#l_linenumber;~l_quantity;#n=count(*);~rank=sum(count(*)) OVER (PARTITION BY l_linenumber ORDER BY l_quantity) - count(*) + (count(*) + 1) / 2", "FROM lineitem GROUP BY l_linenumber, l_quantity"))
def _(s, d):
    return st.average_rank(fx.table(s, d, "lineitem"), ["l_linenumber"], "l_quantity")


# -- sources and sinks: written, read again and compared by value

_IO_AC = 'session_key;#action_idx;type;~start="start";~end="end";~x;~y;~timestamp="timestamp";node;#points=n_points'


@query("io2_io3_action_sequences", sql(o.ACTIONS, _IO_AC, "FROM ac"))
def _(s, d):
    path = scratch(s, "sequences")
    io.write_action_sequences(actions_of(s, d), path)
    got = io.read_action_sequences(s, path, lines=True)
    n = F.size("path")
    return got.select("session_key", "action_idx", "type", "start", "end", "x", "y", "timestamp", "node", F.when(n >= 0, n).alias("points"))


@query("io1_session_arrays_in_parts", ORACLE_SQL["pf1_explode_events"])
def _(s, d):
    """Arrays of sessions, read back by many tasks a file."""
    path = scratch(s, "session-arrays")
    io.write_session_arrays(fx.raw_sessions(s, d).drop("file_order"), path)
    sessions = io.read_sessions(s, path, fx.MODULES, in_parts=True)
    return ev.explode_events(sessions).select("participant", "sess", "module", "t", "x", "y", "is_click", "node")


@query("io2_sequence_objects_in_parts", ORACLE_SQL["io2_io3_action_sequences"])
def _(s, d):
    """Objects of action lists, read back by many tasks a file."""
    path = scratch(s, "sequence-objects")
    io.write_sequence_objects(actions_of(s, d), path)
    got = io.read_action_sequences(s, path, in_parts=True)
    n = F.size("path")
    return got.select("session_key", "action_idx", "type", "start", "end", "x", "y", "timestamp", "node", F.when(n >= 0, n).alias("points"))


@query("io4_actions_flat", sql(o.ACTIONS, "session_key;#action_idx;type;~start=\"start\";~end=\"end\";~duration;~distance;~x;~y;~timestamp=\"timestamp\";node", "FROM ac"))
def _(s, d):
    path = scratch(s, "flat")
    io.write_actions_flat(actions_of(s, d), path)
    return s.read.csv(path, header=True, schema="session_key string, action_idx int, type string, start double, end double, duration double, distance double, x double, y double, timestamp double, node string")


@query("io5_features_csv", sql(o.FEATURES, f"session_key;#action_idx;dom_element_type;~action_duration;{_KIN}", "FROM ft"))
def _(s, d):
    path, f = scratch(s, "features-csv"), features_of(s, d)
    io.write_features(f, path)
    return io.read_features(s, path, f.schema.simpleString()[7:-1].replace(":", " ")).select("session_key", "action_idx", "dom_element_type", "action_duration", *fe.KINEMATIC)


@query("io6_io7_split_files", sql(_SPLIT, "participant_id", "FROM sl WHERE split = 'train'"))
def _(s, d):
    path, e = scratch(s, "split"), ev.with_participant_id(fx.events(s, d))
    io.write_split(e, split_of(s, d), path)
    return io.read_participants(s, f"{path}/train_participants")


@query("io8_questionnaires", sql(o.SCORES, "participant_id;sessnum" + _EADS.format(f=""), "FROM qs"))
def _(s, d):
    path = scratch(s, "sheet")
    fx.questionnaires(s, d).write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    return an.questionnaire_scores(io.read_questionnaires(s, path))


@query("io9_report", sql(o.METRICS, "module;#sessions=count(*)", "FROM sm GROUP BY module"))
def _(s, d):
    path = scratch(s, "report")
    io.write_report(an.by_module(fx.session_metrics(s, d)), path, "json")
    return s.read.schema("module string, sessions bigint").json(path)


@query("io9_truncation_report", sql(_TP, "#report_sessions=(SELECT count(*) FROM sm);#report_removed=(SELECT sum(steps_removed) FROM sm);#groups=2;#place=row_number() OVER (ORDER BY steps_removed DESC, truncated DESC, participant_id) - 1;" + _TPC, "FROM (SELECT * FROM tp ORDER BY steps_removed DESC, truncated DESC, participant_id LIMIT 10)"))
def _(s, d):
    """A nested report, written as JSON and read again: its top participants."""
    path, report = scratch(s, "truncation-report"), rp.truncation_report(fx.session_metrics(s, d), 150)
    io.write_report(report, path, "json")
    got = s.read.schema(report.schema).json(path)
    return got.select(F.col("sessions").alias("report_sessions"), F.col("steps_removed").alias("report_removed"), F.size("session_groups").alias("groups"), F.posexplode("top_participants").alias("place", "p")).select("report_sessions", "report_removed", "groups", "place", "p.*")


@query("io9_reconstruction_report", sql(o.METRICS, "#report_sessions=(SELECT count(*) FROM sm);#report_people=(SELECT count(DISTINCT participant_id) FROM sm);#report_mismatches=0;~report_improvement=(SELECT avg(improvement_pct) FROM sm);module;#sessions=count(*);~improvement_mean=avg(improvement_pct);~mse_model_mean=avg(mse_model)", "FROM sm GROUP BY module"))
def _(s, d):
    path, report = scratch(s, "reconstruction-report"), rp.reconstruction_report(fx.session_metrics(s, d), rm.feature_metrics(fx.predictions(s, d)))
    io.write_report(report, path, "json")
    got = s.read.schema(report.schema).json(path)
    head = (F.col("sessions").alias("report_sessions"), F.col("participants").alias("report_people"), F.col("participant_id_mismatches").alias("report_mismatches"), F.col("improvement_mean").alias("report_improvement"))
    return got.select(*head, F.explode("modules").alias("m")).select(*(f"report_{c}" for c in ("sessions", "people", "mismatches", "improvement")), "m.module", "m.sessions", "m.improvement_mean", "m.mse_model_mean")


@query("io10_embeddings_csv", sql("", "#vec_id;" + ";".join(f"~emb_{j}=embedding[{j + 1}]" for j in range(64)), "FROM embeddings"))
def _(s, d):
    path = scratch(s, "embeddings")
    io.write_embeddings(fx.table(s, d, "embeddings"), path, 64)
    return s.read.schema("vec_id long, " + ", ".join(f"emb_{j} float" for j in range(64))).csv(path, header=True)
