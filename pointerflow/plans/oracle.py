"""Common table expressions of the SQL twins, by the frame they stand for."""

from __future__ import annotations

EVENTS = """raw_ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev0 AS (SELECT 'P' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS participant, CAST(1 + (day(ts) - 1) // 15 AS VARCHAR) AS sess,
 CASE event_id % 3 WHEN 0 THEN 'behavior_RESS' WHEN 1 THEN 'behavior_EADS' ELSE 'behavior_WAI_sr' END AS module,
 CAST((epoch_us(ts) - 1704067200000000) // 200000000 AS DOUBLE) AS t, CAST((floor(value) % 4) * 5 AS DOUBLE) AS x, CAST((k % 3) * 4 AS DOUBLE) AS y,
 event_type = 'click' AS is_click,
 CASE WHEN event_type = 'click' THEN CASE WHEN k < 50 THEN '<div class="q">a</div>' WHEN k < 80 THEN '<input type="radio">' WHEN k < 95 THEN '<LABEL for="z">t</LABEL>'
  WHEN k = 97 THEN '<img src="u">' WHEN k = 99 THEN 'plain text' ELSE '<!-- <b> --><button>go</button>' END END AS node, event_id AS ord FROM raw_ev),
ev AS (SELECT *, participant || '|' || sess || '|' || module AS session_key FROM ev0)"""

DELTAS = EVENTS + """,
dl0 AS (SELECT *, row_number() OVER w AS event_idx, lag(t) OVER w AS prev_t, lag(x) OVER w AS prev_x, lag(y) OVER w AS prev_y FROM ev WINDOW w AS (PARTITION BY session_key ORDER BY t, is_click, ord)),
dl AS (SELECT *, t - prev_t AS dt, sqrt((x - prev_x) * (x - prev_x) + (y - prev_y) * (y - prev_y)) AS dist FROM dl0),
dp AS (SELECT *, coalesce(NOT is_click AND dt >= 250 AND dist < 3, false) AS pausing FROM dl)"""

PAUSES = """,
pz0 AS (SELECT *, sum(CASE WHEN pausing THEN 0 ELSE 1 END) OVER (PARTITION BY session_key ORDER BY event_idx) AS run FROM dp),
pz AS (SELECT session_key, min(event_idx) AS made_at, min(prev_t) AS "start", max(t) AS "end", sum(dt) AS duration, sum(dist) AS distance, arg_min(prev_x, event_idx) AS x, arg_min(prev_y, event_idx) AS y FROM pz0 WHERE pausing GROUP BY session_key, run)"""

# The anchor is carried from event to event; e* is the hover that an event ends.
HOVERS = """,
sc AS (SELECT session_key, event_idx, t, x, y, CAST(NULL AS DOUBLE) AS a_t, CAST(NULL AS DOUBLE) AS ax, CAST(NULL AS DOUBLE) AS ay, CAST(NULL AS DOUBLE) AS es, CAST(NULL AS DOUBLE) AS ex, CAST(NULL AS DOUBLE) AS ey, CAST(NULL AS DOUBLE) AS ee FROM dp WHERE event_idx = 1
 UNION ALL
 SELECT d.session_key, d.event_idx, d.t, d.x, d.y,
  CASE WHEN d.pausing OR d.is_click THEN NULL WHEN s.a_t IS NULL THEN CASE WHEN d.dist < 10 THEN s.t END WHEN sqrt((d.x - s.ax) * (d.x - s.ax) + (d.y - s.ay) * (d.y - s.ay)) > 10 THEN NULL ELSE s.a_t END,
  CASE WHEN d.pausing OR d.is_click THEN NULL WHEN s.a_t IS NULL THEN CASE WHEN d.dist < 10 THEN s.x END WHEN sqrt((d.x - s.ax) * (d.x - s.ax) + (d.y - s.ay) * (d.y - s.ay)) > 10 THEN NULL ELSE s.ax END,
  CASE WHEN d.pausing OR d.is_click THEN NULL WHEN s.a_t IS NULL THEN CASE WHEN d.dist < 10 THEN s.y END WHEN sqrt((d.x - s.ax) * (d.x - s.ax) + (d.y - s.ay) * (d.y - s.ay)) > 10 THEN NULL ELSE s.ay END,
  s.a_t, s.ax, s.ay,
  CASE WHEN d.pausing OR s.a_t IS NULL THEN NULL WHEN d.is_click THEN d.t WHEN sqrt((d.x - s.ax) * (d.x - s.ax) + (d.y - s.ay) * (d.y - s.ay)) > 10 THEN s.t END
 FROM sc s JOIN dp d ON d.session_key = s.session_key AND d.event_idx = s.event_idx + 1),
hv AS (SELECT session_key, event_idx AS made_at, false AS flushed, es AS "start", ex AS x, ey AS y, ee AS "end" FROM sc WHERE ee - es >= 1000
 UNION ALL
 SELECT session_key, event_idx + 1, true, a_t, ax, ay, t FROM (SELECT *, max(event_idx) OVER (PARTITION BY session_key) AS last_idx FROM sc) WHERE event_idx = last_idx AND t - a_t >= 1000)"""

MOVES = """,
mv0 AS (SELECT d.*, sum(CASE WHEN d.pausing OR d.is_click OR h.made_at IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY d.session_key ORDER BY d.event_idx) AS segment FROM dp d LEFT JOIN (SELECT * FROM hv WHERE NOT flushed) h ON h.session_key = d.session_key AND h.made_at = d.event_idx),
mv1 AS (SELECT * FROM mv0 WHERE NOT pausing AND NOT is_click AND dist > 0),
mv AS (SELECT session_key, segment, min(event_idx) AS made_at, arg_min(prev_t, event_idx) AS "start", arg_max(t, event_idx) AS "end", sum(dt) AS duration, sum(dist) AS distance, arg_max(x, event_idx) AS x, arg_max(y, event_idx) AS y, count(*) + 1 AS n_points FROM mv1 GROUP BY session_key, segment)"""

ACTIONS = "WITH RECURSIVE " + DELTAS + PAUSES + HOVERS + MOVES + """,
ac0 AS (
 SELECT session_key, made_at, 1 AS rank, 'pause' AS type, "start", "end", duration, distance, x, y, CAST(NULL AS DOUBLE) AS "timestamp", CAST(NULL AS VARCHAR) AS node, CAST(NULL AS BIGINT) AS n_points, CAST(NULL AS BIGINT) AS segment FROM pz
 UNION ALL SELECT session_key, event_idx, 1, 'click', NULL, NULL, NULL, NULL, x, y, t, node, NULL, NULL FROM dp WHERE is_click AND event_idx > 1
 UNION ALL SELECT session_key, made_at, 0, 'hover', "start", "end", "end" - "start", NULL, x, y, NULL, NULL, NULL, NULL FROM hv
 UNION ALL SELECT session_key, made_at, 1, 'mouse_movement', "start", "end", duration, distance, x, y, "end", NULL, n_points, segment FROM mv),
ac AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY made_at, rank) - 1 AS action_idx FROM ac0),
pt AS (
 SELECT a.session_key, a.action_idx, m.event_idx AS i, m.x AS px, m.y AS py, m.t AS pt FROM ac a JOIN mv1 m ON m.session_key = a.session_key AND m.segment = a.segment WHERE a.type = 'mouse_movement'
 UNION ALL SELECT a.session_key, a.action_idx, m.event_idx - 1, m.prev_x, m.prev_y, m.prev_t FROM ac a JOIN mv1 m ON m.session_key = a.session_key AND m.event_idx = a.made_at WHERE a.type = 'mouse_movement')"""

STATS = ACTIONS + """,
al AS (SELECT session_key, px AS x, py AS y FROM pt UNION ALL SELECT session_key, x, y FROM ac WHERE type <> 'mouse_movement'),
st0 AS (SELECT session_key, median(x) AS x_center, median(y) AS y_center, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS xi, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS yi, max(x) - min(x) AS xr, max(y) - min(y) AS yr FROM al GROUP BY session_key),
st AS (SELECT session_key, x_center, y_center, CASE WHEN xi > 1e-6 THEN xi WHEN xr > 1e-6 THEN xr ELSE 1 END AS x_scale, CASE WHEN yi > 1e-6 THEN yi WHEN yr > 1e-6 THEN yr ELSE 1 END AS y_scale FROM st0)"""

FEATURES = STATS + """,
np AS (SELECT p.session_key, p.action_idx, row_number() OVER (PARTITION BY p.session_key, p.action_idx ORDER BY i) AS i, (px - x_center) / x_scale AS x, (py - y_center) / y_scale AS y, pt AS t, px AS x_raw, py AS y_raw FROM pt p JOIN st USING (session_key)),
sp0 AS (SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM np WINDOW w AS (PARTITION BY session_key, action_idx ORDER BY i)),
sp1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt ELSE 0 END AS speed FROM sp0 WHERE i > 1),
sp2 AS (SELECT *, speed - lag(speed) OVER w AS dspeed, lag(dx) OVER w AS pdx, lag(dy) OVER w AS pdy FROM sp1 WINDOW w AS (PARTITION BY session_key, action_idx ORDER BY i)),
sp AS (SELECT *, CASE WHEN pdx IS NULL THEN NULL WHEN sqrt(pdx * pdx + pdy * pdy) * sqrt(dx * dx + dy * dy) = 0 THEN 0 ELSE acos(greatest(-1.0, least(1.0, (pdx * dx + pdy * dy) / (sqrt(pdx * pdx + pdy * pdy) * sqrt(dx * dx + dy * dy))))) END AS angle FROM sp2),
sg AS (SELECT a.session_key, a.action_idx, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM np a JOIN np b ON b.session_key = a.session_key AND b.action_idx = a.action_idx AND b.i = a.i + 1),
cr AS (SELECT p.session_key, p.action_idx, count(*) AS crossings FROM sg p JOIN sg q ON p.session_key = q.session_key AND p.action_idx = q.action_idx AND q.i > p.i + 1
 WHERE ((p.ax < 1e300) AND (((q.ax - p.ax) * (q.b_y - p.ay) - (q.ay - p.ay) * (q.bx - p.ax) > 0) <> ((q.ax - p.bx) * (q.b_y - p.b_y) - (q.ay - p.b_y) * (q.bx - p.bx) > 0))
  AND (((p.bx - p.ax) * (q.ay - p.ay) - (p.b_y - p.ay) * (q.ax - p.ax) > 0) <> ((p.bx - p.ax) * (q.b_y - p.ay) - (p.b_y - p.ay) * (q.bx - p.ax) > 0))) GROUP BY p.session_key, p.action_idx),
en AS (SELECT session_key, action_idx, arg_min(x, i) AS fx, arg_min(y, i) AS fy, arg_min(t, i) AS ft, arg_max(x, i) AS lx, arg_max(y, i) AS ly, arg_max(t, i) AS lt, arg_max(x_raw, i) AS rx, arg_max(y_raw, i) AS ry FROM np GROUP BY session_key, action_idx),
km0 AS (SELECT session_key, action_idx, sum(d) AS total, stddev_pop(d) AS jitter, coalesce(avg(dspeed), 0) AS acc, count(*) FILTER (WHERE angle > pi() / 4) AS turns, coalesce(avg(angle), 0) AS curv, coalesce(sum(angle), 0) AS turned FROM sp GROUP BY session_key, action_idx),
km AS (SELECT k.*, e.*, coalesce(c.crossings, 0) AS crossings, CASE WHEN lt - ft > 0 THEN lt - ft ELSE 1 END AS lasts, sqrt((lx - fx) * (lx - fx) + (ly - fy) * (ly - fy)) AS off FROM km0 k JOIN en e USING (session_key, action_idx) LEFT JOIN cr c USING (session_key, action_idx)),
ft0 AS (
 SELECT session_key, action_idx, 'mouse_movement' AS action_type, CAST(NULL AS VARCHAR) AS dom_element_type, lt AS "time", lasts AS action_duration, total / lasts AS cursor_speed, acc AS acceleration_mean, CASE WHEN abs(acc) > 1e-6 THEN 1 / acc ELSE 0 END AS reciprocal_acceleration, jitter, turns AS direction_changes, curv AS curvature_mean,
  CASE WHEN total > 0 THEN turned / total ELSE 0 END AS rate_of_curvature, total AS distance_travelled, off AS movement_offset, CASE WHEN total > 0 THEN off / total ELSE 0 END AS straightness, crossings AS self_intersections, lx AS x, ly AS y, rx AS x_raw, ry AS y_raw FROM km
 UNION ALL SELECT session_key, action_idx, type, nullif(lower(regexp_extract(regexp_replace(node, '<!--.*?-->', '', 'gs'), '<([A-Za-z][A-Za-z0-9:-]*)', 1)), ''), "timestamp", NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, (ac.x - x_center) / x_scale, (ac.y - y_center) / y_scale, ac.x, ac.y FROM ac JOIN st USING (session_key) WHERE type = 'click'
 UNION ALL SELECT session_key, action_idx, type, NULL, "end", coalesce("end", 0) - coalesce("start", 0), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, (ac.x - x_center) / x_scale, (ac.y - y_center) / y_scale, ac.x, ac.y FROM ac JOIN st USING (session_key) WHERE type IN ('hover', 'pause')),
ft AS (SELECT *, coalesce("time" - lag("time") OVER (PARTITION BY session_key ORDER BY action_idx), 0) AS time_since_last_action, split_part(session_key, '|', 3) AS module_id, split_part(session_key, '|', 1) AS participant_id FROM ft0)"""

RUNS = "WITH " + DELTAS + """,
rn0 AS (SELECT *, dist < 10 AS near, CASE WHEN NOT (dist < 10) OR is_click THEN 1 ELSE 0 END AS ends, max(event_idx) OVER (PARTITION BY session_key) AS last_idx FROM dp WHERE event_idx > 1),
rn1 AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY session_key ORDER BY event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM rn0),
rn AS (SELECT session_key, min(prev_t) AS "start", max(t) AS "end", max(t) - min(prev_t) AS dwell, max(t) - min(prev_t) >= 1000 AS valid, max(event_idx) = max(last_idx) AND NOT arg_max(is_click, event_idx) AS final FROM rn1 WHERE near GROUP BY session_key, run)"""

METRICS = """WITH sm0 AS (SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '|' || substr(o_orderpriority, 1, 1) || '|' || CASE o_orderkey % 3 WHEN 0 THEN 'behavior_RESS' WHEN 1 THEN 'behavior_EADS' ELSE 'behavior_WAI_sr' END || '|' || CAST(o_orderkey AS VARCHAR) AS session_id,
 'P' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS participant_id, avg(l_discount) AS mse_model, avg(l_tax) AS mse_baseline, CAST(sum(l_quantity) AS BIGINT) AS length_raw FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority),
sm AS (SELECT *, least(length_raw, 150) AS length, 100 * (mse_baseline - mse_model) / (mse_baseline + 1e-12) AS improvement_pct, split_part(session_id, '|', 3) AS module, regexp_extract(split_part(session_id, '|', 2), '(\\d+)', 1) AS sessnum, length_raw > 150 AS is_truncated, greatest(length_raw - 150, 0) AS steps_removed FROM sm0 WHERE mse_baseline > 0)"""

SCORES = METRICS + """,
qs0 AS (SELECT 'P' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS participant_id, CAST(1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS sessnum,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 22 END AS d, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) % 22 END AS a, event_id % 22 AS s FROM events WHERE event_type = 'signup'),
qs AS (SELECT participant_id, sessnum, avg(d) AS "EADS_Depressao", avg(a) AS "EADS_Ansiedade", avg(s) AS "EADS_Stress" FROM qs0 GROUP BY participant_id, sessnum),
lk AS (SELECT sm.*, qs."EADS_Depressao", qs."EADS_Ansiedade", qs."EADS_Stress", qs."EADS_Depressao" IS NOT NULL AND qs."EADS_Ansiedade" IS NOT NULL AND qs."EADS_Stress" IS NOT NULL AS has_eads FROM sm LEFT JOIN qs ON qs.participant_id = sm.participant_id AND qs.sessnum = sm.sessnum)"""

LONG = """WITH lf0 AS (SELECT vec_id AS session, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
lf AS (SELECT session, 'E' || CAST(label AS VARCHAR) AS participant, label, CAST(i // 8 AS INTEGER) AS step, 'f' || CAST(i % 8 AS VARCHAR) AS feature, CAST(v AS DOUBLE) AS y_true, CAST(v AS DOUBLE) * 0.5 AS y_pred, i // 8 <= session % 8 AS valid FROM lf0),
bl AS (SELECT feature, avg(y_true) AS mean FROM lf WHERE valid AND label < 7 GROUP BY feature),
ses AS (SELECT session, participant, sum((y_true - y_pred) * (y_true - y_pred)) FILTER (WHERE valid) / count(*) FILTER (WHERE valid) AS mse_model, sum((y_true - mean) * (y_true - mean)) FILTER (WHERE valid) / count(*) FILTER (WHERE valid) AS mse_baseline, count(DISTINCT step) FILTER (WHERE valid) AS length, count(DISTINCT step) AS length_raw FROM lf JOIN bl USING (feature) GROUP BY session, participant),
rs AS (SELECT feature, stddev_pop(y_true) AS std, avg(y_true) AS mean, count(*) AS n FROM lf WHERE valid AND label < 7 GROUP BY feature)"""
