"""Oracle SQL (DuckDB dialect) for the registered queries.

Written from the rules, apart from the inverse normal CDF, whose published
approximation both sides share: the views
``embeddings``, ``events``, ``lineitem`` are the test tables. Doubles are
rounded to the same digits as the Spark side.
"""

from __future__ import annotations

import math

from ..functions.probit import probit_sql
from ..functions.uniform import gaussian_sql, uniform, uniform_sql
from ..params import OnlineParams
from .common import DELTA_DAYS, DELTA_HOURS, EMB_Q, EV_Q, EV_SPLIT, M_LAST, MANY_Q, T_FACTOR
from .queries import DRAW_SEED, EV_HALF, MILESTONE_BAND, MILESTONES, REQUESTS, SNAP

INF = "CAST('inf' AS DOUBLE)"
DAY_US = 86400000000.0
HOUR_US = 3600000000.0


def _tick(us: float) -> str:
    return f"CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / {us}) AS BIGINT)"


def _sqd(a: str, b: str) -> str:
    return f"list_sum(list_transform({a}, lambda v, i: ({b}[i] - v) * ({b}[i] - v)))"


def _sqd2(a: str, b: str) -> str:
    """2-d squared distance (events)."""
    return f"(({a}[1] - {b}[1]) * ({a}[1] - {b}[1]) + ({a}[2] - {b}[2]) * ({a}[2] - {b}[2]))"


def _argmin(points: str, centers: str, dist: str, pid: str = "id") -> str:
    """Nearest center per point; ties to the lowest slot."""
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT p.*, c.slot, {dist} AS d2, "
        f"row_number() OVER (PARTITION BY p.{pid} ORDER BY {dist}, c.slot) AS rn "
        f"FROM {points} p CROSS JOIN {centers} c) WHERE rn = 1"
    )


EMB_PTS = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings"


def _emb_seeds(q: int, pts: str = "emb_pts") -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS slot, x AS c FROM (SELECT id, x FROM {pts} ORDER BY id LIMIT {q})"


def _emb_state_ctes(q: int = EMB_Q) -> str:
    """emb_pts, seeds, a0 (assignment to seeds), cfp (per slot/pos sums),
    st (slot, n, cen, rmsd) incl. singleton radius."""
    return f"""
emb_pts AS ({EMB_PTS}),
seeds AS ({_emb_seeds(q)}),
a0 AS ({_argmin('emb_pts', 'seeds', _sqd('p.x', 'c.c'))}),
el AS (SELECT slot, unnest(range(len(x))) AS pos, unnest(x) AS v FROM a0),
cfp AS (SELECT slot, pos, sum(v) AS s1, sum(v * v) AS s2 FROM el GROUP BY slot, pos),
cnt AS (SELECT slot, count(*) AS n FROM a0 GROUP BY slot),
agg AS (SELECT slot, list(s1 ORDER BY pos) AS c1, list(s2 ORDER BY pos) AS c2, sum(s2) AS ss2, sum(s1 * s1) AS ss1 FROM cfp GROUP BY slot),
st0 AS (
  SELECT s.slot, coalesce(cnt.n, 0) AS n,
         CASE WHEN coalesce(cnt.n, 0) > 0 THEN list_transform(agg.c1, lambda v: v / cnt.n) ELSE s.c END AS cen,
         CASE WHEN coalesce(cnt.n, 0) > 1 THEN sqrt(greatest(agg.ss2 / cnt.n - agg.ss1 / (cnt.n * cnt.n), 0.0)) ELSE 0.0 END AS r0
  FROM seeds s LEFT JOIN cnt USING (slot) LEFT JOIN agg USING (slot)),
nn AS (SELECT a.slot, sqrt(min({_sqd('a.cen', 'b.cen')})) AS nn_dist FROM st0 a CROSS JOIN st0 b
       WHERE {_sqd('a.cen', 'b.cen')} <> 0 GROUP BY a.slot),
st AS (SELECT st0.slot, st0.n, st0.cen, CASE WHEN st0.n = 1 THEN coalesce(nn.nn_dist, {INF}) ELSE st0.r0 END AS rmsd
       FROM st0 LEFT JOIN nn USING (slot))"""


EV_PTS = f"""SELECT event_id AS id, [value, CAST(json_extract(props, '$.k') AS DOUBLE)] AS x, {_tick(DAY_US)} AS tick, user_id
FROM events WHERE value IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL"""


def _ev_state_ctes(q: int = EV_Q, split: int = EV_SPLIT) -> str:
    """ev, evs (seeds), a0, g0, est (slot, ids, n, s10, s11, s20, s21, t1, t2, cen, rmsd)."""
    return f"""
ev AS ({EV_PTS}),
evs AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS slot, x AS c FROM (SELECT id, x FROM ev ORDER BY id LIMIT {q})),
ev0 AS (SELECT * FROM ev WHERE tick < {split}),
a0 AS ({_argmin('ev0', 'evs', _sqd2('p.x', 'c.c'))}),
g0 AS (SELECT slot, count(*) AS n, sum(x[1]) AS s10, sum(x[2]) AS s11, sum(x[1] * x[1]) AS s20, sum(x[2] * x[2]) AS s21,
              CAST(sum(tick) AS BIGINT) AS t1, CAST(sum(tick * tick) AS BIGINT) AS t2 FROM a0 GROUP BY slot),
est0 AS (
  SELECT s.slot, CAST(s.slot AS VARCHAR) AS ids, coalesce(g.n, 0) AS n,
         coalesce(g.s10, 0.0) AS s10, coalesce(g.s11, 0.0) AS s11, coalesce(g.s20, 0.0) AS s20, coalesce(g.s21, 0.0) AS s21,
         coalesce(g.t1, 0) AS t1, coalesce(g.t2, 0) AS t2,
         CASE WHEN coalesce(g.n, 0) > 0 THEN [g.s10 / g.n, g.s11 / g.n] ELSE s.c END AS cen,
         CASE WHEN coalesce(g.n, 0) > 1 THEN sqrt(greatest((g.s20 + g.s21) / g.n - (g.s10 * g.s10 + g.s11 * g.s11) / (g.n * g.n), 0.0)) ELSE 0.0 END AS r0
  FROM evs s LEFT JOIN g0 g USING (slot)),
enn AS (SELECT a.slot, sqrt(min({_sqd2('a.cen', 'b.cen')})) AS nn_dist FROM est0 a CROSS JOIN est0 b
        WHERE {_sqd2('a.cen', 'b.cen')} <> 0 GROUP BY a.slot),
est AS (SELECT est0.* EXCLUDE (r0), CASE WHEN est0.n = 1 THEN coalesce(enn.nn_dist, {INF}) ELSE est0.r0 END AS rmsd
        FROM est0 LEFT JOIN enn USING (slot))"""


def _stamp(n="n", t1="t1", t2="t2", m=M_LAST) -> str:
    nd = f"CAST({n} AS DOUBLE)"
    mu = f"(CASE WHEN {nd} > 0 THEN CAST({t1} AS DOUBLE) / {nd} ELSE 0.0 END)"
    sigma = f"sqrt(greatest(CAST({t2} AS DOUBLE) / {nd} - {mu} * {mu}, 0.0))"
    p = f"(1.0 - {float(m)!r} / (2.0 * {nd}))"
    return f"(CASE WHEN {nd} < {2.0 * m!r} THEN {mu} ELSE {mu} + {sigma} * {probit_sql(p)} END)"


def _ev_stale_ctes(now: int = EV_SPLIT, delta: int = DELTA_DAYS) -> str:
    return f""",
ess AS (SELECT *, {_stamp()} AS stamp FROM est),
esw AS (SELECT *, (stamp < CAST({now - delta} AS DOUBLE)) OR n = 0 AS stale FROM ess)"""


STATE_OUT = """slot, ids, n, t1 AS cf1t, t2 AS cf2t, round(s10, 4) AS cf1x0, round(s11, 4) AS cf1x1,
round(s20, 4) AS cf2x0, round(s21, 4) AS cf2x1"""


def _ev_batch_outliers() -> str:
    return f""",
evb AS (SELECT * FROM ev WHERE tick >= {EV_SPLIT}),
ab AS ({_argmin('evb', '(SELECT slot, cen AS c, rmsd FROM est)', _sqd2('p.x', 'c.c'))}),
outl AS (SELECT ab.id, ab.x, ab.tick FROM ab JOIN est USING (slot) WHERE NOT (sqrt(ab.d2) <= {T_FACTOR!r} * est.rmsd))"""


# -- SQL per query -------------------------------------------------------------------


def _parse_vectors() -> str:
    cols = ", ".join(f"CAST({c} AS VARCHAR)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"))
    return f"""
WITH t AS (SELECT l_orderkey, l_linenumber, string_split(trim(concat_ws(' ', {cols})), ' ') AS toks FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, toks[len(toks)] AS label,
             list_transform(toks[1:len(toks) - 1], lambda s: TRY_CAST(s AS DOUBLE)) AS x FROM t)
SELECT l_orderkey, l_linenumber, label, CAST(len(x) AS INTEGER) AS dims, x[1] AS x0, x[2] AS x1, x[3] AS x2, x[4] AS x3
FROM p WHERE len(x) = 4 AND len(list_filter(x, lambda v: v IS NULL OR isnan(v))) = 0"""


def _stream_source() -> str:
    return f"SELECT id, x[1] AS x0, x[2] AS x1 FROM ({EV_PTS})"


def _hourly_counts() -> str:
    return f"""
h AS (SELECT {_tick(HOUR_US)} AS tick FROM events),
c AS (SELECT tick, count(*) AS n_batch FROM h GROUP BY tick),
span AS (SELECT unnest(range(0, max(tick) + 1)) AS tick FROM h),
tc AS (SELECT span.tick, CAST(coalesce(c.n_batch, 0) AS BIGINT) AS n_batch FROM span LEFT JOIN c USING (tick)),
run AS (SELECT tick, n_batch, CAST(sum(n_batch) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_total FROM tc)"""


def _tick_counters() -> str:
    return f"WITH {_hourly_counts()} SELECT tick, n_batch, n_total FROM run"


def _progress() -> str:
    return f"WITH {_hourly_counts()} SELECT tick + 1 AS tc, n_batch, n_total AS n FROM run WHERE n_batch > 0"


def _milestones() -> str:
    marks = ", ".join(f"({m})" for m in MILESTONES)
    return f"""WITH {_hourly_counts()},
pr AS (SELECT tick + 1 AS tc, n_total AS n FROM run WHERE n_batch > 0),
mk AS (SELECT CAST(mark AS BIGINT) AS mark FROM (VALUES {marks}) v(mark))
SELECT tc, n, mark FROM pr JOIN mk ON n > mark - {MILESTONE_BAND} AND n <= mark + {MILESTONE_BAND}"""


def _assign_nearest() -> str:
    return f"""WITH emb_pts AS ({EMB_PTS}), seeds AS ({_emb_seeds(EMB_Q)}),
a AS ({_argmin('emb_pts', 'seeds', _sqd('p.x', 'c.c'))})
SELECT id, slot, round(d2, 6) AS d2 FROM a"""


def _assign_many() -> str:
    return f"""WITH ev AS MATERIALIZED ({EV_PTS}), seeds AS MATERIALIZED ({_emb_seeds(MANY_Q, 'ev')}),
a AS (SELECT p.id, min({{'d2': {_sqd2('p.x', 'c.c')}, 'slot': c.slot}}) AS b FROM ev p CROSS JOIN seeds c GROUP BY p.id)
SELECT id, b.slot AS slot, round(b.d2, 6) AS d2 FROM a"""


def _split_outliers() -> str:
    return f"""WITH {_emb_state_ctes()},
a1 AS ({_argmin('emb_pts', '(SELECT slot, cen AS c FROM st)', _sqd('p.x', 'c.c'))})
SELECT a1.id, a1.slot, sqrt(a1.d2) <= {T_FACTOR!r} * st.rmsd AS inside, round(a1.d2, 6) AS d2 FROM a1 JOIN st USING (slot)"""


def _cf_aggregate() -> str:
    return f"""WITH {_emb_state_ctes()}
SELECT cfp.slot, cnt.n, CAST(cfp.pos AS INTEGER) AS pos, round(cfp.s1, 6) AS cf1x, round(cfp.s2, 6) AS cf2x
FROM cfp JOIN cnt USING (slot)"""


def _cf_apply() -> str:
    return f"""WITH {_ev_state_ctes()},
evb AS (SELECT * FROM ev WHERE tick >= {EV_SPLIT}),
ab AS ({_argmin('evb', '(SELECT slot, cen AS c FROM est)', _sqd2('p.x', 'c.c'))}),
gb AS (SELECT slot, count(*) AS n, sum(x[1]) AS s10, sum(x[2]) AS s11, sum(x[1] * x[1]) AS s20, sum(x[2] * x[2]) AS s21,
              CAST(sum(tick) AS BIGINT) AS t1, CAST(sum(tick * tick) AS BIGINT) AS t2 FROM ab GROUP BY slot)
SELECT e.slot, e.n + coalesce(g.n, 0) AS n, e.t1 + coalesce(g.t1, 0) AS cf1t, e.t2 + coalesce(g.t2, 0) AS cf2t,
       round(e.s10 + coalesce(g.s10, 0.0), 4) AS cf1x0, round(e.s11 + coalesce(g.s11, 0.0), 4) AS cf1x1,
       round(e.s20 + coalesce(g.s20, 0.0), 4) AS cf2x0, round(e.s21 + coalesce(g.s21, 0.0), 4) AS cf2x1
FROM est e LEFT JOIN gb g USING (slot)"""


def _refresh_rmsd() -> str:
    return f"""WITH {_emb_state_ctes()},
ex AS (SELECT slot, n, rmsd, unnest(range(len(cen))) AS pos, unnest(cen) AS c FROM st)
SELECT slot, n, CAST(pos AS INTEGER) AS pos, round(c, 6) AS centroid, round(rmsd, 6) AS rmsd FROM ex"""


def _singleton_radius() -> str:
    return f"WITH {_emb_state_ctes()} SELECT slot, round(nn_dist, 6) AS nn_dist FROM nn"


def _user_hourly() -> str:
    return f"""
h AS (SELECT user_id, {_tick(HOUR_US)} AS tick FROM events),
u AS (SELECT user_id, count(*) AS n, CAST(sum(tick) AS BIGINT) AS t1, CAST(sum(tick * tick) AS BIGINT) AS t2 FROM h GROUP BY user_id),
nw AS (SELECT max(tick) + 1 AS now FROM h)"""


def _relevance_stamp() -> str:
    return f"WITH {_user_hourly()} SELECT user_id, n, round({_stamp()}, 4) AS stamp FROM u"


def _stale_slots() -> str:
    return f"""WITH {_user_hourly()},
s AS (SELECT u.user_id, u.n, {_stamp()} AS stamp, nw.now FROM u CROSS JOIN nw)
SELECT user_id, round(stamp, 4) AS stamp, CAST(row_number() OVER (ORDER BY user_id) AS INTEGER) AS stale_rank
FROM s WHERE stamp < CAST(now - {DELTA_HOURS} AS DOUBLE) OR n = 0"""


def _replace_stale() -> str:
    return f"""WITH {_ev_state_ctes()}{_ev_stale_ctes()}{_ev_batch_outliers()},
ns AS (SELECT count(*) AS k FROM esw WHERE stale),
ro AS (SELECT id, x, tick, row_number() OVER (ORDER BY tick, id) AS rk FROM outl),
rs AS (SELECT slot, row_number() OVER (ORDER BY slot) AS rk FROM esw WHERE stale),
mx AS (SELECT max(slot) AS m FROM esw),
rep AS (SELECT rs.slot, rk, ro.x, ro.tick, mx.m + rk AS new_id FROM rs JOIN ro USING (rk) CROSS JOIN mx),
oth AS (SELECT a.slot, a.x, CASE WHEN o2.rk < a.rk THEN o2.x ELSE o.cen END AS c
        FROM rep a JOIN esw o ON o.slot <> a.slot LEFT JOIN rep o2 ON o2.slot = o.slot),
rad AS (SELECT slot, sqrt(min({_sqd2('x', 'c')})) AS r FROM oth WHERE {_sqd2('x', 'c')} <> 0 GROUP BY slot)
SELECT e.slot,
  round(CASE WHEN rep.slot IS NULL THEN e.cen[1] ELSE rep.x[1] END, 4) AS c0,
  round(CASE WHEN rep.slot IS NULL THEN e.cen[2] ELSE rep.x[2] END, 4) AS c1,
  round(CASE WHEN rep.slot IS NULL THEN e.rmsd ELSE coalesce(rad.r, {INF}) END, 4) AS rmsd,
  CASE WHEN rep.slot IS NULL THEN e.ids ELSE CAST(rep.new_id AS VARCHAR) END AS ids,
  CASE WHEN rep.slot IS NULL THEN e.n ELSE 1 END AS n,
  CASE WHEN rep.slot IS NULL THEN e.t1 ELSE rep.tick END AS cf1t,
  CASE WHEN rep.slot IS NULL THEN e.t2 ELSE rep.tick * rep.tick END AS cf2t,
  round(CASE WHEN rep.slot IS NULL THEN e.s10 ELSE rep.x[1] END, 4) AS cf1x0,
  round(CASE WHEN rep.slot IS NULL THEN e.s11 ELSE rep.x[2] END, 4) AS cf1x1,
  round(CASE WHEN rep.slot IS NULL THEN e.s20 ELSE rep.x[1] * rep.x[1] END, 4) AS cf2x0,
  round(CASE WHEN rep.slot IS NULL THEN e.s21 ELSE rep.x[2] * rep.x[2] END, 4) AS cf2x1
FROM esw e LEFT JOIN rep USING (slot) LEFT JOIN rad ON rad.slot = e.slot"""


def _closest_pair_ctes() -> str:
    return f"""{_ev_state_ctes()}{_ev_stale_ctes()},
kp AS (SELECT a.slot AS slot_a, b.slot AS slot_b, {_sqd2('a.cen', 'b.cen')} AS d2
       FROM esw a JOIN esw b ON a.slot < b.slot WHERE NOT a.stale AND NOT b.stale),
cp AS (SELECT * FROM kp ORDER BY d2, slot_a, slot_b LIMIT 1)"""


def _closest_pair() -> str:
    return f"WITH {_closest_pair_ctes()} SELECT slot_a, slot_b, round(d2, 4) AS d2 FROM cp"


def _merge_pair() -> str:
    return f"""WITH {_closest_pair_ctes()},
b AS (SELECT e.* FROM est e JOIN cp ON e.slot = cp.slot_b)
SELECT e.slot,
  round(CASE WHEN e.slot = cp.slot_a THEN (e.s10 + b.s10) / (e.n + b.n) ELSE e.cen[1] END, 4) AS c0,
  round(CASE WHEN e.slot = cp.slot_a THEN (e.s11 + b.s11) / (e.n + b.n) ELSE e.cen[2] END, 4) AS c1,
  round(CASE WHEN e.slot = cp.slot_a THEN sqrt(greatest((e.s20 + b.s20 + e.s21 + b.s21) / (e.n + b.n)
    - ((e.s10 + b.s10) * (e.s10 + b.s10) + (e.s11 + b.s11) * (e.s11 + b.s11)) / ((e.n + b.n) * (e.n + b.n)), 0.0)) ELSE e.rmsd END, 4) AS rmsd,
  CASE WHEN e.slot = cp.slot_a THEN e.ids || ',' || b.ids WHEN e.slot = cp.slot_b THEN '' ELSE e.ids END AS ids,
  CASE WHEN e.slot = cp.slot_a THEN e.n + b.n WHEN e.slot = cp.slot_b THEN 0 ELSE e.n END AS n,
  CASE WHEN e.slot = cp.slot_a THEN e.t1 + b.t1 WHEN e.slot = cp.slot_b THEN 0 ELSE e.t1 END AS cf1t,
  CASE WHEN e.slot = cp.slot_a THEN e.t2 + b.t2 WHEN e.slot = cp.slot_b THEN 0 ELSE e.t2 END AS cf2t,
  round(CASE WHEN e.slot = cp.slot_a THEN e.s10 + b.s10 WHEN e.slot = cp.slot_b THEN 0.0 ELSE e.s10 END, 4) AS cf1x0,
  round(CASE WHEN e.slot = cp.slot_a THEN e.s11 + b.s11 WHEN e.slot = cp.slot_b THEN 0.0 ELSE e.s11 END, 4) AS cf1x1,
  round(CASE WHEN e.slot = cp.slot_a THEN e.s20 + b.s20 WHEN e.slot = cp.slot_b THEN 0.0 ELSE e.s20 END, 4) AS cf2x0,
  round(CASE WHEN e.slot = cp.slot_a THEN e.s21 + b.s21 WHEN e.slot = cp.slot_b THEN 0.0 ELSE e.s21 END, 4) AS cf2x1
FROM est e CROSS JOIN cp CROSS JOIN b"""


def _order_sql(t: str, alpha: int) -> str:
    return (
        f"CAST(len(list_filter(range(1, 63), lambda i: pow({alpha}, i) <= {t} "
        f"AND {t} % CAST(pow({alpha}, i) AS BIGINT) = 0)) AS INTEGER)"
    )


def _expiry_sql(t: str, alpha: int, l: int) -> str:
    return f"({t} + {alpha ** l + 1} * CAST(pow({alpha}, {_order_sql(t, alpha)} + 1) AS BIGINT))"


def _schedule(clock_sql: str) -> str:
    a, l = SNAP.alpha, SNAP.l
    return f"""
tt AS ({clock_sql}),
sc AS (SELECT unnest(range(1, T + 1)) AS tick, T FROM tt),
sched AS (SELECT tick, {_order_sql('tick', a)} AS snap_order,
                 tick >= 1 AND tick <= T AND {_expiry_sql('tick', a, l)} > T AS live FROM sc)"""


HOURLY_T = f"SELECT max({_tick(HOUR_US)}) + 1 AS T FROM events"
DAILY_T = f"SELECT max(tick) + 1 AS T FROM ({EV_PTS})"


def _snapshot_order() -> str:
    return f"WITH {_schedule(HOURLY_T)} SELECT tick, snap_order, live FROM sched"


def _snapshot_live() -> str:
    return f"""WITH {_schedule(HOURLY_T)}
SELECT tick, snap_order, {_expiry_sql('tick', SNAP.alpha, SNAP.l)} AS expires FROM sched WHERE live"""


def _requests_cte() -> str:
    vals = ", ".join(f"({tc}, {h})" for tc, h in REQUESTS)
    return f"req AS (SELECT CAST(tc AS BIGINT) AS tc, CAST(h AS BIGINT) AS h FROM (VALUES {vals}) v(tc, h))"


def _pairs_ctes() -> str:
    return f"""{_schedule(DAILY_T)},
lt AS (SELECT tick FROM sched WHERE live),
{_requests_cte()},
f AS (SELECT tc, h, max(CASE WHEN tick <= tc THEN tick END) AS t1, min(tick) AS mn FROM req CROSS JOIN lt GROUP BY tc, h),
s AS (SELECT f.tc, f.h, f.t1, f.mn, max(CASE WHEN lt.tick <= f.t1 - f.h THEN lt.tick END) AS t2 FROM f CROSS JOIN lt GROUP BY f.tc, f.h, f.t1, f.mn),
pairs AS (SELECT tc, h, coalesce(t1, -1) AS t1, CASE WHEN t1 IS NULL THEN -1 ELSE coalesce(t2, mn) END AS t2 FROM s)"""


def _snapshot_pair() -> str:
    return f"WITH {_pairs_ctes()} SELECT tc, h, t1, t2 FROM pairs"


def _user_snap(clock: str, name: str, src: str = "ev") -> str:
    """Per-user CF of events with day < clock (columns: clock, slot, n, s*, t*)."""
    return f"""{name} AS (
  SELECT {clock} AS clock, CAST(user_id AS INTEGER) AS slot, count(*) AS n,
         sum(x[1]) AS s10, sum(x[2]) AS s11, sum(x[1] * x[1]) AS s20, sum(x[2] * x[2]) AS s21,
         CAST(sum(tick) AS BIGINT) AS t1, CAST(sum(tick * tick) AS BIGINT) AS t2
  FROM {src} WHERE tick < {clock} GROUP BY user_id)"""


def _lineage_ctes() -> str:
    return f"""ev AS ({EV_PTS}),
{_user_snap(20, 'u20')},
{_user_snap(10, 'u10')},
p20 AS (SELECT CAST(floor(slot / 2) AS INTEGER) AS slot, CAST(sum(n) AS BIGINT) AS n, sum(s10) AS s10, sum(s11) AS s11, sum(s20) AS s20, sum(s21) AS s21,
               CAST(sum(t1) AS BIGINT) AS t1, CAST(sum(t2) AS BIGINT) AS t2, list(CAST(slot AS BIGINT) ORDER BY slot) AS ids FROM u20 GROUP BY 1),
rel AS (SELECT p20.slot AS slot1, u10.slot AS slot2 FROM p20 JOIN u10 ON list_contains(p20.ids, CAST(u10.slot AS BIGINT)))"""


def _lineage_match() -> str:
    return f"WITH {_lineage_ctes()} SELECT DISTINCT slot1, slot2 FROM rel"


def _horizon_subtract() -> str:
    return f"""WITH {_lineage_ctes()},
sub AS (SELECT rel.slot1, CAST(sum(u10.n) AS BIGINT) AS n, sum(u10.s10) AS s10, sum(u10.s11) AS s11, sum(u10.s20) AS s20, sum(u10.s21) AS s21,
               CAST(sum(u10.t1) AS BIGINT) AS t1, CAST(sum(u10.t2) AS BIGINT) AS t2, list(CAST(u10.slot AS BIGINT)) AS ids
        FROM rel JOIN u10 ON rel.slot2 = u10.slot GROUP BY rel.slot1),
res AS (SELECT p.slot,
  CASE WHEN b.slot1 IS NULL THEN p.ids ELSE list_filter(p.ids, lambda u: NOT list_contains(b.ids, u)) END AS idl,
  p.n - coalesce(b.n, 0) AS n, p.t1 - coalesce(b.t1, 0) AS t1, p.t2 - coalesce(b.t2, 0) AS t2,
  p.s10 - coalesce(b.s10, 0.0) AS s10, p.s11 - coalesce(b.s11, 0.0) AS s11,
  p.s20 - coalesce(b.s20, 0.0) AS s20, p.s21 - coalesce(b.s21, 0.0) AS s21
  FROM p20 p LEFT JOIN sub b ON p.slot = b.slot1)
SELECT true AS horizon_exact, slot, array_to_string(idl, ',') AS ids, n, t1 AS cf1t, t2 AS cf2t,
  round(s10, 4) AS cf1x0, round(s11, 4) AS cf1x1, round(s20, 4) AS cf2x0, round(s21, 4) AS cf2x1 FROM res"""


def _all_user_snaps() -> str:
    """User snapshots at every live daily clock: (clock, slot, ...)."""
    return f"""{_schedule(DAILY_T)},
ev AS ({EV_PTS}),
lt AS (SELECT tick FROM sched WHERE live),
us AS (SELECT lt.tick AS clock, CAST(ev.user_id AS INTEGER) AS slot, count(*) AS n,
              sum(x[1]) AS s10, sum(x[2]) AS s11, sum(x[1] * x[1]) AS s20, sum(x[2] * x[2]) AS s21,
              CAST(sum(ev.tick) AS BIGINT) AS t1, CAST(sum(ev.tick * ev.tick) AS BIGINT) AS t2
       FROM ev JOIN lt ON ev.tick < lt.tick GROUP BY lt.tick, ev.user_id)"""


def _snapshot_roundtrip() -> str:
    return f"""WITH {_all_user_snaps()}
SELECT slot, CAST(slot AS VARCHAR) AS ids, n, t1 AS cf1t, t2 AS cf2t, round(s10, 4) AS cf1x0, round(s11, 4) AS cf1x1,
       round(s20, 4) AS cf2x0, round(s21, 4) AS cf2x1 FROM us WHERE clock = 28"""


def _snapshot_text() -> str:
    nl = "chr(10)"
    rule = "'=========================================================== '"
    return f"""WITH {_all_user_snaps()}
SELECT clock AS tick, slot,
  {rule} || {nl} ||
  'MicroCluster IDs = [' || CAST(slot AS VARCHAR) || ']' || {nl} ||
  'CF2X = [' || printf('%.4f', s20) || ',' || printf('%.4f', s21) || ']' || {nl} ||
  'CF1X = [' || printf('%.4f', s10) || ',' || printf('%.4f', s11) || ']' || {nl} ||
  'CF2T = ' || CAST(t2 AS VARCHAR) || {nl} ||
  'CF1T = ' || CAST(t1 AS VARCHAR) || {nl} ||
  'N = ' || CAST(n AS VARCHAR) || {nl} AS text
FROM us WHERE clock <= 12"""


def _horizon_sweep() -> str:
    return f"""WITH {_all_user_snaps()},
{_requests_cte()},
f AS (SELECT tc, h, max(CASE WHEN tick <= tc THEN tick END) AS t1, min(tick) AS mn FROM req CROSS JOIN lt GROUP BY tc, h),
s AS (SELECT f.tc, f.h, f.t1, f.mn, max(CASE WHEN lt.tick <= f.t1 - f.h THEN lt.tick END) AS t2 FROM f CROSS JOIN lt GROUP BY f.tc, f.h, f.t1, f.mn),
pairs AS (SELECT tc, h, t1, coalesce(t2, mn) AS t2 FROM s WHERE t1 IS NOT NULL),
s1 AS (SELECT pairs.*, us.* EXCLUDE (clock) FROM pairs JOIN us ON us.clock = pairs.t1),
s2 AS (SELECT pairs.tc, pairs.h, us.* EXCLUDE (clock) FROM pairs JOIN us ON us.clock = pairs.t2),
res AS (SELECT s1.tc, s1.h, s1.t1, s1.t2, s1.slot,
  CASE WHEN s2.slot IS NOT NULL AND s1.t1 - s1.h >= s1.t2 THEN s1.n - s2.n ELSE s1.n END AS n,
  CASE WHEN s2.slot IS NOT NULL AND s1.t1 - s1.h >= s1.t2 THEN s1.s10 - s2.s10 ELSE s1.s10 END AS s10,
  CASE WHEN s2.slot IS NOT NULL AND s1.t1 - s1.h >= s1.t2 THEN s1.s11 - s2.s11 ELSE s1.s11 END AS s11
  FROM s1 LEFT JOIN s2 ON s1.tc = s2.tc AND s1.h = s2.h AND s1.slot = s2.slot),
live AS (SELECT * FROM res WHERE n > 0)
SELECT tc, h, t1, t2, slot, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY tc, h), 9) AS weight,
       round(s10, 4) AS s0, round(s11, 4) AS s1 FROM live"""


def _label_ctes() -> str:
    return f"""emb_pts AS ({EMB_PTS}),
el AS (SELECT label AS slot, unnest(range(len(x))) AS pos, unnest(x) AS v FROM emb_pts),
lcnt AS (SELECT label AS slot, count(*) AS n FROM emb_pts GROUP BY label),
lc AS (SELECT slot, pos, sum(v) AS s1 FROM el GROUP BY slot, pos),
lpe AS (SELECT lc.slot, lc.pos, lc.s1 / lcnt.n AS v FROM lc JOIN lcnt USING (slot)),
lpts AS (SELECT slot, n, CAST(n AS DOUBLE) AS w, CAST(n AS DOUBLE) / sum(n) OVER () AS weight,
                (SELECT list(v ORDER BY pos) FROM lpe WHERE lpe.slot = lcnt.slot) AS c FROM lcnt)"""


def _macro_centers() -> str:
    return f"WITH {_label_ctes()} SELECT slot, CAST(pos AS INTEGER) AS pos, round(v, 6) AS center FROM lpe"


def _macro_weights() -> str:
    return f"WITH {_label_ctes()} SELECT slot, n, round(weight, 9) AS weight FROM lpts"


def _interval_ctes(k_draws: int, name: str, u: str | None = None) -> str:
    return f"""{name}_iv AS (SELECT slot, c, sum(weight) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, weight,
                       max(slot) OVER () AS mxs FROM lpts),
{name}_iv2 AS (SELECT slot, c, hi - weight AS lo, CASE WHEN slot = mxs THEN {INF} ELSE hi END AS hi FROM {name}_iv),
{name}_u AS (SELECT i, {u or f"(i + 0.5) / {float(k_draws)!r}"} AS u FROM range(0, {k_draws}) r(i)),
{name} AS (SELECT iv.slot, iv.c, count(*) AS draws FROM {name}_u u JOIN {name}_iv2 iv ON u.u >= iv.lo AND u.u < iv.hi GROUP BY iv.slot, iv.c)"""


def _weighted_sample() -> str:
    return f"WITH {_label_ctes()}, {_interval_ctes(5000, 'smp')} SELECT slot, draws FROM smp"


def _lloyd_ctes(pts: str, init: str, iters: int, dims: int) -> str:
    """Unrolled weighted Lloyd: ``pts(slot, c, w)``, ``init(cluster, center)``;
    ends with ``cfin(cluster, center)`` and ``afin`` (final assignment)."""
    parts = [f"c0 AS (SELECT cluster, center FROM {init})"]
    for i in range(1, iters + 1):
        d = _sqd("p.c", "k.center")
        parts.append(
            f"a{i} AS (SELECT slot, w, c, cluster FROM (SELECT p.slot, p.w, p.c, k.cluster, "
            f"row_number() OVER (PARTITION BY p.slot ORDER BY {d}, k.cluster) AS rn FROM {pts} p CROSS JOIN c{i - 1} k) WHERE rn = 1)"
        )
        parts.append(
            f"e{i} AS (SELECT cluster, pos, sum(w * v) / sum(w) AS v FROM "
            f"(SELECT cluster, w, unnest(range({dims})) AS pos, unnest(c) AS v FROM a{i}) GROUP BY cluster, pos)"
        )
        parts.append(
            f"c{i} AS (SELECT k.cluster, coalesce((SELECT list(v ORDER BY pos) FROM e{i} WHERE e{i}.cluster = k.cluster), k.center) AS center "
            f"FROM c{i - 1} k)"
        )
    d = _sqd("p.c", "k.center")
    parts.append(
        f"afin AS (SELECT slot, w, cluster FROM (SELECT p.slot, p.w, k.cluster, "
        f"row_number() OVER (PARTITION BY p.slot ORDER BY {d}, k.cluster) AS rn FROM {pts} p CROSS JOIN c{iters} k) WHERE rn = 1)"
    )
    parts.append(f"cfin AS (SELECT * FROM c{iters})")
    parts.append("wfin AS (SELECT cfin.cluster, coalesce(sum(afin.w), 0.0) AS weight FROM cfin LEFT JOIN afin USING (cluster) GROUP BY cfin.cluster)")
    return ",\n".join(parts)


def _macro_out(dims_name: str = "center") -> str:
    return f"""SELECT cluster, round(weight, 4) AS weight, CAST(pos AS INTEGER) AS pos, round(v, 6) AS {dims_name}
FROM (SELECT cfin.cluster, wfin.weight, unnest(range(len(cfin.center))) AS pos, unnest(cfin.center) AS v FROM cfin JOIN wfin USING (cluster))"""


def _heaviest_init(k: int, pts: str) -> str:
    return f"(SELECT CAST(row_number() OVER (ORDER BY w DESC, slot) - 1 AS INTEGER) AS cluster, c AS center FROM (SELECT * FROM {pts} ORDER BY w DESC, slot LIMIT {k}))"


def _weighted_draws() -> str:
    return f"WITH {_label_ctes()}, {_interval_ctes(5000, 'smp', uniform_sql(DRAW_SEED, 0, 'i'))} SELECT slot, draws FROM smp"


def _drawn_kmeans() -> str:
    smp, st = (_interval_ctes(n, name, uniform_sql(DRAW_SEED + k, 0, "i")) for k, (n, name) in enumerate([(5000, "smp"), (5, "st")]))
    return f"""WITH {_label_ctes()}, {smp}, {st},
sp AS (SELECT slot, c, CAST(draws AS DOUBLE) AS w FROM smp),
si AS (SELECT CAST(row_number() OVER (ORDER BY slot, r) - 1 AS INTEGER) AS cluster, c AS center
       FROM (SELECT slot, c, unnest(range(draws)) AS r FROM st)),
{_lloyd_ctes('sp', 'si', 20, 64)}
{_macro_out()}"""


def _macro_kmeans() -> str:
    return f"""WITH {_label_ctes()},
{_lloyd_ctes('lpts', _heaviest_init(5, 'lpts'), 20, 64)}
{_macro_out()}"""


def _sampled_kmeans() -> str:
    return f"""WITH {_label_ctes()}, {_interval_ctes(5000, 'smp')}, {_interval_ctes(5, 'st')},
sp AS (SELECT slot, c, CAST(draws AS DOUBLE) AS w FROM smp),
si AS (SELECT CAST(row_number() OVER (ORDER BY slot, r) - 1 AS INTEGER) AS cluster, c AS center
       FROM (SELECT slot, c, unnest(range(draws)) AS r FROM st)),
{_lloyd_ctes('sp', 'si', 20, 64)}
{_macro_out()}"""


def _centers_csv() -> str:
    return f"""WITH {_label_ctes()},
{_lloyd_ctes('lpts', _heaviest_init(5, 'lpts'), 20, 64)}
SELECT cluster, array_to_string(list_transform(center, lambda v: printf('%.6f', v)), ',') AS line FROM cfin"""


def _micro_macro() -> str:
    return f"""WITH {_emb_state_ctes()},
mp AS (SELECT st.slot, CAST(st.n AS DOUBLE) AS w, list_transform(agg.c1, lambda v: v / st.n) AS c FROM st JOIN agg USING (slot) WHERE st.n > 0),
{_lloyd_ctes('mp', _heaviest_init(3, 'mp'), 20, 64)}
{_macro_out()}"""


def _kmeans_wssse() -> str:
    return f"""WITH emb_pts AS ({EMB_PTS}), seeds AS ({_emb_seeds(5)}),
a AS ({_argmin('emb_pts', 'seeds', _sqd('p.x', 'c.c'))})
SELECT round(sum(d2), 6) AS wssse, count(*) AS n FROM a"""


def _skm_split(w: str, c: str) -> str:
    """The end of a streaming k-means update over rows ``u(slot, c, w)``: where
    the lightest weight is below 1e-8 of the heaviest, the heaviest center is
    split in two that share the weights."""
    pert = "1e-14 * greatest(abs(v), 1.0)"
    return f"""SELECT u.slot,
  CASE WHEN NOT dying THEN {c} WHEN u.slot = big THEN list_transform(big_c, lambda v: v + {pert})
       WHEN u.slot = small THEN list_transform(big_c, lambda v: v - {pert}) ELSE {c} END AS c,
  CASE WHEN dying AND u.slot IN (big, small) THEN (big_w + small_w) / 2.0 ELSE {w} END AS w"""


_SKM_ENDS = """(SELECT *, small_w < 1e-8 * big_w AS dying FROM (
    SELECT arg_min(slot, {'w': -w, 's': slot}) AS big, max(w) AS big_w, arg_min(c, {'w': -w, 's': slot}) AS big_c,
           arg_min(slot, {'w': w, 's': slot}) AS small, min(w) AS small_w FROM u))"""


def _skm_moved(decay: str) -> str:
    """New center and weight from ``k(c, w)``, ``cnt``, ``sx0``, ``sx1``, ``tot``."""
    w1 = f"(k.w * {decay} + CAST(coalesce(g.cnt, 0) AS DOUBLE))"
    n = "CAST(g.cnt AS DOUBLE)"
    move = lambda i: f"(1.0 - {n} / greatest({w1}, 1e-16)) * k.c[{i + 1}] + ({n} / greatest({w1}, 1e-16) / {n}) * g.sx{i}"
    return f"CASE WHEN g.cnt > 0 THEN [{move(0)}, {move(1)}] ELSE k.c END AS c, {w1} AS w"


def _skm_update(i: int, prev: str, batch: str) -> str:
    """CTEs of one update with decay 1: ``prev(slot, c, w)`` and the points of
    ``batch(id, x)`` -> ``k{i}``."""
    return f"""
a{i} AS MATERIALIZED ({_argmin(batch, prev, _sqd2('p.x', 'c.c'))}),
g{i} AS (SELECT slot, count(*) AS cnt, sum(x[1]) AS sx0, sum(x[2]) AS sx1 FROM a{i} GROUP BY slot),
u{i} AS MATERIALIZED (SELECT k.slot, {_skm_moved('1.0')} FROM {prev} k LEFT JOIN g{i} g USING (slot)),
k{i} AS MATERIALIZED ({_skm_split('u.w', 'u.c')} FROM u{i} u CROSS JOIN {_SKM_ENDS.replace('FROM u)', f'FROM u{i})')})"""


def _streaming_kmeans() -> str:
    """One update a day, over the days there are (a day without points changes
    nothing)."""
    decay = math.exp(math.log(0.5) / 1000)
    disc = f"pow({decay!r}, CAST((SELECT coalesce(sum(cnt), 0) FROM g) AS DOUBLE))"
    return f"""WITH RECURSIVE ev AS ({EV_PTS}),
k0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS slot, x AS c, CAST(1.0 AS DOUBLE) AS w FROM (SELECT id, x FROM ev ORDER BY id LIMIT 5)),
model AS (
  SELECT CAST(0 AS BIGINT) AS day, slot, c, w FROM k0
  UNION ALL
  (WITH k AS (SELECT * FROM model),
  near AS (SELECT * FROM (
    SELECT p.id, p.x, k.slot, row_number() OVER (PARTITION BY p.id ORDER BY {_sqd2('p.x', 'k.c')}, k.slot) AS rn
    FROM k JOIN ev p ON p.tick = k.day) WHERE rn = 1),
  g AS (SELECT slot, count(*) AS cnt, sum(x[1]) AS sx0, sum(x[2]) AS sx1 FROM near GROUP BY slot),
  u AS (SELECT k.day, k.slot, {_skm_moved(disc)} FROM k LEFT JOIN g USING (slot))
  SELECT u.day + 1 AS day, z.slot, z.c, z.w FROM u JOIN ({_skm_split('u.w', 'u.c')} FROM u CROSS JOIN {_SKM_ENDS}) z ON z.slot = u.slot
  WHERE u.day <= (SELECT max(tick) FROM ev)))
SELECT slot, round(w, 6) AS weight, round(c[1], 6) AS c0, round(c[2], 6) AS c1 FROM model
WHERE day = (SELECT max(tick) + 1 FROM ev)"""


# -- starts of the online phase ----------------------------------------------------

SEED = OnlineParams(q=1, dim=1).seed
EV_ALL = f"SELECT event_id AS id, [value, CAST(json_extract(props, '$.k') AS DOUBLE)] AS x, {_tick(DAY_US)} AS tick FROM events WHERE value IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL"


def _built(batch: str, centers: str, now: int) -> str:
    """CTEs and result of a state built from ``centers(slot, c)`` and the points
    of ``batch`` at tick ``now``."""
    return f"""
fin AS MATERIALIZED ({_argmin(batch, centers, _sqd2('p.x', 'c.c'))}),
sums AS (SELECT slot, count(*) AS n, sum(x[1]) AS s10, sum(x[2]) AS s11, sum(x[1] * x[1]) AS s20, sum(x[2] * x[2]) AS s21 FROM fin GROUP BY slot),
built AS (
  SELECT s.slot, CAST(s.slot AS VARCHAR) AS ids, coalesce(g.n, 0) AS n, coalesce(g.n, 0) * {now} AS t1, coalesce(g.n, 0) * {now * now} AS t2,
         coalesce(g.s10, 0.0) AS s10, coalesce(g.s11, 0.0) AS s11, coalesce(g.s20, 0.0) AS s20, coalesce(g.s21, 0.0) AS s21
  FROM {centers} s LEFT JOIN sums g USING (slot))
SELECT {STATE_OUT} FROM built"""


def _slots(q: int) -> str:
    return f"(SELECT CAST(unnest(range(0, {q})) AS INTEGER) AS slot)"


def _init_random() -> str:
    c = ", ".join(uniform_sql(SEED, j, "slot") for j in range(2))
    return f"""WITH ev AS ({EV_ALL}),
c0 AS MATERIALIZED (SELECT slot, [{c}] AS c FROM {_slots(EV_Q)}),{_built('ev', 'c0', 0)}"""


def _init_streaming_kmeans() -> str:
    c = ", ".join(gaussian_sql(SEED, j, "slot") for j in range(2))
    return f"""WITH ev AS ({EV_ALL}),
early AS (SELECT * FROM ev WHERE tick < {EV_HALF}),
late AS (SELECT * FROM ev WHERE tick >= {EV_HALF}),
k0 AS MATERIALIZED (SELECT slot, [{c}] AS c, CAST(0.0 AS DOUBLE) AS w FROM {_slots(EV_Q)}),{_skm_update(1, 'k0', 'early')},{_skm_update(2, 'k1', 'late')},{_built('late', 'k2', 1)}"""


def _init_kmeans() -> str:
    """The start by oversampled rounds and ten rounds from it, draw by draw."""
    q, ell, rounds = EV_Q, 2 * EV_Q, 2
    parts = [
        f"ev AS ({EV_ALL})",
        f"cand0 AS MATERIALIZED (SELECT 0 AS i, x FROM ev ORDER BY {uniform_sql(SEED, 0, 'id')}, id LIMIT 1)",
    ]
    for r in range(1, rounds + 1):
        parts += [
            f"far{r} AS MATERIALIZED (SELECT p.id, p.x, min({_sqd2('p.x', 'c.x')}) AS d2 FROM ev p CROSS JOIN cand{r - 1} c GROUP BY p.id, p.x)",
            f"hit{r} AS (SELECT id, x FROM far{r} WHERE {uniform_sql(SEED, r, 'id')} < {float(ell)!r} / (SELECT sum(d2) FROM far{r}) * d2)",
            f"cand{r} AS MATERIALIZED (SELECT i, x FROM cand{r - 1} UNION ALL SELECT (SELECT max(i) FROM cand{r - 1}) + row_number() OVER (ORDER BY id) AS i, x FROM hit{r})",
        ]
    c = f"cand{rounds}"
    owned = _argmin("ev", f"(SELECT i AS slot, x AS c FROM {c})", _sqd2("p.x", "c.c"))
    parts += [
        f"held AS (SELECT slot AS i, count(*) AS n FROM ({owned}) GROUP BY slot)",
        f"p0 AS MATERIALIZED (SELECT i, x, CAST(coalesce(n, 0) AS DOUBLE) AS w, CAST(1.0 AS DOUBLE) AS d2 FROM {c} LEFT JOIN held USING (i))",
    ]
    for j in range(q):
        u = float(uniform(SEED, 1000 + j, 0))
        parts.append(
            f"s{j} AS MATERIALIZED (SELECT i, x FROM (SELECT *, max(cum) OVER () AS whole FROM (SELECT *, sum(w * d2) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM p{j})) "
            f"WHERE cum > {u!r} * whole ORDER BY i LIMIT 1)"
        )
        new = _sqd2("p.x", "s.x")
        parts.append(f"p{j + 1} AS MATERIALIZED (SELECT p.i, p.x, p.w, {new if j == 0 else f'least(p.d2, {new})'} AS d2 FROM p{j} p CROSS JOIN s{j} s)")
    parts.append("r0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT CAST({j} AS INTEGER) AS slot, x AS c FROM s{j}" for j in range(q)) + ")")
    for i in range(1, 11):
        parts += [
            f"a{i} AS MATERIALIZED ({_argmin('ev', f'r{i - 1}', _sqd2('p.x', 'c.c'))})",
            f"r{i} AS MATERIALIZED (SELECT k.slot, CASE WHEN g.n > 0 THEN [g.s0 / g.n, g.s1 / g.n] ELSE k.c END AS c FROM r{i - 1} k "
            f"LEFT JOIN (SELECT slot, count(*) AS n, sum(x[1]) AS s0, sum(x[2]) AS s1 FROM a{i} GROUP BY slot) g USING (slot))",
        ]
    return "WITH " + ",\n".join(parts) + "," + _built("ev", "r10", 0)


def _kmeans_train() -> str:
    return f"""WITH lp AS MATERIALIZED (SELECT row_number() OVER () AS slot, l_orderkey * 8 + l_linenumber AS id, [CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)] AS c, CAST(1.0 AS DOUBLE) AS w FROM lineitem),
li0 AS (SELECT CAST(row_number() OVER (ORDER BY id, c) - 1 AS INTEGER) AS cluster, c AS center FROM (SELECT id, c FROM lp ORDER BY id, c LIMIT 2)),
{_lloyd_ctes('lp', 'li0', 20, 4)},
cost AS (SELECT sum(d) AS wssse FROM (SELECT p.slot, min({_sqd('p.c', 'k.center')}) AS d FROM lp p CROSS JOIN cfin k GROUP BY p.slot))
SELECT cluster AS slot, CAST(weight AS BIGINT) AS n, {", ".join(f"round(center[{i + 1}], 4) AS c{i}" for i in range(4))}, round(wssse / 1e9, 6) AS wssse_1e9
FROM cfin JOIN wfin USING (cluster) CROSS JOIN cost"""


def _lineage_members() -> str:
    return f"""WITH ev AS ({EV_PTS}),
u AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS id FROM ev WHERE tick < 20)
SELECT CAST(floor(id / 10) AS INTEGER) AS slot, CAST(row_number() OVER (PARTITION BY floor(id / 10) ORDER BY id) - 1 AS BIGINT) AS pos, id FROM u"""


def _online_totals(days: int = 1) -> str:
    return f"""WITH ev AS (SELECT x, tick // {days} AS tick FROM ({EV_PTS}))
SELECT count(*) AS n, CAST(sum(tick) AS BIGINT) AS cf1t, CAST(sum(tick * tick) AS BIGINT) AS cf2t,
       round(sum(x[1]), 2) AS cf1x0, round(sum(x[2]), 2) AS cf1x1,
       round(sum(x[1] * x[1]), 2) AS cf2x0, round(sum(x[2] * x[2]), 2) AS cf2x1
FROM ev"""


ORACLE = {
    "online_totals": _online_totals,
    "stream_totals": lambda: _online_totals(6),
    "text_scan": _stream_source,
    "weighted_draws": _weighted_draws,
    "drawn_kmeans": _drawn_kmeans,
    "parse_vectors": _parse_vectors,
    "stream_source": _stream_source,
    "tick_counters": _tick_counters,
    "progress": _progress,
    "milestones": _milestones,
    "assign_nearest": _assign_nearest,
    "assign_many": _assign_many,
    "split_outliers": _split_outliers,
    "cf_aggregate": _cf_aggregate,
    "cf_apply": _cf_apply,
    "refresh_rmsd": _refresh_rmsd,
    "singleton_radius": _singleton_radius,
    "relevance_stamp": _relevance_stamp,
    "stale_slots": _stale_slots,
    "replace_stale": _replace_stale,
    "closest_pair": _closest_pair,
    "merge_pair": _merge_pair,
    "snapshot_order": _snapshot_order,
    "snapshot_live": _snapshot_live,
    "snapshot_pair": _snapshot_pair,
    "lineage_match": _lineage_match,
    "horizon_subtract": _horizon_subtract,
    "snapshot_roundtrip": _snapshot_roundtrip,
    "snapshot_text": _snapshot_text,
    "horizon_sweep": _horizon_sweep,
    "macro_centers": _macro_centers,
    "macro_weights": _macro_weights,
    "weighted_sample": _weighted_sample,
    "macro_kmeans": _macro_kmeans,
    "sampled_kmeans": _sampled_kmeans,
    "centers_csv": _centers_csv,
    "micro_macro": _micro_macro,
    "kmeans_wssse": _kmeans_wssse,
    "kmeans_train": _kmeans_train,
    "lineage_members": _lineage_members,
    "init_random": _init_random,
    "init_kmeans": _init_kmeans,
    "init_streaming_kmeans": _init_streaming_kmeans,
    "streaming_kmeans": _streaming_kmeans,
}


def oracle_sql() -> dict[str, str]:
    return {k: f().strip() for k, f in ORACLE.items()}
