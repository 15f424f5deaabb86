"""Shared SQL of the oracle side: the derived tables as DuckDB expressions."""

from __future__ import annotations

ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey"


def samples(name: str, session: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT session_id, i, CAST(i AS DOUBLE) / 1000 AS ts, ch0, ch1, ch2, ch3, y FROM (
    SELECT CAST({session} AS BIGINT) AS session_id,
           row_number() OVER (PARTITION BY {session} ORDER BY {ORDER}) - 1 AS i,
           l_quantity AS ch0, l_extendedprice / 1000 AS ch1, l_discount * 1000 AS ch2, l_tax * 1000 AS ch3,
           CAST(year(l_shipdate) AS INTEGER) AS y
    FROM lineitem))"""


FA = samples("fa", "l_suppkey")
FB = samples("fb", "floor(l_suppkey / 10)")


def windows(source: str = "fa", size: int = 150, hop: int = 25, first: int = 0, channels=(0, 1, 2, 3)) -> str:
    """Windows as lists, one row per window: cut from one list per session."""
    lists = ", ".join(f"list(ch{c} ORDER BY i) AS a{c}" for c in channels)
    cuts = ", ".join(f"a{c}[{first} + k * {hop} + 1 : {first} + k * {hop} + {size}] AS x{c}" for c in channels)
    return f"""whole AS MATERIALIZED (SELECT session_id, count(*) AS n, list(ts ORDER BY i) AS t, {lists} FROM {source} GROUP BY session_id),
w AS MATERIALIZED (
  SELECT session_id, CAST(k AS INTEGER) AS k, t[{first} + k * {hop} + 1] AS start_time, t[{first} + k * {hop} + {size}] AS end_time, {cuts}
  FROM (SELECT *, unnest(range(0, (n - {size} - {first}) // {hop} + 1)) AS k FROM whole WHERE n >= {size} + {first}))"""


def year_label(y: str = "y") -> str:
    return (
        f"CASE {y} WHEN 1996 THEN 'open' WHEN 1998 THEN 'fist' WHEN 2000 THEN 'hook_em' WHEN 2001 THEN 'thumbs_up' "
        f"WHEN 1995 THEN 'rest' WHEN 1997 THEN 'rest' WHEN 1999 THEN 'rest' END"
    )


LABELLED = f"""lw AS MATERIALIZED (
  SELECT a.session_id, CAST(a.i // 25 AS INTEGER) AS k, a.ts AS start_time, b.ts AS end_time, {year_label('a.y')} AS label, a.y AS y
  FROM fb a JOIN fb b ON b.session_id = a.session_id AND b.i = a.i + 149 WHERE a.i % 25 = 0)"""

RUNS = """marked AS (SELECT *, CASE WHEN lag(label) OVER s IS DISTINCT FROM label THEN 1 ELSE 0 END AS opens
  FROM lw WINDOW s AS (PARTITION BY session_id ORDER BY k)),
runs AS MATERIALIZED (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY k) - 1 AS run FROM marked)"""

EVENTS = """ev AS MATERIALIZED (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k,
         epoch_us(ts) AS ts_us, event_type, value FROM events)"""

CLASSES = ("click", "error", "purchase", "signup", "view")


def _class_p(c: str) -> str:
    return (
        f"CASE WHEN flat THEN 0.2e0 ELSE 0.02e0 + 0.54e0 * CAST(blk = '{c}' AS INTEGER) "
        f"+ 0.36e0 * CAST(event_type = '{c}' AS INTEGER) END"
    )


FC = EVENTS + f""",
lead AS (SELECT session_id, k // 8 AS b, arg_min(event_type, k) AS blk FROM ev GROUP BY 1, 2),
fc AS MATERIALIZED (SELECT session_id, k, event_type, value, [{', '.join(_class_p(c) for c in CLASSES)}] AS p
  FROM (SELECT ev.*, lead.blk, (ev.k < 3 OR ev.k % 40 >= 28) AS flat
        FROM ev JOIN lead ON lead.session_id = ev.session_id AND lead.b = ev.k // 8))"""

EMA = FC + """,
em AS (
  SELECT session_id, k, p, list_transform(p, lambda x: 0.7e0 * 0.2e0 + (1 - 0.7e0) * x) AS s FROM fc WHERE k = 0
  UNION ALL
  SELECT f.session_id, f.k, f.p, list_transform(range(1, 6), lambda c: 0.7e0 * e.s[c] + (1 - 0.7e0) * f.p[c])
  FROM em e JOIN fc f ON f.session_id = e.session_id AND f.k = e.k + 1),
sm AS MATERIALIZED (SELECT session_id, CAST(k AS BIGINT) AS k,
  CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS raw,
  CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS winner, list_max(s) AS conf, s FROM em)"""

HYST = EMA + """,
hy AS (
  SELECT session_id, k, raw, winner, conf, CASE WHEN conf < 0.25e0 THEN -1 ELSE winner END AS output FROM sm WHERE k = 0
  UNION ALL
  SELECT s.session_id, s.k, s.raw, s.winner, s.conf,
    CASE WHEN s.conf < 0.25e0 OR s.winner = h.output THEN h.output
         WHEN h.output < 0 OR s.conf >= 0.70e0 THEN s.winner ELSE h.output END
  FROM hy h JOIN sm s ON s.session_id = h.session_id AND s.k = h.k + 1),
hs AS MATERIALIZED (SELECT * FROM hy)"""

_MAJ = "hist[list_position(votes, list_max(votes))]"
VOTE = EMA + """,
vt AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS k, 0 AS raw, 0 AS winner, 0e0 AS conf, CAST([] AS INTEGER[]) AS hist, false AS rejected,
         CAST(NULL AS INTEGER) AS majority, 0e0 AS confidence, -1 AS output, -1 AS pend, 0 AS cnt
  FROM sm WHERE k = 0
  UNION ALL
  SELECT session_id, k, raw, winner, conf, hist, rejected, majority, confidence,
    CASE WHEN rejected THEN output WHEN output < 0 THEN majority WHEN majority = output THEN output
         WHEN majority = pend AND cnt + 1 >= 3 THEN majority ELSE output END,
    CASE WHEN rejected THEN pend ELSE majority END,
    CASE WHEN rejected THEN cnt WHEN output < 0 OR majority = output THEN 1 WHEN majority = pend THEN cnt + 1 ELSE 1 END
  FROM (
    SELECT *, CASE WHEN rejected THEN NULL ELSE hist[list_position(votes, list_max(votes))] END AS majority,
      CASE WHEN rejected THEN conf ELSE list_max(votes) / len(hist) END AS confidence
    FROM (
      SELECT *, list_transform(hist, lambda v: len(list_filter(hist, lambda u: u = v))) AS votes
      FROM (
        SELECT s.session_id, s.k, s.raw, s.winner, s.conf, s.conf < 0.40e0 AS rejected,
          CASE WHEN s.conf < 0.40e0 THEN v.hist ELSE list_append(v.hist, s.winner)[-5:] END AS hist, v.output, v.pend, v.cnt
        FROM vt v JOIN sm s ON s.session_id = v.session_id AND s.k = v.k + 1)))),
vd AS MATERIALIZED (SELECT * FROM vt WHERE k >= 0)"""

VECTORS = """vec AS MATERIALIZED (
  SELECT vec_id % 5 AS session_id, vec_id AS k, 'c' || label AS label, vec_id // 10 AS trial_id,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS f FROM embeddings)"""
LONG = VECTORS + """,
lf AS MATERIALIZED (SELECT session_id, k, label, trial_id, CAST(pos - 1 AS INTEGER) AS pos, f[pos] AS v
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS pos FROM vec))"""
CLASS_STATS = LONG + """,
cs AS MATERIALIZED (SELECT session_id, label, pos, count(*) AS n, avg(v) AS mean FROM lf GROUP BY ALL),
st AS MATERIALIZED (
  SELECT a.session_id, a.pos, a.mu, b.sd + 1e-8 AS sigma
  FROM (SELECT session_id, pos, avg(mean) AS mu FROM cs GROUP BY ALL) a
  JOIN (SELECT session_id, pos, stddev_pop(v) AS sd FROM lf GROUP BY ALL) b USING (session_id, pos))"""


def sql(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
