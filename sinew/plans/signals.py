"""Queries: windows, filters and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinew.constants import HAND_CHANNELS, POWER_BANDS
from sinew.functions import signal
from sinew.operators import features as FE
from sinew.operators import filters as FI
from sinew.operators import windows as W
from sinew.plans import fragments as S
from sinew.plans.catalog import q, r, register, rounded
from sinew.sources import testdata as td

CH = ("ch0", "ch1", "ch2", "ch3")


def _checks(windows):
    """What identifies a window's content: its ends and its sums."""
    total = lambda c: F.aggregate(F.get("x", F.lit(c)), F.lit(0.0), lambda a, v: a + v)
    size = F.size(F.get("x", F.lit(0)))
    return windows.select(
        "session_id", "k", size.cast("long").alias("n"), r("start_time").alias("start_time"), r("end_time").alias("end_time"),
        *[r(total(c)).alias(f"sum{c}") for c in range(4)],
        r(F.col("x")[1][0]).alias("first1"), r(F.element_at(F.col("x")[2], -1)).alias("last2"),
    )


CHECKS = (
    "SELECT session_id, k, len(x0) AS n, " + q("start_time", "start_time") + ", " + q("end_time", "end_time") + ", "
    + ", ".join(q(f"list_sum(x{c})", f"sum{c}") for c in range(4)) + ", " + q("x1[1]", "first1") + ", "
    + q("x2[-1]", "last2") + " FROM w"
)


@register("sliding_windows", S.sql(S.FA, S.windows(), select=CHECKS))
def sliding_windows(spark, sf):
    return _checks(W.sliding_windows(td.short_sessions(spark, sf)))


@register("device_windows", S.sql(S.FA, S.windows(first=25), select=CHECKS))
def device_windows(spark, sf):
    return _checks(W.device_windows(td.short_sessions(spark, sf)))


@register("ring_windows", S.sql(S.FA, S.windows(size=160, first=15), select=CHECKS))
def ring_windows(spark, sf):
    return _checks(W.ring_windows(td.short_sessions(spark, sf), 160))


@register("long_session_windows", S.sql(S.FB, S.windows("fb"), select=CHECKS))
def long_session_windows(spark, sf):
    return _checks(W.sliding_windows(td.long_sessions(spark, sf)))


@register("tumbling_windows", S.sql(S.FA, S.windows(hop=150), select=CHECKS))
def tumbling_windows(spark, sf):
    return _checks(W.tumbling_windows(td.short_sessions(spark, sf), 150))


@register("flush_partial", S.sql(
    S.FA,
    "c AS (SELECT session_id, CASE WHEN count(*) >= 150 THEN (count(*) - 150) // 25 + 1 ELSE 0 END AS k FROM fa GROUP BY 1)",
    select="SELECT session_id, CAST(k AS INTEGER) AS k, count(*) AS n, " + q("min(ts)", "start_time") + ", "
    + q("max(ts)", "end_time") + ", " + q("sum(ch1)", "sum1") + " FROM fa JOIN c USING (session_id) WHERE i >= k * 25 GROUP BY ALL"))
def flush_partial(spark, sf):
    out = W.flush_partial(td.short_sessions(spark, sf))
    total = F.aggregate(F.get("x", F.lit(1)), F.lit(0.0), lambda a, v: a + v)
    return out.select(
        "session_id", "k", F.col("n").cast("long").alias("n"), r("start_time").alias("start_time"),
        r("end_time").alias("end_time"), r(total).alias("sum1"),
    )


@register("window_index", S.sql(
    S.FB, S.LABELLED, select="SELECT session_id, k, " + q("start_time", "start_time") + ", " + q("end_time", "end_time") + ", label FROM lw"))
def window_index(spark, sf):
    return rounded(td.labelled_windows(spark, sf).drop("y"), ["start_time", "end_time"])


@register("reconstruct_signal", S.sql(
    S.FA, "c AS (SELECT session_id, (count(*) - 150) // 25 + 1 AS n FROM fa GROUP BY 1)",
    select=f"""SELECT session_id, i, ch0, {q('ch1', 'ch1')}, ch2, ch3, 'w' || least(i // 25, n - 1) AS label
FROM fa JOIN c USING (session_id) WHERE i < (n - 1) * 25 + 150"""))
def reconstruct_signal(spark, sf):
    windows = W.sliding_windows(td.short_sessions(spark, sf)).withColumn("label", F.concat(F.lit("w"), "k"))
    return rounded(W.reconstruct_signal(windows), ["ch1"])


@register("flatten_windows", S.sql(S.FA, S.windows(), select=f"""SELECT session_id, CAST(k // 4 AS BIGINT) AS part, count(*) * 150 AS n,
{q('(max(k) * 150 + 149) / 1000e0', 't_last')}, {q('sum(list_sum(x0))', 'sum0', 4)}, {q('sum(list_sum(x3))', 'sum3', 4)} FROM w GROUP BY ALL"""))
def flatten_windows(spark, sf):
    flat = W.flatten_windows(W.sliding_windows(td.short_sessions(spark, sf)))
    return flat.groupBy("session_id", F.floor(F.col("pos") / 600).alias("part")).agg(
        F.count("*").alias("n"), r(F.max("t")).alias("t_last"), r(F.sum("ch0"), 4).alias("sum0"), r(F.sum("ch3"), 4).alias("sum3")
    )


@register("center_global", S.sql(S.FA, "m AS (SELECT session_id, avg(ch0) m0, avg(ch1) m1, avg(ch2) m2, avg(ch3) m3 FROM fa GROUP BY 1)",
    select=f"SELECT session_id, i, {', '.join(q(f'ch{c} - m{c}', f'ch{c}', 4) for c in range(4))} FROM fa JOIN m USING (session_id)"))
def center_global(spark, sf):
    return rounded(W.center_global(td.short_sessions(spark, sf)).select("session_id", "i", *CH), CH, 4)


@register("slice_time", S.sql(S.FA, select="SELECT session_id, i, ts, ch0 FROM fa WHERE ts >= 0.1e0 AND ts < 0.1e0 + 0.25e0"))
def slice_time(spark, sf):
    return W.slice_time(td.short_sessions(spark, sf), 0.1, 0.25).select("session_id", "i", "ts", "ch0")


@register("drop_initial", S.sql(S.FA, select="SELECT session_id, i - 500 AS i, ch0, ch2 FROM fa WHERE i >= 500"))
def drop_initial(spark, sf):
    return W.drop_initial(td.short_sessions(spark, sf)).select("session_id", "i", "ch0", "ch2")


# ------------------------------------------------------------------------------------- filters

IMPULSE = "h AS MATERIALIZED (SELECT [" + ", ".join(repr(float(v)) + ("" if "e" in repr(float(v)) else "e0") for v in signal.impulse_response(*signal.BANDPASS, 150)) + "] AS h)"


def _window_stats(rows):
    """First, middle and last value and the sum of every channel of prepared windows."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    return rows.select("session_id", "k", F.posexplode("x").alias("channel", "x")).select(
        "session_id", "k", "channel", r(F.col("x")[0]).alias("v0"), r(F.col("x")[75]).alias("v75"), r(F.col("x")[149]).alias("v149"),
        r(total(F.col("x")), 3).alias("energy"),
    )


def _list_stats(source: str) -> str:
    one = lambda c: (
        f"SELECT session_id, k, {c} AS channel, {q(f'x{c}[1]', 'v0')}, {q(f'x{c}[76]', 'v75')}, {q(f'x{c}[150]', 'v149')}, "
        f"{q(f'list_sum(list_transform(x{c}, lambda v: v * v))', 'energy', 3)} FROM {source}"
    )
    return " UNION ALL ".join(one(c) for c in range(4))


def _apply(name: str, source: str, expr: str, channels=(0, 1, 2, 3)) -> str:
    return f"{name} AS MATERIALIZED (SELECT session_id, k, " + ", ".join(expr.format(x=f"x{c}") + f" AS x{c}" for c in channels) + f" FROM {source})"


DC = "list_transform({x}, lambda v: v - list_avg({x}))"
TONE = "list_transform({x}, lambda v: 64e0 * v / (32e0 + abs(v)))"
# Output t is the sum over j ≤ t of h[t − j]·(x[j] − x[0]): a product with the reversed response.
CONVOLVE = "list_transform(range(1, 151), lambda t: list_dot_product(h_rev[151 - t : 150], list_transform({x}[1 : t], lambda v: v - {x}[1])))"


def _filtered(name: str, source: str, channels) -> str:
    reverse = f"{source}_h AS (SELECT {source}.*, list_reverse(h.h) AS h_rev FROM {source}, h)"
    return reverse + ",\n" + _apply(name, f"{source}_h", CONVOLVE, channels)


@register("remove_dc", S.sql(S.FA, S.windows(), _apply("d", "w", DC), select=_list_stats("d")))
def remove_dc(spark, sf):
    windows = W.sliding_windows(td.short_sessions(spark, sf))
    return _window_stats(windows.withColumn("x", F.transform("x", FI.remove_dc)))


@register("tone_map", S.sql(S.FA, S.windows(), _apply("d", "w", DC), _apply("t", "d", TONE), select=_list_stats("t")))
def tone_map(spark, sf):
    windows = W.sliding_windows(td.short_sessions(spark, sf))
    return _window_stats(windows.withColumn("x", F.transform("x", lambda c: FI.tone_map(FI.remove_dc(c)))))


@register("bandpass_window", S.sql(S.FA, S.windows(), IMPULSE, _filtered("b", "w", range(4)), select=_list_stats("b")))
def bandpass_window(spark, sf):
    return _window_stats(FI.bandpass_windows(W.sliding_windows(td.short_sessions(spark, sf))))


def _poly(design) -> tuple[list[float], list[float]]:
    import numpy as np

    zeros, poles, gain = signal.butterworth(*design)
    return np.real(gain * np.poly(zeros)).tolist(), np.real(np.poly(poles)).tolist()


def recursion(name: str, source: str, design, channels, order: str = "i") -> str:
    """Direct-form recursion over ``order`` from rest; columns ch0.. of ``source`` become filtered."""
    b, a = _poly(design)
    n = len(b) - 1
    zero = "[" + ", ".join(["0e0"] * n) + "]"
    xs = "[" + ", ".join(f"s.ch{c}" for c in channels) + "]"
    # State z per channel as in the transposed direct form.
    y = f"{b[0]!r} * x[c] + z[c][1]"
    nxt = lambda j: f"{b[j]!r} * x[c] - ({a[j]!r}) * ({y})" + (f" + z[c][{j + 1}]" if j < n else "")
    state = "[" + ", ".join(nxt(j) for j in range(1, n + 1)) + "]"
    m = len(channels)
    step = f"""list_transform(range(1, {m + 1}), lambda c: {y}) AS y, list_transform(range(1, {m + 1}), lambda c: {state}) AS z"""
    return f"""{name} AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS {order}, CAST([] AS DOUBLE[]) AS y, list_transform(range(0, {m}), lambda c: {zero}) AS z
  FROM (SELECT DISTINCT session_id FROM {source})
  UNION ALL
  SELECT session_id, {order}, {step} FROM (
    SELECT s.session_id, s.{order}, {xs} AS x, p.z FROM {name} p JOIN {source} s ON s.session_id = p.session_id AND s.{order} = p.{order} + 1))"""


@register("bandpass_stream", S.sql(S.FA, recursion("bs", "fa", signal.BANDPASS, range(4)),
    select="SELECT session_id, i, " + ", ".join(q(f"y[{c + 1}]", f"ch{c}", 5) for c in range(4)) + " FROM bs WHERE i >= 0"))
def bandpass_stream(spark, sf):
    out = FI.bandpass_stream(td.short_sessions(spark, sf))
    return rounded(out.drop("ts"), CH, 5)


def seeded_pass(name: str, source: str, design, channels, backward: bool) -> str:
    """One direction of a zero-phase filter: seeded with the steady state of its first sample."""
    low = design[2] == "low"
    cols = [f"ch{c}" for c in channels]
    order = "last_i - i" if backward else "i"
    shifted = f"""{name}_in AS MATERIALIZED (
  SELECT e.session_id, {order} AS j, {', '.join(f'e.{c} - f.{c} AS {c}' for c in cols)}
  FROM (SELECT *, max(i) OVER (PARTITION BY session_id) AS last_i FROM {source}) e
  JOIN (SELECT session_id, {', '.join(f'arg_{"max" if backward else "min"}({c}, i) AS {c}' for c in cols)} FROM {source} GROUP BY 1) f USING (session_id))"""
    run = recursion(f"{name}_run", f"{name}_in", design, channels, "j")
    back = f"""{name} AS MATERIALIZED (
  SELECT e.session_id, e.i, {', '.join(f"r.y[{n + 1}] + {'f.' + c if low else '0e0'} AS {c}" for n, c in enumerate(cols))}
  FROM (SELECT *, max(i) OVER (PARTITION BY session_id) AS last_i FROM {source}) e
  JOIN (SELECT session_id, {', '.join(f'arg_{"max" if backward else "min"}({c}, i) AS {c}' for c in cols)} FROM {source} GROUP BY 1) f USING (session_id)
  JOIN {name}_run r ON r.session_id = e.session_id AND r.j = {'e.last_i - e.i' if backward else 'e.i'})"""
    return f"{shifted},\n{run},\n{back}"


def zero_phase_sql(name: str, source: str, design, channels, pad: int) -> str:
    """Odd extension, forward pass, backward pass; ``name`` has i from 0 again."""
    cols = [f"ch{c}" for c in channels]
    ends = f"""{name}_e AS MATERIALIZED (
  SELECT session_id, count(*) AS n, {', '.join(f'list({c} ORDER BY i) AS {c}' for c in cols)} FROM {source} GROUP BY 1),
{name}_x AS MATERIALIZED (
  SELECT session_id, j AS i, {', '.join(
      f'CASE WHEN j < {pad} THEN 2 * {c}[1] - {c}[{pad} - j + 1] WHEN j < n + {pad} THEN {c}[j - {pad} + 1] '
      f'ELSE 2 * {c}[n] - {c}[2 * n + {pad} - 1 - j] END AS {c}' for c in cols)}
  FROM (SELECT *, unnest(range(0, n + 2 * {pad})) AS j FROM {name}_e))"""
    forward = seeded_pass(f"{name}_f", f"{name}_x", design, channels, False)
    backward = seeded_pass(f"{name}_b", f"{name}_f", design, channels, True)
    strip = f"""{name} AS MATERIALIZED (
  SELECT b.session_id, b.i - {pad} AS i, {', '.join('b.' + c for c in cols)} FROM {name}_b b JOIN {name}_e e USING (session_id)
  WHERE b.i >= {pad} AND b.i < e.n + {pad})"""
    return ",\n".join([ends, forward, backward, strip])


@register("zero_phase_high", S.sql(S.FA, zero_phase_sql("zp", "fa", signal.HIGHPASS_20, (0, 1, 2, 3), 9),
    select=f"SELECT session_id, i, {', '.join(q(c, c, 5) for c in CH)} FROM zp"))
def zero_phase_high(spark, sf):
    return rounded(FI.zero_phase(td.short_sessions(spark, sf), "high").drop("ts"), CH, 5)


@register("zero_phase_low", S.sql(S.FA, zero_phase_sql("zp", "fa", signal.LOWPASS_10, (0, 1, 2, 3), 9),
    select=f"SELECT session_id, i, {', '.join(q(c, c, 5) for c in CH)} FROM zp"))
def zero_phase_low(spark, sf):
    return rounded(FI.zero_phase(td.short_sessions(spark, sf), "low").drop("ts"), CH, 5)


BAND4 = zero_phase_sql("zp", "fa", signal.BANDPASS_4, (0, 1, 2, 3), 27)


@register("zero_phase_band", S.sql(S.FA, BAND4, select=f"SELECT session_id, i, {', '.join(q(c, c, 4) for c in CH)} FROM zp"))
def zero_phase_band(spark, sf):
    return rounded(FI.zero_phase(td.short_sessions(spark, sf), "band").drop("ts"), CH, 4)


ENVELOPE = (
    zero_phase_sql("hp", "fa", signal.HIGHPASS_20, (0, 1, 2, 3), 9),
    "lv AS MATERIALIZED (SELECT session_id, i, sqrt((ch0*ch0 + ch1*ch1 + ch2*ch2 + ch3*ch3) / 4) AS ch0 FROM hp)",
    zero_phase_sql("en", "lv", signal.LOWPASS_10, (0,), 9),
)


@register("activity_envelope", S.sql(S.FA, *ENVELOPE, select=f"SELECT session_id, i, {q('ch0', 'env', 5)} FROM en"))
def activity_envelope(spark, sf):
    return rounded(FI.activity_envelope(td.short_sessions(spark, sf)).drop("ts"), ["env"], 5)


@register("rms_across_channels", S.sql(S.FA, select="SELECT session_id, i, " + q("sqrt((ch0*ch0 + ch1*ch1 + ch2*ch2 + ch3*ch3) / 4)", "rms") + " FROM fa"))
def rms_across_channels(spark, sf):
    return td.short_sessions(spark, sf).select("session_id", "i", r(FI.rms_across_channels()).alias("rms"))


@register("moving_rms", S.sql(S.FA, select="SELECT session_id, i, " + ", ".join(
    q(f"sqrt(sum(ch{c} * ch{c}) OVER s / 150)", f"ch{c}") for c in range(4))
    + " FROM fa WINDOW s AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 75 PRECEDING AND 74 FOLLOWING)"))
def moving_rms(spark, sf):
    return rounded(FI.moving_rms(td.short_sessions(spark, sf)), CH)


AC = """ac AS MATERIALIZED (SELECT session_id, k, sqrt((""" + " + ".join(
    f"list_sum(list_transform(x{c}, lambda v: (v - list_avg(x{c})) * (v - list_avg(x{c}))))" for c in range(4)) + ") / 600) AS ac_rms FROM w)"


@register("window_ac_rms", S.sql(S.FA, S.windows(), AC, select=f"SELECT session_id, k, {q('ac_rms', 'ac_rms')} FROM ac"))
def window_ac_rms(spark, sf):
    return W.sliding_windows(td.short_sessions(spark, sf)).select("session_id", "k", r(W.window_rms()).alias("ac_rms"))


RECENT = recursion("b3", "fa", signal.BANDPASS, (3,)) + """,
rr AS MATERIALIZED (SELECT session_id, i, CASE WHEN i >= 149 THEN sqrt(avg(y[1] * y[1]) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) ELSE 0e0 END AS rms
  FROM b3 WHERE i >= 0)"""


@register("recent_rms", S.sql(S.FA, RECENT, select=f"SELECT session_id, i, {q('rms', 'rms', 5)} FROM rr"))
def recent_rms(spark, sf):
    return rounded(FI.recent_rms(FI.bandpass_stream(td.short_sessions(spark, sf), ["ch3"])), ["rms"], 5)


@register("hop_levels", S.sql(S.FA, RECENT, select=f"SELECT session_id, CAST((i - 174) // 25 AS INTEGER) AS k, i, {q('rms', 'rms', 5)} FROM rr WHERE i >= 174 AND (i - 174) % 25 = 0"))
def hop_levels(spark, sf):
    return rounded(FI.hop_levels(td.short_sessions(spark, sf)), ["rms"], 5)


# ------------------------------------------------------------------------------------ features

FLAT_DIGITS = {"var": 4, "mnp": 4}




def prepared(source: str = "w", bandpass: bool = True, reinhard: bool = True, channels=HAND_CHANNELS) -> str:
    """Band-pass, DC removal and tone map of window lists, then one row per channel: ``pc``."""
    parts, at = [], source
    if bandpass:
        parts += [IMPULSE, _filtered("fb_", at, channels)]
        at = "fb_"
    parts.append(_apply("dc_", at, DC, channels))
    at = "dc_"
    if reinhard:
        parts.append(_apply("tm_", at, TONE, channels))
        at = "tm_"
    parts.append(f"pw AS MATERIALIZED (SELECT * FROM {at})")
    union = " UNION ALL ".join(f"SELECT session_id, k, {c} AS channel, x{c} AS x FROM pw" for c in channels)
    parts.append(f"pc AS MATERIALIZED ({union})")
    return ",\n".join(parts)


TD = """td AS MATERIALIZED (SELECT *,
  list_sum(list_transform(d, lambda v: abs(v))) AS wl,
  len(list_filter(range(1, 150), lambda j: x[j] * x[j + 1] < 0 AND abs(d[j]) > 0.1e0 * rms)) AS zc,
  len(list_filter(range(1, 149), lambda j: -d[j] * d[j + 1] > (0.1e0 * rms) * (0.1e0 * rms))) AS ssc,
  list_avg(list_transform(x, lambda v: abs(v))) AS mav, list_var_pop(x) AS var, list_sum(list_transform(x, lambda v: abs(v))) AS iemg,
  len(list_filter(d, lambda v: abs(v) > 0.1e0 * rms)) AS wamp
  FROM (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 150) AS rms,
        list_transform(range(1, 150), lambda j: x[j + 1] - x[j]) AS d FROM pc)),
nf AS MATERIALIZED (SELECT session_id, k, greatest(sqrt(sum(rms * rms)), 1e-6) AS nrm FROM td GROUP BY ALL)"""

# Yule-Walker of order 4 by the Durbin recursion, one level per CTE.
AR = """ar0 AS MATERIALIZED (SELECT session_id, k, channel, list_transform(range(0, 5), lambda j: list_dot_product(x[1 : 150 - j], x[j + 1 : 150]) / 150) AS r FROM pc),
ar1 AS (SELECT *, r[2] / r[1] AS p1, r[1] * (1 - (r[2] / r[1]) * (r[2] / r[1])) AS e1 FROM ar0),
ar2 AS (SELECT *, (r[3] - p1 * r[2]) / e1 AS p2 FROM ar1),
ar2b AS (SELECT *, p1 - p2 * p1 AS b1, e1 * (1 - p2 * p2) AS e2 FROM ar2),
ar3 AS (SELECT *, (r[4] - b1 * r[3] - p2 * r[2]) / e2 AS p3 FROM ar2b),
ar3b AS (SELECT *, b1 - p3 * p2 AS c1, p2 - p3 * b1 AS c2, e2 * (1 - p3 * p3) AS e3 FROM ar3),
ar4 AS (SELECT *, (r[5] - c1 * r[4] - c2 * r[3] - p3 * r[2]) / e3 AS p4 FROM ar3b),
ar AS MATERIALIZED (SELECT session_id, k, channel, c1 - p4 * p3 AS ar1, c2 - p4 * c2 AS ar2, p3 - p4 * c1 AS ar3, p4 AS ar4 FROM ar4)"""

SPECTRUM = """basis AS MATERIALIZED (SELECT b, list_transform(range(0, 150), lambda j: cos(2 * pi() * b * j / 256)) AS co,
  list_transform(range(0, 150), lambda j: sin(2 * pi() * b * j / 256)) AS si FROM (SELECT unnest(range(0, 129)) AS b)),
ps AS MATERIALIZED (SELECT session_id, k, channel, b, b * 1000e0 / 256 AS f,
  list_dot_product(x, co) * list_dot_product(x, co) + list_dot_product(x, si) * list_dot_product(x, si) AS p FROM pc, basis),
tot AS (SELECT session_id, k, channel, sum(p) + 1e-10 AS total, arg_max(f, (p, -b)) AS pkf FROM ps GROUP BY ALL),
cum AS (SELECT ps.*, total, sum(p) OVER (PARTITION BY session_id, k, channel ORDER BY b) AS upto FROM ps JOIN tot USING (session_id, k, channel)),
sp AS MATERIALIZED (SELECT session_id, k, channel, sum(f * p) / any_value(total) AS mnf, coalesce(min(f) FILTER (upto >= total / 2), 500e0) AS mdf,
  any_value(total) / 129 AS mnp, """ + ", ".join(
    f"sum(p) FILTER (f >= {lo} AND f < {hi}) / any_value(total) AS bp{n}" for n, (lo, hi) in enumerate(POWER_BANDS)
) + """ FROM cum GROUP BY ALL),
spk AS MATERIALIZED (SELECT sp.*, pkf FROM sp JOIN tot USING (session_id, k, channel))"""

PAIRS = ((0, 1), (0, 2), (1, 2))
CROSS = "cc AS MATERIALIZED (SELECT pw.session_id, pw.k, " + ", ".join(
    f"greatest(least(list_dot_product(x{a}, x{b}) / (150 * (t{a}.rms + 1e-10) * (t{b}.rms + 1e-10)), 1e0), -1e0) AS cc_{a}{b}_corr, "
    f"ln((t{a}.rms + 1e-10) / (t{b}.rms + 1e-10)) AS cc_{a}{b}_lrms, list_dot_product(x{a}, x{b}) / 150 / (nrm * nrm) AS cc_{a}{b}_cov"
    for a, b in PAIRS) + " FROM pw JOIN nf USING (session_id, k) " + " ".join(
    f"JOIN td t{c} ON t{c}.session_id = pw.session_id AND t{c}.k = pw.k AND t{c}.channel = {c}" for c in HAND_CHANNELS) + ")"


_rounded = q


def _digits(name: str) -> int:
    return FLAT_DIGITS.get(name.split("_")[-1], 5)


def feature_sql(names: list[str], normalize: bool = True, exact: bool = False) -> str:
    """One column per feature name from the parts above, rounded unless ``exact``."""
    q = (lambda value, name, digits: f"{value} AS {name}") if exact else _rounded
    home = {}
    for key in ("rms", "wl", "zc", "ssc", "mav", "var", "iemg", "wamp"):
        home[key] = "td"
    for key in ("ar1", "ar2", "ar3", "ar4"):
        home[key] = "ar"
    for key in ("mnf", "mdf", "pkf", "mnp", "bp0", "bp1", "bp2", "bp3"):
        home[key] = "spk"
    columns, joins = [], {}
    for name in names:
        if name.startswith("cc_"):
            joins["cc"] = "JOIN cc ON cc.session_id = nf.session_id AND cc.k = nf.k"
            columns.append(q(f"cc.{name}", name, _digits(name)))
            continue
        ch, key = name.split("_")
        alias = f"{home[key]}{ch[2:]}"
        joins[alias] = f"JOIN {home[key]} {alias} ON {alias}.session_id = nf.session_id AND {alias}.k = nf.k AND {alias}.channel = {ch[2:]}"
        value = f"CAST({alias}.{key} AS DOUBLE)"
        if normalize and key in ("rms", "wl", "mav", "iemg"):
            value += " / nrm"
        columns.append(q(value, name, _digits(name)))
    return f"SELECT nf.session_id, nf.k, {', '.join(columns)} FROM nf {' '.join(joins.values())}"


FULL = FE.FeatureOptions()
NAMES = FULL.names()


def _named(features, options, names):
    table = FE.by_name(features, options, names)
    return table.select("session_id", "k", *[r(n, _digits(n)).alias(n) for n in names])


def _family(keys) -> list[str]:
    return [n for n in NAMES if not n.startswith("cc_") and n.split("_")[1] in keys]


def _all_parts(*extra: str) -> tuple[str, ...]:
    return (S.FA, S.windows(channels=HAND_CHANNELS), prepared(), TD, *extra)


@register("assemble_features", S.sql(*_all_parts(AR, SPECTRUM, CROSS), select=feature_sql(NAMES)))
def assemble_features(spark, sf):
    return _named(FE.extract_features(td.short_sessions(spark, sf)), FULL, NAMES)


@register("features_of_windows", S.sql(*_all_parts(AR, SPECTRUM, CROSS), select=feature_sql(NAMES)))
def features_of_windows(spark, sf):
    columns = [f"ch{c}" for c in HAND_CHANNELS]
    windows = W.sliding_windows(td.short_sessions(spark, sf), columns=columns)
    return _named(FE.features_of_windows(windows), FULL, NAMES)


TIME_NAMES = _family(("rms", "wl", "zc", "ssc", "mav", "var", "iemg", "wamp"))
AR_NAMES = _family(("ar1", "ar2", "ar3", "ar4"))
MOMENT_NAMES = _family(("mnf", "mdf", "pkf", "mnp"))
BAND_NAMES = _family(("bp0", "bp1", "bp2", "bp3"))
PAIR_NAMES = [n for n in NAMES if n.startswith("cc_")]


@register("td_features", S.sql(*_all_parts(), select=feature_sql(TIME_NAMES, normalize=False)))
def td_features(spark, sf):
    options = FE.FeatureOptions(normalize=False)
    return _named(FE.extract_features(td.short_sessions(spark, sf), options), options, TIME_NAMES)


@register("feature_norm", S.sql(*_all_parts(), select=feature_sql(_family(("rms", "wl", "mav", "iemg")))))
def feature_norm(spark, sf):
    return _named(FE.extract_features(td.short_sessions(spark, sf)), FULL, _family(("rms", "wl", "mav", "iemg")))


@register("ar_features", S.sql(*_all_parts(AR), select=feature_sql(AR_NAMES)))
def ar_features(spark, sf):
    return _named(FE.extract_features(td.short_sessions(spark, sf)), FULL, AR_NAMES)


@register("spectral_moments", S.sql(*_all_parts(SPECTRUM), select=feature_sql(MOMENT_NAMES)))
def spectral_moments(spark, sf):
    return _named(FE.extract_features(td.short_sessions(spark, sf)), FULL, MOMENT_NAMES)


@register("band_power", S.sql(*_all_parts(SPECTRUM), select=feature_sql(BAND_NAMES)))
def band_power(spark, sf):
    return _named(FE.extract_features(td.short_sessions(spark, sf)), FULL, BAND_NAMES)


@register("cross_channel", S.sql(*_all_parts(CROSS), select=feature_sql(PAIR_NAMES)))
def cross_channel(spark, sf):
    return _named(FE.extract_features(td.short_sessions(spark, sf)), FULL, PAIR_NAMES)


@register("power_spectrum", S.sql(*_all_parts(SPECTRUM), select=f"SELECT session_id, k, channel, CAST(b AS INTEGER) AS bin, {q('p', 'p', 2)} FROM ps"))
def power_spectrum(spark, sf):
    """All 129 bins of every window and channel."""
    spec = FE.power_spectrum(td.short_sessions(spark, sf))
    return spec.select("session_id", "k", "channel", F.posexplode("p").alias("bin", "p")).withColumn("p", r("p", 2))


DEVICE = (
    S.FA, recursion("bs", "fa", signal.BANDPASS, HAND_CHANNELS),
    "fbs AS MATERIALIZED (SELECT session_id, i, CAST(i AS DOUBLE) / 1000 AS ts, y[1] AS ch0, y[2] AS ch1, y[3] AS ch2 FROM bs WHERE i >= 0)",
    S.windows("fbs", first=25, channels=HAND_CHANNELS), prepared(bandpass=False), TD, AR, SPECTRUM, CROSS,
)


@register("device_features", S.sql(*DEVICE, select=feature_sql(NAMES)))
def device_features(spark, sf):
    """The device's phase and session-long filter."""
    features = FE.extract_features(td.short_sessions(spark, sf), continuous=True, first=25)
    return _named(features, FULL, NAMES)


RAW4 = (S.FA, S.windows(), prepared(bandpass=False, reinhard=False, channels=range(4)), TD)


@register("td4_by_channel", S.sql(*RAW4, select=f"""SELECT session_id, k, channel, {q('rms', 'rms')}, {q('wl', 'wl')},
CAST(zc AS DOUBLE) AS zc, CAST(ssc AS DOUBLE) AS ssc FROM td"""))
def td4_by_channel(spark, sf):
    return rounded(FE.td4_native(td.short_sessions(spark, sf), channels=range(4)), ["rms", "wl"])


TD4_OPTIONS = FE.FeatureOptions.td4()


@register("td4_features", S.sql(*RAW4, select=feature_sql(TD4_OPTIONS.names(), normalize=False)))
def td4_features(spark, sf):
    return _named(FE.extract_features(td.short_sessions(spark, sf), TD4_OPTIONS), TD4_OPTIONS, TD4_OPTIONS.names())


def _tumbling_sql() -> str:
    one = lambda c: f"""SELECT session_id, k, 'ch{c}' AS ch, x{c} AS x, thr{c} AS thr FROM tw JOIN lim USING (session_id)"""
    return ",\n".join([
        "zt AS MATERIALIZED (SELECT session_id, i, CAST(i AS DOUBLE) / 1000 AS ts, ch0, ch1, ch2 FROM zp)",
        "lim AS (SELECT session_id, " + ", ".join(f"sqrt(avg(ch{c} * ch{c})) AS thr{c}" for c in range(3)) + " FROM zt GROUP BY 1)",
        S.windows("zt", hop=150, channels=range(3)).replace("w AS MAT", "tw AS MAT"),
        "u AS MATERIALIZED (" + " UNION ALL ".join(one(c) for c in range(3)) + ")",
        """tt AS MATERIALIZED (SELECT session_id, k, ch, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 150) AS rms,
  list_sum(list_transform(range(1, 150), lambda j: abs(x[j + 1] - x[j]))) AS wl,
  len(list_filter(range(1, 150), lambda j: x[j] * x[j + 1] < 0 AND abs(x[j + 1] - x[j]) > 0.7e0 * thr)) AS zc,
  len(list_filter(range(2, 150), lambda j: (x[j] - x[j - 1]) * (x[j] - x[j + 1]) > 0.6e0 * thr * 0.6e0 * thr)) AS ssc FROM u)""",
    ])


@register("td4_tumbling", S.sql(S.FA, BAND4, _tumbling_sql(), select="SELECT session_id, k, " + ", ".join(
    q(f"CAST(max({key}) FILTER (ch = 'ch{c}') AS DOUBLE)", f"ch{c}_{key}", 4) for c in range(3) for key in ("rms", "wl", "zc", "ssc"))
    + " FROM tt GROUP BY ALL"))
def td4_tumbling(spark, sf):
    columns = ["ch0", "ch1", "ch2"]
    filtered = FI.zero_phase(td.short_sessions(spark, sf), "band", columns)
    out = FE.td4_tumbling(filtered, 150, columns)
    return rounded(out, [c for c in out.columns if c.startswith("ch")], 4)


def _csd_sql() -> str:
    pairs = [(a, b) for a in range(3) for b in range(a, 3)]
    bands = ((0, 62), (62, 125), (125, 187), (187, 250), (250, 375), (375, 500))
    parts = [
        """fbasis AS MATERIALIZED (SELECT b, b * 1000e0 / 150 AS f, list_transform(range(0, 150), lambda j: cos(2 * pi() * b * j / 150)) AS co,
  list_transform(range(0, 150), lambda j: sin(2 * pi() * b * j / 150)) AS si FROM (SELECT unnest(range(0, 76)) AS b))""",
        "ft AS MATERIALIZED (SELECT session_id, k, f, " + ", ".join(
            f"list_dot_product(x{c}, co) AS re{c}, list_dot_product(x{c}, si) AS im{c}" for c in range(3)) + " FROM w, fbasis)",
        "csd AS MATERIALIZED (SELECT session_id, k, " + ", ".join(
            f"sum(re{a} * re{b} + im{a} * im{b}) FILTER (f >= {lo} AND f < {hi}) / 150 AS c{n}_{a}{b}"
            for n, (lo, hi) in enumerate(bands) for a, b in pairs) + " FROM ft GROUP BY ALL)",
    ]
    columns = [
        q(f"ln(greatest(c{n}_{a}{b}, 1e-10))" if a == b else f"c{n}_{a}{b}", f"m{n}_{a}{b}", 5)
        for n in range(len(bands)) for a, b in pairs
    ]
    return S.sql(S.FA, S.windows(channels=range(3)), *parts, select="SELECT session_id, k, " + ", ".join(columns) + " FROM csd")


@register("mpf_features", _csd_sql())
def mpf_features(spark, sf):
    features = FE.cross_spectrum(td.short_sessions(spark, sf))
    names = [f"m{n}_{a}{b}" for n in range(6) for a in range(3) for b in range(a, 3)]
    return features.select("session_id", "k", *[r(F.col("f")[n], 5).alias(name) for n, name in enumerate(names)])
