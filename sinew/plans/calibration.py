"""Queries: normalisation, calibration, rest gate, splits and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinew.operators import augment as AU
from sinew.operators import calibrate as C
from sinew.operators import features as FE
from sinew.operators import filters as FI
from sinew.operators import proportional as P
from sinew.operators import split as SP
from sinew.operators import windows as W
from sinew.plans import fragments as S
from sinew.plans.catalog import q, r, register, rounded
from sinew.plans.signals import AC, RECENT
from sinew.session import settle
from sinew.sources import testdata as td

REST = "c0"


def _long(df, value="f"):
    keep = [c for c in df.columns if c != value]
    return df.select(*keep, F.posexplode(value).alias("pos", "v"))


def _vector_rows(features):
    return _long(features.select("session_id", "k", "f")).withColumn("v", r("v", 5))


@register("session_zscore", S.sql(S.CLASS_STATS, select=f"SELECT session_id, k, pos, {q('(v - mu) / sigma', 'v', 5)} FROM lf JOIN st USING (session_id, pos)"))
def session_zscore(spark, sf):
    return _vector_rows(C.session_zscore(td.vectors(spark, sf)))


PLAIN = """pl AS MATERIALIZED (SELECT session_id, pos, avg(v) AS mu, stddev_pop(v) AS sd FROM lf GROUP BY ALL)"""


@register("session_zscore_plain", S.sql(S.LONG, PLAIN, select=f"SELECT session_id, k, pos, {q('(v - mu) / (sd + 1e-8)', 'v', 5)} FROM lf JOIN pl USING (session_id, pos)"))
def session_zscore_plain(spark, sf):
    return _vector_rows(C.session_zscore(td.vectors(spark, sf), balanced=False))


@register("plot_zscore", S.sql(S.LONG, PLAIN, select=f"SELECT session_id, k, pos, {q('(v - mu) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END', 'v', 5)} FROM lf JOIN pl USING (session_id, pos)"))
def plot_zscore(spark, sf):
    return _vector_rows(C.plot_zscore(td.vectors(spark, sf)))


@register("training_stats", S.sql(S.CLASS_STATS, select=f"SELECT pos, {q('avg(mu)', 'mu_train')}, {q('avg(sigma)', 'sigma_train')} FROM st GROUP BY 1"))
def training_stats(spark, sf):
    return rounded(C.training_stats(td.vectors(spark, sf)), ["mu_train", "sigma_train"])


@register("raw_centroids", S.sql(S.CLASS_STATS, select=f"SELECT label, pos, {q('avg(mean)', 'centroid')} FROM cs GROUP BY ALL"))
def raw_centroids(spark, sf):
    return rounded(C.raw_centroids(td.vectors(spark, sf)), ["centroid"])


DELTA = f"""tr AS (SELECT pos, avg(mu) AS mu_train, avg(sigma) AS sigma_train FROM st GROUP BY 1),
dl AS (SELECT pos, mu_train - c AS delta FROM tr JOIN (SELECT pos, avg(mean) AS c FROM cs WHERE label = '{REST}' GROUP BY 1) USING (pos))"""


@register("rest_delta", S.sql(S.CLASS_STATS, DELTA, select=f"SELECT pos, {q('delta', 'delta')} FROM dl"))
def rest_delta(spark, sf):
    return rounded(C.rest_delta(td.vectors(spark, sf), REST), ["delta"])


NORMED = "nz AS MATERIALIZED (SELECT session_id, k, label, trial_id, pos, (v - mu) / sigma AS v FROM lf JOIN st USING (session_id, pos))"


@register("class_centroids", S.sql(S.CLASS_STATS, NORMED, select=f"SELECT label, pos, {q('avg(v)', 'centroid')} FROM nz GROUP BY ALL"))
def class_centroids(spark, sf):
    return rounded(C.class_centroids(C.session_zscore(td.vectors(spark, sf))), ["centroid"])


@register("fit_calibration", S.sql(S.CLASS_STATS, select=f"SELECT session_id, pos, {q('mu', 'mu')}, {q('sigma', 'sigma')} FROM st"))
def fit_calibration(spark, sf):
    fitted = C.fit_calibration(td.vectors(spark, sf))
    rows = fitted.select("session_id", F.posexplode(F.arrays_zip("mu", "sigma")).alias("pos", "s"))
    return rows.select("session_id", "pos", r("s.mu").alias("mu"), r("s.sigma").alias("sigma"))


@register("apply_calibration", S.sql(
    S.CLASS_STATS, DELTA, select=f"""SELECT session_id, k, pos, {q('CASE WHEN session_id = 4 THEN v ELSE (v - mu) / sigma_train END', 'v', 5)}
FROM lf JOIN st USING (session_id, pos) JOIN tr USING (pos)"""))
def apply_calibration(spark, sf):
    """Training deviations as scale; session 4 has no calibration and passes through."""
    features = td.vectors(spark, sf)
    scale = C.to_vectors(C.training_stats(features), [], ["sigma_train"])
    fitted = C.fit_calibration(features).filter(F.col("session_id") != 4)
    return _vector_rows(C.apply_calibration(features, fitted, scale))


@register("invert_calibration", S.sql(S.LONG, select=f"SELECT session_id, k, pos, {q('v', 'v', 5)} FROM lf"))
def invert_calibration(spark, sf):
    features = td.vectors(spark, sf)
    fitted = C.fit_calibration(features)
    return _vector_rows(C.invert_calibration(C.apply_calibration(features, fitted), fitted))


@register("calibration_residual", S.sql(
    S.CLASS_STATS, NORMED, "ct AS (SELECT label, pos, avg(v) AS c FROM nz GROUP BY ALL)",
    select=f"""SELECT session_id, label, {q('sqrt(sum((c - (mean - mu) / sigma) * (c - (mean - mu) / sigma)))', 'residual')}
FROM cs JOIN st USING (session_id, pos) JOIN ct USING (label, pos) GROUP BY ALL"""))
def calibration_residual(spark, sf):
    features = td.vectors(spark, sf)
    train = C.class_centroids(C.session_zscore(features))
    return rounded(C.calibration_residual(train, features), ["residual"])


DEVICE = f"""rs AS (SELECT session_id, pos, avg(v) AS mu, CASE WHEN var_pop(v) > 1e-12 THEN sqrt(var_pop(v)) ELSE 1e-6 END AS sd, count(*) AS n
  FROM lf WHERE label = '{REST}' GROUP BY ALL HAVING count(*) >= 10)"""


@register("device_calibration", S.sql(
    S.CLASS_STATS, DELTA, DEVICE, select=f"""SELECT session_id, pos, {q('mu + delta', 'mu')}, {q('CASE WHEN sigma_train > 1e-6 THEN sigma_train ELSE sd END', 'sigma')}
FROM rs JOIN tr USING (pos) JOIN dl USING (pos)"""))
def device_calibration(spark, sf):
    features = td.vectors(spark, sf)
    rest = features.filter(F.col("label") == REST)
    fitted = C.device_calibration(rest, C.training_stats(features), C.rest_delta(features, REST))
    return rounded(fitted, ["mu", "sigma"])


@register("device_calibration_floor", S.sql(
    S.LONG, DEVICE, select=f"""SELECT session_id, pos, {q('mu', 'mu')},
{q('greatest(sd, greatest(0.25e0 * avg(sd) OVER (PARTITION BY session_id), 1e-6))', 'sigma')} FROM rs"""))
def device_calibration_floor(spark, sf):
    rest = td.vectors(spark, sf).filter(F.col("label") == REST)
    return rounded(C.device_calibration(rest), ["mu", "sigma"])


CLIP = f"""clip AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY k) - 1 AS n FROM lf WHERE label = '{REST}'),
rc AS (SELECT session_id, pos, avg(v) AS mu, CASE WHEN stddev_pop(v) > 1e-6 THEN stddev_pop(v) ELSE 1e-6 END AS sigma FROM clip WHERE n < 20 GROUP BY ALL)"""


@register("rest_calibration", S.sql(S.LONG, CLIP, select=f"SELECT session_id, pos, {q('mu', 'mu')}, {q('sigma', 'sigma')} FROM rc"))
def rest_calibration(spark, sf):
    from sinew.ordered import chunk_of, dense_index

    rest = td.vectors(spark, sf).filter(F.col("label") == REST).withColumnRenamed("k", "at")
    clip = dense_index(rest, ["session_id"], ["at"], chunk_of("at", 4096), "k")
    return rounded(C.rest_calibration(clip, seconds=0.1), ["mu", "sigma"])


# ----------------------------------------------------------------------------------- rest gate

ENERGY = (
    S.FB, S.LABELLED, S.windows("fb"), AC,
    "el AS MATERIALIZED (SELECT ac.session_id, ac.k, lw.label, ac_rms FROM ac JOIN lw USING (session_id, k))",
)


def _energy(spark, sf):
    """One small row per window, settled: the quantiles and gates read it several times."""
    samples = td.numbered_sessions(spark, sf)
    windows = W.sliding_windows(samples).select("session_id", "k", W.window_rms().alias("ac_rms"))
    return settle(windows.join(td.labelled(samples).select("session_id", "k", "label"), ["session_id", "k"]))


GATE = """lim AS (SELECT session_id, min(ac_rms) FILTER (label = 'rest') AS lo, max(ac_rms) FILTER (label <> 'rest') AS hi,
  count(*) FILTER (label = 'rest') AS nr, count(*) FILTER (label <> 'rest') AS na FROM el GROUP BY 1),
cand AS MATERIALIZED (SELECT *, CASE WHEN j = 999 THEN hi ELSE lo + j * ((hi - lo) / 999) END AS t FROM lim, (SELECT unnest(range(0, 1000)) AS j)),
miss AS MATERIALIZED (SELECT c.session_id, c.j, c.t, c.nr, c.na, count(*) FILTER (e.label = 'rest' AND e.ac_rms > c.t) AS rm,
  count(*) FILTER (e.label <> 'rest' AND e.ac_rms <= c.t) AS am FROM cand c JOIN el e USING (session_id) GROUP BY ALL),
gate AS MATERIALIZED (SELECT session_id, arg_min(t, (rm * na + am * nr, j)) AS gate, arg_min(rm / nr, (rm * na + am * nr, j)) AS rest_miss,
  arg_min(am / na, (rm * na + am * nr, j)) AS active_miss FROM miss GROUP BY 1)"""


@register("rest_gate", S.sql(*ENERGY, GATE, select=f"SELECT session_id, {q('gate', 'gate')}, {q('rest_miss', 'rest_miss')}, {q('active_miss', 'active_miss')} FROM gate"))
def rest_gate(spark, sf):
    return rounded(C.rest_gate(_energy(spark, sf)), ["gate", "rest_miss", "active_miss"])


@register("energy_summary", S.sql(
    *ENERGY, "mx AS (SELECT session_id, max(ac_rms) AS m FROM el WHERE label = 'rest' GROUP BY 1)",
    select=f"""SELECT session_id, label, {q('quantile_cont(ac_rms, 0.05)', 'p5')}, {q('quantile_cont(ac_rms, 0.5)', 'p50')},
{q('quantile_cont(ac_rms, 0.95)', 'p95')}, {q('min(ac_rms)', 'low')}, {q('max(ac_rms)', 'high')},
label <> 'rest' AND min(ac_rms) < any_value(m) AS overlaps_rest FROM el JOIN mx USING (session_id) GROUP BY session_id, label"""))
def energy_summary(spark, sf):
    return rounded(C.energy_summary(_energy(spark, sf)), ["p5", "p50", "p95", "low", "high"])


@register("apply_rest_gate", S.sql(
    *ENERGY, GATE, select=f"""SELECT session_id, k, ac_rms < gate AS gated, CASE WHEN ac_rms < gate THEN 0e0 ELSE 0.5e0 END AS p0,
CASE WHEN ac_rms < gate THEN 1e0 ELSE 0.125e0 END AS p3 FROM el JOIN gate USING (session_id)"""))
def apply_rest_gate(spark, sf):
    from sinew.constants import GESTURES

    energy = _energy(spark, sf)
    p = F.array(*[F.lit(v) for v in (0.5, 0.125, 0.125, 0.125, 0.125)])
    gated = C.apply_rest_gate(energy.withColumn("p", p), C.rest_gate(energy), GESTURES)
    return gated.select("session_id", "k", "gated", F.col("p")[0].alias("p0"), F.col("p")[3].alias("p3"))


PHASES = """ph AS (SELECT *, CASE WHEN i >= 100 AND i < 300 THEN 'rest' WHEN i >= 400 AND i < 500 THEN 'max' END AS phase FROM rr),
cc AS MATERIALIZED (SELECT session_id, phase, count(*) AS hops, avg(rms) AS mean, min(rms) AS low, max(rms) AS high FROM ph
  WHERE phase IS NOT NULL AND (i - CASE phase WHEN 'rest' THEN 100 ELSE 400 END) % 25 = 24 GROUP BY ALL)"""


def _clip(spark, sf):
    levels = FI.recent_rms(FI.bandpass_stream(td.short_sessions(spark, sf), ["ch3"]))
    return P.calibration_clip(levels, settle=100, rest=200, peak=100)


@register("calibration_clip", S.sql(S.FA, RECENT, PHASES, select=f"SELECT session_id, phase, hops, {q('mean', 'mean', 5)}, {q('low', 'low', 5)}, {q('high', 'high', 5)} FROM cc"))
def calibration_clip(spark, sf):
    return rounded(_clip(spark, sf), ["mean", "low", "high"], 5)


@register("two_point_calibration", S.sql(
    S.FA, RECENT, PHASES, select=f"""SELECT session_id, {q("max(mean) FILTER (phase = 'rest')", 'rest_rms', 5)}, {q("max(mean) FILTER (phase = 'max')", 'max_rms', 5)},
max(mean) FILTER (phase = 'max') > 1.2e0 * max(mean) FILTER (phase = 'rest') AS valid FROM cc GROUP BY 1"""))
def two_point_calibration(spark, sf):
    return rounded(P.two_point_calibration(_clip(spark, sf)), ["rest_rms", "max_rms"], 5)


# --------------------------------------------------------------------------- splits, augmentation

TRIALS = "tz AS MATERIALIZED (SELECT session_id, CAST(y - 1995 AS BIGINT) AS trial_id, count(*) AS n FROM lw GROUP BY ALL)"


def _trials(spark, sf):
    return td.labelled_windows(spark, sf).select(
        "session_id", "k", "label", (F.col("y") - 1995).cast("long").alias("trial_id")
    )


@register("group_kfold", S.sql(
    S.FB, S.LABELLED, TRIALS,
    "od AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, session_id DESC, trial_id DESC) AS pos FROM tz)",
    """gk AS (
  SELECT CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS session_id, CAST(-1 AS BIGINT) AS trial_id, CAST(0 AS BIGINT) AS n, -1 AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
  UNION ALL
  SELECT o.pos, o.session_id, o.trial_id, o.n, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
    list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END)
  FROM gk JOIN od o ON o.pos = gk.pos + 1)""",
    select="SELECT session_id, trial_id, n, fold FROM gk WHERE pos > 0"))
def group_kfold(spark, sf):
    return SP.group_kfold(_trials(spark, sf), ["session_id", "trial_id"])


HASHED = """hs AS MATERIALIZED (SELECT trial_id, (trial_id * 2654435761) % 4294967296 AS h FROM (SELECT DISTINCT trial_id FROM vec)),
split AS MATERIALIZED (SELECT trial_id, CASE WHEN row_number() OVER (ORDER BY h, trial_id) <= ceil(0.2 * (SELECT count(*) FROM hs)) THEN 'test' ELSE 'train' END AS split FROM hs)"""


@register("group_split", S.sql(S.VECTORS, HASHED, select="SELECT trial_id, split FROM split"))
def group_split(spark, sf):
    return SP.group_shuffle_split(td.vectors(spark, sf))


@register("split_class_counts", S.sql(
    S.VECTORS, HASHED, select="""SELECT label, CAST(count_if(split = 'train') AS BIGINT) AS train, CAST(count_if(split = 'test') AS BIGINT) AS test
FROM vec JOIN split USING (trial_id) GROUP BY 1"""))
def split_class_counts(spark, sf):
    features = td.vectors(spark, sf)
    return SP.split_class_counts(features, SP.group_shuffle_split(features))


@register("shuffle_holdout", S.sql(
    S.VECTORS, "hs AS (SELECT session_id, k, ((session_id % 1048576 + k % 1048576 * 31) * 2654435761) % 4294967296 AS h FROM vec)",
    select="SELECT session_id, k, row_number() OVER (ORDER BY h, session_id, k) > floor((SELECT count(*) FROM hs) * (1 - 0.1e0)) AS holdout FROM hs"))
def shuffle_holdout(spark, sf):
    return SP.shuffle_holdout(td.vectors(spark, sf)).select("session_id", "k", "holdout")


@register("leave_one_session_out", S.sql(S.VECTORS, select="SELECT session_id AS fold, count(*) AS n FROM vec GROUP BY 1"))
def leave_one_session_out(spark, sf):
    return SP.leave_one_session_out(td.vectors(spark, sf)).groupBy("fold").agg(F.count("*").alias("n"))


@register("tile_groups", S.sql(
    S.VECTORS, select="SELECT session_id, k, label, trial_id, CAST(copy AS INTEGER) AS copy, copy = 0 AS is_real FROM vec, (SELECT unnest(range(0, 3)) AS copy)"))
def tile_groups(spark, sf):
    return AU.tile_groups(td.vectors(spark, sf).drop("f"))


LOW = 4294967295


def _mix(values: str) -> str:
    """The 32-bit mix of every item of a list."""
    for shift, factor in AU.MIX:
        step = f"xor(x, x >> {shift})"
        values = f"list_transform({values}, lambda x: {f'({step} * {factor}) & {LOW}' if factor else step})"
    return values


def _uniforms(numbers: str) -> str:
    counters = f"list_transform({numbers}, lambda j: (b + CAST(j AS UBIGINT)) & {LOW})"
    return f"list_transform({_mix(f'list_transform({_mix(counters)}, lambda x: xor(x, a))')}, lambda x: (x + 0.5e0) / 4294967296e0)"


def _word(n: int) -> str:
    return f"CAST('0x' || substr(md5(session_id || ':' || k || ':' || copy || ':42'), {8 * n + 1}, 8) AS UBIGINT)"


def copies_sql(source: str = "w", multiplier: int = 3) -> str:
    """Windows (session_id, k, x0 … x3) to ``ag``: copies 0 … ``multiplier`` − 1 with their noise."""
    square = " + ".join(f"list_sum(list_transform(x{c}, lambda v: v * v))" for c in range(4))
    noisy = ", ".join(f"list_transform(range(1, 151), lambda i: x{c}[i] * g + z[(i - 1) * 4 + {c + 1}] * (0.05e0 * lv) + 20 * (2 * few[{c + 3}] - 1)) AS y{c}" for c in range(4))
    turned = ", ".join(f"CASE WHEN copy = 0 THEN x{c} ELSE list_transform(range(0, 150), lambda i: y{c}[((i - s + 150) % 150) + 1]) END AS x{c}" for c in range(4))
    return f"""cp AS (SELECT * REPLACE (CAST(copy AS INTEGER) AS copy), {_word(0)} AS a, {_word(1)} AS b FROM (SELECT *, unnest(range(0, {multiplier})) AS copy FROM {source})),
fw AS MATERIALIZED (SELECT *, {_uniforms('[0, 1, 2, 3, 4, 5]')} AS few, {_uniforms('range(64, 1264)')} AS u FROM cp),
gn AS (SELECT *, 0.8e0 + 0.4e0 * few[1] AS g, CAST(floor(few[2] * 11) AS BIGINT) - 5 AS s,
  list_transform(range(1, 601), lambda n: sqrt(-2 * ln(u[2 * n - 1])) * cos(2 * pi() * u[2 * n])) AS z FROM fw),
lv AS (SELECT *, g * sqrt(({square}) / 600) + 1e-8 AS lv FROM gn),
ny AS (SELECT *, {noisy} FROM lv),
ag AS MATERIALIZED (SELECT * EXCLUDE (x0, x1, x2, x3, y0, y1, y2, y3, z, u, few), {turned} FROM ny)"""


@register("augment", S.sql(S.FA, S.windows(), copies_sql(), select=f"""SELECT session_id, k, copy, copy = 0 AS is_real,
{q("sqrt((" + " + ".join(f"list_sum(list_transform(x{c}, lambda v: (v - list_avg(x{c})) * (v - list_avg(x{c}))))" for c in range(4)) + ") / 600)", "ac_rms", 4)},
{q("x1[1]", "first1", 6)}, {q("x2[150]", "last2", 6)}, {q("list_sum(x0)", "sum0", 4)} FROM ag"""))
def augment(spark, sf):
    windows = W.sliding_windows(td.short_sessions(spark, sf))
    copies = AU.augment(windows)
    return copies.select(
        "session_id", "k", "copy", "is_real", r(W.window_rms(), 4).alias("ac_rms"), r(F.col("x")[1][0]).alias("first1"),
        r(F.col("x")[2][149]).alias("last2"), r(F.aggregate(F.col("x")[0], F.lit(0.0), lambda a, v: a + v), 4).alias("sum0"),
    )


@register("training_matrix")
def training_matrix(spark, sf):
    """Windows → copies → features → per-session z-score from the originals only."""
    from sinew.plans.workflows import training_matrix as build

    samples = td.numbered_sessions(spark, sf)
    keys = td.labelled(samples).select("session_id", "k", "label", (F.col("y") - 1995).alias("trial_id"))
    windows = W.sliding_windows(samples).select("session_id", "k", "x").join(keys, ["session_id", "k"])
    out = build(windows, multiplier=2)
    return out.select("session_id", "k", "copy", "label", *[r(F.col("f")[n], 4).alias(f"f{n}") for n in (0, 30, 68)])
