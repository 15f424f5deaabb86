"""Queries: parsing text logs and deriving tables from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinew.operators import events as E
from sinew.plans import fragments as S
from sinew.plans.catalog import q, r, register
from sinew.sources import lines as LN
from sinew.sources import testdata as td


def _raw_lines(spark, sf):
    """Sample lines with every 50th cut after its second field and every 70th a status message."""
    whole = F.concat_ws(",", *[F.col(f"ch{c}").cast("string") for c in range(4)])
    cut = F.concat_ws(",", F.col("ch0").cast("string"), F.col("ch1").cast("string"))
    line = (
        F.when(F.col("i") % 70 == 69, F.lit('{"status":"info","msg":"ok"}')).when(F.col("i") % 50 == 49, cut)
        .when(F.col("i") % 90 == 89, "").when(F.col("i") % 110 == 109, "1,2,x,4").otherwise(F.concat(F.lit(" "), whole, F.lit(" ")))
    )
    return td.short_sessions(spark, sf).select("session_id", "i", line.alias("line"))


GOOD = "i % 70 <> 69 AND i % 50 <> 49 AND i % 90 <> 89 AND i % 110 <> 109"


@register("parse_samples", S.sql(S.FA, select=f"SELECT session_id, i, ch0, ch1, ch2, ch3 FROM fa WHERE {GOOD}"))
def parse_samples(spark, sf):
    return LN.parse_samples(_raw_lines(spark, sf))


@register("parse_quality", S.sql(S.FA, select=f"SELECT session_id, count_if({GOOD}) AS parsed, count_if(NOT ({GOOD})) AS rejected FROM fa GROUP BY 1")
          .replace("count_if(i", "CAST(count_if(i").replace("109) AS parsed", "109) AS BIGINT) AS parsed")
          .replace("count_if(NOT", "CAST(count_if(NOT").replace("109)) AS rejected", "109)) AS BIGINT) AS rejected"))
def parse_quality(spark, sf):
    return LN.parse_quality(_raw_lines(spark, sf))


@register("skip_telemetry", S.sql(S.FA, select="SELECT session_id, i FROM fa WHERE i % 70 <> 69 AND (i % 50 = 49 OR i % 90 <> 89)"))
def skip_telemetry(spark, sf):
    return LN.skip_telemetry(_raw_lines(spark, sf)).select("session_id", "i")


@register("parse_predictions", S.sql(S.EVENTS, select=f"""SELECT session_id, k,
CASE WHEN event_type = 'error' THEN 'status' ELSE 'prediction' END AS kind,
CASE WHEN event_type = 'click' THEN 'fist' WHEN event_type = 'view' THEN 'open' END AS gesture,
CASE WHEN event_type = 'click' THEN {q('value')} WHEN event_type = 'view' THEN 0e0 END AS conf,
CASE WHEN event_type = 'click' THEN k ELSE -1 END AS t_ms, CASE WHEN event_type = 'error' THEN 'info' END AS status
FROM ev WHERE event_type IN ('click', 'view', 'error')"""))
def parse_predictions(spark, sf):
    e = F.col("event_type")
    line = (
        F.when(e == "click", F.format_string('{"gesture":"fist","conf":%s,"t_ms":%d}', F.col("value").cast("string"), F.col("k")))
        .when(e == "view", F.lit('{"gesture":"open"}'))
        .when(e == "error", F.lit('{"status":"info","msg":"ready"}'))
        .when(e == "purchase", F.lit('{"gesture":"fist","conf'))
        .otherwise(F.lit('{"other":1}'))
    )
    rows = td.event_rows(spark, sf).select("session_id", "k", line.alias("line"))
    out = LN.parse_predictions(rows).drop("msg")
    return out.withColumn("conf", r("conf")).withColumn("t_ms", F.coalesce("t_ms", F.lit(-1)))


def _command_lines(spark, sf):
    e, k = F.col("event_type"), F.col("k") % 3
    start = F.when(k == 0, "start").when(k == 1, "start_predict").otherwise("start_laptop_predict")
    name = (
        F.when(e == "signup", "connect").when(e == "click", start).when(e == "view", "stop")
        .when(e == "purchase", "calibrate").otherwise("disconnect")
    )
    line = F.when(F.col("k") % 17 == 16, F.concat(F.lit('{"command": "'), name, F.lit('"}'))).when(
        k == 2, F.concat(F.lit('{"cmd":"'), name, F.lit('_now"}'))
    ).otherwise(F.concat(F.lit('{"cmd" :   "'), name, F.lit('"}')))
    return td.event_rows(spark, sf).select("session_id", "k", line.alias("line"))


COMMANDS = S.EVENTS + """,
cm AS MATERIALIZED (SELECT session_id, k, CASE WHEN k % 17 = 16 THEN NULL ELSE CASE event_type WHEN 'signup' THEN 'connect' WHEN 'view' THEN 'stop' WHEN 'purchase' THEN 'calibrate'
  WHEN 'error' THEN 'disconnect' WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'start_predict' ELSE 'start_laptop_predict' END END END AS cmd FROM ev)"""


@register("parse_commands", S.sql(COMMANDS, select="SELECT session_id, k, cmd FROM cm"))
def parse_commands(spark, sf):
    return LN.parse_commands(_command_lines(spark, sf))


SPELLINGS = ("rest", "FIST", "open", "hook_em", "THUMBS_UP", "hook-em", "wave")
MEANT = ("rest", "fist", "open", "hook_em", "thumbs_up", "none", "none")


@register("parse_gesture_commands", S.sql(S.EVENTS, select="SELECT session_id, k, CASE k % 7 " + " ".join(
    f"WHEN {n} THEN '{g}'" for n, g in enumerate(MEANT)) + " END AS gesture FROM ev"))
def parse_gesture_commands(spark, sf):
    names = F.array(*[F.lit(s) for s in SPELLINGS])
    line = F.concat(F.lit('{"gesture": "'), F.get(names, (F.col("k") % 7).cast("int")), F.lit('"}'))
    return LN.parse_gesture_commands(td.event_rows(spark, sf).select("session_id", "k", line.alias("line")))


STATES = COMMANDS + """,
fsm AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS cmd, 'IDLE' AS state FROM cm WHERE k = 0
  UNION ALL
  SELECT c.session_id, c.k, c.cmd, CASE WHEN c.cmd IS NULL THEN f.state WHEN c.cmd = 'connect' THEN 'CONNECTED' WHEN f.state = 'IDLE' THEN 'IDLE'
    WHEN c.cmd = 'disconnect' THEN 'IDLE'
    WHEN f.state = 'CONNECTED' THEN CASE c.cmd WHEN 'start' THEN 'STREAMING' WHEN 'start_predict' THEN 'PREDICTING'
      WHEN 'start_laptop_predict' THEN 'LAPTOP_PREDICT' WHEN 'calibrate' THEN 'CALIBRATING' ELSE 'CONNECTED' END
    WHEN c.cmd = 'stop' THEN 'CONNECTED' ELSE f.state END
  FROM fsm f JOIN cm c ON c.session_id = f.session_id AND c.k = f.k + 1)"""


@register("device_state_timeline", S.sql(STATES, select="SELECT session_id, k, cmd, state FROM fsm WHERE k >= 0"))
def device_state_timeline(spark, sf):
    return E.device_state_timeline(LN.parse_commands(_command_lines(spark, sf)))


def _readings(spark, sf, drop: bool):
    samples = td.short_sessions(spark, sf)
    values = F.array(*[F.col(f"ch{c}") for c in range(4)])
    rows = samples.select("session_id", "i", F.posexplode(values).alias("channel", "value")).select(
        "session_id", (F.col("i") * 4 + F.col("channel")).alias("seq"), "channel", "value"
    )
    return rows.filter(F.col("seq") % 13 != 5) if drop else rows


@register("assemble_scans", S.sql(S.FA, select="SELECT session_id, i, ch0, ch1, ch2, ch3 FROM fa"))
def assemble_scans(spark, sf):
    return E.assemble_scans(_readings(spark, sf, False))


@register("assemble_channels", S.sql(
    S.FA,
    "rd AS MATERIALIZED (SELECT session_id, i * 4 + c AS seq, c, CASE c WHEN 0 THEN ch0 WHEN 1 THEN ch1 WHEN 2 THEN ch2 ELSE ch3 END AS v"
    " FROM fa, (SELECT unnest(range(0, 4)) AS c) WHERE (i * 4 + c) % 13 <> 5)",
    "rn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM rd)",
    """fold AS (
  SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, 0 AS mask, false AS emit, [0e0, 0e0, 0e0, 0e0] AS latest FROM rn WHERE n = 1
  UNION ALL
  SELECT r.session_id, r.n, r.seq,
    CASE WHEN (CASE WHEN emit THEN 0 ELSE mask END | (1 << CAST(r.c AS INTEGER))) = 15 THEN 15 ELSE CASE WHEN emit THEN 0 ELSE mask END | (1 << CAST(r.c AS INTEGER)) END,
    (CASE WHEN emit THEN 0 ELSE mask END | (1 << CAST(r.c AS INTEGER))) = 15,
    list_transform(range(0, 4), lambda j: CASE WHEN j = r.c THEN r.v ELSE latest[j + 1] END)
  FROM fold f JOIN rn r ON r.session_id = f.session_id AND r.n = f.n + 1)""",
    select="SELECT session_id, seq, latest[1] AS ch0, latest[2] AS ch1, latest[3] AS ch2, latest[4] AS ch3 FROM fold WHERE emit"))
def assemble_channels(spark, sf):
    """Readings with every 13th lost, so scans are incomplete and shift."""
    return E.assemble_channels(_readings(spark, sf, True))


@register("quantise_counts", S.sql(S.FA, select="""SELECT session_id, i, CAST(round_even(least(greatest((ch0 - 10) * 2.5e0, 0e0), 65535e0), 0) AS INTEGER) AS a,
CAST(round_even(least(greatest(ch1 * 1000e0, 0e0), 65535e0), 0) AS INTEGER) AS b FROM fa"""))
def quantise_counts(spark, sf):
    return td.short_sessions(spark, sf).select(
        "session_id", "i", E.quantise_counts((F.col("ch0") - 10) * 2.5).alias("a"), E.quantise_counts(F.col("ch1") * 1000.0).alias("b")
    )


DAY = 86_400_000_000


@register("gap_report", S.sql(S.EVENTS, select=f"""SELECT session_id, gap_start, ts_us AS gap_end, ts_us - gap_start AS gap FROM (
SELECT *, lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us) AS gap_start FROM ev) WHERE ts_us - gap_start > {DAY}"""))
def gap_report(spark, sf):
    return E.gap_report(td.event_rows(spark, sf), "ts_us", DAY, width=DAY / 4)


# -------------------------------------------------------------------------------- feature dumps


def _dump_lines(spark, sf):
    """Feature vectors written as dump lines: 81 numbers each, some cut, some malformed, with marks."""
    f = F.col("f")
    values = F.slice(F.concat(f, f), 1, 81)
    n = F.col("k")
    text = F.concat_ws(",", F.transform(values, lambda v: v.cast("string")))
    cut = F.concat_ws(",", F.transform(F.slice(values, 1, 80), lambda v: v.cast("string")))
    bad = F.concat(text, F.lit("x"))
    body = F.when(n % 7 == 6, cut).when(n % 11 == 10, bad).otherwise(text)
    line = F.when(n % 97 == 50, "#PARITY_BEGIN").when(n % 97 == 90, F.lit("#PARITY_END 9")).when(
        n % 13 == 12, F.concat(F.lit("CMEAN,"), text)
    ).when(n % 13 == 11, F.concat(F.lit("CSTD,"), text)).otherwise(F.concat_ws(",", F.lit("H"), n, n * 25 + 149, body))
    return td.vectors(spark, sf).select("session_id", n.alias("n"), line.alias("line"))


DUMP = S.VECTORS + """,
dl AS MATERIALIZED (SELECT session_id, k AS n, (f || f)[1:81] AS v,
  CASE WHEN k % 97 = 50 THEN 'B' WHEN k % 97 = 90 THEN 'E' WHEN k % 13 = 12 THEN 'M' WHEN k % 13 = 11 THEN 'S' WHEN k % 7 = 6 OR k % 11 = 10 THEN 'X' ELSE 'H' END AS kind FROM vec),
sl AS MATERIALIZED (SELECT d.* FROM dl d JOIN (SELECT session_id, max(n) AS b FROM dl WHERE kind = 'B' GROUP BY 1) g USING (session_id)
  LEFT JOIN LATERAL (SELECT min(e.n) AS e FROM dl e WHERE e.session_id = d.session_id AND e.kind = 'E' AND e.n > g.b) x ON true
  WHERE d.n > g.b AND (x.e IS NULL OR d.n < x.e))"""


@register("dump_slice", S.sql(DUMP, select="SELECT session_id, n FROM sl"))
def dump_slice(spark, sf):
    return LN.dump_slice(_dump_lines(spark, sf)).select("session_id", "n")


@register("read_feature_dump", S.sql(DUMP, select=f"""SELECT session_id, n, CAST(n AS INTEGER) AS hop, n * 25 + 149 AS "end", {q('v[1]', 'f0')}, {q('v[69]', 'f68')},
{q('list_sum(v[1:69])', 'f_sum')}, {q('list_sum(v[70:74])', 'lda_sum')}, {q('list_sum(v[75:79])', 'ensemble_sum')}, {q('v[81]', 'mlp_conf')} FROM dl WHERE kind = 'H'"""))
def read_feature_dump(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    dump = LN.read_feature_dump(_dump_lines(spark, sf))
    return dump.select(
        "session_id", "n", "hop", "end", r(F.col("f")[0]).alias("f0"), r(F.col("f")[68]).alias("f68"), r(total("f")).alias("f_sum"),
        r(total("p_lda")).alias("lda_sum"), r(total("p_ensemble")).alias("ensemble_sum"), r("mlp_conf").alias("mlp_conf"),
    )


@register("read_dump_calibration", S.sql(DUMP, select=f"""SELECT session_id, {q('list_sum(arg_max(v, n) FILTER (kind = ' + "'M'" + '))', 'mu_sum')},
{q('list_sum(arg_max(v, n) FILTER (kind = ' + "'S'" + '))', 'sigma_sum')} FROM dl GROUP BY 1"""))
def read_dump_calibration(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    dump = LN.read_dump_calibration(_dump_lines(spark, sf))
    return dump.select("session_id", r(total("mu")).alias("mu_sum"), r(total("sigma")).alias("sigma_sum"))
