"""Text logs: sample lines, prediction and command messages, feature dumps.

Every parser is a set of column expressions on a ``line`` column, so it works on batch and
streaming text alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinew.constants import ALIASES, CHANNELS, COMMANDS, GESTURES
from sinew.ordered import Scan, running

# What counts as a number on a sample line.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
FEATURES = 69


def read_lines(spark, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def skip_telemetry(lines: DataFrame) -> DataFrame:
    """Without empty lines and JSON messages."""
    text = F.trim("line")
    return lines.filter((text != "") & ~text.startswith("{"))


def _fields() -> Column:
    return F.split(F.trim("line"), ",", -1)


def is_sample(channels: int = CHANNELS) -> Column:
    parts = _fields()
    return (F.size(parts) == channels) & F.forall(parts, lambda v: v.rlike(NUMBER))


def parse_samples(lines: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """Lines of exactly ``channels`` numbers as ``ch0..``; everything else is dropped."""
    keep = [c for c in lines.columns if c != "line"]
    parts = _fields()
    return lines.filter(is_sample(channels)).select(
        *keep, *[F.trim(F.get(parts, F.lit(c))).try_cast("double").alias(f"ch{c}") for c in range(channels)]
    )


def parse_quality(lines: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """Parsed and rejected lines per session."""
    good = is_sample(channels)
    return lines.groupBy("session_id").agg(F.count_if(good).alias("parsed"), F.count_if(~good).alias("rejected"))


def parse_predictions(lines: DataFrame) -> DataFrame:
    """Prediction rows (gesture, conf) and status rows; other lines are ignored."""
    keep = [c for c in lines.columns if c != "line"]
    message = F.from_json("line", "gesture string, conf double, t_ms bigint, status string, msg string", {"mode": "PERMISSIVE"})
    rows = lines.withColumn("_m", message)
    return rows.filter(F.col("_m.gesture").isNotNull() | F.col("_m.status").isNotNull()).select(
        *keep,
        F.when(F.col("_m.gesture").isNotNull(), "prediction").otherwise("status").alias("kind"),
        F.col("_m.gesture").alias("gesture"),
        F.when(F.col("_m.gesture").isNotNull(), F.coalesce("_m.conf", F.lit(0.0))).alias("conf"),
        F.col("_m.t_ms").alias("t_ms"),
        F.col("_m.status").alias("status"),
        F.col("_m.msg").alias("msg"),
    )


def format_predictions(rows: DataFrame) -> DataFrame:
    """Prediction rows as JSON lines."""
    fields = [F.col("gesture"), F.round("conf", 4).alias("conf")]
    if "t_ms" in rows.columns:
        fields.append(F.col("t_ms"))
    return rows.select(F.to_json(F.struct(*fields)).alias("line"))


def command_of(line: Column) -> Column:
    """Command of a line, by prefix in the fixed order; null where there is none."""
    value = F.regexp_extract(line, r'"cmd"[^:]*:[ "]*(.*)', 1)
    found = F.lit(None).cast("string")
    for name in reversed(COMMANDS):
        found = F.when(value.startswith(name), name).otherwise(found)
    return found


def parse_commands(lines: DataFrame) -> DataFrame:
    keep = [c for c in lines.columns if c != "line"]
    return lines.select(*keep, command_of(F.col("line")).alias("cmd"))


def parse_gesture_commands(lines: DataFrame, dialect: str = "model") -> DataFrame:
    """Gesture named on a line through the alias table; unknown spellings are ``none``."""
    keep = [c for c in lines.columns if c != "line"]
    name = F.regexp_extract("line", r'"gesture"[^:]*:[ "]*([^"]*)', 1)
    known = {spelling: gesture for d, spelling, gesture in ALIASES if d == dialect}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return lines.select(*keep, F.coalesce(F.try_element_at(table, name), F.lit("none")).alias("gesture"))


# ---------------------------------------------------------------------------------- feature dumps


def dump_slice(lines: DataFrame, order: str = "n", *, size: int = 65536) -> DataFrame:
    """Lines after the last begin mark up to the following end mark, per ``session_id``."""
    begins = F.col("line").startswith("#PARITY_BEGIN")
    ends = F.col("line").startswith("#PARITY_END")
    begin = lines.groupBy("session_id").agg(F.max(F.when(begins, F.col(order))).alias("_begin"))
    located = lines.join(begin, "session_id")
    end = (
        located.filter(ends & (F.col(order) > F.col("_begin")))
        .groupBy("session_id").agg(F.min(order).alias("_end"))
    )
    inside = (F.col(order) > F.col("_begin")) & (F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    return located.join(end, "session_id", "left").filter(inside).select(*lines.columns)


def read_feature_dump(lines: DataFrame, features: int = FEATURES, classes: int = len(GESTURES)) -> DataFrame:
    """``H`` lines as hop, end, features, two probability vectors, class and confidence.

    Lines with another number of values, or with a malformed one, are dropped.
    """
    keep = [c for c in lines.columns if c != "line"]
    parts = F.split(F.trim("line"), ",", -1)
    wanted = features + 2 * classes + 2
    values = F.transform(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), lambda v: F.trim(v).try_cast("double"))
    rows = lines.filter(F.trim("line").startswith("H,")).select(
        *keep,
        F.get(parts, F.lit(1)).try_cast("int").alias("hop"),
        F.get(parts, F.lit(2)).try_cast("bigint").alias("end"),
        values.alias("_v"),
    )
    good = (
        (F.size("_v") == wanted) & F.col("hop").isNotNull() & F.col("end").isNotNull()
        & F.forall("_v", lambda v: v.isNotNull())
    )
    return rows.filter(good).select(
        *keep, "hop", "end",
        F.slice("_v", 1, features).alias("f"),
        F.slice("_v", features + 1, classes).alias("p_lda"),
        F.slice("_v", features + classes + 1, classes).alias("p_ensemble"),
        F.get("_v", F.lit(wanted - 2)).cast("int").alias("mlp_class"),
        F.get("_v", F.lit(wanted - 1)).alias("mlp_conf"),
    )


def read_dump_calibration(lines: DataFrame) -> DataFrame:
    """Mean and deviation vectors (CMEAN, CSTD lines) of each dump."""
    keep = [c for c in lines.columns if c not in ("line", "n")]
    text = F.trim("line")
    parts = F.split(text, ",", -1)
    numbers = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda v: F.trim(v).try_cast("double"))
    pick = lambda mark: F.max_by(numbers, F.when(text.startswith(mark), F.col("n")))
    return (
        lines.filter(text.startswith("CMEAN") | text.startswith("CSTD"))
        .groupBy(*keep).agg(pick("CMEAN").alias("mu"), pick("CSTD").alias("sigma"))
    )
