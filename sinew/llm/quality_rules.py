"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

A sketch is a table of counts by logarithmic bucket (relative error below 1 %), so sketches of parts merge by adding
counts. Fences outside the quartiles, per language and source, take the place of fixed cutoffs; groups with
few documents use their language's merged sketch, and that of all documents if even that is small.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinew.llm.frames import field, fresh_name, map_texts, stored
from sinew.llm.text import SPACED_WORD, Hasher, Texts, joined, mixed, owners, per_text

WINDOW = 5
_HASH = Hasher(7)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

GAMMA = log(1.02)
SMALLEST = 1e-6  # values below are one bucket
FILES = 8  # of the table of sketches
LEAST = 100  # documents for a sketch of its own
REACH = 3.0  # quartile distances from the quartiles to the fences
#: Metrics with the smallest spread that counts as one, on their scale (logarithmic for the first two).
METRICS = {"size": 1.0, "word_length": 0.25, "symbols": 0.02, "dup_lines": 0.1, "repeats": 0.05}
_LOGARITHMIC = ("size", "word_length")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(texts: Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word, by text."""
    data, at = texts.data, texts.offsets
    starts, ends, first = texts.words(SPACED_WORD)
    member = SPACED_WORD[data]
    in_words = np.concatenate([[0], np.cumsum(member)])
    sums = lambda flags: per_text(flags, at) if len(data) else np.zeros(len(texts), np.int64)
    chars, symbols = sums(member & (data & 0xC0 != 0x80)), sums(_SYMBOL[data])
    begin, finish, line_first = texts.lines()
    worded = in_words[finish] > in_words[begin]
    line_owner = owners(line_first)[worded]
    own = _HASH.ranges(data, begin[worded], finish[worded]) ^ mixed(line_owner.astype(np.uint64))
    n_lines = np.bincount(line_owner, minlength=len(texts))
    _, kept = np.unique(own, return_index=True)
    dup = n_lines - np.bincount(line_owner[kept], minlength=len(texts))
    words = _HASH.ranges(data, starts, ends)
    owner = owners(first)
    grams = joined(words, WINDOW)
    valid = np.flatnonzero(owner[: len(grams)] == owner[WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
    key = grams[valid] ^ mixed(owner[valid].astype(np.uint64))
    order = np.argsort(key)
    ordered = key[order]
    twice = np.zeros(len(order), bool)
    same = ordered[1:] == ordered[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    depth = np.zeros(len(words) + 1, np.int32)
    found = valid[order[twice]]
    np.add.at(depth, found, 1)
    np.add.at(depth, found + WINDOW, -1)
    repeated = per_text(np.cumsum(depth)[:-1] > 0, first) if len(words) else np.zeros(len(texts), np.int64)
    return [np.diff(first), chars, symbols, dup, repeated, n_lines]


def measured(docs: DataFrame, text: str, *, keep: list[str] | None = None, names: tuple[str, ...] = _COUNTS) -> DataFrame:
    return map_texts(docs, text, lambda t, _: [c.astype(np.int64) for c in counts(t)], [field(n, T.LongType()) for n in names], keep=keep)


def metric(name: str, count: dict[str, Column]) -> Column:
    """Value of a metric; null where it has no meaning."""
    words, chars, lines = count["n_words"], count["word_chars"], count["n_lines"]
    value = {
        "size": words.cast("double"),
        "word_length": F.try_divide(chars, words),
        "symbols": F.try_divide(count["n_symbols"], chars),
        "dup_lines": F.try_divide(count["n_dup_lines"], lines),
        "repeats": F.try_divide(count["n_repeat_words"], words),
    }[name]
    return F.when(words > 0, value)


def bucket(value: Column) -> Column:
    return F.when(value.isNotNull(), F.ceil(F.log(F.greatest(value, F.lit(SMALLEST))) / GAMMA)).cast("int")


def bucket_value(number: Column) -> Column:
    """The middle of a bucket; 0 for the bucket of the smallest values."""
    least = -int(-log(SMALLEST) / GAMMA)
    return F.when(number <= least, 0.0).otherwise(F.exp((number - 0.5) * GAMMA))


def sketches(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """Counts (by, metric, bucket, n): the sketch of every group and metric."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(v).alias("bucket")) for m, v in values.items()])
    return rows.select(*by, F.explode(cells).alias("c")).select(*by, "c.metric", "c.bucket").where("bucket IS NOT NULL").groupBy(*by, "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def _cells(only: Column | None = None) -> Column:
    """A group's buckets in order, as an array: at most a few hundred for each metric."""
    cell = F.struct("bucket", "n")
    return F.array_sort(F.collect_list(cell if only is None else F.when(only, cell)))


def _quantile(cells: Column, total: Column, share: float) -> Column:
    """Middle of the first bucket that the share of all values reaches; null without values."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("found"))

    def step(a: Column, c: Column) -> Column:
        upto = a["upto"] + c["n"]
        return F.struct(upto.alias("upto"), F.coalesce(a["found"], F.when(upto >= total * share, c["bucket"])).alias("found"))

    return bucket_value(F.aggregate(cells, start, step, lambda a: a["found"]))


def _total(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["n"])


def quantiles(sketch: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, metric, n, a column for each share) from sketches."""
    gathered = sketch.groupBy(*by, "metric").agg(_cells().alias("cells")).withColumn("n", _total(F.col("cells")))
    return gathered.select(*by, "metric", "n", *[_quantile(F.col("cells"), F.col("n"), q).alias(name) for name, q in shares.items()])


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, low and high fence of every metric): REACH quartile distances, of the metric's least spread or more, outside the quartiles."""
    gathered = sketch.groupBy(*by).agg(*[_cells(F.col("metric") == m).alias(m) for m in METRICS])
    quartiles = gathered.select(*by, _total(F.col("size")).alias("n"), *[
        _quantile(F.col(m), _total(F.col(m)), q).alias(f"{m}_{name}") for m in METRICS for name, q in (("q1", 0.25), ("q3", 0.75))
    ])
    columns = []
    for m, least in METRICS.items():
        q1, q3 = F.col(f"{m}_q1"), F.col(f"{m}_q3")
        if m in _LOGARITHMIC:
            q1, q3 = F.log(F.greatest(q1, F.lit(SMALLEST))), F.log(F.greatest(q3, F.lit(SMALLEST)))
        spread = F.greatest(q3 - q1, F.lit(least)) * REACH
        low, high = (F.exp(q1 - spread), F.exp(q3 + spread)) if m in _LOGARITHMIC else (q1 - spread, q3 + spread)
        columns += [low.alias(f"{m}_low"), high.alias(f"{m}_high")]
    return quartiles.select(*by, "n", *columns)


def thresholds(rows: DataFrame, values: dict[str, Column], least: int = LEAST) -> DataFrame:
    """(lang, source, fences) for every group of `rows`, each from the smallest sketch with `least` documents."""
    sketch = stored(sketches(rows, ["lang", "source"], values), "sketches", files=FILES)
    own, lang, every = fences(sketch, ["lang", "source"]), fences(merged(sketch, ["lang"]), ["lang"]), fences(merged(sketch.withColumn("all", F.lit(1)), ["all"]), ["all"])
    names = [c for c in own.columns if c not in ("lang", "source", "n")]
    lang = lang.select(F.col("lang").alias("of_lang"), F.col("n").alias("lang_n"), *[F.col(c).alias(f"lang_{c}") for c in names])
    overall = every.first()  # one row
    join = own.join(lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    last = {c: F.lit(None if overall is None else overall[c]).cast("double") for c in names}
    pick = [F.when(F.col("n") >= least, F.col(c)).when(F.col("lang_n") >= least, F.col(f"lang_{c}")).otherwise(last[c]).alias(c) for c in names]
    return join.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *pick)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", *, least: int = LEAST) -> DataFrame:
    """(key, counts, base_failed, kept) for every row.

    Base rule: fewer than 10 words, or over 20 % of them in repeated 5-word windows. Other rows are kept if all metrics lie
    within the fences of their language and source; null languages and sources are groups of their own. A null text is an
    empty one. Repeated rows stay; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = stored(measured(rows, "text", keep=["key", "lang", "source"]), "measured")
    count = {c: F.col(c) for c in _COUNTS}
    values = {m: metric(m, count) for m in METRICS}
    limits = stored(thresholds(rows, values, least), "fences", files=FILES)
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.lit(True)
    for m, v in values.items():
        inside = inside & F.coalesce(v.between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return out.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"))


def filtered(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The kept rows with all their columns; rows with equal keys and texts share a verdict."""
    mark = fresh_name(docs.columns, "row_hash")
    marked = docs.withColumn(mark, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    verdicts = judged(marked, mark, text, lang, source, **options).where("kept").select(F.col(mark).alias("kept_row")).distinct()
    return marked.join(verdicts, F.col(mark) == F.col("kept_row"), "left_semi").drop(mark)
