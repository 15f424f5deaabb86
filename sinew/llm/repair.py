"""Cheapest repair of conversations: rank-convergence parallel Viterbi over chunks of rows.

A conversation is repaired by edits until the initials of its roles read `(s?(ua)+)?`. Every row gets a code of one
byte (initial of the role, fault); the costs to finish from each of four grammar states, backwards over the codes, are
a min-plus product. Rows are cut into chunks. All chunks are run at once from the same speculative vector at their end,
and keep the vector of every row. Fix-up passes then give a chunk the vector that its successor found at its start and
run again from the end until a row's vector differs from the kept one only by a constant: all rows before it stay right.
Passes end when every chunk started from its successor's vector, so the stitched costs are exact at any chunk length.

Tracing needs vectors only up to a constant. Each chunk is traced from all four states, the maps from entry to exit
state are chained along the conversation, and the chunks are traced from the states they are really entered with.

States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinew.llm.frames import digests, stored
from sinew.ordered import chunk_of, dense_index, with_neighbours

CHUNK_ROWS = 128  # rows of one step; a conversation of any length is many steps
INSERT, DELETE, REROLE, UNFINISHED = 5, 2, 1, 5
WORDLESS = r"[^\x20\x09-\x0D]"
_NONE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
#: A code is 4 times the initial's class (s, u, a, another, none at all) plus the fault; the last one fills chunks up.
_PAD = 20
_BIG = 1000
_LETTERS = np.array(["D", "K", "R"])
_FORCED = np.array([2, 2, 3, 2])  # the state after an inserted or reroled row
#: Costs to finish without further rows.
_FINISH = np.array([0, 2 * INSERT, INSERT, 0], np.int16)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state by code, edit (delete, keep, rerole) and state."""
    #: (state, class of the initial): next state
    follow = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
    cost = np.full((_PAD + 1, 3, 4), _BIG, np.int16)
    after = np.tile(np.arange(4), (_PAD + 1, 3, 1))
    cost[_PAD, 1] = 0
    for code in range(_PAD):
        initial, fault = divmod(code, 4)
        cost[code, 0] = DELETE
        if fault in (_BLANK, _DUPLICATE):
            continue
        extra = UNFINISHED if fault == _TRUNCATED else 0
        for state in range(4):
            if initial == 4:
                cost[code, 1, state] = extra
            elif (state, initial) in follow:
                cost[code, 1, state], after[code, 1, state] = extra, follow[state, initial]
        cost[code, 2], after[code, 2] = REROLE + extra, _FORCED
    return cost, after


_COST, _AFTER = _tables()


def _totals(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Costs (chunks, edits, states) of each edit of one row and of all rows after it."""
    n = len(codes)
    return _COST[codes] + np.take_along_axis(following, _AFTER[codes].reshape(n, 12), axis=1).reshape(n, 3, 4)


def _closed(best: np.ndarray) -> np.ndarray:
    """Costs with up to two inserted rows before the edit."""
    c2, c3 = best[:, 2], best[:, 3]
    one, two = INSERT + c2, 2 * INSERT + c3
    opening = np.minimum(one, two)
    return np.stack([np.minimum(best[:, 0], opening), np.minimum(best[:, 1], opening), np.minimum(c2, INSERT + c3), np.minimum(c3, one)], axis=1)


def _before(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The vectors one row earlier, less their minimum."""
    out = _closed(_totals(codes, following).min(axis=1))
    out = np.where((codes == _PAD)[:, None], following, out)
    return out - out.min(axis=1, keepdims=True)


def backward(codes: np.ndarray, ends: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """Vectors (chunks, rows + 1, 4) from the vectors at the chunks' ends; with `kept`, only as far as they change."""
    n, m = codes.shape
    out = np.zeros((n, m + 1, 4), np.int16) if kept is None else kept.copy()
    out[:, m] = ends
    running = np.ones(n, bool)
    for j in range(m - 1, -1, -1):
        some = np.flatnonzero(running)
        if not len(some):
            break
        made = _before(codes[some, j], out[some, j + 1])
        if kept is not None:
            running[some] = (made != out[some, j]).any(axis=1)
        out[some, j] = made
    return out


def trace(codes: np.ndarray, vectors: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest edits from the given entry states, ASCII-least among equals.

    Gives (chunks, rows) arrays: state before the row, number of rows inserted there, edit; and the exit states.
    """
    n, m = codes.shape
    at, rows = entry.copy(), np.arange(n)
    states, inserted, edits = np.zeros((n, m), np.int8), np.zeros((n, m), np.int8), np.ones((n, m), np.int8)
    for j in range(m):
        code = codes[:, j]
        states[:, j] = at
        totals = _totals(code, vectors[:, j + 1])
        least = _closed(totals.min(axis=1))
        open_ = code != _PAD
        for _ in range(3):
            here = least[rows, at]
            delete = totals[rows, 0, at] == here
            insert = open_ & ~delete & (INSERT + least[rows, _FORCED[at]] == here)
            edit = np.where(delete, 0, np.where(totals[rows, 1, at] == here, 1, 2))
            done = open_ & ~insert
            edits[done, j] = edit[done]
            at[done] = _AFTER[code[done], edit[done], at[done]]
            at[insert] = _FORCED[at[insert]]
            inserted[insert, j] += 1
            open_ &= insert
    return states, inserted, edits, at


# ---------------------------------------------------------------------------------------- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) after damage by crc32(`conv_id:turn`) mod 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 takes `.`, `!` and `?` out, 3 repeats it, 4 gives it to the user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


KEYS = ["c", "keyless"]


def numbered(rows: DataFrame) -> DataFrame:
    """(c, keyless, r, turn, role, text): rows of each conversation numbered by turn (nulls first), then role, text and copy.

    A null conv_id is a conversation of its own. A role or text of null counts as one space.
    """
    copy = [] if "copy" in rows.columns else [F.lit(0).alias("copy")]
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    keyed = rows.select(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("keyless"), "turn", space("role"), space("text"), *(["copy"] if not copy else copy))
    chunk = F.coalesce(chunk_of("turn", 4096), F.lit(-(1 << 62)))
    return dense_index(keyed, KEYS, ["turn", "role", "text", "copy"], chunk, "r").select(*KEYS, "r", "turn", "role", "text")


def coded(rows: DataFrame) -> DataFrame:
    """(c, keyless, r, turn, initial, fault) of numbered rows: 0 none, 1 blank, 2 said before, 3 without final stop."""
    hashes = [F.xxhash64("role", "text").alias("h"), F.xxhash64("text", F.lit(7), "role").alias("g")]
    last = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    own = F.when(~F.col("text").rlike(WORDLESS), _BLANK).when(~last, _TRUNCATED).otherwise(_NONE)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).when(first == "", 4).otherwise(3)
    brief = rows.select(*KEYS, "r", "turn", *hashes, initial.alias("initial"), own.alias("own"))
    earliest = brief.groupBy(*KEYS, "h", "g").agg(F.min("r").alias("earliest"))
    fault = F.when(F.col("own") == _BLANK, _BLANK).when(F.col("r") > F.col("earliest"), _DUPLICATE).otherwise(F.col("own"))
    return brief.join(earliest, [*KEYS, "h", "g"]).select(*KEYS, "r", "turn", "initial", fault.alias("fault"))


# -------------------------------------------------------------------------------------- chunks


def _padded(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a batch of chunks side by side, and the chunks' lengths."""
    sizes = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(sizes), int(sizes.max())), _PAD, np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = codes.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def _packed(vectors: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    return [v[: n + 1].astype(np.uint8).tobytes() for v, n in zip(vectors, sizes, strict=True)]


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width + 1, 4), np.int16)
    for row, raw in zip(out, column.to_pylist(), strict=True):
        one = np.frombuffer(raw, np.uint8).reshape(-1, 4)
        row[: len(one)], row[len(one) :] = one, one[-1]
    return out


CHUNKS = "c long, keyless boolean, chunk long, codes array<int>, vectors binary"


def _with(batch: pa.RecordBatch, names: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more.values()], names=[*names, *more])


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            codes, sizes = _padded(batch.column("codes"))
            vectors = backward(codes, np.tile(_FINISH, (len(codes), 1)))
            yield _with(batch, ["c", "keyless", "chunk", "codes"], {"vectors": pa.array(_packed(vectors, sizes), pa.binary())})


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            codes, sizes = _padded(batch.column("codes"))
            kept = _unpacked(batch.column("vectors"), codes.shape[1])
            ends = np.stack([np.frombuffer(e, np.uint8) for e in batch.column("goal").to_pylist()]).astype(np.int16)
            vectors = backward(codes, ends, kept)
            yield _with(batch, ["c", "keyless", "chunk", "codes"], {"vectors": pa.array(_packed(vectors, sizes), pa.binary())})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            codes, _ = _padded(batch.column("codes"))
            vectors = _unpacked(batch.column("vectors"), codes.shape[1])
            exits = np.stack([trace(codes, vectors, np.full(len(codes), s))[3] for s in range(4)], axis=1)
            packed = (exits << (2 * np.arange(4))).sum(axis=1)
            yield _with(batch, ["c", "keyless", "chunk"], {"exits": pa.array(packed, pa.int32())})


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry states; rows come sorted by conversation and chunk."""
    current, state = None, 0
    for batch in batches:
        entries = []
        for c, keyless, chunk, exits in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if chunk == 0:
                current, state = (c, keyless), 0
            assert current == (c, keyless)
            entries.append(state)
            state = exits >> (2 * state) & 3
        yield _with(batch, ["c", "keyless", "chunk"], {"entry": pa.array(entries, pa.int32())})


EDITS = "c long, keyless boolean, chunk long, states array<int>, inserted array<int>, edits array<string>, trailing int, audit string, cost long"


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        codes, sizes = _padded(batch.column("codes"))
        vectors = _unpacked(batch.column("vectors"), codes.shape[1])
        last = batch.column("is_last").to_numpy(zero_copy_only=False)
        states, inserted, edits, left = trace(codes, vectors, batch.column("entry").to_numpy(zero_copy_only=False).astype(np.int64))
        trailing = np.where(last, np.array([0, 2, 1, 0])[left], 0)
        real = codes != _PAD
        at = np.where(inserted == 1, _FORCED[states], np.where(inserted == 2, _FORCED[_FORCED[states]], states))
        cost = (inserted * INSERT + np.where(real, np.take_along_axis(_COST[codes, :, at], edits[..., None].astype(np.int64), axis=2)[..., 0], 0)).sum(axis=1) + trailing * INSERT
        letters = _LETTERS[edits]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        spread = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[real], kind))
        audits = [
            "".join("I" * int(k) + e for k, e in zip(i[:n], w[:n], strict=True)) + "I" * int(t)
            for i, w, n, t in zip(inserted, letters, sizes, trailing, strict=True)
        ]
        yield _with(batch, ["c", "keyless", "chunk"], {
            "states": spread(states.astype(np.int32), pa.int32()),
            "inserted": spread(inserted.astype(np.int32), pa.int32()),
            "edits": spread(letters, pa.string()),
            "trailing": pa.array(trailing, pa.int32()),
            "audit": pa.array(audits),
            "cost": pa.array(cost, pa.int64()),
        })


def _start(vectors: str) -> Column:
    return F.substring(F.col(vectors), 1, 4)


def repairs(codes: DataFrame, *, size: int = CHUNK_ROWS) -> DataFrame:
    """The edits of every chunk of `size` rows: (c, keyless, chunk, states, inserted, edits, trailing, audit, cost).

    `codes` has (c, keyless, r, initial, fault) with r counting from 0 in each conversation. `inserted` is the number
    of rows put in before each row, `trailing` after the conversation's last one.
    """
    pairs = F.sort_array(F.collect_list(F.struct("r", (F.col("initial") * 4 + F.col("fault")).cast("int").alias("code"))))
    grouped = codes.groupBy(*KEYS, chunk_of("r", size).alias("chunk")).agg(pairs.alias("rows")).select(*KEYS, "chunk", F.col("rows.code").alias("codes"))
    chunks = stored(grouped.mapInArrow(_speculate, CHUNKS), "chunks")
    along = Window.partitionBy(*KEYS).orderBy("chunk")
    end = F.substring(F.col("vectors"), -4, 4)
    while True:
        goals = chunks.select(*KEYS, "chunk", end.alias("end"), F.lead(_start("vectors")).over(along).alias("goal"))
        wrong = goals.where("goal <> end").select(*KEYS, "chunk", "goal")
        if wrong.isEmpty():
            break
        linked = chunks.join(wrong, [*KEYS, "chunk"], "left")
        fixed = linked.where("goal IS NOT NULL").mapInArrow(_fix_up, CHUNKS)
        chunks = stored(linked.where("goal IS NULL").drop("goal").unionByName(fixed), "chunks")
    exits = chunks.select(*KEYS, "chunk", "codes", "vectors").mapInArrow(_exits, "c long, keyless boolean, chunk long, exits int")
    entries = exits.repartition(*KEYS).sortWithinPartitions(*KEYS, "chunk").mapInArrow(_chain, "c long, keyless boolean, chunk long, entry int")
    lasts = chunks.groupBy(*KEYS).agg(F.max("chunk").alias("last"))
    ready = chunks.join(entries, [*KEYS, "chunk"]).join(lasts, KEYS).withColumn("is_last", F.col("chunk") == F.col("last"))
    return ready.select(*KEYS, "chunk", "codes", "vectors", "entry", "is_last").mapInArrow(_trace, EDITS)


def _inserted(state: Column, count: Column) -> Column:
    """The inserted rows as lines."""
    user, assistant = F.lit("user:"), F.lit("assistant:")
    first = F.when(state == 2, assistant).otherwise(user)
    second = F.when(state == 2, user).otherwise(assistant)
    return F.when(count == 1, F.array(first)).when(count == 2, F.array(first, second)).otherwise(F.array().cast("array<string>"))


def repaired(rows: DataFrame, edits: DataFrame, *, size: int = CHUNK_ROWS) -> DataFrame:
    """(c, keyless, r, turn, edit, lines): each row's edit, with an I for every row inserted before or (at the end) after it,
    and what the repaired conversation has in its place, as lines `role:text`."""
    each = edits.select(*KEYS, "chunk", "trailing", F.posexplode(F.arrays_zip("states", "inserted", "edits")).alias("at", "e"), F.size("edits").alias("n"))
    each = each.select(
        *KEYS, (F.col("chunk") * size + F.col("at")).alias("r"), F.col("e.states").alias("state"), F.col("e.inserted").alias("inserted"), F.col("e.edits").alias("edit"),
        F.when(F.col("at") == F.col("n") - 1, F.col("trailing")).otherwise(0).alias("trailing"),
    )
    # A row stands after an odd number of inserted rows in the other phase.
    waits = F.when(F.col("inserted") == 0, F.col("state") == 2).when(F.col("inserted") == 1, F.col("state") != 2).otherwise(F.col("state") == 2)
    role = F.when(F.col("edit") == "K", F.col("role")).when(waits, F.lit("assistant")).otherwise(F.lit("user"))
    own = F.when(F.col("edit") == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(":", role, "text")))
    # Only after a system row are two rows missing at the end, after a user row one.
    tail = F.when(F.col("trailing") == 2, F.array(F.lit("user:"), F.lit("assistant:"))).when(F.col("trailing") == 1, F.array(F.lit("assistant:"))).otherwise(F.array().cast("array<string>"))
    letters = F.concat(F.repeat(F.lit("I"), F.col("inserted")), "edit", F.repeat(F.lit("I"), F.col("trailing")))
    return rows.join(each, [*KEYS, "r"]).select(*KEYS, "r", "turn", letters.alias("edit"), F.concat(_inserted(F.col("state"), F.col("inserted")), own, tail).alias("lines"))


def audited(conversations: DataFrame, rows: DataFrame | None = None, *, size: int = CHUNK_ROWS) -> DataFrame:
    """Faults and cheapest repair of every conv_id of `conversations`, of its `rows` (its own rows, if not given).

    Columns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A conversation without rows has zeros,
    an empty audit and the hash of the empty string; a null conv_id is a conversation like others; an empty table gives
    no rows. Rows of equal turn are taken by role, text and copy; repeated rows are duplicates. Other columns are not looked at.
    """
    numbers = stored(numbered(conversations if rows is None else rows), "rows")
    codes = stored(coded(numbers), "codes")
    edits = stored(repairs(codes, size=size), "edits")
    pairs = with_neighbours(codes, KEYS, "r", ["initial"], chunk_of("r", 4096))
    legal = (F.col("prev_initial") * 8 + F.col("initial")).isin(0 * 8 + 1, 1 * 8 + 2, 2 * 8 + 1)
    counts = pairs.groupBy(*KEYS).agg(
        *[F.count_if(F.col("fault") == k).alias(name) for name, k in (("blank", _BLANK), ("duplicate", _DUPLICATE), ("truncated", _TRUNCATED))],
        F.count_if(F.col("prev_initial").isNotNull() & ~legal).alias("illegal"),
    )
    turns = codes.where("turn IS NOT NULL").groupBy(*KEYS, "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy(*KEYS).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    whole = edits.groupBy(*KEYS).agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    lines = repaired(numbers, edits, size=size).where(F.size("lines") > 0).select(*KEYS, "r", F.array_join("lines", "\n").alias("line"))
    hashes = digests(lines, KEYS, ["r"], "line", "\n", "repaired_sha256")
    every = conversations.select(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("keyless")).distinct()
    out = every
    for part in (counts, gaps, whole, hashes):
        out = out.join(part, KEYS, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.when(~F.col("keyless"), F.col("c")).alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
