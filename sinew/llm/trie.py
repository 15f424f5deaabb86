"""Prefix trie of conversations: a z-fast trie whose compacted nodes are found by hashes of prefixes.

A conversation is a sequence of turns; every prefix has a 128-bit hash, a running sum of hashes of (depth, role, text).
A compacted node stands for the stretch of depths (a, b] between two branchings or ends, with one conversation that runs
through it. It is filed under the hash of its prefix at its handle: the depth in (a, b] with most trailing zero bits.

Conversations come in batches and are located by fat binary search: for each number of trailing zeros, from many to none, the one
depth of that kind within a conversation's bounds is looked up among the handles of that kind. A hit moves the lower
bound to the node's end, a miss the upper bound below the depth; a hash of every step is shuffled once for all levels.
The search ends at the exit node. Of all conversations of a batch that leave the trie at one point by the same turn one, drawn by a
hash, becomes a leaf, and points inside stretches become nodes; the others follow the new leaf's stretch to their next point.
A round halves the conversations of a group on average, so rounds grow with the logarithm of the largest group.

Sums over subtrees go up by doubling jumps along the parents; then stretches are expanded to a row per depth. Copies of a
conversation are one string with a number of members, so a group of copies of any size costs its rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinew.llm.frames import digests, stored
from sinew.ordered import Scan, chunk_of, dense_index, running

CHUNK_ROWS = 4096
BATCHES = (6, 100)  # hundredths of the conversations that are in the trie after each batch
FAMILY, SHARED = 20, 4  # conversations of one family share up to SHARED - 1 opening turns
WORD = r"[^\x20\x09-\x0D]+"


def root() -> Column:
    """The hash of the empty prefix."""
    return F.unhex(F.md5(F.lit("0,0,0,0").cast("binary")))


def fattest(low: str, high: str) -> Column:
    """The depth in (low, high] with most trailing zero bits."""
    return F.expr(f"shiftleft(-1L, length(bin({low} ^ {high})) - 1) & {high}")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c) of all conversations, and (c, d, role, text) of their turns after rebuilding, d from 1.

    Conversation c gets the first h turns of conversation c - c % 20 (fewer if it has fewer, none if there is none) and its own
    turns after its first h; h is crc32 of the decimal c mod 4. Turns go by number, nulls first, then role and text; null roles and texts
    are empty. Rows without conv_id belong to no conversation.
    """
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", empty("role"), empty("text"))
    chunk = F.coalesce(chunk_of("turn", CHUNK_ROWS), F.lit(-(1 << 62)))
    turns = stored(dense_index(rows, ["c"], ["turn", "role", "text"], chunk, "r").select("c", "r", "role", "text"), "turns")
    sizes = turns.groupBy("c").agg(F.count("*").alias("n"))
    names = sizes.select("c", (F.col("c") - F.col("c") % FAMILY).alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % SHARED).alias("h"))
    names = names.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left")
    names = names.select("c", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    opening = turns.where(F.col("r") < SHARED - 1).withColumnRenamed("c", "base")
    first = names.join(opening, "base").where("r < h").select("c", (F.col("r") + 1).alias("d"), "role", "text")
    own = turns.join(names, "c").where("r >= h").select("c", (F.col("r") - F.col("h") + F.col("taken") + 1).alias("d"), "role", "text")
    return sizes.select("c"), first.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, k, words, upto): the hash of each prefix, the words of its last turn and of all its turns."""
    low = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))
    one, two = F.xxhash64("d", "role", "text"), F.xxhash64("text", "role", "d", F.lit(3))
    rows = turns.select("c", "d", one.alias("one"), two.alias("two"), F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("words"))
    parts = {"s1": low(F.col("one")), "s2": F.shiftrightunsigned("one", 32), "s3": low(F.col("two")), "s4": F.shiftrightunsigned("two", 32), "upto": F.col("words")}
    sums = running(rows, ["c"], ["d"], chunk_of("d", CHUNK_ROWS), {name: Scan("sum", value) for name, value in parts.items()})
    return sums.select("c", "d", F.unhex(F.md5(F.concat_ws(",", "s1", "s2", "s3", "s4").cast("binary"))).alias("k"), "words", "upto")


# -------------------------------------------------------------------------------------- building

NODE = ["k", "a", "b", "rep", "parent", "above", "upto", "handle", "first", "level"]


def _filed(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Nodes (k, a, b, rep, parent, above, upto) with the hashes at their handle and at their first depth."""
    at = nodes.withColumn("f", fattest("a", "b")).withColumn("level", F.expr("length(bin(f)) - length(rtrim('0', bin(f)))"))
    handles = steps.select(F.col("c").alias("rep"), F.col("d").alias("f"), F.col("k").alias("handle"))
    firsts = steps.select(F.col("c").alias("rep"), (F.col("d") - 1).alias("a"), F.col("k").alias("first"))
    return at.join(handles, ["rep", "f"]).join(firsts, ["rep", "a"]).select(*NODE)


def locate(strings: DataFrame, nodes: DataFrame, steps: DataFrame, levels: int) -> DataFrame:
    """Fat binary search: `strings` (s, len, …) with lo, lok and low, the depth, hash and words of the deepest node that a hit led to,
    and `exit`, the node inside whose stretch the string ends or leaves, if that is the node of the last hit.

    A hit only says that a string has the node's prefix up to its handle. The search goes on from the node's end: if the string
    leaves earlier, nothing below can be hit, and one comparison at the end tells.
    """
    zero = F.lit(0).cast("long")
    now = strings.select("*", zero.alias("lo"), root().alias("lok"), zero.alias("low"), F.col("len").alias("hi"), F.lit(None).cast("binary").alias("exit"))
    for level in range(levels - 1, -1, -1):
        unit = 1 << level
        # Bounds hold one multiple of the unit at most: higher levels have dealt with their own.
        ask = F.expr(f"shiftleft(shiftright(hi, {level}), {level})")
        now = now.withColumn("ask", F.when(F.col("exit").isNull() & (ask > F.col("lo")), ask))
        hashes = steps.where(f"d & {2 * unit - 1} = {unit}").select(F.col("c").alias("s"), F.col("d").alias("ask"), F.col("k").alias("handle"))
        filed = nodes.where(F.col("level") == level).select("handle", F.col("k").alias("hit"), F.col("b").alias("hit_b"), F.col("upto").alias("hit_upto"))
        now = now.join(hashes, ["s", "ask"], "left").join(filed, "handle", "left")
        beyond = F.col("hit_b") > F.col("hi")
        moved = F.col("hit").isNotNull() & ~beyond
        # A level is a query of its own: the driver plans, and plans anew as stages end, two joins and never those of several levels.
        now = stored(now.select(
            *strings.columns,
            *[F.when(moved, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in (("lo", "hit_b"), ("lok", "hit"), ("low", "hit_upto"))],
            F.when(F.col("ask").isNotNull() & F.col("hit").isNull(), F.col("ask") - 1).otherwise(F.col("hi")).alias("hi"),
            F.when(beyond, F.col("hit")).otherwise(F.col("exit")).alias("exit"),
        ), "search")
    seen = steps.select(F.col("c").alias("s"), F.col("d").alias("lo"), F.col("k").alias("seen"))
    left = (F.col("lo") > 0) & (F.col("seen") != F.col("lok"))
    return now.join(seen, ["s", "lo"], "left").select(*strings.columns, "lo", "lok", "low", F.when(left, F.col("lok")).otherwise(F.col("exit")).alias("exit"))


_PLAIN = ["s", "len", "key", "upto"]


def _beyond(points: DataFrame, steps: DataFrame) -> DataFrame:
    """`turn`, the hash one turn beyond each point (null if the string ends there)."""
    following = steps.select(F.col("c").alias("s"), (F.col("d") - 1).alias("at"), F.col("k").alias("turn"))
    return points.join(following, ["s", "at"], "left").select(*_PLAIN, "exit", "at", "pk", "pw", "turn")


def _entries(found: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Where located strings leave the trie: (s, len, key, upto, exit, at, pk, pw, turn); `exit` is set inside a stretch."""
    step = steps.select(F.col("c").alias("s"), F.col("d").alias("next"), F.col("k").alias("turn"))
    children = nodes.select(F.col("first").alias("turn"), F.col("k").alias("child"))
    found = found.withColumn("next", F.when(F.col("exit").isNull(), F.col("lo") + 1)).join(step, ["s", "next"], "left").join(children, "turn", "left")
    found = stored(found.withColumn("exit", F.coalesce("exit", "child")).drop("child", "next"), "found")
    outside = found.where("exit IS NULL").select(*_PLAIN, "exit", F.col("lo").alias("at"), F.col("lok").alias("pk"), F.col("low").alias("pw"), "turn")
    return outside.unionByName(_inside(found.where("exit IS NOT NULL").select(*_PLAIN, "exit"), nodes, steps))


def _inside(strings: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """The same for strings that enter the stretch of the node `exit`: how far they go along with it. At its end `exit` is null."""
    own = steps.select(F.col("c").alias("s"), "d", "k", F.col("upto").alias("pw"))
    its = steps.select(F.col("c").alias("rep"), "k")
    entered = strings.join(nodes.select(F.col("k").alias("exit"), "a", "b", "rep"), "exit")
    common = entered.join(own, "s").where("d > a AND d <= least(b, len)").join(its, ["rep", "k"]).groupBy(*_PLAIN, "exit", "b").agg(F.max(F.struct("d", "k", "pw")).alias("x"))
    points = common.select(*_PLAIN, F.when(F.col("x.d") < F.col("b"), F.col("exit")).alias("exit"), F.col("x.d").alias("at"), F.col("x.k").alias("pk"), F.col("x.pw").alias("pw"))
    return _beyond(points, steps)


def _insert(points: DataFrame, nodes: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with the points and a leaf for one string of each group, and the other strings with the leaf they go along with."""
    bare = NODE[:7]
    cuts = points.where("exit IS NOT NULL").select(F.col("exit").alias("node"), "at", "pk", "pw").distinct()
    along = Window.partitionBy("node").orderBy("at")
    before = lambda c, default: F.coalesce(F.lag(c).over(along), F.col(default))
    split = cuts.join(nodes.select(F.col("k").alias("node"), "a", "rep", "parent", "above"), "node").select(
        F.col("pk").alias("k"), before("at", "a").alias("a"), F.col("at").alias("b"), "rep", before("pk", "parent").alias("parent"),
        before("pw", "above").alias("above"), F.col("pw").alias("upto"),
    )
    lowest = cuts.groupBy("node").agg(F.max(F.struct("at", "pk", "pw")).alias("x")).select(F.col("node").alias("k"), "x")
    rest = nodes.join(lowest, "k").select("k", F.col("x.at").alias("a"), "b", "rep", F.col("x.pk").alias("parent"), F.col("x.pw").alias("above"), "upto")
    chosen = points.where("turn IS NOT NULL").groupBy("turn").agg(F.min_by(F.struct("s", "len", "key", "upto", "at", "pk", "pw"), F.struct(F.xxhash64("s"), "s")).alias("x"))
    chosen = stored(chosen.select("turn", "x.*"), "leaves")
    leaves = chosen.select(F.col("key").alias("k"), F.col("at").alias("a"), F.col("len").alias("b"), F.col("s").alias("rep"), F.col("pk").alias("parent"), F.col("pw").alias("above"), "upto")
    changed = split.unionByName(rest).unionByName(leaves).select(*bare)
    nodes = nodes.join(lowest, "k", "left_anti").unionByName(_filed(changed, steps))
    others = points.where("turn IS NOT NULL").join(chosen.select("turn", F.col("s").alias("first"), F.col("key").alias("leaf")), "turn").where("s <> first")
    return nodes, others.select(*_PLAIN, F.col("leaf").alias("exit"))


def build(strings: DataFrame, steps: DataFrame, *, shares: tuple[int, ...] = BATCHES) -> DataFrame:
    """Compacted nodes below the root, from distinct `strings` (s, len, key, upto) and their `steps` (c, d, k, words, upto).

    Columns k (hash of the prefix that ends the stretch), a, b (its depths (a, b]), rep (a string through it), parent (k of the
    node at depth a), above and upto (words up to depth a and b), and the hashes it is filed under. Strings come in batches by a hash;
    `shares` are the hundredths that have come after each batch.
    """
    spark = strings.sparkSession
    strings = strings.where("len > 0").select(*_PLAIN)
    levels = strings.agg(F.coalesce(F.max("len"), F.lit(0))).first()[0].bit_length()
    nodes = spark.createDataFrame([], "k binary, a long, b long, rep long, parent binary, above long, upto long, handle binary, first binary, level int")
    place = F.pmod(F.xxhash64("key"), F.lit(100))
    for low, high in zip((0, *shares[:-1]), shares, strict=True):
        batch = strings.where((place >= low) & (place < high))
        points = stored(_entries(locate(batch, nodes, steps, levels), nodes, steps), "points")
        while True:
            nodes, others = _insert(points, nodes, steps)
            nodes, others = stored(nodes, "nodes"), stored(others, "others")
            if others.isEmpty():
                break
            points = stored(_inside(others, nodes, steps), "points")
    return nodes


# --------------------------------------------------------------------------------------- results


def upwards(nodes: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """(k, sums, least) over whole subtrees of `nodes` (k, parent, …): each round adds what stands 1, 2, 4, … levels below."""
    now = nodes.select("k", F.col("parent").alias("jump"), *sums, *least)
    while not (up := now.where("jump IS NOT NULL")).isEmpty():
        gains = up.groupBy(F.col("jump").alias("k")).agg(*[F.sum(c).alias(f"{c}_") for c in sums], *[F.min(c).alias(f"{c}_") for c in least])
        jumps = now.where("jump IS NOT NULL").select(F.col("k").alias("jump"), F.col("jump").alias("further"))
        joined = now.join(gains, "k", "left").join(jumps, "jump", "left")
        now = stored(joined.select(
            "k", F.col("further").alias("jump"), *[(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in sums],
            *[F.least(c, f"{c}_").alias(c) for c in least],
        ), "sums")
    return now.drop("jump")


def prefix_trie(names: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per distinct prefix of the conversations `names` (c) with `turns` (c, d, role, text), the root of depth 0 included.

    conv_id, the smallest member; depth; parent_conv_id, the parent's conv_id (null at the root); n_convs, members (conversations
    that start with the prefix); n_children; n_leaves, childless nodes in the subtree, itself included; saved_tokens, the sum over the
    subtree of (n_convs - 1) times words of the last turn; ends_sha256 of the ascending ids of the members that end there.
    Copies are members of the same nodes; conversations without turns end at the root; no conversations give no rows.
    """
    every = stored(prefixes(turns), "steps")
    full = every.groupBy("c").agg(F.max(F.struct("d", "k", "upto")).alias("x"))
    zero = F.lit(0).cast("long")
    members = stored(names.join(full, "c", "left").select(
        "c", F.coalesce("x.d", zero).alias("len"), F.coalesce("x.k", root()).alias("key"), F.coalesce("x.upto", zero).alias("upto")), "members")
    strings = stored(members.groupBy("len", "key", "upto").agg(F.min("c").alias("s"), F.count("*").alias("n")).select("s", "len", "key", "upto", "n"), "strings")
    steps = stored(every.join(strings.select(F.col("s").alias("c")), "c", "left_semi"), "strings-steps")
    nodes = build(strings.drop("n"), steps).select("k", "a", "b", "rep", "parent", "above", "upto")

    top = strings.agg(F.min("s").alias("rep")).where("rep IS NOT NULL").select(
        root().alias("k"), zero.alias("a"), zero.alias("b"), "rep", F.lit(None).cast("binary").alias("parent"), zero.alias("above"), zero.alias("upto"))
    nodes = top.unionByName(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "k", "left").join(strings.select(F.col("key").alias("k"), "n", "s"), "k", "left")
    nodes = stored(nodes.withColumn("n_children", F.coalesce("n_children", zero)).withColumn("n", F.coalesce("n", zero)).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "nodes")
    totals = upwards(nodes, ["n", "leaf"], ["s"]).withColumnsRenamed({"n": "n_convs", "leaf": "n_leaves", "s": "conv_id"})
    nodes = nodes.drop("n", "s", "leaf").join(totals, "k").withColumn("own", (F.col("n_convs") - 1) * (F.col("upto") - F.col("above")))
    nodes = stored(nodes, "nodes")
    nodes = nodes.join(upwards(nodes, ["own"], []).withColumnRenamed("own", "saved"), "k")
    nodes = nodes.join(totals.select(F.col("k").alias("parent"), F.col("conv_id").alias("up_id")), "parent", "left")

    ends = digests(members.select("key", "c", F.col("c").cast("string").alias("id")), ["key"], ["c"], "id", ",", "ends")
    nodes = nodes.join(ends.withColumnRenamed("key", "k"), "k", "left")
    # Depths of a stretch have the members of its end; the root is a stretch of one depth.
    rows = nodes.withColumn("depth", F.explode(F.sequence(F.least(F.col("a") + 1, "b"), "b")))
    at = steps.select(F.col("c").alias("rep"), F.col("d").alias("depth"), "words", F.col("upto").alias("so_far"))
    rows = rows.join(at, ["rep", "depth"], "left")
    bottom = F.col("depth") == F.col("b")
    spared = F.col("saved") - F.col("own") + (F.col("n_convs") - 1) * (F.col("upto") - F.coalesce("so_far", zero) + F.coalesce("words", zero))
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("a") + 1, F.col("conv_id")).otherwise(F.col("up_id")).alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", spared.alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
