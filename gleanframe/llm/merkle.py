"""Merkle manifest of a table: a hash tree per group of rows, one tree over the groups, and a proof for every row.

Rows become leaves, in ascending order of their id within a tree; every FANOUT neighbours make one node until
one is left. An aligned block of FANOUT ** LOCAL leaves is a partition of the manifest and hashes its own subtree.
Then the blocks swap their nodes by a butterfly: in round r the FANOUT blocks whose numbers differ in digit r
only meet, each learns the others' nodes, appends them to its proof and hashes the node above. So ancestors are
hashed by every block below them, and after the last round each block holds its whole upper proof: there is no pass
back down. Where the last subtree of a run is short, its blocks stand in for those that it lacks, so each block
sends at most once per block that a full subtree has. The subroots are leaves of a tree of the same kind.

A leaf, and what a round carries, is a hash: texts are read once and never shuffled. Positions come from one range
sort, so a tree that holds most rows is spread over all tasks. NULL in any field is hashed as such; a NULL tree
comes first; NULL ids come first; rows that repeat an id are leaves of their own, ordered by hash. An empty
table has an empty manifest. Other columns are neither read nor passed on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, once, saved

FANOUT = 8
#: Levels that one block hashes by itself: a block has FANOUT ** LOCAL leaves.
LOCAL = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each as its length in bytes and its text, or a mark for NULL."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _depth(n: Column) -> Column:
    """Levels above n leaves: digits of n - 1 in base FANOUT."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, FANOUT)))


def _positions(leaves: DataFrame) -> DataFrame:
    """Adds n (leaves of the tree) and pos (from 0, by ord and hash): one range sort, then offsets of its parts."""
    ordered = leaves.repartitionByRange("tree", F.col("ord").asc_nulls_first(), "leaf").sortWithinPartitions("tree", F.col("ord").asc_nulls_first(), "leaf")
    ordered = saved(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    # One row per tree and part. Parts are ranges, so these are no more than parts and trees together.
    runs = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "tree", "part", "held", F.sum("held").over(Window.partitionBy("tree")).alias("n"), (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    key = F.xxhash64("tree", "part")
    runs = saved(runs.select(key.alias("key"), F.col("tree").alias("_tree"), F.col("part").alias("_part"), "held", "n", "shift"))
    found = join_hot(ordered.withColumn("key", key), runs, "key", "held").filter("tree = _tree AND part = _part")
    return found.withColumn("pos", F.col("at") + F.col("shift"))


def _blocks(leaves: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Per block: tree, n, m (blocks of the tree), block, members (payload, leaf), levels (its nodes, leaves first), node (its root)."""
    size = FANOUT**LOCAL
    member = F.struct("pos", *payload, "leaf")
    blocks = _positions(leaves).groupBy("tree", "n", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))

    def above(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        runs = F.sequence(F.lit(1), F.size(last), F.lit(FANOUT))
        return F.concat(levels, F.array(F.transform(runs, lambda i: F.sha2(_joined(F.slice(last, i, FANOUT)), 256))))

    height = F.least(F.lit(LOCAL), _depth(F.col("n")))
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array(F.col("members.leaf")), above)
    blocks = once(blocks, levels=levels)
    return saved(blocks.withColumn("m", F.ceil(F.col("n") / size).cast("long")).withColumn("node", F.element_at(F.element_at("levels", -1), 1)))


def _butterfly(blocks: DataFrame) -> DataFrame:
    """Per block: tree, m, block, root (of its tree), upper (its proof above the block)."""
    state = saved(blocks.select("tree", "m", "block", "node", F.array().cast(PATH).alias("upper")))
    rounds = state.agg(F.max(_depth(F.col("m")))).first()[0] or 0
    for r in range(rounds):
        width = FANOUT**r  # blocks below one node of this level
        node, lane = F.floor(F.col("block") / width).cast("long"), F.col("block") % width
        done = F.col("m") <= width
        held = F.least(F.lit(width), F.col("m") - node * width)  # blocks below this node
        # A short subtree stands in for the blocks it lacks, where others of the run look for them.
        lanes = F.when(held == width, F.array(lane)).when(node % FANOUT == 0, F.array(lane)).otherwise(F.sequence(lane, F.lit(width - 1), held))
        sent = state.filter(~done).select(
            "*", F.floor(node / FANOUT).alias("run"), (node % FANOUT).alias("digit"), lane.alias("own"), F.explode(lanes).alias("lane")
        )
        swap = Window.partitionBy("tree", "run", "lane")
        met = sent.withColumn("met", F.array_sort(F.collect_list(F.struct("digit", "node")).over(swap))).filter("lane = own")
        side = lambda test: _joined(F.filter("met", test)["node"])
        step = F.struct(side(lambda x: x["digit"] < F.col("digit")).alias("before"), side(lambda x: x["digit"] > F.col("digit")).alias("after"))
        met = met.select("tree", "m", "block", F.sha2(_joined(F.col("met.node")), 256).alias("node"), F.concat("upper", F.array(step)).alias("upper"))
        state = saved(state.filter(done).unionByName(met))
    return state.withColumnRenamed("node", "root")


def _own_path(levels: str, place: Column) -> Column:
    """Siblings on each level of a block above the leaf at a place (from 0)."""

    def step(nodes: Column, level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(FANOUT), level)).cast("int")
        first = at - at % FANOUT
        return F.struct(_joined(F.slice(nodes, first + 1, at - first)).alias("before"), _joined(F.slice(nodes, at + 2, first + FANOUT - 1 - at)).alias("after"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _proofs(blocks: DataFrame, upper: DataFrame, payload: Sequence[str], passed_on: Sequence[str]) -> DataFrame:
    """Per leaf: tree, payload, leaf, path (siblings by level, up to the top of `upper`), and columns of `upper`."""
    rows = blocks.drop("m", "node").join(upper.select("tree", "block", "upper", *passed_on), ["tree", "block"])
    own = F.transform("members", lambda x, i: F.struct(*[x[c].alias(c) for c in (*payload, "leaf")], _own_path("levels", i).alias("path")))
    rows = rows.select("tree", "upper", *passed_on, F.explode(own).alias("x"))
    return rows.select("tree", *[f"x.{c}" for c in (*payload, "leaf")], F.concat("x.path", "upper").alias("path"), *passed_on)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", key: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row: key, leaf, subroot, root, path (siblings before and after the own node, from the leaf up), claimed.

    `changed` says what fields hold where they are to be verified, as columns over docs: `claimed` is the leaf of that
    row, and equals `leaf` where nothing differs.
    """
    now = {**{f: F.col(f) for f in fields}, **(changed or {})}
    leaf = leaf_hash([F.col(f) for f in fields])
    same = F.lit(True)
    for f in changed or {}:
        same = same & now[f].eqNullSafe(F.col(f))
    claimed = F.when(~same, leaf_hash([now[f] for f in fields]))
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))  # NULL before any value, the rest in order of bytes
    leaves = docs.select(name.alias("tree"), F.col(key).alias("ord"), leaf.alias("leaf"), claimed.alias("claimed"))
    blocks = _blocks(leaves, ["ord", "claimed"])
    lower = _butterfly(blocks)

    subroots = lower.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("ord"), F.col("root").alias("leaf"))
    tops = _blocks(subroots, ["ord"])
    top = _proofs(tops, _butterfly(tops), ["ord"], ["root"])
    weights = lower.filter("block = 0").select("tree", "m")
    top = saved(top.select(F.col("ord").alias("tree"), F.col("path").alias("rest"), F.col("root").alias("top")).join(weights, "tree"))
    upper = join_hot(lower.drop("m"), top, "tree", "m")
    upper = upper.select("tree", "block", F.concat("upper", "rest").alias("upper"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    out = _proofs(blocks, saved(upper), ["ord", "claimed"], ["subroot", "root"])
    return out.select(F.col("ord").alias(key), "leaf", "subroot", "root", "path", F.coalesce("claimed", "leaf").alias("claimed"))


def proof_text(path: str = "path") -> Column:
    """The siblings of a path as one text."""
    return _joined(F.transform(path, lambda p: F.concat(p["before"], p["after"])))


def folded(leaf: str = "claimed", path: str = "path") -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, F.col(leaf), lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def verified(rows: DataFrame) -> DataFrame:
    """A manifest with folded_root (from the claimed leaf) and verified (whether it is the root)."""
    return once(rows, folded_root=folded()).withColumn("verified", F.col("folded_root") == F.col("root"))
