"""Documents whose shingle sets overlap: exact links at a Jaccard threshold, and the components they form.

Equal sets are one class; only class representatives are compared. Two sets of sizes s <= t that link
differ in at most d = (s + t) * (1 - j) / (1 + j) shingles, j being 0.6 or more. Shingles are dealt by hash into k parts, k well
above d, where k follows from a band of sizes (sets near a band's upper end are dealt for the next band
too). So linked sets agree in k - d parts at least. Empty parts say nothing and are never keys. A set with e
of them leaves out its k - d - 1 - e most frequent other keys as well, frequent over the whole table: of the keys
that two linked sets share the rarest one always stays. A set with more empty parts than that keeps all its
keys and is dealt anew with other hashes, until a deal leaves it few enough; of two linked sets, the one that
stops first stops at a deal that the other one has too. Sets that agree in a
key are chained over the smallest row of the key, never paired, and the chains' components are groups
that no link leaves.

Inside a group links are found by T-occurrence search with inverted lists: a query of n shingles needs
T = ceil(j * n) of them. By DivideSkip its longest lists are set aside, fewer than T; the short ones are
merged in order, what occurs often enough there is looked up in the long ones by binary search, and
what reaches the overlap is a link. Only sets outside the largest component so far are asked, since
a link between components has an end outside it; so a large group of near copies takes few queries. Groups
over `budget` shingles are dealt into chunks, and each pair of chunks is searched: memory of a task is
bounded and no link is lost. The links become components of the same kind.

Shingles are 64-bit hashes of `width` words (lower-case A-Z); a class is equal in two 64-bit sums and in
size. NULL and blank texts have no shingles and link with nothing, not with each other. Ids may be
repeated; a NULL id is larger than any other. Other columns are not passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import BitFilter, fresh, join_hot, saved

WIDTH = 3
#: Smallest similarity in hundredths, and the least one that the keys can serve.
PERCENT = 90
LEAST_PERCENT = 60
#: Parts beyond the largest difference, besides twice the empty parts to be expected.
SPARE = 4
#: A band of sizes ends at this multiple of its start.
BAND = 1.25
#: Shingles of one chunk of a group; a task holds two chunks.
BUDGET = 2_000_000
_ALL = (1 << 64) - 1


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes; with fewer words than `width` the whole sequence is one shingle."""
    data = W.LOWER[W.bytes_of(text)]
    h = W.hashes(data, *W.spans(data))
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(width, len(h))
    n = len(h) - k + 1
    return np.unique(W.join(h[:n], *[h[i : i + n] for i in range(1, k)]))


def upper(band: int) -> int:
    return math.floor(BAND ** (band + 1))


def bands(size: int, percent: int) -> list[int]:
    """The band of a set, and the next one if its partners reach into it; a partner is never two bands away."""
    band = max(0, int(math.log(size, BAND)) - 1)
    while upper(band) < size:
        band += 1
    most, out = size * 100 // percent, [band]
    while upper(out[-1]) < most:
        out.append(out[-1] + 1)
    return out


def differences(size: int, size_limit: int, percent: int) -> int:
    """The largest difference of a set of this size and a linked one of at most `size_limit`."""
    return (size + min(size_limit, size * 100 // percent)) * (100 - percent) // (100 + percent)


@cache
def parts(band: int, percent: int) -> int:
    """Parts for the sets of a band: more than the largest difference, by SPARE and twice the parts that its smallest sets leave empty."""
    most = differences(upper(band), upper(band), percent)
    smallest = max(1, upper(band - 1) * percent // 100) if band else 1
    k = most + SPARE
    for _ in range(4):
        k = most + SPARE + math.ceil(2 * k * math.exp(-smallest / k))
    return k


def signatures(held: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (deal, band, part, shingles in the part), and for each a tag: 64 times the number of the set's
    keys in that deal and band that may be left out, plus a number of the deal and band."""
    out, tags = [], []
    with np.errstate(over="ignore"):
        mixed = W.mix(held)
        for band in bands(len(held), percent):
            k, most = parts(band, percent), differences(len(held), upper(band), percent)
            deal, spare = 0, -1
            while spare < 0:
                at = (W.mix(held ^ np.uint64(0x5851F42D4C957F2D * (deal + 1) & _ALL)) % np.uint64(k)).astype(np.int64)
                order = np.argsort(at)
                at = at[order]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                used, sums, counts = at[first], np.add.reduceat(mixed[order], first), np.diff(np.append(first, len(at)))
                spare = k - most - 1 - (k - len(used))
                out.append(W.join(W.mix(np.full(len(used), band + 1 + (deal << 20), np.uint64)), used.astype(np.uint64), sums, counts.astype(np.uint64)))
                tags.append(np.full(len(used), 64 * max(0, spare) + len(tags) % 64))
                deal += 1
    return np.concatenate(out), np.concatenate(tags)


def _sums(held: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets of one size apart."""
    with np.errstate(over="ignore"):
        out = np.array([W.mix(held).sum(dtype=np.uint64), W.mix(held ^ np.uint64(0x9E6C63D0876A9A47)).sum(dtype=np.uint64)])
    return tuple(out.view(np.int64).tolist())


def _mark(a: int, b: int, doc: int | None) -> int:
    """A hash of set and id: the smallest one of a class says whose text is read again."""
    key = np.array([a, b, -1 if doc is None else doc], dtype=np.int64).view(np.uint64)
    return int(W.join(key[:1], key[1:2], key[2:]).view(np.int64)[0])


def _described(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Per row: row, doc_id, sign (hash of the text), n, a, b (sums of the set), mark, and its signatures with their tags."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                held = shingles(text.as_py(), width)
                a, b = _sums(held)
                sigs, tags = signatures(held, percent) if len(held) else ([], [])
                out.append((len(held), a, b, _mark(a, b, doc), np.asarray(sigs, np.uint64).view(np.int64), np.asarray(tags, np.int32)))
            columns = zip(*out, strict=True) if out else [[]] * 6
            types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                ["row", "doc_id", "sign", "n", "a", "b", "mark", "sigs", "tags"],
            )

    text = F.col(text_col).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("sign"), text.alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, sign long, n long, a long, b long, mark long, sigs array<long>, tags array<int>")


def _postings(sets: DataFrame, first: BitFilter, some: BitFilter | None = None) -> DataFrame:
    """(row, sig, tag) of the rows that may stand for their class, and of keys that may be in ``some``.

    The lists of keys, the bulk of the table, are filtered where they lie and not shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsigned = lambda column: column.to_numpy(zero_copy_only=False).view(np.uint64)
        for batch in batches:
            batch = batch.filter(pa.array(first.has(unsigned(batch.column(1)))))
            sigs, tags = batch.column(2).flatten(), batch.column(3).flatten()
            rows = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            out = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), sigs, tags], ["row", "sig", "tag"])
            yield out if some is None else out.filter(pa.array(some.has(unsigned(sigs))))

    return sets.select("row", F.xxhash64("row").alias("place"), "sigs", "tags").mapInArrow(run, "row long, sig long, tag int")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of edges (x, y): the smallest node that each one reaches.

    Each round gives a node the smallest label next to it and then that label's own label, so paths
    shrink geometrically. A round's labels are written.
    """
    both = saved(edges.filter("x <> y").select("x", "y").unionByName(edges.filter("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = saved(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        lower = saved(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        # A root may learn from its members as well as they from it.
        offered = lower.filter("root < was").groupBy(F.col("was").alias("node")).agg(F.min("root").alias("offer"))
        lower = lower.join(offered, "node", "left").select("node", "was", F.least("root", "offer").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = lower.join(jump, "root", "left").select("node", "was", F.least("root", "further").alias("root"))
        labels = saved(jumped)
        if labels.filter("root <> was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


class Forest:
    """Components of the sets in one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.size = np.ones(n, dtype=np.int64)

    def link(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[a]))
        if len(roots) > 1:
            total = self.size[roots].sum()
            self.root[np.isin(self.root, roots)] = roots[0]
            self.size[roots] = 0
            self.size[roots[0]] = total


class Lists:
    """Inverted lists of some sets, each in ascending order of set number."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, self.starts, self.lengths = np.unique(tokens[order], return_index=True, return_counts=True)

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Sets whose Jaccard similarity with the query reaches the threshold."""
        n = len(query)
        need = -(-percent * n // 100)
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens))]
        at = at[np.isin(self.tokens[at], query)]
        if len(at) < need:
            return np.zeros(0, np.int64)
        lengths = self.lengths[at]
        order = np.argsort(lengths, kind="stable")
        # DivideSkip: the more lists are set aside, the fewer entries are merged and the more candidates are probed.
        aside = min(need - 1, int(need / (0.1 * math.log2(max(2, int(lengths.max()))) + 1)))
        short, long_ = at[order[: len(order) - aside]], at[order[len(order) - aside :]]
        merged = np.sort(np.concatenate([self.owner[self.starts[k] : self.starts[k] + self.lengths[k]] for k in short]))
        found, overlap = np.unique(merged, return_counts=True)
        able = (overlap >= need - aside) & (self.sizes[found] * 100 >= percent * n) & (n * 100 >= percent * self.sizes[found])
        found, overlap = found[able], overlap[able]
        for seen, k in enumerate(long_):
            if not len(found):
                break
            entries = self.owner[self.starts[k] : self.starts[k] + self.lengths[k]]
            place = np.searchsorted(entries, found)
            overlap = overlap + (entries[np.minimum(place, len(entries) - 1)] == found)
            left = overlap + (len(long_) - seen - 1) >= need
            found, overlap = found[left], overlap[left]
        return found[100 * overlap >= percent * (self.sizes[found] + n - overlap)]


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the number of its component's first set."""
    forest, lists = Forest(len(sets)), Lists(sets)
    waiting = np.ones(len(sets), dtype=bool)
    while True:
        largest = int(forest.size.argmax())
        open_ = np.flatnonzero(waiting & ((forest.root != largest) | (forest.size[largest] == 1)))
        if not len(open_):
            return forest.root
        for k in open_[: max(1, len(open_) // 8)]:
            if forest.size[forest.root[k]] == 1 or forest.root[k] != forest.size.argmax():
                forest.link(int(k), lists.search(sets[k], percent))
                waiting[k] = False


def _links(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, width: int, percent: int, budget: int) -> DataFrame:
    """Links as edges between classes; groups has (node, root, n, a, b, mark) of the classes to compare."""
    sizes = groups.groupBy("root").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members"))
    sizes = saved(sizes.withColumn("chunks", F.ceil(F.col("total") / budget).cast("int")))
    dealt = join_hot(groups, sizes, "root", "members").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # Every two chunks meet once; a chunk meets itself where it meets another one.
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: (o != F.col("chunk")) | (F.col("chunks") == 1))
    cells = F.transform(others, lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))
    dealt = dealt.select("node", "root", "a", "b", "mark", cells.alias("cells"))
    wanted = BitFilter(groups, "mark")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = shingles(text.as_py(), width)
                a, b = _sums(held)
                mark = _mark(a, b, doc)
                if wanted.has(np.array([mark]).view(np.uint64))[0]:
                    for column, x in zip(out, (a, b, mark, held.tobytes()), strict=True):
                        column.append(x)
            types = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["a", "b", "mark", "held"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(keep, "a long, b long, mark long, held binary")
    ready = rows.join(dealt, ["a", "b", "mark"]).select("node", "root", "held", F.explode("cells").alias("c")).select("node", "root", "held", "c.i", "c.j")

    def search(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)  # a row that repeats id and text comes twice
        held = table.column("held")
        root = linked([np.frombuffer(held[int(k)].as_py(), dtype=np.uint64) for k in first], percent)
        moved = root != np.arange(len(root))
        return pa.table({"x": nodes[moved], "y": nodes[root][moved]})

    return ready.groupBy("root", "i", "j").applyInArrow(search, "x long, y long")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, budget: int) -> DataFrame:
    """Per row: row, doc_id, sign, n, component_id, first."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"a similarity between {LEAST_PERCENT} and 100 hundredths is needed: {percent}")
    rows = saved(_described(docs, id_col, text_col, width, percent))
    sets = rows.filter("n > 0")
    same = ["a", "b", "n"]
    classes = sets.groupBy(*same).agg(
        F.min("row").alias("node"), F.min("mark").alias("mark"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    classes = saved(classes)
    first = BitFilter(classes.select(F.xxhash64("node").alias("place")), "place")
    shared = _postings(sets, first).groupBy("sig").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("members"))
    shared = saved(shared.filter("members > 1"))
    postings = saved(_postings(sets, first, BitFilter(shared, "sig")))
    near = join_hot(postings, shared, "sig", "members")
    # Copies that the filter let through; the hub is none, being the smallest row with its set.
    near = near.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    # Keys that other sets lack are the rarest ones and are not here: what may go is the most frequent of the others.
    common = Window.partitionBy("row", "tag").orderBy(F.col("members").desc(), "sig")
    near = near.withColumn("k", F.row_number().over(common)).filter(F.col("k") > F.floor(F.col("tag") / 64))
    reach = components(near.select(F.col("row").alias("x"), F.col("hub").alias("y")))
    groups = saved(reach.join(classes, "node").select("node", "root", "n", "a", "b", "mark"))
    found = components(saved(_links(docs, groups, id_col, text_col, width, percent, budget)))
    named = saved(classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ends = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ends, "root").withColumn("key", F.xxhash64(*same))
    # Of the component's rows with the smallest id, the one with the smallest number stays.
    named = saved(named.select("key", F.col("a").alias("_a"), F.col("b").alias("_b"), "root", "component_id", "copies"))
    full = join_hot(sets.withColumn("key", F.xxhash64(*same)), named, "key", "copies").filter("a = _a AND b = _b")
    full = full.select("row", "doc_id", "sign", "n", "component_id", "root")
    candidates = full.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    firsts = candidates.groupBy("root").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    alone = rows.filter("n = 0").select("row", "doc_id", "sign", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    full = saved(full).join(firsts, "row", "left").withColumn("first", F.coalesce("first", F.lit(False))).drop("root")
    return full.unionByName(alone)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, budget: int = BUDGET
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id of its component), first (true for one row of each component)."""
    found = _components(docs, id_col, text_col, width, percent, budget)
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "first")


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, budget: int = BUDGET
) -> DataFrame:
    """One row of each component with all its columns: one with the smallest id. Rows without words stay."""
    found = _components(docs, id_col, text_col, width, percent, budget).filter("n > 0")
    key, sign, own = fresh(docs, "_id", "_sign", "_sign_of_row")
    keys = found.groupBy(F.col("doc_id").alias(key), F.col("sign").alias(sign)).agg(F.max("first").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    touched = saved(keys.filter("NOT _first OR _rows > 1"))
    rows = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(sign))
    out = rows.join(touched.select(key, sign), same, "left_anti")
    again = touched.filter("_first").select(key, sign)  # rows that repeat id and text: one of them
    if not again.isEmpty():
        out = out.unionByName(rows.join(again, same, "left_semi").dropDuplicates([id_col, own]))
    return out.drop(own)
