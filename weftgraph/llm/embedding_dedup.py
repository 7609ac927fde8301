"""Embedding near-dedup by a random-projection tree forest.

Equal vectors of a label form one class with a count, and one representative goes on. Each of ``trees`` trees
splits a label's vectors again and again at the median of their projections on a random direction,
with spill: a vector nearer to the split than ``SPILL`` standard deviations of the projected distance of a
threshold pair goes to both sides. The tops of the trees are fitted by the driver on a hashed sample of at most about
``sample`` representatives, and all vectors are routed through them. Leaves that hold more than ``leaf_limit`` vectors then are split
again in rounds: a hashed sample of each such leaf, of about ``FIT_ROWS`` vectors, is fitted by a task, and the leaf's vectors are routed
through its subtree, until leaves are small or can't be split, as when much of a leaf lies within the spill: such a leaf is a dense group, most
of whose pairs are links to be counted. So the size of other leaves doesn't grow with the table. Between rounds only ids are kept.

Members of a leaf are compared with each other; leaves that stay too large are compared as pairs of blocks, so none is too
large for a task and none is left out. Each link is verified in double precision where it is found, and counted
only in the least of the leaves that its ends share, so links are never shipped, only their counts
and, for each leaf, the joins that connect its members.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, or has
a null label, links with nothing, and is its own component; vectors of different length don't link; a
row that repeats is another vector linked with its like; rows that repeat a vec_id with different
vectors are joined to each other by it. A null vec_id is kept, has component null and no links.
Columns other than ``vec_id``, ``embedding`` and ``label`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph.components import connected_components
from weftgraph.storage import cut, scratch

#: Vectors of a fitted leaf in a sample at least, and levels of a tree at most.
LEAF_SAMPLE, LEVELS = 16, 32
SPILL = 0.4
#: Vectors of both sides of a split at most, in those of the leaf.
MOST_COPIES = 1.25
#: Vectors of a leaf on which its subtree is fitted; numbers of the driver's sample at most.
FIT_ROWS, SAMPLE_NUMBERS = 512, 8_000_000
_FORESTS: dict[int, "Forest"] = {}


def directions(seed: int, size: int) -> np.ndarray:
    """A random direction for each level."""
    d = np.random.default_rng(seed).normal(size=(size, LEVELS))
    return d / np.linalg.norm(d, axis=0)


def margin(size: int, threshold: float) -> float:
    return SPILL * float(np.sqrt(2 - 2 * threshold) / np.sqrt(size))


def fit_tree(p: np.ndarray, spill: float, leaf: float) -> dict[int, float]:
    """Medians by path (that of the root is 1) of a tree over projections (rows by levels)."""
    splits, todo = {}, [(1, np.arange(len(p)))]
    while todo:
        path, own = todo.pop()
        level = path.bit_length() - 1
        if len(own) <= max(leaf, LEAF_SAMPLE) or level >= LEVELS:
            continue
        q = p[own, level]
        at = float(np.median(q))
        left, right = own[q <= at + spill], own[q > at - spill]
        if len(left) + len(right) > MOST_COPIES * len(own):  # comparing the parts would cost no less than comparing all
            continue
        splits[path] = at
        todo += [(2 * path, left), (2 * path + 1, right)]
    return splits


def route_tree(p: np.ndarray, splits: dict[int, float], spill: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf's path and rows."""
    todo = [(1, np.arange(len(p)))]
    while todo:
        path, own = todo.pop()
        if path not in splits:
            yield path, own
            continue
        q, at = p[own, path.bit_length() - 1], splits[path]
        todo += [(2 * path, own[q <= at + spill]), (2 * path + 1, own[q > at - spill])]


def _leaf_id(*parts: object) -> int:
    text = "|".join(map(str, parts)).encode()
    return (zlib.crc32(text) << 31) ^ zlib.crc32(b"leaf" + text)


class Forest:
    """Split points of the tops of all trees."""

    def __init__(self, trees: int, threshold: float, leaf: float):
        self.trees, self.threshold, self.leaf = trees, threshold, leaf
        self.splits: dict[tuple[int, str, int], dict[int, float]] = {}

    def _projected(self, tree: int, x: np.ndarray) -> np.ndarray:
        return x @ directions(1000 * tree + x.shape[1], x.shape[1])

    def fit(self, label: str, x: np.ndarray) -> None:
        for tree in range(self.trees):
            self.splits[(tree, label, x.shape[1])] = fit_tree(self._projected(tree, x), margin(x.shape[1], self.threshold), self.leaf)

    def route(self, label: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves they are in, one entry for each."""
        rows, leaves = [], []
        for tree in range(self.trees):
            splits = self.splits.get((tree, label, x.shape[1]), {})
            for path, own in route_tree(self._projected(tree, x), splits, margin(x.shape[1], self.threshold)):
                rows.append(own)
                leaves.append(np.full(len(own), _leaf_id(tree, label, x.shape[1], path)))
        return np.concatenate(rows), np.concatenate(leaves)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and offsets of a list column without nulls."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _forest(broadcast, number: int) -> Forest:
    if number not in _FORESTS:
        _FORESTS.clear()
        _FORESTS[number] = broadcast.value
    return _FORESTS[number]


def _router(broadcast, number: int):
    """A row for each representative and leaf."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _forest(broadcast, number)
        for batch in batches:
            labels, (values, at) = batch.column(2).to_pylist(), _flat(batch.column(3))
            kinds: dict[tuple[str, int], list[int]] = {}
            for i, kind in enumerate(zip(labels, np.diff(at).tolist(), strict=True)):
                kinds.setdefault(kind, []).append(i)
            for (label, size), own in kinds.items():
                own = np.array(own)
                rows, leaves = forest.route(label, _unit(values[at[own][:, None] + np.arange(size)]))
                yield _members(batch, own[rows], leaves)

    return route


def _members(batch: pa.RecordBatch, rows: np.ndarray, leaves: np.ndarray) -> pa.RecordBatch:
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(leaves, pa.int64())], ["rep", "a", "leaf"])


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in a column, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for i, j in zip(edges, edges[1:], strict=False):
            if held and held[0].column(key)[0].as_py() != keys[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as unit vectors."""
    values, at = _flat(column.combine_chunks())
    return _unit(values.reshape(len(at) - 1, -1))


def _subtrees(threshold: float):
    """A subtree for each leaf of a sample of its vectors."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 0):
            leaf, x = table.column(0)[0].as_py(), _matrix(table.column(1))
            splits = fit_tree(x @ directions(leaf & 0x7FFFFFFF, x.shape[1]), margin(x.shape[1], threshold), LEAF_SAMPLE)
            lists = [pa.array([list(own)], pa.list_(kind)) for own, kind in ((splits, pa.int64()), (splits.values(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), *lists], ["leaf", "paths", "medians"])

    return fit


def _subrouter(threshold: float):
    """Rows of ``(rep, a, leaf, v, paths, medians)``, sorted by leaf, to a row for each representative and leaf of the subtree."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in _groups(iter([batch]), 2):
                leaf, x = table.column(2)[0].as_py(), _matrix(table.column(3))
                splits = dict(zip(table.column(4)[0].as_py(), table.column(5)[0].as_py(), strict=True))
                for path, own in route_tree(x @ directions(leaf & 0x7FFFFFFF, x.shape[1]), splits, margin(x.shape[1], threshold)):
                    yield _members(table.combine_chunks().to_batches()[0], own, np.full(len(own), _leaf_id(leaf, path)))

    return route


def compare_leaf(leaf: int, x: np.ndarray, times: np.ndarray, leaves: tuple[np.ndarray, np.ndarray], side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member the number of vectors it links with here, and the first member it is joined to.

    ``leaves``: numbers and offsets of the leaves of each member. ``side``: if given, only members of different sides are compared.
    """
    n = len(x)
    owner = np.repeat(np.arange(n), np.diff(leaves[1]))
    lower = leaves[0] < leaf
    _, code, times_ = np.unique(leaves[0][lower], return_inverse=True, return_counts=True)
    shared = times_[code] > 1
    bits = np.zeros((n, 8 * max(1, -(-int((times_ > 1).sum()) // 8))), bool)
    bits[owner[lower][shared], (np.cumsum(times_ > 1) - 1)[code[shared]]] = True
    bits = np.packbits(bits, axis=1)
    links, joined = np.zeros(n, np.int64), np.zeros((n, n), bool)
    for a in range(0, n, 256):
        near = x[a : a + 256] @ x[a:].T >= threshold
        i, j = np.nonzero(np.triu(near, 1))
        i, j = i + a, j + a
        if side is not None:
            apart = side[i] != side[j]
            i, j = i[apart], j[apart]
        for b in range(0, len(i), 8192):
            p, q = i[b : b + 8192], j[b : b + 8192]
            here = ~(bits[p] & bits[q]).any(axis=1)  # not met in a lesser leaf
            p, q = p[here], q[here]
            links += np.bincount(p, times[q], n).astype(np.int64) + np.bincount(q, times[p], n).astype(np.int64)
            joined[p, q] = joined[q, p] = True
    label = np.full(n, -1)
    for root in np.flatnonzero(joined.any(axis=1)):
        if label[root] >= 0:
            continue
        label[root], todo = root, [root]
        while todo:
            found = np.flatnonzero(joined[todo.pop()] & (label < 0))
            label[found] = root
            todo += found.tolist()
    return links, np.where(label < 0, np.arange(n), label)


def _comparer(threshold: float):
    """Rows of ``(part, leaf, p, q, rep, a, side, times, leaves, v)``, sorted by part."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 0):
            if table.num_rows < 2:
                continue
            leaf, p, q = (table.column(k)[0].as_py() for k in (1, 2, 3))
            rep, a, side, times = (table.column(k).to_numpy() for k in (4, 5, 6, 7))
            links, label = compare_leaf(leaf, _matrix(table.column(9)), times, _flat(table.column(8).combine_chunks()), side if p != q else None, threshold)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(a[at]), pa.array(links[at]), pa.array(rep[label[at]])], ["rep", "a", "links", "peer"])

    return compare


def _split_again(members: DataFrame, reps: DataFrame, threshold: float, leaf_limit: int) -> DataFrame:
    """``(rep, a, leaf)`` with leaves of more than ``leaf_limit`` members split until they are small or can't be split."""
    vectors, done = reps.select("rep", "a", "v"), None
    while True:
        sizes = members.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_limit)
        sizes = cut(sizes, "large_leaves")
        if sizes.isEmpty():
            return members if done is None else done.unionByName(members)
        large = members.join(sizes, "leaf")
        drawn = F.pmod(F.xxhash64("rep", "a", "leaf"), F.lit(1 << 30)) < F.lit(FIT_ROWS) / F.col("n") * (1 << 30)
        sample = large.where(drawn).join(vectors, ["rep", "a"]).select("leaf", "v")
        parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fitted = sample.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(_subtrees(threshold), "leaf long, paths array<long>, medians array<double>")
        fitted = cut(fitted.where(F.size("paths") > 0), "subtrees")
        stay = members.join(fitted.select("leaf"), "leaf", "left_anti")
        done = stay if done is None else done.unionByName(stay)
        if fitted.isEmpty():
            return done
        # Rows meet their subtree by an equi-join, which Spark splits where a leaf has very many of them.
        going = members.join(vectors, ["rep", "a"]).join(fitted, "leaf").select("rep", "a", "leaf", "v", "paths", "medians")
        members = cut(going.sortWithinPartitions("leaf").mapInArrow(_subrouter(threshold), "rep long, a long, leaf long"), "members")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, trees: int = 8, leaf_limit: int = 500, sample: int = 50_000) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = rows.withColumns({"a": F.xxhash64("label", "v"), "b": F.hash("v", "label")})
    classes = rows.where("good").groupBy("a", "b").agg(F.min(F.struct("vec_id", "label", "v")).alias("m"), F.count("*").alias("times"))
    reps = cut(classes.select("a", "b", "times", F.col("m.vec_id").alias("rep"), F.col("m.label").alias("label"), F.col("m.v").alias("v")), "vectors")

    total, widest = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    share = min(1.0, min(sample, SAMPLE_NUMBERS // max(1, widest or 0)) / max(1, total))
    forest = Forest(trees, threshold, leaf_limit * share)
    kinds: dict[tuple[str, int], list] = {}
    drawn = reps.where(F.pmod(F.xxhash64("a", F.lit(0)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("label", "v", "a").toArrow().sort_by("a")
    for label, v in zip(drawn.column(0).to_pylist(), drawn.column(1), strict=True):
        kinds.setdefault((label, len(v)), []).append(v.values.to_numpy(zero_copy_only=False))
    for (label, _), x in kinds.items():
        forest.fit(label, _unit(np.array(x)))
    broadcast = spark.sparkContext.broadcast(forest)
    with scratch(spark) as made:
        tops = reps.select("rep", "a", "label", "v").mapInArrow(_router(broadcast, int(broadcast._jbroadcast.id())), "rep long, a long, leaf long")
        members = cut(_split_again(cut(tops, "tops"), reps, threshold, leaf_limit), "members")
        sizes = members.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
        lists = members.groupBy("rep", "a").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
        own = reps.select("rep", "a", "v", "times").join(lists, ["rep", "a"])
        blocks = F.ceil(F.col("n") / leaf_limit).cast("int")
        placed = members.join(sizes, "leaf").withColumn("k", blocks).withColumn("side", F.pmod(F.xxhash64("a", "leaf"), F.col("k")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        p, q = F.least("side", "other"), F.greatest("side", "other")
        placed = placed.select(F.xxhash64("leaf", p, q).alias("part"), "leaf", p.alias("p"), q.alias("q"), "rep", "a", "side").join(own, ["rep", "a"])
        placed = placed.select("part", "leaf", "p", "q", "rep", "a", "side", "times", "leaves", "v")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = cut(placed.repartition(parts, "part").sortWithinPartitions("part", "rep", "a").mapInArrow(_comparer(threshold), "rep long, a long, links long, peer long"), "leaf_links")
        made.pop()  # what was found stays

    counts = found.groupBy("rep", "a").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("src"), F.col("peer").alias("dst")).distinct())
    known = reps.select("rep", "a", "b", "times").join(counts, ["rep", "a"], "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("a", "b", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    own = rows.where("good").select("vec_id", "a", "b").join(known, ["a", "b"]).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(rest).select("*", (F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id"))).alias("kept"))
