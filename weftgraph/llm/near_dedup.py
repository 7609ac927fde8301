"""MinHash near-dedup by a chosen-path set similarity join.

Texts become sets of hashed word shingles. Texts with equal sets form one class, and only one
representative of a class goes on. ``trees`` independent trees branch the representatives. A tree's
first path is chosen by three of their minwise tokens. In a node of more than ``node_limit`` members all
are first compared with one leader, which joins a dense group at once (see ``_led``; nothing is lost by
it). If what isn't joined is still too large, it is split by ``branches`` minwise tokens chosen at random
for that node, down to ``depth`` levels. Members of a small node are compared exhaustively. What is still
large at the last level is compared exhaustively too, as pairs of blocks of ``node_limit``, so no task
ever holds more than two blocks of a node. A pair of similarity s shares a first path with probability
1 - (1 - s ** 3) ** trees (at 0.75 and 21 trees: 0.99999). A split keeps it with probability 1 - (1 - s) ** branches; where
all of a pair's nodes are split ``depth`` times it is 1 - (1 - s ** 3 * (1 - (1 - s) ** branches) ** depth) ** trees (0.99994; see ``recall``).

Comparison inside a node takes the full sets, of every pair: the sizes of all intersections are counted exactly, by
products of 0/1 matrices of members by shared shingles where there are many members. No sketch stands between a pair that
meets and its comparison. Each node emits the links that join its members, fewer than it has members. What is written on
the way is deleted when the links are.

Defined results: a null or blank text has no shingles, links with nothing, and is its own
component; a null doc_id has component null and is kept; rows that repeat a doc_id count as one
document that has each of their sets. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import textkernels as tk
from weftgraph.operators.graph.components import connected_components
from weftgraph.storage import cut, drop, scratch

SEPARATORS = b" \t\n\x0b\x0c\r"
SKETCH = 64
#: Tokens that choose a tree's first path: three levels of branching are taken at once.
ROOT = 3
_TABLE = tk.word_table(SEPARATORS)
_SALT = tk.mix(np.arange(1, 2 * SKETCH + 5, dtype=np.uint64))
#: Shingles of a matrix of members by shingles.
_COLUMNS = 2048
#: Documents that a task remembers to have sent.
_RECENT = 100_000


def _sketches(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SKETCH minwise values of each set (rows); rows of empty sets are zero."""
    out = np.zeros((len(at) - 1, SKETCH), np.int32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k in range(SKETCH):
            least = np.minimum.reduceat((hashes ^ _SALT[k]) * (_SALT[SKETCH + k] | np.uint64(1)), at[full])
            out[full, k] = (tk.mix(least) >> np.uint64(33)).astype(np.int32)
    return out


def _set_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of each set."""
    out = np.zeros((2, len(at) - 1), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k in range(2):
            out[k, full] = np.add.reduceat(tk.mix(hashes ^ _SALT[2 * SKETCH + k]), at[full])
    return out.view(np.int64)


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tk.blocks(batch.column(1)):
                hashes, offsets = tk.shingle_sets(data, at, _TABLE, size)
                h = _set_hashes(hashes, offsets)
                flat = pa.array(_sketches(hashes, offsets).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCH * (j - i) + 1, SKETCH, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(h[0]), pa.array(h[1]), lists],
                    ["doc_id", "n_shingles", "h1", "h2", "sketch"],
                )

    return sign


def signatures(documents: DataFrame, size: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, h1, h2, sketch)`` for each row."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signer(size), "doc_id long, n_shingles long, h1 long, h2 long, sketch array<int>"
    )


def _blocks(rows: DataFrame, mine: str, other: str, node_limit: int) -> tuple:
    """Own block and the blocks to meet, of a row whose side has ``mine`` members and meets ``other`` members."""
    k, m = (F.greatest(F.lit(1), F.ceil(F.col(c) / node_limit)).cast("int") for c in (mine, other))
    return F.pmod(F.xxhash64("rep", "h1"), k).cast("int"), F.explode(F.sequence(F.lit(0), m - 1))


def _led(large: DataFrame, fetch, percent: int, node_limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare every member of each large node with one leader: links, nodes of doubtful members, and members not linked with their number.

    Members linked with the leader are joined by it. With distance 1 - similarity, which is a metric, a member
    at more than twice the threshold's distance from the leader can't be near one that is within it. So only members
    between the two must still meet the linked ones, block by block; and all that are not linked stay in the node.
    The leader is the member of least hash, and is known by it (``lk``), so the nodes that a dense group has in many trees mostly
    share it, and a member is compared with it once.
    """
    # A table of its own: its size, not that of all nodes, says whether the texts must move to meet it.
    pairs = cut(large.select("rep", "h1", "lk").distinct(), "pairs")
    sets = cut(fetch(pairs.select("rep", "h1").distinct()), "sets")
    # The few sets of leaders are found by the same keys as all others, so sets move by their keys once, and to their leaders once.
    own = large.where(F.xxhash64("rep", "h1") == F.col("lk")).select("rep", "h1", "lk").distinct()
    leaders = sets.join(own, ["rep", "h1"]).select("lk", F.col("rep").alias("leader"), F.col("set").alias("leader_set"))
    met = pairs.join(sets, ["rep", "h1"]).join(leaders, "lk")
    common = F.size(F.array_intersect("set", "leader_set"))
    met = met.select("rep", "h1", "lk", "leader", (100 * common).alias("c"), (F.size("set") + F.size("leader_set") - common).alias("u"))
    linked, doubtful = F.col("c") >= percent * F.col("u"), F.col("c") >= (2 * percent - 100) * F.col("u")
    met = cut(met.select("rep", "h1", "lk", "leader", F.when(linked, 0).when(doubtful, 1).otherwise(2).alias("far")), "met")
    links = met.where("far = 0 and rep <> leader").select(F.col("rep").alias("src"), F.col("leader").alias("dst"))
    placed = cut(large.join(met.select("rep", "h1", "lk", "far"), ["rep", "h1", "lk"]).select("node", "rep", "h1", "far"), "placed")
    sizes = placed.groupBy("node").agg(*[F.count_if(F.col("far") == k).alias(f"n{k}") for k in range(3)]).where("n1 + n2 > 0")
    left = cut(placed.join(sizes, "node").where("far > 0 or n1 > 0"), "left")
    both, parts = left.where("far < 2 and n1 > 0"), []
    for far, mine, other in ((0, "n0", "n1"), (1, "n1", "n0")):
        own, meets = _blocks(both, mine, other, node_limit)
        rows = both.where(F.col("far") == far).select("node", "rep", "h1", own.alias("own"), meets.alias("meets"))
        pair = ("own", "meets") if far == 0 else ("meets", "own")
        parts.append(rows.select(F.xxhash64("node", F.lit("doubt"), *pair).alias("node"), "rep", "h1", F.lit(1 - far).alias("side")))
    return links, parts[0].unionByName(parts[1]), left.where("far > 0").select("node", "rep", "h1", (F.col("n1") + F.col("n2")).alias("n"))


def _nodes(reps: DataFrame, fetch, percent: int, trees: int, branches: int, depth: int, node_limit: int) -> tuple[DataFrame, DataFrame | None]:
    """``(node, rep, h1, side)`` of nodes to compare, with members of side 1 joined already; and links found on the way."""
    roots = [F.xxhash64(F.lit(t), *[F.get("sketch", F.lit(ROOT * t + k)) for k in range(ROOT)]) for t in range(trees)]
    level = reps.select(F.explode(F.array(*roots)).alias("node"), "rep", "h1")
    done = links = None
    for d in range(depth + 1):
        size = level.groupBy("node").agg(F.count("*").alias("n"), F.min(F.xxhash64("rep", "h1")).alias("lk")).where("n > 1")
        sized = cut(level.join(size, "node"), "nodes")
        small = sized.where(F.col("n") <= node_limit).select("node", "rep", "h1", F.lit(0).alias("side"))
        done = small if done is None else done.unionByName(small)
        large = sized.where(F.col("n") > node_limit)
        if large.isEmpty():
            return done, links
        if d == depth:
            break
        found, doubts, rest = _led(large, fetch, percent, node_limit)
        links = found if links is None else links.unionByName(found)
        done = done.unionByName(doubts)
        if rest.isEmpty():
            return done, links
        picks = F.explode(F.array(*[F.lit(b) for b in range(branches)]))
        split = (
            rest.where(F.col("n") > node_limit)
            .join(reps.select("rep", "h1", "sketch"), ["rep", "h1"])
            .select("node", "rep", "h1", "sketch", picks.alias("b"))
            .withColumn("i", F.pmod(F.xxhash64("node", "b"), F.lit(SKETCH)).cast("int"))
            .select(F.xxhash64("node", "b", F.get("sketch", F.col("i"))).alias("node"), "rep", "h1")
        )
        level = rest.where(F.col("n") <= node_limit).select("node", "rep", "h1").unionByName(split)
    blocks, meets = _blocks(large, "n", "n", node_limit)
    rows = large.select("node", "rep", "h1", blocks.alias("x"), meets.alias("y"))
    rows = rows.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("node"), "rep", "h1", F.lit(0).alias("side"))
    return done.unionByName(rows), links


def recall(s: float, trees: int = 21, branches: int = 2, depth: int = 2) -> float:
    """Least probability that a pair of similarity ``s`` meets, as when all its nodes are large."""
    return 1 - (1 - s**ROOT * (1 - (1 - s) ** branches) ** depth) ** trees


def _set_fetcher(size: int):
    """Sets of documents whose set has the given hash."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tk.blocks(batch.column(1), 1 << 20):
                hashes, offsets = tk.shingle_sets(data, at, _TABLE, size)
                wanted = batch.column(2).slice(i, j - i)
                good = pa.array(_set_hashes(hashes, offsets)[0] == wanted.to_numpy(zero_copy_only=False))
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), wanted, sets], ["rep", "h1", "set"]).filter(good)

    return fetch


def _fetcher(size: int):
    """Sets of the documents that some node holds, one row for each node. Rows that repeat a document are sent once, as far as the last ``_RECENT`` tell."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sent = ["node", "rep", "side", "set"], {}

        def rows(own: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names)

        for batch in batches:
            for i, j, data, at in tk.blocks(batch.column(1), 1 << 20):
                hashes, offsets = tk.shingle_sets(data, at, _TABLE, size)
                seen = _set_hashes(hashes, offsets)[0]
                ids, wanted = batch.column(0).slice(i, j - i).to_pylist(), batch.column(2).slice(i, j - i).to_pylist()
                out, held = [], 0
                for d, at_nodes in enumerate(batch.column(3).slice(i, j - i).to_pylist()):
                    if int(seen[d]) != wanted[d] or (ids[d], wanted[d]) in sent:
                        continue
                    sent[ids[d], wanted[d]] = True
                    if len(sent) > _RECENT:
                        del sent[next(iter(sent))]
                    own = hashes[offsets[d] : offsets[d + 1]].tobytes()
                    for x in at_nodes:
                        out.append((x["node"], ids[d], x["side"], own))
                        held += len(own)
                        if held > 8 << 20:
                            yield rows(out)
                            out, held = [], 0
                if out:
                    yield rows(out)

    return fetch


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    owner, held = owner[order], times[code[order]]
    out, pairs = np.zeros((n, n), np.float32), []
    for f in range(2, 6):  # shingles that few members hold: their pairs one by one
        few = owner[held == f].reshape(-1, f)
        pairs += [few[:, i] * n + few[:, j] for i in range(f) for j in range(f) if i != j]
    out += np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n)
    owner, held = owner[held > 5], held[held > 5]
    column = np.cumsum(np.append(0, np.diff(code[order][times[code[order]] > 5]) != 0)) if len(owner) else owner
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        part = np.zeros((n, _COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def node_links(ids: list[int], sets: list[np.ndarray], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of at least ``percent`` similarity that join the members of one node. Members of side 1 are joined already."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    if n < 2:
        return []
    if n == 2:
        common = 0 if sides is not None and all(sides) else len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if common and 100 * common >= percent * (sizes.sum() - common) else []
    common = intersections(sets)
    linked = (common > 0) & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
    np.fill_diagonal(linked, False)
    out, new = [], np.ones(n, bool)
    joined = np.flatnonzero(sides) if sides is not None else []
    for root in [joined, *[[x] for x in range(n)]]:
        if not len(root) or not new[root].any():
            continue
        new[root] = False
        todo = list(root)
        while todo:
            x = todo.pop()
            found = np.flatnonzero(linked[x] & new)
            new[found] = False
            todo += found.tolist()
            out += [(ids[x], ids[y]) for y in found]
    return out


def _comparer(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            now, ids, sides, sets, last = None, [], [], [], None
            for batch in batches:
                for node, rep, side, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if node != now:
                        yield from node_links(ids, sets, percent, sides)
                        now, ids, sides, sets, last = node, [], [], [], None
                    if last == (rep, side, own):  # a repeated row that came from another task
                        continue
                    last = (rep, side, own)
                    ids.append(rep)
                    sides.append(side)
                    sets.append(np.frombuffer(own, np.uint64))
            yield from node_links(ids, sets, percent, sides)

        held: list[tuple[int, int]] = []
        for link in links():
            held.append(link)
            if len(held) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.int64()) for k in (0, 1)], ["src", "dst"])
                held = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.int64()) for k in (0, 1)], ["src", "dst"])

    return compare


def near_duplicates(
    documents: DataFrame, size: int = 5, percent: int = 75, trees: int = 21, branches: int = 2, depth: int = 2, node_limit: int = 400
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``documents``.

    ``depth``: how often large nodes are split before the rest is compared in blocks, the same at every size of input.
    """
    spark = documents.sparkSession
    signed = cut(signatures(documents, size), "signatures")
    reps = cut(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sketch")).alias("m")).select("h1", "h2", F.col("m.doc_id").alias("rep"), F.col("m.sketch").alias("sketch")),
        "representatives",
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))

    def fetch(some: DataFrame) -> DataFrame:
        held = texts.join(some, "rep").select("rep", "text", "h1").mapInArrow(_set_fetcher(size), "rep long, h1 long, set array<long>")
        return held.dropDuplicates(["rep", "h1"])

    with scratch(spark) as made:
        nodes, early = _nodes(reps, fetch, percent, trees, branches, depth, node_limit)
        # Trees often agree on a node's members: such nodes are compared once. A node is known by two sums over its members.
        member = F.xxhash64("rep", "h1", "side")
        same = nodes.groupBy("node").agg(F.bit_xor(member).alias("x"), F.sum(F.shiftright(member, 8)).alias("y"), F.count("*").alias("n"))
        chosen = same.groupBy("x", "y", "n").agg(F.min("node").alias("node")).select("node")
        at = nodes.join(chosen, "node").groupBy("rep", "h1").agg(F.collect_set(F.struct("node", "side")).alias("nodes"))
        held = texts.join(at, "rep").select("rep", "text", "h1", "nodes").mapInArrow(_fetcher(size), "node long, rep long, side int, set binary")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        links = held.repartition(parts, "node").sortWithinPartitions("node", "rep", "side", "set").mapInArrow(_comparer(percent), "src long, dst long")
        links = cut((links if early is None else links.unionByName(early)).distinct(), "links")
        made.pop()  # the links themselves stay
    found = connected_components(links)
    drop(links)
    classes = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("c"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("c"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).select(
        "*", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept")
    )
