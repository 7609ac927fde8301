"""Hard negatives of vectors by a vector-approximation file.

Every component of a vector is an integer, and every dimension is cut into at most 64 cells, so that a vector's approximation is one byte a
dimension. For an anchor, tables of the least and the largest product of each dimension and cell turn an approximation into a lower and an upper
bound of the score by table lookups and sums. Two scans use them: the first finds the anchor's positives, the best rows of its label; the second finds,
for each positive, the best rows of other labels whose score is within a window below the positive's. Only rows whose bounds say that they may
enter the best so far are scored exactly, so the result is that of a full comparison.

Where the cells lie is fitted on at most ``sample`` vectors, those of the least hashes of ids; their outer ends are the true extremes of all rows.
The fit decides how tight bounds are, never what is found.

Rows are cut into stripes and anchors into blocks of a bounded size. A task holds one block and streams one stripe past it, so that its memory is
bounded, it gives a bounded number of rows an anchor, and any number of tasks can share the work. Rows of one label and vector can't be told apart by
their scores: only the few least ids of each are scanned, more of which can never be among the best.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that share an id are one: that of
the least label, then vector. Vectors of different lengths are compared as if the shorter one went on with zeros. Components beyond 65,536 on either side count
as that. Equal scores are ordered by id. An empty table gives an empty one. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import cut, scratch

CELLS = 64
SAMPLE = 4096
#: Bytes of anchors, as doubles, that a task holds; anchors of a tile of bounds, and rows of it.
BLOCK_BYTES, TILE, ROWS = 16 << 20, 128, 256
LIMIT = float(1 << 24)
NONE = np.iinfo(np.int64).min


def integer_vector(embedding: str, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of every component; null where the vector is null or holds a null or non-finite component."""
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(embedding, lambda x: F.floor(F.least(F.greatest(scale * x.cast("double"), F.lit(-LIMIT)), F.lit(LIMIT))).cast("int"))
    return F.when(finite, whole)


class Cells:
    """Cells of every dimension: ``low[d, c]`` and ``high[d, c]`` are the least and the largest integer of cell ``c``."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, largest: np.ndarray):
        self.dims = len(least)
        self.starts = []
        self.low, self.high = np.zeros((2, self.dims, CELLS), np.int64)
        for d in range(self.dims):
            inner = np.unique(np.quantile(sample[:, d], np.arange(1, CELLS) / CELLS, method="nearest")) if len(sample) else np.empty(0, np.int64)
            starts = np.concatenate([[least[d]], inner[(inner > least[d]) & (inner <= largest[d])]]).astype(np.int64)
            self.starts.append(starts)
            self.low[d] = np.pad(starts, (0, CELLS - len(starts)), "edge")
            self.high[d] = np.pad(np.concatenate([starts[1:] - 1, [largest[d]]]), (0, CELLS - len(starts)), "edge")

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(vectors.shape, np.uint8)
        for d, starts in enumerate(self.starts):
            out[:, d] = np.searchsorted(starts, vectors[:, d], "right") - 1
        return out

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """``[d, c, 0 or 1, anchor]``: least and largest product of an anchor's component with a value of the cell."""
        q = anchors.T[:, None, :]
        products = np.stack([q * self.low[:, :, None], q * self.high[:, :, None]], axis=2)
        products.sort(axis=2)
        top = np.abs(products).max(axis=(1, 2, 3), initial=0).sum() if products.size else 0
        return products.astype(np.int32 if top < 1 << 31 else np.int64)


def bounds(tables: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds ``[row, anchor]`` of scores."""
    dims, _, _, n = tables.shape
    total = np.zeros((len(codes), 2, n), tables.dtype)
    part = np.empty_like(total)
    for d in range(dims):
        np.take(tables[d], codes[:, d], axis=0, out=part, mode="clip")
        total += part
    return total[:, 0], total[:, 1]


def _matrix(values: pd.Series, dims: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), dims)


def _firsts(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group by falling score, then rising id; an id counts once in a group."""
    order = np.lexsort((ids, -score, group))
    g, new = group[order], np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (ids[order][1:] != ids[order][:-1])
    order, g = order[new], g[new]
    begins = np.searchsorted(g, g, "left")
    return order[np.arange(len(g)) - begins < k]


class Best:
    """The first ``k`` scores and ids of each of ``n`` groups so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(group)
        if not len(touched):
            return
        held = self.scores[touched] != NONE
        groups = np.concatenate([np.repeat(touched, held.sum(axis=1)), group])
        scores, every = np.concatenate([self.scores[touched][held], score]), np.concatenate([self.ids[touched][held], ids])
        chosen = _firsts(groups, scores, every, self.k)
        groups, scores, every = groups[chosen], scores[chosen], every[chosen]
        at = np.arange(len(groups)) - np.searchsorted(groups, groups, "left")
        self.scores[touched] = NONE
        self.scores[groups, at], self.ids[groups, at] = scores, every

    def worst(self) -> np.ndarray:
        """The score that a group's newcomer must reach."""
        return self.scores[:, -1]


def _kth_largest(group: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``k``-th largest value of each of ``n`` groups, or ``NONE``."""
    order = np.lexsort((-value, group))
    g = group[order]
    at = np.arange(len(g)) - np.searchsorted(g, g, "left") == k - 1
    out = np.full(n, NONE)
    out[g[at]] = value[order][at]
    return out


class Scan:
    """What a task does with the rows that stream past its block of anchors."""

    def __init__(self, cells: Cells, anchors: pd.DataFrame, k: int):
        self.cells, self.k = cells, k
        anchors = anchors.sort_values(["label", "id"], kind="stable")
        self.ids, self.labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        self.vectors = _matrix(anchors["vec"], cells.dims, np.int32)
        self.scored = 0

    def exact(self, anchor: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        self.scored += len(anchor)
        return np.einsum("ij,ij->i", self.vectors[anchor].astype(np.int64), vectors.astype(np.int64))

    def rows(self, batch: pd.DataFrame) -> None:
        ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
        codes, vectors = _matrix(batch["codes"], self.cells.dims, np.uint8), _matrix(batch["vec"], self.cells.dims, np.int32)
        for wanted, part in self.pairs(labels):
            for a in range(0, len(wanted), TILE):
                tile = wanted[a : a + TILE]
                tables = self.cells.tables(self.vectors[tile].astype(np.int64))
                for b in range(0, len(part), ROWS):
                    rows = part[b : b + ROWS]
                    self.tile(tile, *bounds(tables, codes[rows]), ids[rows], labels[rows], vectors[rows])


class Positives(Scan):
    """The best rows of the anchor's label, without itself."""

    def __init__(self, cells: Cells, anchors: pd.DataFrame, k: int):
        super().__init__(cells, anchors, k)
        self.best = Best(len(self.ids), k)

    def pairs(self, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for label in np.unique(labels):
            yield np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)

    def tile(self, tile, low, high, ids, labels, vectors) -> None:
        least = self.best.worst()[tile]
        if len(low) > self.k:  # one of them may be the anchor itself
            least = np.maximum(least, np.partition(low, len(low) - self.k - 1, axis=0)[len(low) - self.k - 1])
        row, column = np.nonzero((high >= least) & (ids[:, None] != self.ids[tile]))
        self.best.add(tile[column], self.exact(tile[column], vectors[row]), ids[row])

    def found(self) -> pd.DataFrame:
        anchor, at = np.nonzero(self.best.scores != NONE)
        return pd.DataFrame({"anchor": self.ids[anchor], "positive": 0, "id": self.best.ids[anchor, at], "score": self.best.scores[anchor, at]})


class Negatives(Scan):
    """The best rows of other labels within each positive's window."""

    def __init__(self, cells: Cells, anchors: pd.DataFrame, k: int, low: int, high: int):
        super().__init__(cells, anchors, k)
        anchors = anchors.sort_values(["label", "id"], kind="stable")
        lists = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in anchors["positives"]]
        self.width = max((len(x) for x in lists), default=0)
        self.positive, self.least, self.largest = np.zeros((len(lists), self.width), np.int64), *np.full((2, len(lists), self.width), np.iinfo(np.int64).max)
        self.largest[:] = NONE
        for i, x in enumerate(lists):  # an empty window where there are fewer
            self.positive[i, : len(x)] = x[:, 0]
            self.least[i, : len(x)], self.largest[i, : len(x)] = -((-low * x[:, 1]) // 100), (high * x[:, 1]) // 100
        self.best = Best(len(lists) * self.width, k)

    def pairs(self, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.width:
            yield np.arange(len(self.ids)), np.arange(len(labels))

    def tile(self, tile, low, high, ids, labels, vectors) -> None:
        may = (high >= self.least[tile].min(axis=1)) & (low <= self.largest[tile].max(axis=1)) & (labels[:, None] != self.labels[tile])
        row, column = np.nonzero(may)
        anchor, low, high = tile[column], low[row, column].astype(np.int64), high[row, column].astype(np.int64)
        worst, keep = self.best.worst().reshape(-1, self.width), np.zeros(len(row), bool)
        for j in range(self.width):
            least, largest = self.least[anchor, j], self.largest[anchor, j]
            sure = (low >= least) & (high <= largest)
            enough = np.maximum(worst[tile, j], _kth_largest(column[sure], low[sure], len(tile), self.k))
            keep |= (high >= np.maximum(least, enough[column])) & (low <= largest)
        row, anchor = row[keep], anchor[keep]
        score = self.exact(anchor, vectors[row])
        for j in range(self.width):
            inside = (score >= self.least[anchor, j]) & (score <= self.largest[anchor, j])
            self.best.add(anchor[inside] * self.width + j, score[inside], ids[row[inside]])

    def found(self) -> pd.DataFrame:
        group, at = np.nonzero(self.best.scores != NONE)
        anchor, j = np.divmod(group, max(1, self.width))
        return pd.DataFrame({"anchor": self.ids[anchor], "positive": self.positive[anchor, j], "id": self.best.ids[group, at], "score": self.best.scores[group, at]})


def fit_cells(vectors: DataFrame, sample: int = SAMPLE) -> Cells:
    """Cells of ``(id, vec)``: extremes of all rows, inner borders of the quantiles of a sample."""
    dims = vectors.agg(F.max(F.size("vec"))).first()[0] or 0

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, largest = np.zeros((2, dims), np.int64)  # zero is always within, as vectors go on with zeros
        for batch in batches:
            for v in batch["vec"]:
                least[: len(v)], largest[: len(v)] = np.minimum(least[: len(v)], v), np.maximum(largest[: len(v)], v)
        yield pd.DataFrame({"d": np.arange(dims), "least": least, "largest": largest})

    ends = vectors.select("vec").mapInPandas(extremes, "d int, least long, largest long").groupBy("d").agg(F.min("least").alias("least"), F.max("largest").alias("largest"))
    ends = ends.orderBy("d").toPandas()  # a row a dimension
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toPandas()["vec"]
    drawn = np.zeros((len(chosen), dims), np.int64)
    for i, v in enumerate(chosen):
        drawn[i, : len(v)] = v
    return Cells(drawn, ends["least"].to_numpy(), ends["largest"].to_numpy())


def _encoded(vectors: DataFrame, cells: Cells) -> DataFrame:
    """``(id, label, vec, codes)`` with vectors as bytes."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.zeros((len(batch), cells.dims), np.int32)
            for i, x in enumerate(batch["vec"]):
                v[i, : len(x)] = x
            yield batch[["id", "label"]].assign(vec=[x.tobytes() for x in v], codes=[x.tobytes() for x in cells.codes(v)])

    return vectors.select("id", "label", "vec").mapInPandas(encode, "id long, label long, vec binary, codes binary")


def _scanned(anchors: DataFrame, rows: DataFrame, blocks: int, stripes: int, make) -> DataFrame:
    """``(anchor, positive, id, score)``: what each block of anchors finds in each stripe of rows."""
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.array_repeat(F.lit(0), n)) if n == 1 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = anchors.select((deal(blocks) * stripes).alias("at"), every(stripes).alias("k"), F.lit(0).alias("tag"), "id", "label", "vec", F.lit(None).cast("binary").alias("codes"), "positives")
    second = rows.select(deal(stripes).alias("at"), every(blocks).alias("k"), F.lit(1).alias("tag"), "id", "label", "vec", "codes", F.lit(None).cast("binary").alias("positives"))
    both = first.withColumn("task", F.col("at") + F.col("k")).unionByName(second.withColumn("task", F.col("at") + F.col("k") * stripes)).drop("at", "k")
    dealt = both.repartitionById(blocks * stripes, "task").sortWithinPartitions("tag", "label")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, work = [], None
        for batch in batches:
            block.append(batch[batch["tag"] == 0])
            batch = batch[batch["tag"] == 1]
            if len(batch):
                if work is None and sum(map(len, block)):
                    work = make(pd.concat(block))
                if work is not None:
                    work.rows(batch)
        if work is not None:
            yield work.found()

    return dealt.mapInPandas(scan, "anchor long, positive long, id long, score long")


def _best(found: DataFrame, k: int, *group: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``(id long, label long, vec array<int>)``.

    ``is_anchor`` is a condition on ``id``. A negative's score is ``low`` to ``high`` per cent of its positive's, ends included.
    """
    spark = vectors.sparkSession
    with scratch(spark) as made:
        once = vectors.where("id is not null and label is not null and vec is not null").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("v"))
        once = cut(once.select("id", F.col("v.label").cast("long").alias("label"), F.col("v.vec").alias("vec")), "vectors")
        cells = fit_cells(once)
        copies = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
        keep = max(positives + 1, negatives)
        rows = cut(_encoded(once.withColumn("copy", copies).where(F.col("copy") <= keep), cells), "approximations")
        anchors = cut(_encoded(once.where(is_anchor), cells), "anchors")
        blocks = -(-anchors.count() * max(1, cells.dims) * 8 // block_bytes) or 1
        stripes = -(-2 * spark.sparkContext.defaultParallelism // blocks)
        plain = anchors.withColumn("positives", F.lit(None).cast("binary"))
        near = cut(_best(_scanned(plain, rows, blocks, stripes, lambda a: Positives(cells, a, positives)), positives, "anchor"), "positives")
        listed = near.groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("p"), "score"))).alias("list"))  # ``positives`` at most

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[["id"]].assign(positives=[np.array([(p["p"], p["score"]) for p in x], np.int64).tobytes() for x in batch["list"]])

        known = anchors.join(listed.mapInPandas(packed, "id long, positives binary"), "id")
        found = _best(_scanned(known, rows, blocks, stripes, lambda a: Negatives(cells, a, negatives, low, high)), negatives, "anchor", "positive")
        scores = near.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
        out = found.join(scores, ["anchor", "positive"]).select(
            F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        return made.keep(cut(out, "negatives"))


SQL = """WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""
