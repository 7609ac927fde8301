"""Hard negatives against a full comparison, against SQL, and odd rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import hard_negatives as hn
from weftgraph.llm import queries

D = "/root/testdata/sf0.01"


def brute(rows, positives=5, negatives=3, low=50, high=95, every=50):
    """All pairs, from ``(id, label, ints)`` with ids that differ."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, other, w in rows if b != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(-t, b) for t, b, other in scored if other != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k, b, -s, t) for k, (t, b) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def found(spark, rows, **args):
    frame = spark.createDataFrame(rows, "id long, label int, vec array<int>")
    return sorted(map(tuple, hn.hard_negatives(frame, F.col("id") % 50 == 0, **args).collect()))


@pytest.fixture
def rows():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 16)) * 60
    made = []
    for i in range(700):
        label = int(r.integers(4))
        made.append((i, label, [int(x) for x in centres[int(r.integers(6))] * 0.7 + r.normal(size=16) * 40]))
    return made


def test_full_comparison(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_ties_and_many_copies(spark, rows):
    copies = [(1000 + i, i % 3, rows[0][2]) for i in range(400)] + [(2000 + i, 1, [0] * 16) for i in range(60)] + [(3000, 2, [-x for x in rows[0][2]])]
    assert found(spark, rows[:200] + copies) == brute(rows[:200] + copies)


def test_many_blocks_and_stripes_change_nothing(spark, rows):
    assert found(spark, rows, block_bytes=16 * 8 * 3) == brute(rows)


def test_other_numbers_and_windows(spark, rows):
    args = {"positives": 2, "negatives": 7, "low": 10, "high": 99}
    assert found(spark, rows, **args) == brute(rows, **args)


def test_bounds_hold_and_most_rows_are_never_scored(rows):
    v = np.array([x[2] for x in rows])
    cells = hn.Cells(v[:50], v.min(axis=0), v.max(axis=0))
    low, high = hn.bounds(cells.tables(v[:40]), cells.codes(v))
    exact = v @ v[:40].T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 0.2 * exact.std() * 4
    frame = pd.DataFrame({"id": np.arange(len(v)), "label": [x[1] for x in rows], "vec": [x.astype(np.int32).tobytes() for x in v], "codes": [x.tobytes() for x in cells.codes(v)]})
    scan = hn.Positives(cells, frame[:40], 5)
    scan.rows(frame)
    pairs = sum((frame["label"] == x).sum() for x in frame["label"][:40])
    assert scan.scored < 0.5 * pairs


def test_numbers_that_need_64_bits():
    v = np.array([[1 << 20, -(1 << 20)], [(1 << 20) - 1, 5], [-3, 1 << 19]])
    cells = hn.Cells(v, v.min(axis=0), v.max(axis=0))
    low, high = hn.bounds(cells.tables(v), cells.codes(v))
    assert (low <= v @ v.T).all() and (v @ v.T <= high).all()


def test_the_query_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{D}/embeddings.parquet'")
    right = sorted(connection.execute(hn.SQL).fetchall())
    assert right and sorted(map(tuple, queries.op12_hard_negative_mining(spark, D).collect())) == right


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (50, None, 1), (100, [1.0, None], 1), (150, [nan, 1.0], 1), (200, [1.0, -inf], 1), (250, [1.0, 0.2], None), (None, [1.0, 1.0], 1), (300, [], 2)]
    rows += [(1, [0.9, 0.5], 1), (1, [0.9, 0.5], 1), (1, [0.1, 0.1], 3), (2, [0.8], 2), (3, [0.5, 0.5, 9.0], 2), (4, [3e38, 0.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors = frame.select(F.col("vec_id").alias("id"), "label", hn.integer_vector("embedding").alias("vec"), F.lit(1).alias("ID2"), F.lit(2).alias("codes"), F.lit(3).alias("task"))
    full = [(0, 1, [256, 128]), (1, 1, [230, 128]), (2, 2, [204, 0]), (3, 2, [128, 128, 2304]), (4, 2, [1 << 24, 0]), (300, 2, [])]
    pad = lambda v: v + [0] * (3 - len(v))
    right = brute([(i, label, pad(v)) for i, label, v in full])
    assert sorted(map(tuple, hn.hard_negatives(vectors, F.col("id") % 50 == 0).collect())) == right and right
    assert hn.hard_negatives(vectors.limit(0), F.col("id") % 50 == 0).isEmpty()
    assert hn.hard_negatives(vectors, F.col("id") > 1000).isEmpty()
