import random
import re

from pyspark.sql import functions as F

from weftgraph.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            p = words(t)
            m = min(window, len(p))
            for k in range(len(p) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == p[k : k + m]:
                        hit |= set(range(j, j + m))
                        found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def run(spark, docs, items, window=10, **options):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    d = d.withColumns({"items": F.lit("clash"), "n_hit": F.lit(1), "extra": F.lit(2)})
    rows = dc.decontaminate(d, b, window, **options)
    assert rows.columns.count("items") == 1 and "extra" in rows.columns
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows.collect()}


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("a b c d".split()) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 3, 5, 8]))) for i in range(12)]
    docs = [(i, text(r.randint(0, 40))) for i in range(40)]
    return docs, items


def test_equals_brute_force_for_all_lengths_of_items(spark):
    docs, items = corpus(1)
    assert {len(words(t)) for _, t in items} >= {0, 1, 2, 3}
    assert run(spark, docs, items, 4) == brute(docs, items, 4)


def test_benchmark_in_blocks_gives_the_same(spark):
    docs, items = corpus(2)
    assert run(spark, docs, items, 4, block_bytes=16) == brute(docs, items, 4)


def test_fifty_blocks_and_one_table_at_a_time(spark):
    r = random.Random(6)
    items = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(12))) for i in range(150)]
    docs = [(i, " ".join([*(f"w{r.randrange(400)}" for _ in range(5)), *(items[(7 * i + k) % 150][1] for k in range(i % 3)), "end"])) for i in range(40)]
    size = sum(len(t) for _, t in items)
    got = run(spark, docs, items, block_bytes=size // 50)
    assert got == brute(docs, items, 10) and sum(n > 0 for _, n, _ in got.values()) > 20
    dc._TABLES[0] = []
    dc._tables(type("B", (), {"value": []})(), 1, 10)
    assert set(dc._TABLES) == {1}
    dc._TABLES.clear()


def test_columns_of_the_caller_keep_their_names_and_values(spark):
    names = ["_found0", "found", "_found", "a", "B", "c", "more", "f"]
    d = spark.createDataFrame([(1, "x y z"), (None, "x y z"), (None, "x y z")], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    bench = spark.createDataFrame([(1, "x y"), (2, "y z")], "item_id long, text string")
    for size in (2 << 20, 1):
        out = dc.decontaminate(d, bench, 2, block_bytes=size)
        assert set(out.columns) == {*d.columns, "n_words", "n_hit", "spans", "items"} and [out.first()[n] for n in names] == names
        assert [(r["n_hit"], r["items"]) for r in out.collect()] == [(3, ["1", "2"])] * 3


def test_odd_rows(spark):
    item = "One two-three FOUR; five 6 seven éight nine ten eleven"
    docs = [(1, None), (2, ""), (3, "x " * 50_000 + item), (4, item.upper().replace("É", "é")), (5, "One two three"), (6, "!!"), (7, item + " " + item)]
    items = [(10, item), (9, item), (None, "solo"), (11, None), (12, "?!"), (10, "five 6")]
    assert run(spark, docs, items) == brute(docs, [x for x in items if x[0] is not None], 10)
    hit = run(spark, [(1, "a solo b")], items)[1]
    assert hit == (3, 1, [])


def test_ids_are_sorted_as_strings_and_tables_may_be_empty(spark):
    assert run(spark, [(1, "a b c")], [(9, "a b"), (10, "b c")], 2)[1] == (3, 3, ["10", "9"])
    assert run(spark, [(1, "a")], [(1, "x")][:0]) == {1: (1, 0, [])}
    assert run(spark, [(1, "a")][:0], [(1, "x")]) == {}


def test_shifts_skip_and_never_miss():
    patterns = {tuple(b"%d" % x for x in range(k, k + 10)): {"i"} for k in range(5)}
    search = dc.WuManber(patterns)
    text = [b"%d" % x for x in (*range(100, 130), *range(0, 14), *range(200, 210))]
    assert [a for a, _ in search.search(text)] == [30, 31, 32, 33, 34]
    assert search.shift.get((b"100", b"101"), search.far) == 9
