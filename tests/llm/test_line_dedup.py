import duckdb
import pandas as pd
from pyspark.sql import functions as F

from weftgraph.llm import line_dedup as ld


def brute(rows, least=5):
    sites, first = {}, {}
    for i, text, source in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n")):
            key = line.strip(" \t\r\x0b\x0c")
            if key:
                sites.setdefault(key, set()).update([source] if source is not None else [])
                first.setdefault(key, (i, pos))
    out = {}
    for i, text, _ in rows:
        if text is None:
            out[i] = (None, 0, 0)
            continue
        lines = text.split("\n")
        kept = [x for pos, x in enumerate(lines) if not (k := x.strip(" \t\r\x0b\x0c")) or len(sites[k]) < least or first[k] == (i, pos)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_removed": F.lit("x"), "pos": F.lit(1), "a": F.lit(1)})
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in ld.dedup_lines(frame, **options).collect()}


ROWS = [(i, f"own {i}\n" + "\n".join(f" shared {k} " if i % 2 else f"shared {k}" for k in range(1, 12) if i % k == 0) + "\n\nend\n", f"s{i % 9}" if i % 10 else None) for i in range(120)]


def test_equals_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_threshold_is_exact_and_sure_for_many_sites(spark):
    rows = [(i, f"l{k}", f"s{i}") for k, n in enumerate((3, 4, 5, 6, 40, 400)) for i in range(n)]
    rows = [(j, text, source) for j, (_, text, source) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_sites=40) == brute(rows, 40)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "\n\n", "c"), (4, "x\n" * 30_000, "d"), *[(10 + i, "x", f"s{i}") for i in range(4)], (20, "x\nx", None), (21, "y" * 100_000, "q")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == {}
    frame = spark.createDataFrame([(None, "x\nz", "a"), *[(1, "x", f"s{i}") for i in range(6)]], "doc_id long, text string, source string")
    out = [(r["doc_id"], r["text"]) for r in ld.dedup_lines(frame).collect()]
    assert sorted(out, key=str) == [(1, "")] * 6 + [(None, "x\nz")]


def test_columns_of_the_caller_keep_their_names_and_values(spark):
    names = ["_gone", "gone", "_doc", "doc", "_check", "Check", "lines", "_lines", "pos", "site", "first"]
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    out = ld.dedup_lines(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_removed"] and [out.first()[n] for n in names] == names


def test_sql_says_the_same(spark):
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text", "source"]))
    assert {r[0]: r[1:] for r in db.execute(ld.SQL).fetchall()} == brute(ROWS)


def test_main_path_has_no_python(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    plan = ld.dedup_lines(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
