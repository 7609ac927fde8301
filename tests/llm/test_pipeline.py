import random
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as cp
from weftgraph.llm import decontaminate
from weftgraph.llm.queries import tokenizer
from weftgraph.storage import new_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder: Path):
    r = random.Random(7)
    sound = {"xx": ["ba", "bo", "bri", "ne", "su"], "yy": ["ku", "kö", "zi", "to", "ed"]}
    line = lambda lang, n=9: " ".join("".join(r.choice(sound[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    bench = [(i, line("xx", 25)) for i in range(5)]
    docs = []
    for i in range(80):
        lang = r.choice(["xx", "yy"])
        docs.append((i, "\n".join(["Shared footer line here", *[line(lang) for _ in range(6)]]), lang, f"s{i % 8}"))
    near = docs[3][1].split(" ")
    near[40] = "changed"
    docs += [(100, " ".join(near), "xx", "s1"), (101, docs[5][1], "xx", "s2"), (102, line("xx") + " " + bench[2][1] + " " + line("xx"), "xx", "s3"), (103, None, "xx", "s4"), (104, "123 456", "xx", "s5"), (105, "", None, None)]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in docs], COLUMNS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return docs, bench


def test_stages(spark, tmp_path):
    docs, bench = tables(spark, tmp_path)
    out, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        out[name] = {r["doc_id"]: r for r in now.collect()}
        assert now.columns == cp.COLUMNS or k == len(cp.STAGES) - 1
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert set(out["language_id"]) == {i for i, *_ in docs} - {103, 104, 105}
    texts = {i: r["text"] for i, r in out["line_dedup"].items()}
    assert sum("Shared footer" in t for t in texts.values()) == 1 and set(texts) == set(out["language_id"])
    assert all(r["n_chars"] == len(r["text"]) for r in out["line_dedup"].values())
    assert set(texts) - set(out["near_dedup"]) == {100, 101}
    assert set(out["near_dedup"]) - set(out["decontamination"]) == {102}
    assert not any(decontaminate.find(r["text"].encode(), decontaminate.searchers([(str(i), t.encode()) for i, t in bench], 10))[1] for r in out["decontamination"].values())
    assert set(out["packing"]) == set(out["decontamination"])
    assert cp.run(spark, str(tmp_path)).count() == now.count()
    assert cp.ORACLE_SQL is None and tokenizer("word_bpe_49k.json")


def test_empty_corpus(spark, tmp_path):
    tables(spark, tmp_path)
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).collect() == []


def test_every_stage_equals_brute_force_on_what_the_one_before_kept(spark, tmp_path):
    """Each stage against the plain version of its operator, on rows that hold nulls, empty and repeated ones and further columns."""
    import test_decontaminate
    import test_line_dedup
    import test_near_dedup
    import test_packing
    from tokenizers import Tokenizer

    docs, bench = tables(spark, tmp_path)
    rows = [*docs, (200, "", "xx", "s1"), (201, docs[0][1] + " ba", "xx", None), (202, "ba", "xx", "s2"), (203, "bo bri", None, "s3"), (204, "bo bri", None, "s3")]
    now = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], COLUMNS).withColumns({n: F.lit(n) for n in ("lines", "h1", "found", "known", "kept")})
    before = {i: (t, s) for i, t, _, s in rows}
    for name, stage in cp.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"brute-{name}"))
        now = spark.read.parquet(str(tmp_path / f"brute-{name}"))
        found = now.collect()
        after = {r["doc_id"]: (r["text"], r["source"]) for r in found} if name != "packing" else {}
        if name == "language_id":
            assert after == {i: x for i, x in before.items() if any(c.isalpha() for c in x[0] or "")}
        if name == "line_dedup":
            want = test_line_dedup.brute([(i, t, s) for i, (t, s) in before.items()])
            assert {i: t for i, (t, _) in after.items()} == {i: t for i, (t, _, n) in want.items() if n == 0 or t.strip(" ")}
        if name == "near_dedup":
            want = test_near_dedup.brute([(i, t) for i, (t, _) in before.items()])
            assert after == {i: x for i, x in before.items() if want[i][2]}
        if name == "decontamination":
            want = test_decontaminate.brute([(i, t) for i, (t, _) in before.items()], bench, 10)
            assert after == {i: x for i, x in before.items() if want[i][1] == 0}
        if name == "packing":
            sequences, total = test_packing.check(found, [(i, t) for i, (t, _) in before.items()], Tokenizer.from_file(tokenizer("word_bpe_49k.json")), 4096)
            assert sequences == -(-total // 4096)
        before = after


def test_a_run_leaves_only_its_result(spark, tmp_path):
    tables(spark, tmp_path)
    folder = Path(new_path(spark, "x").removeprefix("file://")).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    out = cp.run(spark, str(tmp_path))
    # The plan of the last stage has been run and written, so of all tables only that one is left.
    assert [p.name.split("-")[1] for p in set(folder.iterdir()) - before] == ["packing"] and out.count() > 0
