import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph.llm import language_id as li

SYLLABLES = {"xx": ["ba", "bo", "bri", "ne"], "yy": ["ku", "kö", "zi", "to"], "zz": ["the", "ing", "ou", "st"]}


def corpus(n=240, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(SYLLABLES))
        rows.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))), lang))
    return rows


def test_held_out_accuracy_and_split(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    rows = li.identify(frame).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert 20 < len(held) < 120 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in held)


def test_predictions_ignore_labels_sources_and_held_out_rows(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    wrong = frame.withColumn("lang", F.when(li.held_out(F.col("doc_id")), "qq").otherwise(F.col("lang"))).withColumn("source", F.col("lang"))
    pick = lambda f: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in li.identify(f).collect())
    assert pick(frame) == pick(wrong)


def test_odd_rows(spark):
    odd = [(None, "ba bo", "xx"), (1001, None, "xx"), (1002, "", None), (1003, "123 -- !?", None), (1004, "BA BO BRI NE", None), (1005, "bone " * 50_000, None), (1006, "日本", None)]
    frame = spark.createDataFrame([*corpus(), *odd, odd[4]], "doc_id long, text string, lang string").withColumns({"score": F.lit(7), "_found": F.lit(1)})
    out = {r["doc_id"]: r for r in li.identify(frame).collect()}
    assert {r["_found"] for r in out.values()} == {1}
    assert [out[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3 and out[1001]["score"] == 0.0
    assert out[1004]["lang_pred"] == out[1005]["lang_pred"] == "xx"
    assert out[None]["held_out"] is False and out[1006]["lang_pred"] in SYLLABLES


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in li.identify(frame).collect()] == [("und", 0.0)]
    assert li.identify(frame.limit(0)).collect() == []


def test_kernel_is_shared_ngrams_over_geometric_mean():
    texts = ["ab ab", "abc"]
    model = li.fit(texts, ["p", "q"])
    x = np.concatenate([li.presence(d, at, model.lookup(), len(model.grams)) for _, _, d, at in li.tk.blocks(pa.array(texts))])

    def grams(t):
        b = t.encode()
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    a, b = grams(texts[0]), grams(texts[1])
    assert np.allclose(model.kernel(x), [[1, len(a & b) / (len(a) * len(b)) ** 0.5], [len(a & b) / (len(a) * len(b)) ** 0.5, 1]])


def test_scores_are_those_of_ridge_regression_on_sets_of_ngrams(spark):
    """Brute force: kernels by intersection of Python sets, and the same regression on them."""
    rows = [*corpus(150, 3), (900, "ba BO!", "xx"), (901, "ba BO!", "xx")]
    frame = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string")

    def grams(t):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t.encode())
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    hashes = {(r["doc_id"], r["text"]): r["h"] for r in frame.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h")).collect()}
    learnt = sorted({(lang, hashes[(i, t)], t) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2})
    languages = sorted({x[0] for x in learnt})
    marks = [grams(t) for lang in languages for _, _, t in [x for x in learnt if x[0] == lang][: li.LANDMARKS // 3]]
    like = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[like(grams(t), m) for m in marks] for _, _, t in learnt])
    a = k.T @ k + li.RIDGE * len(learnt) * np.array([[like(x, y) for y in marks] for x in marks])
    y = np.where(np.array([x[0] for x in learnt])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    w = np.linalg.lstsq(a + 1e-9 * np.trace(a) / len(a) * np.eye(len(a)), k.T @ y, rcond=None)[0]
    for r in li.identify(frame).collect():
        f = np.array([like(grams(r["text"]), m) for m in marks]) @ w
        assert r["lang_pred"] == languages[int(f.argmax())] and abs(r["score"] - min(1, max(0, (f.max() + 1) / 2))) < 5e-3


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "aba", lang) for i, lang in enumerate(["yy", "xx"] * 12)]
    found = li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("lang_pred").distinct().collect()
    assert len(found) == 1
    model = li.fit(["aba", "aba"], ["yy", "xx"])
    assert li.predict(pa.array(["aba"]), model, model.lookup())[0] == ["xx"]
