"""The language stage drops texts of scripts that no labelled document has."""

import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_texts_of_unlearnt_scripts_go(spark):
    words = {"xx": "ba bo bri né \u201cnesu\u201d.", "yy": "ku kö zi to; zito \u201cku\u201d"}
    rows = [(i, words[lang] + f" {words[lang][: i % 9]}", lang) for i in range(80) for lang in [("xx", "yy")[i % 2]]]
    odd = [(101, "Привет, \u201cмир\u201d. Как дела?", None), (102, "日本語のテキスト", None), (103, "ba", None), (104, "Né.", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in [*rows, *odd]], COLUMNS)
    found = {r["doc_id"] for r in cp.language_id(spark, docs, "").collect()}
    assert found == {i for i, *_ in rows} | {103, 104}
