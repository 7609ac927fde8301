"""Main texts against labelled pages that weren't learnt from, against a plain reading of the test pages, and odd rows."""

import html
import itertools
import random
import re

import pytest

from weftgraph.llm import queries
from weftgraph.llm.html_text import Page, default_weights, extract_text, labelled_pages, learn, main_text

SCHEMA = "page_id long, url string, html string"


def text_of(source):
    return main_text(source, default_weights())


def test_weights_have_their_signs():
    weights = default_weights()
    assert weights["word"] > 0 and all(w <= 0 for name, w in weights.items() if name.startswith("tag") or name == "word apart")
    assert weights == learn(labelled_pages())


def test_the_scan_finds_the_best_of_all_contiguous_parts():
    r = random.Random(3)
    for _ in range(60):
        source = "".join(r.choice(["<p>", "</p>", "<a href=x>", "</a>", "<div>", "</div>", "word ", "two words ", "<nav>menu</nav>", "<li>"]) for _ in range(25))
        page, weights = Page(source), {k: (1 if k == "word" else -1) * r.random() for k in default_weights()}
        scores = [weights[name] * n for name, n in map(page.feature, page.tokens)]
        sums = {(i, j): sum(scores[i : j + 1]) for i, j in itertools.combinations_with_replacement(range(len(scores)), 2)}
        best = max(sums.values(), default=0)
        found = page.best(weights)
        assert (found is None) == (best <= 0) and (found is None or sums[found] == pytest.approx(best))


def test_pages_of_other_seeds():
    right = 0
    pages = labelled_pages(seed=99, each=10)
    for source, start, stop in pages:
        page, main = Page(source), Page(source[start:stop])
        right += page.blocks(*page.squared(*page.best(default_weights()))) == main.blocks(0, len(main.tokens) - 1)
    assert right >= 0.97 * len(pages)


def test_every_test_page_gives_its_article(spark):
    rows = queries.op11_html_extraction(spark, "/root/testdata/sf0.01").collect()
    sources = {r["page_id"]: r for r in queries.table(spark, "/root/testdata/sf0.01", "pages").collect()}
    assert len(rows) == len(sources)
    for r in rows:
        article = re.search("<article>(.*)</article>", sources[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"]) and r["url"] == sources[r["page_id"]]["url"]


WORDS = "The ministers met on the eve of the vote and said that they would wait for the report before they took a stand on it."


@pytest.mark.parametrize(
    "source",
    [
        f"<div id=wrap><div class='main-menu'>Home News Sport</div><div class=post-content><p>{WORDS}</p><aside>Aside of some length here</aside><p>End.</p></div><div class=comments><p>{WORDS}</p></div></div>",
        f"<body><header><p>{WORDS}</p></header><article><p>{WORDS}<div class=ad>Buy this thing now</div><p>End.</article><section id=comments>{WORDS} {WORDS}</section>",
        f"<main><p>{WORDS}</p><form>Your name and address, please <input> <select><option>{WORDS}</select></form><p>End.</p></main><footer>{WORDS}",
        f"<body><p><a href=/>Home</a> <a href=/b>More of it</a></p><p>{WORDS}</p><p>End.</p><p><a href=/c>Next page</a></p>",
        f"<article><p>{WORDS}</p><script>var a = '<p>{WORDS}</p>';</script><!-- <p>{WORDS}</p> --><style>p {{}}</style><p>End.</p><article class='comment'>{WORDS}</article></article>",
    ],
)
def test_what_is_no_article_goes(source):
    assert text_of(source) == f"{WORDS}\nEnd."


def test_references_and_white_space():
    assert text_of("<article><p>a &lt;b&gt; &amp;amp; caf&eacute; &#8364;\t x<br>y\n\nz&nbsp;end</p>\n<p> &#x41;&unknown; 1 < 2 </p></article>") == "a <b> &amp; café € x y z end\nA&unknown; 1 < 2"


def test_odd_pages(spark):
    long = f"<article>{'<p>' + WORDS + '</p>'}" * 2000
    deep = "<div>" * 3000 + WORDS
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", long), (5, "u", deep), (None, "u", WORDS), (None, "u", WORDS), (6, "u", "<nav>menu</nav>"), (7, "u", "<p \"" * 50), (8, "u", "<!-- open " + WORDS), (9, "u", "x <script> y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    clashing = frame.selectExpr("*", "html AS text", "1 AS `#html`", "2L AS n_chars", "'e' AS element")
    for table in (frame, clashing):
        found = sorted(map(tuple, extract_text(table).collect()), key=str)
        by_id = {r[0]: r[2] for r in found}
        assert len(found) == len(rows) and [r[:2] for r in found].count((None, "u")) == 2
        assert by_id[1] == by_id[2] == by_id[3] == by_id[6] == by_id[8] == "" and by_id[5] == by_id[None] == WORDS and by_id[9] == "x"
        assert by_id[4] == "\n".join([WORDS] * 2000)
    assert extract_text(frame.limit(0)).isEmpty()
