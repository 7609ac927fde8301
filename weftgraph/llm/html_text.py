"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tokens, words and tags. A word scores by where it stands (in a link, in an element that is set apart such as
a menu, or elsewhere), a tag by its kind; words elsewhere score positive or zero and tags negative or zero. One linear scan finds the contiguous
tokens of the highest sum. Weights are learnt from labelled pages, of which the main part is known, by a structured
perceptron that keeps those signs: where the best subsequence isn't the labelled one, weights move towards what the labelled one holds.

The region found is then squared with the page's elements, as scores cut short blocks at its ends: it grows to the article or
content element that holds it or, where there is none, over the paragraphs next to it. Elements set apart inside it are left out.

Defined results: a null html is empty; a page without any word that scores has an empty text; rows that repeat are extracted each; an
empty table gives an empty one; a null page_id or url is passed on. Further columns of the table are passed on where asked for by name.
Work and memory grow with a page's length, and a page is never cut.
"""

from __future__ import annotations

import html as references
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of elements, and words of class, id and role that tell what an element is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl li dt dd figure figcaption table hr".split())
SKIPPED = frozenset("script style template noscript iframe textarea title svg math object canvas select audio video".split())
APART = SKIPPED | frozenset("head nav aside footer form button label fieldset legend dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
APART_WORDS = frozenset(
    "ad ads adv advert advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "cookie cookies consent gdpr notice notices alert popup modal overlay widget widgets login search searchbox pagination pager toolbar copyright skip skiplink".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
HEADER_WORDS = frozenset("header top topbar sitename tagline".split())
CONTENT_WORDS = frozenset("article articlebody content main post story entry".split())
#: Kinds of tags; one that is in none is ``other``.
KINDS = {
    "inline": "b i em strong span u s small mark code font sub sup br abbr time cite q img", "paragraph": "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption",
    "link": "a", "list": "ul ol li dl dt dd", "table": "table thead tbody tfoot tr td th caption", "division": "div section center", "content": "article main",
}
KIND_OF = {name: kind for kind, names in KINDS.items() for name in names.split()}
#: What an opening tag ends if it is still open, and where the search for it stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--|<[!?][^>]*>""")
_TAG_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_MARK = re.compile(r"""(?:^|[\s/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Page:
    """Elements of a page in the order in which they begin, and its tokens: runs of words, and tags.

    An element is ``names[e]`` inside ``parents[e]``; element 0 is the page. A token is ``(offset, element, n_words, text or None, tag or None)``;
    a tag belongs to the element that it begins or ends, or to the one that it stands in.
    """

    def __init__(self, source: str):
        self.names, self.parents, self.marks = ["#page"], [0], [{}]
        self.tokens: list[tuple[int, int, int, str | None, str | None]] = []
        self._read(source)
        self._sum_up()

    def _read(self, source: str) -> None:
        stack, open_, at, no_end = [0], Counter(), 0, set()

        def text(until: int) -> None:
            if until > at and (found := references.unescape(source[at:until])).strip():
                self.tokens.append((at, stack[-1], len(found.split()), found, None))
            elif until > at:
                self.tokens.append((at, stack[-1], 0, " ", None))

        def end(names: set[str], stop: set[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                name = self.names[stack[k]]
                if name in stop:
                    return
                if name in names:
                    for e in stack[k:]:
                        open_[self.names[e]] -= 1
                    del stack[k:]
                    return

        start = source.find("<")
        while start >= 0:
            m = _TAG.match(source, start) or _TAG_LOOSE.match(source, start)
            if m is None:  # a sign, not a tag
                start = source.find("<", start + 1)
                continue
            text(start)
            at = m.end()
            if m[0] == "<!--":
                close = source.find("-->", at)
                at = len(source) if close < 0 else close + 3
            elif m.lastindex:
                name, closing = m[2].lower(), bool(m[1])
                if closing:
                    if open_[name]:
                        e = next(x for x in reversed(stack) if self.names[x] == name)
                        end({name}, set())
                        self.tokens.append((start, e, 0, None, name))
                    else:
                        self.tokens.append((start, stack[-1], 0, None, name))
                else:
                    if open_["p"] and name not in INLINE and name not in SKIPPED and name not in VOID - {"hr"}:
                        end({"p"}, {"table", "button"})
                    if name in IMPLIED and any(open_[x] for x in IMPLIED[name][0]):
                        end(*IMPLIED[name])
                    e = stack[-1]
                    if name not in VOID:
                        e = len(self.names)
                        self.names.append(name)
                        self.parents.append(stack[-1])
                        self.marks.append({k.lower(): v.strip("\"'") for k, v in _MARK.findall(m[3])} if m[3] else {})
                        stack.append(e)
                        open_[name] += 1
                    self.tokens.append((start, e, 0, None, name))
                    if name in SKIPPED and e and stack[-1] == e:  # all up to its end is no markup
                        close = None if name in no_end else re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, at)
                        if close is None:
                            no_end.add(name)
                        if close is not None:
                            at = close.start()
                        elif name in ("script", "style", "textarea", "title"):
                            at = len(source)
            start = source.find("<", at)
        text(len(source))

    def _sum_up(self) -> None:
        """Which elements are set apart, hold links, or hold the content."""
        n = len(self.names)
        words, self.in_link, self.apart, self.content = [0] * n, [False] * n, [False] * n, [0] * n
        inside_content = [False] * n
        for _, e, k, _, _ in self.tokens:
            words[e] += k
        for e in range(n - 1, 0, -1):
            words[self.parents[e]] += words[e]
        for e in range(1, n):
            p, name, mark = self.parents[e], self.names[e], self.marks[e]
            self.in_link[e] = self.in_link[p] or name == "a"
            inside_content[e] = inside_content[p] or name in ("article", "main")
            told = {w.lower() for key in ("class", "id", "itemprop") if key in mark for w in _WORDS.findall(mark[key])} if mark else set()
            role = mark.get("role", "").lower()
            hidden = "hidden" in mark or mark.get("aria-hidden", "").lower() == "true" or "display:none" in mark.get("style", "").replace(" ", "").lower()
            if name in ("html", "body", "main"):
                own = False
            elif name == "article":
                own = bool(told & COMMENT_WORDS)
            else:
                by_name = name in APART or role in APART_ROLES or hidden or name == "header" and not inside_content[p]
                by_word = bool(told & APART_WORDS) or bool(told & HEADER_WORDS) and not inside_content[p] and not told & CONTENT_WORDS
                own = by_name or by_word and 3 * words[e] < 2 * words[0]  # a wrapper of most of the page isn't a sidebar, whatever it is called
            self.apart[e] = self.apart[p] or own
            if not self.apart[e]:
                self.content[e] = 3 if name == "article" else 2 if name == "main" or role == "main" else 1 if told & CONTENT_WORDS and name in ("div", "section", "td") else 0

    def feature(self, token: tuple) -> tuple[str, int]:
        """What a token is to the weights, and how many it stands for."""
        _, e, n, text, tag = token
        if tag is not None:
            return f"tag {KIND_OF.get(tag, 'other')}", 1
        return "word apart" if self.apart[e] else "word in link" if self.in_link[e] else "word", n

    def best(self, weights: dict[str, float]) -> tuple[int, int] | None:
        """First and last token of the subsequence of the highest score, the first such; None where no token scores positive."""
        top, found, now, begun = 0.0, None, 0.0, 0
        for i, token in enumerate(self.tokens):
            name, n = self.feature(token)
            if now <= 0:
                now, begun = 0.0, i
            now += weights.get(name, 0.0) * n
            if now > top:
                top, found = now, (begun, i)
        return found

    def _up(self, e: int) -> Iterator[int]:
        while e:
            yield e
            e = self.parents[e]
        yield 0

    def squared(self, first: int, last: int) -> tuple[int, int]:
        """The region of tokens that whole elements make of ``first`` to ``last``."""
        over = set(self._up(self.tokens[first][1]))
        common = next(e for e in self._up(self.tokens[last][1]) if e in over)
        holders = [e for e in self._up(common) if self.content[e]]
        if holders:
            return self._extent(max(holders, key=lambda e: self.content[e]))  # of one kind the nearest
        while common and (self.names[common] in TEXT_BLOCKS or self.names[common] in INLINE):
            common = self.parents[common]
        child = self._children(common)
        while first > 0 and self._goes_on(first - 1, first, common, child):
            first -= 1
        while last + 1 < len(self.tokens) and self._goes_on(last + 1, last, common, child):
            last += 1
        return first, last

    def _extent(self, e: int) -> tuple[int, int]:
        inside = [False] * len(self.names)
        inside[e] = True
        for x in range(e + 1, len(self.names)):
            inside[x] = inside[self.parents[x]]
        at = [i for i, t in enumerate(self.tokens) if inside[t[1]]]
        return at[0], at[-1]

    def _children(self, e: int) -> list[int]:
        """For each element the child of ``e`` that holds it; ``e`` for itself, -1 outside."""
        out = [-1] * len(self.names)
        out[e] = e
        for x in range(e + 1, len(self.names)):
            p = self.parents[x]
            out[x] = x if p == e else out[p]
        self._links = Counter()
        for _, x, n, _, _ in self.tokens:
            if out[x] > e:
                self._links[out[x], self.in_link[x]] += n
        return out

    def _goes_on(self, i: int, beside: int, common: int, child: list[int]) -> bool:
        """Whether token ``i`` next to the region is more of the same: in a text block, or right in the common element."""
        e = child[self.tokens[i][1]]
        if e == -1 or self.apart[self.tokens[i][1]]:
            return False
        if e == common or e == child[self.tokens[beside][1]]:
            return self.names[common] not in ("#page", "html") or e != common
        plain, linked = self._links[e, False], self._links[e, True]
        return (self.names[e] in TEXT_BLOCKS or self.names[e] in INLINE) and plain >= linked

    def blocks(self, first: int, last: int) -> list[str]:
        """Texts of the region's blocks, without what is set apart. A line break within a block is white space."""
        out, now = [], []

        def close() -> None:
            if text := " ".join("".join(now).split()):
                out.append(text)
            now.clear()

        for _, e, _, text, tag in self.tokens[first : last + 1]:
            if tag is not None and tag not in INLINE:
                close()
            elif self.apart[e]:
                continue
            elif text is not None:
                now.append(text)
            elif tag in ("br", "wbr", "img"):
                now.append(" " if tag == "br" else "")
        close()
        return out


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The main text of a page, its blocks on lines of their own."""
    if not source:
        return ""
    page = Page(source)
    found = page.best(weights)
    return "\n".join(page.blocks(*page.squared(*found))) if found else ""


def learn(pages: Iterable[tuple[str, int, int]], rounds: int = 20) -> dict[str, float]:
    """Weights from pages with the first and last offset of their main part, by an averaged structured perceptron.

    Words outside links and set-apart elements keep a weight of zero or more, tags and set-apart words of zero or less.
    """
    known = []
    for source, start, stop in pages:
        page = Page(source)
        at = [t[0] for t in page.tokens]
        known.append((page, (bisect_left(at, start), bisect_left(at, stop) - 1)))
    names = ["word", "word in link", "word apart", *(f"tag {k}" for k in [*KINDS, "other"])]
    weights = dict.fromkeys(names, -1.0) | {"word": 1.0}
    total: Counter = Counter()

    def held(page: Page, region: tuple[int, int] | None) -> Counter:
        out: Counter = Counter()
        for token in page.tokens[region[0] : region[1] + 1] if region else []:
            name, n = page.feature(token)
            out[name] += n
        return out

    for _ in range(rounds):
        for page, right in known:
            found = page.best(weights)
            if found != right:
                gold, got = held(page, right), held(page, found)
                size = sum(gold.values()) + sum(got.values()) or 1
                for name in names:
                    w = weights[name] + (gold[name] - got[name]) / size
                    weights[name] = max(0.05, w) if name == "word" else min(0.0, w) if name != "word in link" else w
            total.update(weights)
    return {name: total[name] / (rounds * len(known)) for name in names}


def labelled_pages(seed: int = 11, each: int = 6) -> list[tuple[str, int, int]]:
    """Pages of nine layouts with invented words, and where their main part begins and ends."""
    r = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice("aeioubdfgklmnprstv") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def paragraphs(n: int, end: str = "</p>") -> str:
        return "".join(f"<p>{words(1, 60)}{r.choice(['', f' <a href=/x>{words(1, 3)}</a> ', f' <b>{words(1, 4)}</b>', '<br>' + words(3, 9)])} {words(2, 30)}.{end}" for _ in range(n))

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href=/{i}>{words(1, 3)}</a></li>" for i in range(n)) + "</ul>"

    def comments(n: int) -> str:
        return "".join(f"<div class=comment><b>{words(1, 2)}</b><p>{words(5, 40)}</p></div>" for _ in range(n))

    head = lambda: f"<html><head><title>{words(2, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>"
    layouts = [
        lambda: (f"{head()}<nav>{links(8)}</nav><div class=ad>{words(4, 12)}</div>", f"<article><h1>{words(2, 8)}</h1>{paragraphs(r.randint(2, 9))}</article>", f"<footer>&copy; {words(2, 6)}</footer></body></html>"),
        lambda: (f"{head()}<header><h2>{words(1, 4)}</h2>{links(5)}</header><main>", f"<h1>{words(2, 8)}</h1>{paragraphs(r.randint(2, 9))}", f"</main><aside><h3>{words(1, 3)}</h3>{links(7)}</aside><footer>{words(3, 9)}</footer></body></html>"),
        lambda: (f"{head()}<div id=header>{words(2, 5)}</div><div id=menu>{links(9)}</div><div id=content>", f"<h1>{words(2, 8)}</h1>{paragraphs(r.randint(3, 9))}", f"</div><div id=comments>{comments(4)}</div><div id=footer>{words(3, 9)}</div></body></html>"),
        lambda: (f"{head()}<table><tr><td>{words(1, 3)}</td><td>{links(6)}</td></tr><tr><td>{links(12)}</td><td>", paragraphs(r.randint(4, 9), ""), f"</td></tr><tr><td><a href=/>{words(1, 3)}</a> {words(1, 3)}</td></tr></table></body></html>"),
        lambda: (f"{head()}<div class=cookie-notice><p>{words(10, 30)}</p><button>{words(1, 2)}</button></div><div class=post>", f"<h2>{words(2, 7)}</h2>{paragraphs(r.randint(2, 7))}<blockquote>{words(8, 30)}</blockquote>{paragraphs(2)}", f"</div><form><input><label>{words(2, 6)}</label></form><div class=related>{links(5)}</div></body></html>"),
        lambda: (f"{head()}<a href=/>{words(1, 2)}</a> <a href=/b>{words(1, 2)}</a><hr>", f"<h1>{words(2, 6)}</h1>{paragraphs(r.randint(3, 8))}", f"<hr><a href=/c>{words(1, 3)}</a> <a href=/d>{words(1, 3)}</a></body></html>"),
        lambda: (f"{head()}<div><div>{words(1, 4)}</div><div>{links(6)}</div></div><div><div>", f"{paragraphs(r.randint(3, 9))}<ul><li>{words(4, 15)}</li><li>{words(4, 15)}</li></ul>{paragraphs(2)}", f"</div><div>{links(9)}</div></div><div><div>{words(2, 6)}</div></div></body></html>"),
        lambda: (f"{head()}<div role=banner>{words(2, 5)}</div><section class=story>", f"<h1>{words(2, 8)}</h1>{paragraphs(3)}<div class=advert><p>{words(3, 20)}</p></div>{paragraphs(r.randint(3, 6))}", f"</section><section class=newsletter><p>{words(8, 25)}</p></section></body></html>"),
        lambda: (f"{head()}<div class=top><span>{words(1, 3)}</span></div>", f"<article><header><h1>{words(2, 8)}</h1></header>{paragraphs(r.randint(2, 6))}<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>{paragraphs(2)}</article>", f"<section id=comments>{comments(6)}</section></body></html>"),
    ]
    made = [layout() for layout in layouts for _ in range(each)]
    return [(before + main + after, len(before), len(before) + len(main)) for before, main, after in made]


@cache
def default_weights() -> dict[str, float]:
    return learn(labelled_pages())


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: dict[str, float] | None = None) -> DataFrame:
    """The ``keep`` columns of every row with its main ``text`` and ``n_chars``, its number of code points.

    ``weights`` come from ``learn``; without them, from ``labelled_pages``. They are a dozen numbers, sent with the task. No shuffle.
    A kept column may have any name but ``text`` and ``n_chars``.
    """
    learnt = weights or default_weights()
    kept = [pages.schema[k] for k in keep]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x, learnt) for x in batch["#html"]]
            out = batch.drop(columns="#html")
            yield out.assign(text=texts, n_chars=[len(x) for x in texts])

    return pages.select(*keep, pages[html].alias("#html")).mapInPandas(extract, schema)
