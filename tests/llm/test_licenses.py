import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import licenses

PLAIN = [f"Hern the and {w} of onat with edthe {w}ing or stion by that" for w in ("ble", "sha", "tion", "ner", "wh", "ati", "oue", "re", "ly", "ou")] * 12
TWO_LINES = "This program is free software: you can redistribute it and/or modify it under the terms of the\nGNU Affero General Public License as published by the Free Software Foundation."


@pytest.fixture(scope="module")
def classifier():
    return licenses.fit(PLAIN)


def scan(classifier, *texts):
    return [[(h["line"], h["family"]) for h in hits] for hits in licenses.scan_text_column(pa.array(texts, pa.string()), classifier, 0.5, 0.6)[1]]


def test_every_notice_is_found_under_its_family(classifier):
    for family, (named, texts) in licenses.notices().items():
        for change in (str, lambda x: x.upper().rstrip(".")):
            found = scan(classifier, *[change(x) for x in [*named, *texts]])
            assert [set(x) for x in found] == [{(0, family)}] * len(found), family


def test_other_sentences_are_none(classifier):
    others = [*licenses.OTHERS, *PLAIN[:5], "The MIT students hold a driving license.", "license", "All rights", "MIT student", "the License", "driving license", "Public License"]
    assert scan(classifier, *others) == [[]] * len(others)


def test_families_are_told_apart(classifier):
    cases = {
        "SPDX-License-Identifier: MPL-2.0": ["mpl"], "GPL-2.0-only": ["gpl"], "SPDX-License-Identifier: ISC": ["isc"], "SPDX-License-Identifier: LGPL-2.1-only": ["lgpl"],
        "BSD LICENSE": ["bsd"], "MIT License": ["mit"], "License: MIT": ["mit"], "AGPL License": ["agpl"],
        "Licensed under CC BY 4.0 and CC BY-NC 4.0.": ["cc-by", "cc-by-nc"], "Licensed under the Artistic License.": [], "SPDX-License-Identifier: Zlib": [],
    }
    assert [[f for _, f in x] for x in scan(classifier, *cases)] == list(cases.values())


def test_wrapped_notices_are_read_as_one_and_sentences_by_themselves(classifier):
    assert {f for _, f in scan(classifier, TWO_LINES)[0]} == {"agpl"}
    long = " ".join(PLAIN[:30]) + ". Released under the MIT License. Hern " + " ".join(PLAIN[:30]) + "."
    assert scan(classifier, long) == [[(0, "mit")]]


def test_unseen_licences_are_unknown_to_the_calibration():
    texts, labels = licenses._examples(PLAIN, licenses.Templates())
    temperature, lift = licenses._calibration(texts, labels, sorted({*labels}))
    assert 0.2 <= temperature <= 5 and lift > -2


def test_lines_and_numbers(classifier):
    text = "\n\nHern the and.\nReleased under the MIT License.\n \nAll rights reserved."
    numbers, found = licenses.scan_text_column(pa.array([None, text, "", text, "\nAll rights reserved."], pa.string()), classifier, 0.5, 0.6)
    assert numbers == [0, 3, 0, 3, 1]
    assert [[(h["line"], h["family"]) for h in x] for x in found] == [[], [(3, "mit"), (5, "reserved")], [], [(3, "mit"), (5, "reserved")], [(1, "reserved")]]
    assert all(0.5 <= h["probability"] <= 1 for x in found for h in x)


def brute_units(text):
    """(begin, end) of sentences, lines and paragraphs, by plain string work on ASCII text."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    sentences = []
    for a, b in lines:
        cuts = [a, *[a + m.start() + 1 for m in re.finditer(r"[.!?] (?=[A-Z])", text[a:b])], b]
        sentences += list(zip(cuts, cuts[1:]))
    paragraphs = []
    for k, (a, b) in enumerate(lines):
        before = text[slice(*lines[k - 1])] if k else ""
        # The line break before a line counts as its first byte.
        wide = len(before) + (k > 1) >= licenses.WRAP
        if k and wide and before.strip() and before.rstrip()[-1] not in ".!?:;" and text[a:b].strip():
            paragraphs[-1] = (paragraphs[-1][0], b)
        else:
            paragraphs.append((a, b))
    return sentences, lines, paragraphs


def brute(classifier, text, least=0.5, alike=0.6):
    """The same scan one unit and one word at a time."""
    hashed = {}

    def pair(a, b):
        if (a, b) not in hashed:
            hashed[(a, b)] = licenses.pair_sets([f"{a} {b}"])[0][0]
        return hashed[(a, b)]

    def word(a):
        if a not in hashed:
            hashed[a] = licenses._words([a])[0]
        return hashed[a]

    def probabilities(words, pairs):
        total = np.zeros(len(classifier.families))
        for h in [*words, *pairs]:
            total += classifier.weights[int(h) % licenses.WIDTH]
        z = (total / max(1, len(words) + len(pairs)) ** 0.5 + classifier.bias) / classifier.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    known, out, t = licenses.notices(), [], classifier.templates
    for units in brute_units(text):
        new = []
        for a, b in units:
            tokens = re.findall(r"[0-9a-z\x80-\xff]+", text[a:b].lower())
            words, pairs = [word(x) for x in tokens], [pair(x, y) for x, y in zip(tokens, tokens[1:])]
            while words:
                p = probabilities(words, pairs)
                family, own = classifier.families[int(p.argmax())], set(pairs)
                if family == licenses.UNKNOWN or p.max() < least or not own:
                    break
                told = own & set(t.named[family]) or len(own & set(t.text[family])) >= licenses.TELLS
                if len(own) == 1 and not any(set(x) == own for x in t.notices[family]):
                    break
                if len(own) > 1 and (not told or max(len(own & set(x)) / min(len(own), len(x)) for x in t.notices[family]) < alike):
                    break
                if not any(a <= c and d <= b and f == family for c, d, f, _ in out):
                    new.append((a, b, family, float(p.max())))
                pairs = [x for x in pairs if x not in t.named[family] and x not in t.text[family]]
                words = [x for x in words if x not in t.words[family]]
        out += new
    assert known
    return sorted((text[:a].count("\n") + len(text[a:b]) - len(text[a:b].lstrip("\n")), f, p) for a, b, f, p in out)


def test_equals_brute_force(classifier):
    pieces = [TWO_LINES, "Licensed under CC BY 4.0 and CC BY-NC 4.0. Hern the and.", "All rights reserved.", "SPDX-License-Identifier: MIT", *PLAIN[:3], "", " ", "Permission to land was granted.", *[x[1][0] for x in licenses.notices().values() if x[1]]]
    r = np.random.default_rng(3)
    texts = ["\n".join(pieces[i] for i in r.integers(0, len(pieces), int(r.integers(1, 9)))) for _ in range(60)]
    found = licenses.scan_text_column(pa.array(texts), classifier, 0.5, 0.6)[1]
    for text, hits in zip(texts, found, strict=True):
        want = brute(classifier, text)
        assert [(h["line"], h["family"]) for h in hits] == [(a, f) for a, f, _ in want], text
        assert np.allclose(sorted(h["probability"] for h in hits), sorted(p for _, _, p in want), atol=1e-4)
    assert sum(map(len, found)) > 60


def test_table_with_odd_rows(spark):
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, "word " * 100_000 + "\nLicensed under CC BY-NC 4.0."), (None, "x"), (1, "Released under the MIT License.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("notices", F.lit("x"))
    out = sorted((str(r["doc_id"]), r["n_paragraphs"], [n["family"] for n in r["notices"]]) for r in licenses.scan_licenses(frame).collect())
    # The long line has no mark at its end, so the notice behind it belongs to its paragraph.
    assert out == [("1", 1, ["mit"]), ("1", 1, ["mit"]), ("2", 0, []), ("3", 0, []), ("4", 1, ["cc-by-nc"]), ("None", 1, [])]
    assert licenses.scan_licenses(frame.limit(0)).collect() == []


def test_ties_go_to_the_first_family():
    templates = licenses.Templates()
    families = sorted([*templates.families, licenses.UNKNOWN])
    even = licenses.Classifier(families, np.zeros((licenses.WIDTH, len(families)), np.float32), np.zeros(len(families), np.float32), 1.0, templates)
    assert scan(even, "AGPL License", "MIT License") == [[], []]  # no probability reaches the threshold
    assert [f for _, f, _ in even.scan(*licenses._units(["GNU Affero General Public License", "MIT License"]), 0.0, 0.6)] == ["agpl"]


def test_other_licences_are_none_of_these(classifier):
    others = "BSL-1.0 CDDL-1.0 CDDL-1.1 Artistic-1.0 Artistic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 Zlib OFL-1.1 AFL-2.0 AFL-3.0 OSL-3.0 Python-2.0 PostgreSQL Ruby NCSA W3C Vim WTFPL MS-PL MS-RL ODbL-1.0 PDDL-1.0 CECILL-2.1 LPPL-1.3c NPL-1.1 QPL-1.0 IPL-1.0 CPL-1.0 ZPL-2.1 PHP-3.01".split()
    names = ["Academic Free License v. 2.0", "Boost Software License, version 1.0", "Eclipse Public License, v. 2.0", "Open Software License 3.0", "Common Public License 1.0", "Artistic License 2.0"]
    texts = [frame.format(x) for x in others for frame in licenses.IDENTIFIED] + [frame.format(x) for x in names for frame in licenses.FRAMES]
    assert [(x, found) for x, found in zip(texts, scan(classifier, *texts), strict=True) if found] == []


def test_a_naming_pair_holds_a_name():
    named = licenses.Templates().named
    for text in ("1 0", "v 2", "1 1", "License v", "version 2", "the License", "2 0", "License version"):
        assert not any(np.intersect1d(own, licenses.pair_sets([text])[0]).size for own in named.values()), text
