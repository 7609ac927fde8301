"""License scans with a trained paragraph classifier.

Text is read at three grains: sentences, lines, and paragraphs, which are lines joined where they look wrapped (a line of ``WRAP`` bytes
or more without a mark at its end goes on in the next one). Word 1-grams and 2-grams, hashed into ``WIDTH`` columns, go into a
multinomial logistic regression over licence families and an ``unknown`` class. It learns from the notices below, from variants of
them (words dropped, foreign words around them), and, as unknown, from ordinary lines of the corpus: at most about ``sample`` of
them, chosen by hash, of at most ``LINE`` characters, none of them like a notice.

Calibration never sees what is learnt: in each of ``FOLDS`` folds whole families are left out and, with lines kept out too, count as
unknown, beside variants kept out of the families that are learnt. Temperature and the bias of the unknown class are those of least loss over all folds.

A unit whose most probable family reaches ``least`` is then compared with that family's notices. It counts only if it holds a word pair
that tells the family by name (not by a number, "version" or "license" alone) or ``TELLS`` pairs that only its texts have, and most of a notice's word pairs are in it, or most of its own
in a notice; a unit of two words must be a whole notice, and one of a single word never is one. Then what tells this family is taken out of the unit, and what is left is classified again, so a unit may name several families.
A family found at several grains in one place is reported once, where the finest unit begins.

Defined results: a null text has no paragraphs; blank lines are none; ties go to the first family in
sorted order; rows that repeat, or lack an id, are scanned each. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import textkernels as tk

# By family, names as they stand after "the" or "a", identifiers, and paragraphs of its public texts.
NAMES = {
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL", "GNU AGPL"),
    "apache": ("Apache License", "Apache License, Version 2.0", "Apache 2.0 License", "Apache Software License"),
    "bsd": ("BSD License", "2-Clause BSD License", "3-Clause BSD License", "BSD-style license", "New BSD License", "Simplified BSD License"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "CC BY-SA 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "CC0 Public Domain Dedication"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 2", "GNU General Public License, version 3", "GNU General Public License v2.0 or later", "GPL", "GNU GPL", "GPLv2", "GPLv3"),
    "isc": ("ISC License", "ISC license terms"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU Library General Public License", "LGPL", "GNU LGPL"),
    "mit": ("MIT License", "MIT license terms", "Expat License"),
    "mpl": ("Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL", "MPL 2.0"),
    "unlicense": ("Unlicense", "The Unlicense"),
}
IDENTIFIERS = {
    "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL"), "apache": ("Apache-2.0", "Apache"), "bsd": ("BSD-2-Clause", "BSD-3-Clause", "0BSD", "BSD"),
    "cc-by": ("CC-BY-4.0", "CC-BY-3.0", "CC-BY-SA-4.0", "CC-BY-SA-3.0"), "cc-by-nc": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"), "cc0": ("CC0-1.0", "CC0"),
    "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "GPL"), "isc": ("ISC",),
    "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL"), "mit": ("MIT",), "mpl": ("MPL-2.0", "MPL-1.1", "MPL"), "unlicense": ("Unlicense",),
}
TEXTS = {
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
             "You should have received a copy of the GNU Affero General Public License along with this program."),
    "apache": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
             "You should have received a copy of the GNU Lesser General Public License along with this library."),
    "mit": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "reserved": ("All rights reserved.", "Rights reserved.", "Copyright. All rights reserved.", "All rights reserved by the author.",
                 "No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
}
# Sentences that name a licence.
FRAMES = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "Distributed under the terms of the {}.", "This software is available under the {}.", "License: {}", "{}", "{} License", "See the {} for details.",
)
IDENTIFIED = ("SPDX-License-Identifier: {}", "License: {}", "{} License", "Licensed under {}.", "Released under the {} License.")
# Sentences with words of notices that are no notice.
OTHERS = (
    "The driver showed a license to the officer.", "Version 2.0 of the game was released in May.", "All rights were discussed at length.", "The public library is free on Sundays.",
    "Permission to land was granted.", "The terms of the agreement were published by the foundation.", "A license fee is charged for commercial use of the hall.", "This work was done under a grant.",
    "He reserved a table for four.", "The general public is under no obligation.", "Apache is a people of the Southwest.", "MIT released a study on batteries.", "The MIT students hold a driving license.",
    "The license", "Public License", "The mozilla is a lizard of the public park.", "A copy of the software was sold by the lesser shop.",
)

# Words that name no licence, alone or together.
UNTELLING = (*map(str, range(10)), "v", "version", "license", "licence", "licenses", "licensed", "public", "general", "software", "only", "or", "later", "the", "a", "of", "under", "terms", "see", "spdx", "identifier")

UNKNOWN = "unknown"
WIDTH, VARIANTS, STEPS, DECAY, FOLDS = 1 << 15, 4, 120, 1e-4, 3
#: Bytes of a line that may be wrapped, characters of a line that is learnt from, and pairs that tell a family by its texts.
WRAP, LINE, TELLS = 50, 2000, 3
_TABLE = tk.word_table(bytes(range(48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 128)))
_PAIR = tk.mix(np.arange(7, 9, dtype=np.uint64)) | np.uint64(1)


def notices() -> dict[str, tuple[list[str], list[str]]]:
    """By family, its notices that name it, of two words at least, and its other texts."""
    families = sorted({*NAMES, *TEXTS})
    named = {f: [x.format(n) for n in NAMES.get(f, ()) for x in FRAMES] + [x.format(n) for n in IDENTIFIERS.get(f, ()) for x in IDENTIFIED] for f in families}
    return {f: ([x for x in named[f] if " " in x or "-" in x], list(TEXTS.get(f, ()))) for f in families}


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the units' words and word pairs, one unit after the other; for each the unit; and each pair's hash."""
    starts, ends, first = tk.words(data, at, _TABLE)
    h = tk.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    pairs = tk.mix(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1]) if len(h) > 1 else h[:0]
    inside = row[:-1] == row[1:] if len(h) > 1 else np.zeros(0, bool)
    return h, row, pairs[inside], row[:-1][inside] if len(h) > 1 else row[:0]


def _columns(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(WIDTH)).astype(np.int64)


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tk.flat(pa.array(texts, pa.string()))


def pair_sets(texts: list[str]) -> list[np.ndarray]:
    data, at = _units(texts)
    _, _, pairs, row = features(data, at)
    return [np.unique(pairs[row == d]) for d in range(len(texts))]


def _words(texts: list[str]) -> np.ndarray:
    return np.unique(features(*_units(texts))[0])


class Templates:
    """What notices are compared with: by family, the word pairs of each notice, and what only this family has."""

    def __init__(self):
        known = notices()
        self.families = sorted(known)
        sets = {f: (pair_sets(named), pair_sets(texts) if texts else []) for f, (named, texts) in known.items()}
        joined = lambda x: np.unique(np.concatenate([np.zeros(0, np.uint64), *x]))
        every = {f: joined([*a, *b]) for f, (a, b) in sets.items()}
        words = {f: _words([*a, *b]) for f, (a, b) in known.items()}
        untelling = joined(pair_sets([f"{a} {b}" for a in UNTELLING for b in UNTELLING]))
        self.notices, self.named, self.text, self.words = {}, {}, {}, {}
        for f, (named, texts) in sets.items():
            others = joined([every[g] for g in known if g != f])
            distinct: dict[bytes, np.ndarray] = {x.tobytes(): x for x in [*named, *texts] if len(x)}
            self.notices[f] = list(distinct.values())
            # "All rights reserved" has no name but itself.
            self.named[f] = np.setdiff1d(np.setdiff1d(joined(named or texts), others), untelling if named else [])
            self.text[f] = np.setdiff1d(joined(texts), others)
            self.words[f] = np.setdiff1d(words[f], joined([words[g] for g in known if g != f]))

    def confirms(self, family: str, own: np.ndarray, alike: float) -> bool:
        """Whether a unit with the word pairs ``own`` is a notice of the family. A unit of one pair must be a whole notice."""
        if len(own) == 1:
            return any(len(x) == 1 and x[0] == own[0] for x in self.notices[family])
        if not len(np.intersect1d(own, self.named[family])) and len(np.intersect1d(own, self.text[family])) < TELLS:
            return False
        return max(len(np.intersect1d(own, x)) / min(len(own), len(x)) for x in self.notices[family]) >= alike


class Classifier:
    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, templates: Templates):
        self.families, self.weights, self.bias, self.temperature, self.templates = families, weights, bias, temperature, templates

    def softmax(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        f = (total / np.sqrt(np.maximum(count, 1))[:, None] + self.bias) / self.temperature
        f = np.exp(f - f.max(axis=1, keepdims=True))
        return f / f.sum(axis=1, keepdims=True)

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Of each unit and family; and the units' features."""
        found = h, row, pairs, pair_row = features(data, at)
        n, k = len(at) - 1, len(self.families)
        total, count = np.zeros((n, k), np.float32), np.zeros(n)
        for x, r in ((h, row), (pairs, pair_row)):
            if len(x):
                edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                total[r[edge]] += np.add.reduceat(self.weights[_columns(x)], edge)
                count += np.bincount(r, minlength=n)
        return self.softmax(total, count), found

    def families_of(self, words: np.ndarray, pairs: np.ndarray, p: np.ndarray, least: float, alike: float) -> Iterator[tuple[str, float]]:
        """The families that a unit names, one after the other, each with what told the ones before taken out."""
        while True:
            best = int(p.argmax())
            family = self.families[best]
            if family == UNKNOWN or p[best] < least or not len(pairs) or not self.templates.confirms(family, np.unique(pairs), alike):
                return
            yield family, float(p[best])
            pairs = pairs[~np.isin(pairs, np.union1d(self.templates.named[family], self.templates.text[family]))]
            words = words[~np.isin(words, self.templates.words[family])]
            total = self.weights[_columns(words)].sum(axis=0, dtype=np.float32) + self.weights[_columns(pairs)].sum(axis=0, dtype=np.float32)
            p = self.softmax(total[None, :], np.array([len(words) + len(pairs)]))[0]

    def scan(self, data: np.ndarray, at: np.ndarray, least: float, alike: float) -> list[tuple[int, str, float]]:
        """(unit, family, probability) of confirmed notices."""
        p, (h, row, pairs, pair_row) = self.probabilities(data, at)
        best, out = p.argmax(axis=1), []
        for d in np.flatnonzero((p.max(axis=1) >= least) & (best != self.families.index(UNKNOWN))):
            words = h[np.searchsorted(row, d) : np.searchsorted(row, d, "right")]
            own = pairs[np.searchsorted(pair_row, d) : np.searchsorted(pair_row, d, "right")]
            out += [(int(d), f, x) for f, x in self.families_of(words, own, p[d], least, alike)]
        return out


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big")


class _Sparse:
    """Texts by hashed columns, as sorted (row, column) entries of weight 1 / sqrt(entries of the row). Only columns that occur are held."""

    def __init__(self, texts: list[str], columns: np.ndarray | None = None):
        h, row, pairs, pair_row = features(*_units(texts))
        row, column = np.concatenate([row, pair_row]), _columns(np.concatenate([h, pairs]))
        order = np.argsort(row, kind="stable")
        row, column, self.n = row[order], column[order], len(texts)
        value = (1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=self.n))))[row].astype(np.float32)
        self.columns = np.unique(column) if columns is None else columns
        at = np.minimum(np.searchsorted(self.columns, column), len(self.columns) - 1)
        known = self.columns[at] == column
        self.row, self.column, self.value = row[known], at[known], value[known][:, None]
        self.rows = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.by_column = np.argsort(self.column, kind="stable")
        self.heads = np.flatnonzero(np.diff(self.column[self.by_column], prepend=-1))

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]), np.float32)
        if len(self.rows):
            out[self.row[self.rows]] = np.add.reduceat(weights[self.column] * self.value, self.rows)
        return out

    def transposed_times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.columns), x.shape[1]), np.float32)
        if len(self.rows):
            out[self.column[self.by_column][self.heads]] = np.add.reduceat((x[self.row] * self.value)[self.by_column], self.heads)
        return out


def _regression(texts: list[str], y: np.ndarray, kinds: int) -> tuple[_Sparse, np.ndarray, np.ndarray]:
    """Columns, weights and bias of the regression, every class counting alike."""
    x = _Sparse(texts)
    onehot = np.eye(kinds, dtype=np.float32)[y]
    weight = (1 / np.maximum(np.bincount(y, minlength=kinds), 1))[y].astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros((len(x.columns), kinds), np.float32), np.zeros(kinds, np.float32)
    mean, square, step = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)], 0.2
    for t in range(1, STEPS + 1):
        f = x.times(w) + b
        f = np.exp(f - f.max(axis=1, keepdims=True))
        g = (f / f.sum(axis=1, keepdims=True) - onehot) * weight[:, None]
        for k, (v, d) in enumerate(((w, x.transposed_times(g) + DECAY * w), (b, g.sum(axis=0)))):
            mean[k] = 0.9 * mean[k] + 0.1 * d
            square[k] = 0.999 * square[k] + 0.001 * d * d
            v -= step * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return x, w, b


def _examples(ordinary: list[str], templates: Templates) -> tuple[list[str], list[str]]:
    """Texts and their families: lines that are no notice, and the notices with their variants."""
    every = np.unique(np.concatenate([x for own in templates.notices.values() for x in own]))
    plain = [t for t, own in zip(ordinary, pair_sets(ordinary), strict=True) if not len(own) or len(np.intersect1d(own, every)) < 0.3 * len(own)] if ordinary else []
    texts, labels = [*plain, *OTHERS], [UNKNOWN] * (len(plain) + len(OTHERS))
    foreign = [w for t in texts for w in t.split()][:5000]
    for family, (named, others) in notices().items():
        for wording in [*named, *others]:
            words = wording.split()
            for v in range(VARIANTS):
                rng = np.random.default_rng(_hash(f"{wording}|{v}"))
                own = [w for w in words if len(words) < 5 or v == 0 or rng.random() > 0.1] or words
                around = [[foreign[i] for i in rng.integers(0, len(foreign), int(rng.integers(0, 4)))] if v else [] for _ in range(2)]
                texts.append(" ".join([*around[0], *own, *around[1]]))
                labels.append(family)
    return texts, labels


def _calibration(texts: list[str], labels: list[str], families: list[str]) -> tuple[float, float]:
    """Temperature and bias of the unknown class of least loss, over folds whose families are not all learnt."""
    unknown, logits, truth = families.index(UNKNOWN), [], []
    for k in range(FOLDS):
        unseen = {f for i, f in enumerate(f for f in families if f != UNKNOWN) if i % FOLDS == k}
        out = np.array([label in unseen or _hash(f"fold|{t}") % FOLDS == k for t, label in zip(texts, labels, strict=True)])
        y = np.array([unknown if f in unseen else families.index(f) for f in labels])
        if out.all() or not out.any():
            continue
        x, w, b = _regression([t for t, o in zip(texts, out, strict=True) if not o], y[~out], len(families))
        f = _Sparse([t for t, o in zip(texts, out, strict=True) if o], x.columns).times(w) + b
        f[:, [families.index(u) for u in unseen]] = -1e3
        logits.append(f)
        truth.append(y[out])
    f, y = np.concatenate(logits).astype(np.float64), np.concatenate(truth)
    share = 1 / np.maximum(np.bincount(y, minlength=len(families)), 1)[y]

    def loss(t: float, u: float) -> float:
        z = (f + u * (np.arange(len(families)) == unknown)) / t
        z -= z.max(axis=1, keepdims=True)
        return -float(((z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(len(z)), y] * share).sum())

    return min(((float(t), float(u)) for t in np.geomspace(0.2, 5, 20) for u in np.linspace(-2, 2, 9)), key=lambda x: loss(*x))


def fit(ordinary: list[str]) -> Classifier:
    """Train on the notices, their variants and ``ordinary`` lines."""
    templates = Templates()
    families = sorted([*templates.families, UNKNOWN])
    texts, labels = _examples(ordinary, templates)
    temperature, lift = _calibration(texts, labels, families)
    x, w, bias = _regression(texts, np.array([families.index(f) for f in labels]), len(families))
    weights = np.zeros((WIDTH, len(families)), np.float32)
    weights[x.columns] = w
    bias[families.index(UNKNOWN)] += lift
    return Classifier(families, weights, bias, temperature, templates)


_CLASSIFIERS: dict[int, Classifier] = {}


def _classifier(broadcast, number: int) -> Classifier:
    if number not in _CLASSIFIERS:
        _CLASSIFIERS.clear()
        _CLASSIFIERS[number] = broadcast.value
    return _CLASSIFIERS[number]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def grains(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where sentences, lines and paragraphs begin in texts, with the end of all; every grain's edges are edges of the one before."""
    lines = np.unique(np.concatenate([at, np.flatnonzero(data == 10)]))
    mark = np.isin(data, np.frombuffer(b".!?", np.uint8))
    upper = (data >= 65) & (data <= 90) | (data >= 0xC3)
    ends = np.flatnonzero(mark[:-2] & (data[1:-1] == 32) & upper[2:]) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    sentences = np.union1d(lines, ends)
    solid = np.flatnonzero(~_BLANK[data])
    last = np.searchsorted(solid, lines[1:]) - 1  # of each line, its last byte that is no space
    full = (last >= 0) & (solid[np.maximum(last, 0)] >= lines[:-1]) if len(solid) else np.zeros(len(lines) - 1, bool)
    closed = np.ones(len(lines) - 1, bool)
    if len(solid):
        closed[full] = np.isin(data[solid[last[full]]], np.frombuffer(b".!?:;", np.uint8))
    goes_on = full & ~closed & (np.diff(lines) >= WRAP)
    joined = np.append(False, goes_on[:-1] & full[1:]) & ~np.isin(lines[:-1], at)
    return sentences, lines, np.append(lines[:-1][~joined], lines[-1])


def scan_text_column(column: pa.Array, classifier: Classifier, least: float, alike: float) -> tuple[list[int], list[list[dict]]]:
    """For each text the number of its paragraphs and the notices found."""
    numbers, found = [], []
    for _, _, data, at in tk.blocks(column):
        hits: list[list[dict]] = [[] for _ in range(len(at) - 1)]
        if not len(data):
            numbers += [0] * len(hits)
            found += hits
            continue
        taken: list[tuple[int, int, str]] = []  # begin, end and family of what was found at finer grains, in order
        starts, _, _ = tk.words(data, at, _TABLE)
        for edges in grains(data, at):
            new = []
            for d, family, p in classifier.scan(data, edges, least, alike):
                begin, end = int(edges[d]), int(edges[d + 1])
                inside = taken[bisect.bisect_left(taken, (begin, 0, "")) : bisect.bisect_left(taken, (end, 0, ""))]
                if any(f == family for _, _, f in inside):
                    continue
                new.append((begin, end, family))
                t = int(np.searchsorted(at, begin, "right")) - 1
                head = starts[np.searchsorted(starts, begin)]
                hits[t].append({"line": int((data[at[t] : head] == 10).sum()), "family": family, "probability": p})
            taken = sorted(taken + new)
        paragraphs = edges
        worded = np.diff(np.searchsorted(starts, paragraphs)) > 0
        text = np.searchsorted(at, paragraphs[:-1], "right") - 1
        numbers += np.bincount(text[worded], minlength=len(at) - 1).tolist()
        found += [sorted(x, key=lambda r: (r["line"], r["family"])) for x in hits]
    return numbers, found


_HITS = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))


def _scanner(broadcast, number: int, least: float, alike: float):
    @F.arrow_udf("struct<n_paragraphs:long, notices:array<struct<line:int, family:string, probability:double>>>")
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = _classifier(broadcast, number)
        for column in columns:
            numbers, found = scan_text_column(column, classifier, least, alike)
            yield pa.StructArray.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, _HITS)], ["n_paragraphs", "notices"])

    return scan


def _ordinary(documents: DataFrame, sample: int) -> list[str]:
    """Different lines of a hashed sample of documents: one line each, also by hash, of at most ``LINE`` characters."""
    texts = documents.where("text is not null and text <> ''")
    share = min(1.0, sample / max(1, texts.count()))
    lines = F.split("text", "\n")
    rows = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.get(lines, F.pmod(F.hash("text"), F.size(lines))).alias("line"))
    return sorted(r["line"] for r in rows.where(F.length("line") <= LINE).distinct().collect() if r["line"].strip())


def scan_licenses(documents: DataFrame, least: float = 0.5, alike: float = 0.6, sample: int = 2000) -> DataFrame:
    """``(doc_id, n_paragraphs, notices)``, one row for each row of ``documents``; notices have line, family and probability."""
    docs = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    broadcast = docs.sparkSession.sparkContext.broadcast(fit(_ordinary(docs, sample)))
    found = _scanner(broadcast, int(broadcast._jbroadcast.id()), least, alike)("text")
    return docs.select("doc_id", found.alias("_found")).select("doc_id", "_found.n_paragraphs", "_found.notices")
