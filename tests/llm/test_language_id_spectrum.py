"""All n-grams of the landmarks count, and a text's own number holds those of no landmark."""

import random

import numpy as np
import pyarrow as pa

from weftgraph.llm import language_id as li


def many_languages():
    """Languages of their own letters: few landmarks each, so n-grams of one language are held by few landmarks."""
    r = random.Random(5)
    return [("".join(chr(0x4E00 + 300 * k + r.randrange(250)) for _ in range(150)), f"l{k:02}") for k in range(24) for _ in range(8)]


def test_no_ngram_of_a_landmark_falls_out():
    rows = many_languages()
    model = li.fit([t for t, _ in rows], [lang for _, lang in rows])
    own = set()
    for t, _ in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        own |= {g for n in (1, 2, 3) for g in li.codes(data, n).tolist()}
    assert len(own) > 4096 and set(model.grams.tolist()) == own


def test_ngrams_of_no_landmark_lower_the_kernel():
    model = li.fit(["abab", "cdcd"], ["p", "q"])
    found = []
    for _, _, data, at in li.batches(pa.array(["abab", "abxyz"]), len(model.grams)):
        found.append(model.kernel_of(data, at, model.lookup()))
    common, mine, theirs = len({"a", "b", "ab"}), len("abxyz") + 4 + 3, len({"a", "b", "ab", "ba", "aba", "bab"})
    assert np.allclose(np.concatenate(found)[:, 0], [1, common / (mine * theirs) ** 0.5])
