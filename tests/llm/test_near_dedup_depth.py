"""Recall doesn't depend on the size of the input."""

import inspect

import pytest

from weftgraph.llm import near_dedup


def test_one_depth_at_every_size_and_its_recall():
    depth = inspect.signature(near_dedup.near_duplicates).parameters["depth"].default
    assert depth == 2
    assert near_dedup.recall(0.75, depth=0) == pytest.approx(0.99999, abs=1e-5)
    assert near_dedup.recall(0.75, depth=depth) == pytest.approx(0.99994, abs=1e-5)
