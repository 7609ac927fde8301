"""The query of tiles draws with as many rounds as a layout has."""

import inspect

from weftgraph.plans import concept_queries


def test_tiles_take_the_whole_layout(spark, monkeypatch):
    whole, seen = concept_queries.layout.layout, []
    rounds = inspect.signature(whole).parameters["rounds"].default

    def drawn(edges, rounds=rounds, **more):
        seen.append(rounds)
        return whole(edges, rounds=1, **more)

    monkeypatch.setattr(concept_queries.layout, "layout", drawn)
    assert not concept_queries.graph_tiles(spark, "/root/testdata/sf0.001").isEmpty() and seen == [rounds]
