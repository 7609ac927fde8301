"""Tables of a block are deleted when it ends; own column names never meet the caller's."""

import os
import threading
from concurrent.futures import ThreadPoolExecutor

from weftgraph import storage
from weftgraph.functions.names import free


def test_scratch_tables_go_and_kept_ones_stay(spark):
    outside = storage.cut(spark.range(2), "outside")
    with storage.scratch(spark) as made:
        a, b = storage.cut(spark.range(3), "a"), storage.cut(spark.range(4), "b")
        made.remove(next(p for p in made if "/b-" in p))
    paths = {os.path.dirname(t.inputFiles()[0].removeprefix("file://")): t for t in (outside, b)}
    assert all(os.path.isdir(p) for p in paths) and b.count() == 4 and not os.path.isdir(made[0].removeprefix("file://"))
    storage.drop(outside, b)
    assert not any(os.path.isdir(p) for p in paths) and a.schema.names == ["id"]


def test_blocks_of_two_threads_do_not_meet(spark):
    opened, written = threading.Event(), threading.Event()

    def long_block():
        with storage.scratch(spark) as made:
            own = storage.cut(spark.range(5), "own")
            opened.set()
            assert written.wait(60)
            return made.keep(own), list(made)

    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(long_block)
        assert opened.wait(60)
        with storage.scratch(spark) as made:
            other = made.keep(storage.cut(spark.range(3), "other"))
            gone = storage.cut(spark.range(1), "gone")
        written.set()
        own, rest = running.result(60)
    assert own.count() == 5 and other.count() == 3 and rest == []
    assert [p for p in made if "/own-" in p] == [] and not os.path.isdir(os.path.dirname(gone.inputFiles()[0]).removeprefix("file://"))


def test_kept_tables_are_found_by_what_a_plan_reads(spark):
    with storage.scratch(spark) as made:
        a, b = storage.cut(spark.range(3), "a"), storage.cut(spark.range(4), "b")
        both = made.keep(a.join(b, "id"))
        storage.cut(spark.range(2), "c")
    assert both.count() == 3 and len(made) == 1


def test_free_names():
    assert free(["a", "_B"], "a", "b", "_b", "c") == ["_a", "b", "__b", "c"]
