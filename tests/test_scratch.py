"""Scratch tables: scopes remove what was made in them, and nothing that another thread made."""

import os
import threading

from barloom.sources.scratch import materialize, scratch_scope, shared_dir


def tables(spark):
    folder = shared_dir(spark).removeprefix("file://") + "/barloom"
    return {*os.listdir(folder)} if os.path.isdir(folder) else set()


def test_a_scope_leaves_tables_of_other_threads(spark):
    inside, made, out = threading.Event(), threading.Event(), {}

    def first():
        with scratch_scope(spark):
            out["gone"] = materialize(spark.range(3), "gone")
            inside.set()
            made.wait(60)

    def second():
        inside.wait(60)
        out["kept"] = materialize(spark.range(5), "kept")
        made.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out["kept"].count() == 5
    assert not any(x.startswith("gone") for x in tables(spark))


def test_scopes_nest(spark):
    before = tables(spark)
    with scratch_scope(spark):
        kept = materialize(spark.range(4), "outer")
        with scratch_scope(spark):
            materialize(spark.range(4), "inner")
        assert not any(x.startswith("inner") for x in tables(spark) - before)
        assert kept.count() == 4
    assert tables(spark) == before
