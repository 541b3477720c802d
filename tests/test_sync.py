"""M8: an index that follows its pages."""
import pytest

from quarry.operators import knn
from quarry.operators.hooks import Hook
from quarry.plans import ingest
from quarry.plans.ingest import page_sources, processed_urls, sync_sources
from quarry.sources.index_store import (append_index, compact_index, load_cells, load_index, load_manifest, save_index, update_index)

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def texts(spark, path, version=None):
    return {r.source: r.text for r in load_index(spark, path, version).collect()}


def test_three_versions_equal_rebuilds(spark, tmp_path):
    path = str(tmp_path / "index")
    first = [(1, "a", "<p>one</p>"), (2, "b", "<p>two</p>"), (3, "c", "<p>three</p>")]
    second = [*first, (11, "a", "<p>one, revised</p>"), (12, "b", "<p>two</p>"), (13, "d", "<p>four</p>")]
    third = [*second, (21, "c", None), (22, "b", "<p>two, revised</p>")]
    changes = [{(r.source, r.change) for r in sync_sources(spark, page_sources(pages(spark, x)), path).collect()}
               for x in (first, second, third)]
    assert changes == [{("a", "new"), ("b", "new"), ("c", "new")}, {("a", "changed"), ("d", "new")}, {("b", "changed"), ("c", "removed")}]
    assert texts(spark, path) == {"a": "one, revised", "b": "two, revised", "d": "four"}
    assert texts(spark, path, 1) == {"a": "one", "b": "two", "c": "three"}
    assert texts(spark, path, 2) == {"a": "one, revised", "b": "two", "c": "three", "d": "four"}
    assert {r.url for r in processed_urls(spark, path).collect()} == {"a", "b", "d"}
    # an older fetch, the same pages again and an empty batch change nothing and commit nothing
    for rows in (first, third, []):
        assert sync_sources(spark, page_sources(pages(spark, rows)), path).count() == 0
    with pytest.raises(Exception):
        load_index(spark, path, 4)
    # a removed page comes back
    sync_sources(spark, page_sources(pages(spark, [(31, "c", "<p>three</p>")])), path)
    assert texts(spark, path)["c"] == "three"
    assert compact_index(spark, path) == 5 and texts(spark, path) == texts(spark, path, 4)
    assert sync_sources(spark, page_sources(pages(spark, third + [(31, "c", "<p>three</p>")])), path).count() == 0


def test_only_changed_pages_are_embedded(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "index"), []
    real = ingest.build_index
    monkeypatch.setattr(ingest, "build_index", lambda chunks, e: seen.append(sorted(r.source for r in chunks.collect())) or real(chunks, e))
    rows = [(i, f"u{i}", f"<p>text {i}</p>") for i in range(9)]
    sync_sources(spark, page_sources(pages(spark, rows)), path)
    sync_sources(spark, page_sources(pages(spark, rows + [(100, "u4", "<p>other</p>"), (101, "u5", "<p>text 5</p>")])), path)
    assert seen == [[f"u{i}" for i in range(9)], ["u4"]]


def vectors(spark, rows):
    return spark.createDataFrame([(f"{s}#{i}", s, 0, 0, "t", [float(x) for x in v]) for i, (s, v) in enumerate(rows)],
                                 "chunk_id string, source string, chunk_idx int, start int, text string, embedding array<float>")


def test_cells_of_replaced_and_appended_rows(spark, tmp_path):
    """Searches of the stored cells equal searches of the plain rows, version by version."""
    import numpy as np
    rnd = np.random.default_rng(8)
    path = str(tmp_path / "index")
    save_index(vectors(spark, [(f"s{i % 20}", (i % 4) * 30 + rnd.normal(size=3)) for i in range(200)]), path, cells=8)
    append_index(vectors(spark, [(f"n{i}", (i % 5) * 30 + rnd.normal(size=3)) for i in range(60)]), path)
    gone = spark.createDataFrame([(f"s{i}",) for i in range(0, 20, 2)], "source string")
    update_index(vectors(spark, [("s0", rnd.normal(size=3)), ("late", [500, 500, 500])]), path, gone)
    asked = spark.createDataFrame([(i, [float(x) for x in (i % 6) * 30 + rnd.normal(size=3)]) for i in range(25)], "q_id long, embedding array<float>")
    for version, n in ((1, 200), (2, 260), (3, 162)):
        stored = load_cells(spark, path, version)
        assert stored.cells == 8 and stored.sizes.sum() == n == load_index(spark, path, version).count()
        want = knn.knn_join(asked, load_index(spark, path, version), k=4, pivots=1)
        assert sorted(knn.knn_join(asked, stored, k=4).collect()) == sorted(want.collect())
    assert compact_index(spark, path, cells=3) == 4 and load_cells(spark, path).cells == 3
    assert sorted(knn.knn_join(asked, load_cells(spark, path), k=4).collect()) == sorted(want.collect())


def test_an_index_without_manifest_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "index")
    save_index(ingest.page_index(pages(spark, [(1, "a", "<p>one</p>"), (2, "b", "<p>two</p>")])), path)
    assert load_manifest(spark, path) is None
    sync_sources(spark, page_sources(pages(spark, [(1, "a", "<p>one</p>"), (3, "c", "<p>three</p>")])), path)
    assert texts(spark, path) == {"a": "one", "b": "two", "c": "three"}


def test_a_hook_embeds_what_changed(spark, tmp_path):
    path = str(tmp_path / "index")
    hook = Hook("lengths", lambda: lambda ts: [[float(len(t)), 1.0] for t in ts])
    sync_sources(spark, page_sources(pages(spark, [(1, "a", "<p>one</p>")])), path, hook)
    assert list(load_index(spark, path).first().embedding) == [3.0, 1.0]
