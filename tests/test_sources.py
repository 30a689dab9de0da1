import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from halyard.operators.counters import Counters, encode_summary
from halyard.sources import listing, readers
from halyard.sources.loading import CatalogStore, LoadCounts


def test_counters_of_a_running_query(spark):
    df = spark.createDataFrame([(True, 2), (None, 3), (False, None), (True, 5)], "ok boolean, n int").repartition(3)
    runs = encode_summary()
    assert runs.zero == {"total": 0, "succeeded": 0, "failed": 0}
    assert runs.watch(df).groupBy("ok").count().count() == 3
    assert runs.values() == {"total": 4, "succeeded": 2, "failed": 2}
    sums = Counters({"large": F.col("n") > 2}, {"n": F.col("n")})
    sums.watch(df).write.format("noop").mode("overwrite").save()
    assert tuple(sums.row(spark).first()) == (2, 10.0)
    none = Counters({"large": F.col("n") > 2}, {"n": F.col("n")})
    none.watch(df.limit(0)).write.format("noop").mode("overwrite").save()
    assert none.values() == none.zero
    with pytest.raises(ValueError):
        Counters()


def document(path, n, version=2):
    entries = [{"id": i, "artistId": "a", "trackId": "t"} for i in range(n)]
    path.write_text(json.dumps({"version": version, "artists": [], "photos": [], "tracks": [], "entries": entries}))


def test_a_catalog_is_loaded_once_and_failures_are_tried_again(spark, tmp_path):
    path = tmp_path / "catalog.json"
    document(path, 3, version=1)
    store = CatalogStore(spark, str(path))
    for _ in range(2):
        with pytest.raises(Exception, match="invalid catalog"):
            store.get()
    assert store.counts == LoadCounts(2, 2)
    document(path, 4)
    held = store.get()
    assert store.get() is held and held.select(F.size("entries")).first()[0] == 4 and store.counts == LoadCounts(3, 2)
    document(path, 5)
    assert store.get() is held
    store.invalidate()
    assert store.get().select(F.size("entries")).first()[0] == 5 and store.counts == LoadCounts(4, 2)


def test_callers_share_a_load(spark, tmp_path):
    path = tmp_path / "catalog.json"
    document(path, 2)

    def slow(session, where):
        time.sleep(1)
        return readers.catalog(session, where)

    store, got = CatalogStore(spark, str(path), slow), []
    threads = [threading.Thread(target=lambda: got.append(store.get())) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == 6 and all(g is got[0] for g in got) and store.counts == LoadCounts(1, 0)


def test_a_listing_by_pages_is_the_recursive_one(spark, tmp_path):
    for name in ("a/1.txt", "a/2.txt", "a/b/3.txt", "a/b/c/4.txt", "a/b.txt", "a.txt", "z/9", "z/10", "z/y/x/1", "alone", "empty/.keep"):
        f = tmp_path / "store" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(name)
    (tmp_path / "store/none").mkdir()
    root = str(tmp_path / "store")
    wanted = sorted((str(f.relative_to(root)), f.stat().st_size) for f in (tmp_path / "store").rglob("*") if f.is_file())
    for keys in (1, 2, 1000):
        got = listing.listed(spark, root, keys)
        rows = got.withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r["key"], r["size"]) for r in rows) == wanted
        assert len({(r["task"], r["prefix"]) for r in rows}) == len({r["prefix"] for r in rows}) == 4  # a task a prefix
        pages = {}
        for r in rows:
            pages.setdefault((r["prefix"], r["page"]), []).append(r["key"])
        assert max(map(len, pages.values())) <= keys
    assert listing.listed(spark, f"file://{root}", 3).count() == len(wanted)
    assert listing.listed(spark, str(tmp_path / "store/none")).count() == 0
    with pytest.raises(Exception, match="one key at least"):
        listing.listed(spark, root, 0).count()
