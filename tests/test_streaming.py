import time
from datetime import datetime


from corpuskiln.operators.embedding import HashEmbedder
from corpuskiln.operators.store import Store
from corpuskiln.plans.search import status
from corpuskiln.sources.changes import _Changes, file_changes
from corpuskiln.streaming.changes import Totals, arrivals, debounced, first_uploads, indexing, notified, request_counts

T0 = datetime(2024, 1, 1)
EVENTS = "watcher string, path string, kind string, ts timestamp, seq long"


READ = "path string, text string, file_type string, last_modified long, line_offset int, reason string"


def test_indexing_follows_events(spark, tmp_path):
    texts = {"/a.txt": "alpha", "/b.txt": "beta"}
    store = Store(spark, str(tmp_path / "store"), 8)
    files = spark.createDataFrame([(p, t, "txt", 0, 0, None) for p, t in texts.items()] + [("/gone.txt", None, None, None, None, "missing")], READ)

    def run(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        query = indexing(stream, store, HashEmbedder(8), str(tmp_path / "ck"), lambda paths: files.join(paths, "path", "left_semi")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run([("w", "/a.txt", "upsert", T0, 1), ("w", "/b.txt", "upsert", T0, 2), ("w", "/gone.txt", "upsert", T0, 3)])
    assert status(store) == {"files": 2, "chunks": 2}
    run([("w", "/a.txt", "upsert", T0, 4), ("w", "/a.txt", "remove", T0, 5)])
    assert status(store) == {"files": 1, "chunks": 1}


def until_done(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return query


def test_arriving_files_are_indexed(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    store = Store(spark, str(tmp_path / "store"), 8)

    def run():
        until_done(indexing(arrivals(spark, str(tmp_path / "in"), "*.md"), store, HashEmbedder(8), str(tmp_path / "ck")))

    (tmp_path / "in" / "a.md").write_text("# one")
    (tmp_path / "in" / "b.txt").write_text("two")
    run()
    assert status(store) == {"files": 1, "chunks": 1}
    (tmp_path / "in" / "deep" / "c.md").write_text("# three")
    run()
    assert status(store) == {"files": 2, "chunks": 2}


def test_changed_and_removed_files_reach_the_store(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"), 8)
    (folder / "deep").mkdir(parents=True)

    def run():
        stream = file_changes(spark, str(folder), str(tmp_path / "listings"), 3)
        until_done(indexing(stream, store, HashEmbedder(8), str(tmp_path / "ck")))
        return {r.path.rpartition("/")[2]: r.content for r in store.table("chunks").collect()}

    for name, text in (("a.md", "# one"), ("b.txt", "two"), ("deep/c.md", "# three"), ("bad.md", "fine now"), (".hidden.md", "no")):
        (folder / name).write_text(text)
    assert run() == {"a.md": "# one", "b.txt": "two", "c.md": "# three", "bad.md": "fine now"}
    log = len(list((tmp_path / "store" / "_log").glob("0*")))
    assert run() and len(list((tmp_path / "store" / "_log").glob("0*"))) == log  # nothing happened, nothing is done again
    (folder / "a.md").write_text("# one, longer")
    (folder / "b.txt").unlink()
    (folder / "bad.md").write_bytes(b"\xff\xfe\xff")
    assert run() == {"a.md": "# one, longer", "c.md": "# three", "bad.md": "fine now"}
    assert [(r.path.rpartition("/")[2], r.reason) for r in store.table("rejects").collect()] == [("bad.md", "not UTF-8")]
    (folder / "bad.md").write_text("fine again")
    assert run()["bad.md"] == "fine again" and store.table("rejects").count() == 0


def test_totals_are_the_tables_counts(spark, tmp_path):
    folder, store, totals, told = tmp_path / "in", Store(spark, str(tmp_path / "store"), 8), Totals(), []
    folder.mkdir()
    spark.streams.addListener(totals)

    def results(df, batch):
        told.extend((r.path.rpartition("/")[2], r.result, r.reason) for r in df.collect())
        totals.results(df, batch)

    def run():
        until_done(indexing(file_changes(spark, str(folder), str(tmp_path / "listings"), 2), store, HashEmbedder(8), str(tmp_path / "ck"), on_results=results))

    try:
        for name in ("a.md", "b.md", "c.png"):
            (folder / name).write_text(name)
        run()
        (folder / "d.md").write_bytes(b"\xff")
        (folder / "a.md").write_text("a again")
        run()
        (folder / "b.md").unlink()
        run()
        end = time.time() + 30
        while time.time() < end and totals.counters()["removes"] < 1:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(totals)
    assert sorted(told, key=repr) == [("a.md", "indexed", None)] * 2 + [("b.md", "indexed", None), ("b.md", "removed", None), ("c.png", "rejected", "unsupported: png"), ("d.md", "rejected", "not UTF-8")]
    counts = totals.counters()
    assert counts == {"upserts": 5, "removes": 1, "indexed": 3, "rejected": 2, "removed": 1}
    assert store.table("rejects").count() == counts["rejected"] and status(store)["files"] == len({"a.md", "b.md"}) - counts["removed"]


def test_differences_of_listings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    reader = _Changes({"path": str(tmp_path / "in"), "state": str(tmp_path / "listings"), "parts": "2"})

    def changes(a, b):
        return sorted((r[0].rpartition("/")[2], r[1], r[2], r[4], r[6]) for part in reader.partitions(a, b) for r in reader.read(part))

    start = reader.initialOffset()
    assert reader.latestOffset() == start
    (tmp_path / "in" / "a").write_text("1")
    (tmp_path / "in" / "b").write_text("22")
    one = reader.latestOffset()
    assert reader.latestOffset() == one != start
    assert changes(start, one) == [("a", "create", "upsert", 1, 1), ("b", "create", "upsert", 1, 2)]
    (tmp_path / "in" / "a").unlink()
    (tmp_path / "in" / "b").write_text("333")
    (tmp_path / "in" / "é").write_text("")
    two = reader.latestOffset()
    assert changes(one, two) == [("a", "remove", "remove", 2, None), ("b", "data", "upsert", 2, 3), ("é", "create", "upsert", 2, 0)]
    assert changes(start, two) == [("b", "create", "upsert", 2, 3), ("é", "create", "upsert", 2, 0)] and reader.partitions(two, two) == []
    reader.commit(two)
    assert [p.name for p in (tmp_path / "listings").iterdir()] == ["2"]


def test_debounce_gives_the_last_kinds_once_it_is_quiet(spark, tmp_path):
    rows = [("w", "/a", "upsert", T0, 1), ("w", "/a", "remove", T0, 2), ("w", "/b", "upsert", T0, 3)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    query = debounced(stream, 300).writeStream.format("memory").queryName("quiet").outputMode("append").trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("quiet").count() < 2:
            time.sleep(0.5)
        assert sorted(map(tuple, spark.table("quiet").collect())) == [("w", "/a", "remove"), ("w", "/b", "upsert")]
    finally:
        query.stop()


def test_other_streams_have_their_batch_meaning(spark, tmp_path):
    rows = [("d", "k", T0, "sync:notify:00000000-0000-0000-0000-000000000001", "m"), ("d", "k", T0, "sync:notify:x", "n")]
    spark.createDataFrame(rows, "device string, key string, ts timestamp, channel string, message string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("device string, key string, ts timestamp, channel string, message string").parquet(str(tmp_path / "in"))
    open_ones = spark.createDataFrame([("00000000-0000-0000-0000-000000000001", 7)], "device string, connection int")

    def all_of(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
        return spark.table(name).collect()

    assert len(all_of(first_uploads(stream), "firsts")) == 1
    assert [(r.requests, r.accepted) for r in all_of(request_counts(stream, 1, "1 minute"), "counts", "update")] == [(2, 1)]
    assert [r.connection for r in all_of(notified(stream.drop("device"), open_ones), "notes")] == [7]
