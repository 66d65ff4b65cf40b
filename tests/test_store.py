import numpy as np
import pytest

from corpuskiln.config import Config
from corpuskiln.operators.embedding import HashEmbedder
from corpuskiln.operators.rerank import Overlap
from corpuskiln.operators.retrieval import hybrid
from corpuskiln.operators.store import TABLES, Store
from corpuskiln.plans.search import index, index_files, previews, reindex, remove, search, status

E = HashEmbedder(32)


@pytest.fixture
def notes(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: x\n---\n# Alpha\nthe quick fox\n")
    (tmp_path / "b.py").write_text("def beta():\n    return 'slow turtle'\n")
    (tmp_path / "c.png").write_bytes(b"\x89PNG")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xff")
    store = Store(spark, str(tmp_path / "store"), 32)
    rejects = index(spark, store, [str(p) for p in sorted(tmp_path.iterdir()) if p.is_file()], E)
    return store, tmp_path, rejects


def test_index_search_remove(spark, notes):
    store, folder, rejects = notes
    assert {r.path.rpartition("/")[2]: r.reason for r in rejects.collect()} == {"c.png": "unsupported: png", "bad.md": "not UTF-8"}
    assert status(store) == {"files": 2, "chunks": 2}
    best = search(store, E, "quick fox", 1).first()
    assert best.file_path.endswith("a.md") and (best.start_line, best.end_line) == (4, 5) and best.score_kind == "distance"
    both = search(store, E, "slow turtle", 5, use_hybrid=True).collect()
    assert both[0].file_path.endswith("b.py") and both[0].score == 1.0 and both[0].score_kind == "rrf"
    assert [r.file_path[-4:] for r in search(store, E, "slow", 5, filter_file_type=["PY"]).collect()] == ["b.py"]
    assert search(store, E, "slow turtle", 5, reranker=Overlap()).first().score == 1.0
    assert search(store, E, "  ").count() == 0
    assert previews(search(store, E, "quick fox", 1)).first().preview == "# Alpha"
    with pytest.raises(ValueError):
        search(store, E, "x", 0)

    before = sorted(map(tuple, store.table("chunks").collect()))
    reindex(spark, store, E)
    assert sorted(map(tuple, store.table("chunks").collect())) == before

    gone = [r.path for r in store.table("files").where("path like '%b.py'").collect()]
    remove(store, gone)
    remove(store, [*gone, "/nowhere"])
    assert status(store) == {"files": 1, "chunks": 1}
    assert all(store.table(t).where("path like '%b.py'").count() == 0 for t in TABLES)

    with pytest.raises(ValueError, match="not absolute"):
        index(spark, store, ["a.md"], E)
    assert [r.reason for r in index(spark, store, [str(folder / "none.md"), str(folder)], E).collect()] == ["missing", "missing"]

    (folder / "a.md").write_text("")
    reindex(spark, store, E)
    assert status(store) == {"files": 1, "chunks": 0}
    (folder / "a.md").unlink()
    reindex(spark, store, E)
    assert status(store) == {"files": 0, "chunks": 0}


class Counting:
    """Counts the texts it embeds in a file, as its copies run in other processes; refuses texts with "refused"."""

    dimension = 4

    def __init__(self, log):
        self.log = str(log)

    def embed(self, texts):
        if any("refused" in t for t in texts):
            raise ValueError("refused")
        with open(self.log, "a") as f:
            f.write("x" * len(texts))
        return np.ones((len(texts), 4))


def texts(spark, rows):
    return spark.createDataFrame([(p, t, "txt", 0, 0) for p, t in rows], "path string, text string, file_type string, last_modified long, line_offset int")


def test_chunks_are_embedded_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    index_files(store, texts(spark, [(f"/{k}.txt", f"text {k}") for k in range(100)]), Counting(tmp_path / "log"))
    assert (tmp_path / "log").stat().st_size == 100 and status(store) == {"files": 100, "chunks": 100}


def test_one_bad_file_is_a_reject_and_keeps_what_it_had(spark, tmp_path):
    store, e = Store(spark, str(tmp_path / "store"), 4), Counting(tmp_path / "log")
    assert index_files(store, texts(spark, [("/a.txt", "old a"), ("/b.txt", "old b")]), e).count() == 0
    deep = "def f():\n  return " + "(" * 20000 + ")" * 20000
    rejects = index_files(store, texts(spark, [("/a.txt", "refused\n" * 200), ("/b.txt", "new b"), ("/c.py", deep), ("/d.txt", "refused")]), e).collect()
    assert {r.path: r.reason for r in rejects} == {"/a.txt": "embedding: ValueError('refused')", "/d.txt": "embedding: ValueError('refused')"}
    kept = {r.path: r.content for r in store.table("chunks").where("path < '/c'").collect()}
    assert kept == {"/a.txt": "old a", "/b.txt": "new b"} and status(store)["files"] == 3
    assert {r.path for r in store.table("rejects").collect()} == {"/a.txt", "/d.txt"}
    assert index_files(store, texts(spark, [("/a.txt", "a again")]), e).count() == 0
    assert {r.path for r in store.table("rejects").collect()} == {"/d.txt"}


def test_a_change_shows_in_all_tables_or_in_none(spark, tmp_path, monkeypatch):
    store, e = Store(spark, str(tmp_path / "store"), 4), Counting(tmp_path / "log")
    index_files(store, texts(spark, [("/a.txt", "one a"), ("/b.txt", "one b")]), e)
    before = {t: sorted(map(str, store.table(t).collect())) for t in TABLES}
    plain = Store._write

    def stops(self, change, name, rows):
        if name == "postings":
            raise RuntimeError("lost")
        return plain(self, change, name, rows)

    monkeypatch.setattr(Store, "_write", stops)
    with pytest.raises(RuntimeError, match="lost"):
        index_files(store, texts(spark, [("/a.txt", "two a")]), e)
    monkeypatch.undo()
    assert {t: sorted(map(str, store.table(t).collect())) for t in TABLES} == before
    # Two writers that have read the same log: both changes stay.
    other = Store(spark, str(tmp_path / "store"), 4)
    plain_latest, once = Store._latest, []

    def late(self):
        found = plain_latest(self)
        if self is store and not once:
            once.append(1)
            other.remove(["/b.txt"])
        return found

    monkeypatch.setattr(Store, "_latest", late)
    index_files(store, texts(spark, [("/c.txt", "one c")]), e)
    monkeypatch.undo()
    assert sorted(r.path for r in store.table("files").collect()) == ["/a.txt", "/c.txt"]
    (tmp_path / "store" / "_log" / "000000099").write_text("[")  # half written
    assert status(store) == {"files": 2, "chunks": 2}
    (tmp_path / "store" / "_log" / "000000099").unlink()
    before = {t: sorted(map(str, store.table(t).collect())) for t in TABLES}
    store.compact()
    store.vacuum()
    assert {t: sorted(map(str, store.table(t).collect())) for t in TABLES} == before
    assert len(list((tmp_path / "store" / "changes").iterdir())) == 1 and len(list((tmp_path / "store" / "_log").glob("0*"))) == 1


def test_two_compactions_that_meet(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, str(tmp_path / "store"), 4) for _ in range(2))
    e = Counting(tmp_path / "log")
    for k in range(3):
        index_files(one, texts(spark, [(f"/{k}.txt", f"text {k}"), ("/same.txt", f"same {k}")]), e)
    before = {t: sorted(map(str, one.table(t).collect())) for t in TABLES}
    plain, once = Store._commit, []

    def late(self, update):
        if self is two and not once:  # two has read the live changes and written them; one is first
            once.append(1)
            index_files(one, texts(spark, [("/new.txt", "meanwhile")]), e)
            assert one.compact()
        return plain(self, update)

    monkeypatch.setattr(Store, "_commit", late)
    assert not two.compact()
    monkeypatch.undo()
    assert status(two) == {"files": 5, "chunks": 5} and len(two._latest()[1]) == 1
    assert sorted(map(str, two.table("postings").where("path <> '/new.txt'").collect())) == before["postings"]
    # A change that comes between a compaction's reading and its commit stays after it.
    once.clear()

    def between(self, update):
        if self is two and not once:
            once.append(1)
            one.remove(["/new.txt"])
        return plain(self, update)

    monkeypatch.setattr(Store, "_commit", between)
    assert two.compact()
    monkeypatch.undo()
    assert {t: sorted(map(str, two.table(t).collect())) for t in TABLES} == before
    reading = two.table("files")
    two.compact()
    assert reading.count() == 4  # what a reader had before a compaction stays readable
    assert len(list((tmp_path / "store" / "changes").iterdir())) > 1
    two.vacuum()
    assert len(list((tmp_path / "store" / "changes").iterdir())) == 1 and status(two) == {"files": 4, "chunks": 4}


@pytest.mark.parametrize("torn", ["", '[{"id": "x", "ta'])
def test_a_torn_log_entry_stops_nothing(spark, tmp_path, torn):
    store = Store(spark, str(tmp_path / "store"), 4)
    index_files(store, texts(spark, [("/a.txt", "one"), ("/b.txt", "two")]), Counting(tmp_path / "log"))
    (tmp_path / "store" / "_log" / "000000002").write_text(torn)
    store.remove(["/a.txt"])
    assert status(store) == {"files": 1, "chunks": 1}
    assert sorted(p.name for p in (tmp_path / "store" / "_log").glob("0*"))[-1] == "000000003"
    (tmp_path / "store" / "_log" / "000000004").write_text(torn)
    store.vacuum()
    assert status(store) == {"files": 1, "chunks": 1}


def test_many_changes_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corpuskiln.operators.store.MOST_CHANGES", 4)
    store = Store(spark, str(tmp_path / "store"), 4)
    for k in range(6):
        index_files(store, texts(spark, [(f"/{k}.txt", f"text {k}")]), Counting(tmp_path / "log"))
    assert status(store) == {"files": 6, "chunks": 6} and len(store._latest()[1]) < 4


def test_links_and_files_that_turn_unreadable(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"), 32)
    folder.mkdir()
    (folder / "real.md").write_text("# real")
    (folder / "link.md").symlink_to(folder / "real.md")
    (folder / "again.md").symlink_to("link.md")
    (folder / "dangling.md").symlink_to("nowhere.md")
    (folder / "loop.md").symlink_to("loop.md")
    (folder / "empty.txt").write_text("")
    names = ("real.md", "link.md", "again.md", "dangling.md", "loop.md", "empty.txt")
    paths = spark.createDataFrame([(str(folder / n),) for n in names] + [("rel.md",), (None,), (f"file:{folder}/real.md",)], "path string")
    rejects = {r.path.rpartition("/")[2]: r.reason for r in index(spark, store, paths, E).collect()}
    assert rejects.pop("loop.md").startswith("unreadable") and rejects == {"dangling.md": "missing", "rel.md": "not absolute"}
    assert [r.path.rpartition("/")[2] for r in store.table("files").orderBy("path").collect()] == ["empty.txt", "real.md"]
    (folder / "real.md").write_bytes(b"\xff\xfe")
    assert [r.reason for r in reindex(spark, store, E).collect()] == ["not UTF-8"]
    assert status(store) == {"files": 2, "chunks": 1} and store.table("rejects").where("reason = 'not UTF-8'").count() == 1
    # A stored file that becomes a link to another one is no file of its own any more.
    (folder / "other.md").write_text("# other")
    (folder / "real.md").unlink()
    (folder / "real.md").symlink_to("other.md")
    assert reindex(spark, store, E).count() == 0
    assert [r.path.rpartition("/")[2] for r in store.table("files").orderBy("path").collect()] == ["empty.txt", "other.md"]


def test_search_reads_the_index_and_survives_its_reranker(spark, notes):
    class Broken:
        def scores(self, query, content):
            raise RuntimeError("no model")

    store = notes[0]
    plain = search(store, E, "slow turtle", 5, config=Config(hybrid_search=True))
    assert plain.first().score_kind == "rrf"
    assert search(store, E, "slow turtle", 5, reranker=Broken()).collect() == search(store, E, "slow turtle", 5).collect()
    assert search(store, E, "slow turtle", 5, config=Config(relevance_threshold=0.999)).count() == 0
    assert search(store, E, "slow turtle", 5, threshold=0.0, config=Config(relevance_threshold=0.999)).count() == 2
    pieces = store.table("chunks").withColumnRenamed("path", "file_path")
    q = E.embed(["the fox"])[0].tolist()
    a = hybrid(store.table("vectors"), None, q, "the fox", 5, index=(store.table("postings"), store.table("lengths")))
    assert a.collect() == hybrid(store.table("vectors"), pieces, q, "the fox", 5).collect()


def test_wrong_dimension_changes_nothing(spark, notes):
    store = notes[0]
    files = spark.createDataFrame([("/x.txt", "txt", 0, 0)], "path string, file_type string, last_modified long, last_indexed long")
    chunks = spark.createDataFrame([("/x.txt", 0, 1, 1, "x", [1.0])], "path string, chunk_index int, start_line int, end_line int, content string, embedding array<float>")
    with pytest.raises(Exception, match="dimension 32 expected, got 1"):
        store.upsert(files, chunks)
    assert status(store) == {"files": 2, "chunks": 2}


def test_index_and_search_is_brute_force(spark):
    """The registered query, with its chunkers, vectors and order done again in plain Python."""
    import pyarrow.parquet as pq
    import xxhash

    from corpuskiln.operators.chunking import OVERLAP, SIZE, fallback
    from corpuskiln.queries import QUERIES

    data, embedder = "/root/testdata/sf0.001", HashEmbedder(64)
    found, vectors = [], []
    for row in pq.read_table(f"{data}/documents.parquet").to_pylist():
        path = f"/data/{row['doc_id']}.txt"
        for k, c in enumerate(fallback(row["text"], path, SIZE, OVERLAP) if row["text"] else []):
            h = xxhash.xxh64_intdigest(path.encode(), 42)
            h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), h)
            found.append((h - (1 << 64) if h >> 63 else h, path, c.start_line, c.end_line, c.content))
    for at in range(0, len(found), 500):
        vectors.append(embedder.embed([f[4] for f in found[at : at + 500]]))
    distance = np.sqrt(((np.concatenate(vectors).astype(np.float32).astype(float) - embedder.embed(["the attention of the station"])[0]) ** 2).sum(1))
    order = sorted(range(len(found)), key=lambda i: (round(float(distance[i]), 6), found[i][0]))[:20]
    got = sorted(QUERIES["index_and_search"](spark, data).collect(), key=lambda r: (r.score, r.chunk_id))
    assert [(r.chunk_id, r.file_path, r.start_line, r.end_line) for r in got] == [found[i][:4] for i in order]
    assert np.allclose([r.score for r in got], [distance[i] for i in order], atol=1e-6)
