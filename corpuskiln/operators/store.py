"""Index tables: replacing and removing files with their chunks, vectors and postings."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import has_dimension, normalised
from ..session import shuffles_deleted
from .retrieval import postings

MOST_CHANGES = 32
_PIECES = "chunk_id long, path string, chunk_index int, start_line int, end_line int, content string"
#: What is written: a chunk's vector and length are columns of its row, so that a scan reads the ones it names.
WRITTEN = {
    "files": "path string, file_type string, last_modified long, last_indexed long",
    "chunks": f"{_PIECES}, embedding array<float>, length long",
    "postings": "term string, chunk_id long, tf long, positions array<int>",
    "rejects": "path string, reason string",
    "gone": "path string",
}
#: What is read, by table: where its rows are, and their columns.
TABLES = {
    "files": ("files", WRITTEN["files"]),
    "chunks": ("chunks", _PIECES),
    "vectors": ("chunks", "chunk_id long, path string, embedding array<float>"),
    "postings": ("postings", f"{WRITTEN['postings']}, path string"),
    "lengths": ("chunks", "chunk_id long, path string, length long"),
    "rejects": ("rejects", WRITTEN["rejects"]),
}


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def chunk_id(path: Column, index: Column) -> Column:
    """The same chunk gets the same id in every run."""
    return F.xxhash64(path, index)


def removed(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Existing rows whose key isn't among keys; unknown keys change nothing."""
    return existing.join(keys.select(key).distinct(), key, "left_anti").select(*existing.columns)


def with_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors as they are; a job that meets one of another dimension fails. Rows with an error have none to be looked at."""
    wrong = F.concat(F.lit(f"dimension {dimension} expected, got "), F.size("embedding").cast("string"))
    sound = has_dimension(F.col("embedding"), dimension)
    sound = sound | F.col("error").isNotNull() if "error" in vectors.columns else sound
    return vectors.where(F.when(sound, True).otherwise(F.raise_error(wrong).cast("boolean")))


class Store:
    """Parquet tables as a log of changes, under one folder.

    A change writes its rows to a folder of its own. One small file, `_log/<number>`, then lists all live changes with their tables; it is
    written aside and gets its name by a rename that replaces nothing, so a change shows in all tables at once or in
    none, and of two writers the second one commits on top of the first. A row is live unless a later change has its path among its files
    or its `gone` paths. From MOST_CHANGES on, compact() writes the live rows as one change; vacuum()
    deletes what no log entry lists. The same change run again leaves the same rows.

    The file system's rename must not replace a file if it is told so, as in HDFS.
    """

    def __init__(self, spark: SparkSession, root: str, dimension: int) -> None:
        self.spark, self.root, self.dimension = spark, root.rstrip("/"), dimension

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("_log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, list[dict]]:
        """The highest number in the log, and the live changes of the newest whole entry, oldest first."""
        fs, log = self._fs(), self._path("_log")
        names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
        numbers = sorted((int(n) for n in names if n.isdigit()), reverse=True)
        for n in numbers:
            entry = fs.open(self._path(f"_log/{n:09d}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(entry, "UTF-8")
            finally:
                entry.close()
            if text.endswith("]"):  # else it broke off; the next entry's number is beyond it
                return numbers[0], json.loads(text)
        return (numbers or [0])[0], []

    def _commit(self, update: Callable[[list[dict]], list[dict] | None]) -> bool:
        """Makes what update returns for the live changes the newest entry; False if that is None."""
        jvm, aside = self.spark._jvm, self._path(f"_log/.{uuid.uuid4().hex}")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        replace_nothing = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        while True:
            number, live = self._latest()
            newer = update(live)
            if newer is None:
                return False
            out = self._fs().create(aside, True)
            out.write(bytearray(json.dumps(newer).encode()))
            out.close()
            try:
                files.rename(aside, self._path(f"_log/{number + 1:09d}"), replace_nothing)
                return True
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                    raise

    def _read(self, live: list[dict], written: str, schema: str) -> DataFrame:
        """The rows of these changes with `_at`, the change's place among them."""
        places = {c["id"]: k for k, c in enumerate(live) if written in c["tables"]}
        if not places:
            return self.spark.createDataFrame([], f"{schema}, _at int")
        rows = self.spark.read.schema(f"{schema}, change string").parquet(*(f"{self.root}/changes/{c}/{written}" for c in places))
        at = F.create_map(*(F.lit(x) for place in places.items() for x in place))
        return rows.withColumn("_at", at[F.col("change")]).drop("change")

    def _alive(self, live: list[dict], written: str, schema: str) -> DataFrame:
        """The rows that no later change replaces or removes, with `_at`."""
        if written == "postings":  # they go with their chunks, and have their paths
            return self._read(live, written, WRITTEN[written]).join(self._alive(live, "chunks", "chunk_id long, path string"), ["chunk_id", "_at"])
        rows = self._read(live, written, schema)
        if len(live) > 1:
            later = ["gone", "files", *(["rejects"] if written == "rejects" else [])]
            gone = [self._read(live, name, "path string") for name in later if any(name in c["tables"] for c in live)]
            if gone:
                until = functools.reduce(DataFrame.unionAll, gone).groupBy(F.col("path").alias("_path")).agg(F.max("_at").alias("_until"))
                rows = rows.join(until, (F.col("path") == F.col("_path")) & (F.col("_at") < F.col("_until")), "left_anti")
        return rows

    def _live(self, live: list[dict], written: str, schema: str) -> DataFrame:
        return self._alive(live, written, schema).select(_names(schema))

    def tables(self, *names: str) -> list[DataFrame]:
        """Several tables as one log entry has them."""
        live = self._latest()[1]
        return [self._live(live, *TABLES[name]) for name in names]

    def table(self, name: str) -> DataFrame:
        return self.tables(name)[0]

    def _write(self, change: dict, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/changes/{change['id']}/{name}"
        with shuffles_deleted(self.spark):
            rows.withColumn("change", F.lit(change["id"])).write.option("compression", "zstd").parquet(path)
        change["tables"].append(name)
        return self.spark.read.schema(rows.schema).parquet(path)

    def upsert(self, files: DataFrame, chunks: DataFrame, rejects: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
        """Replaces all that is stored of these files, in one change; returns rejects (path, reason).

        files (path, file_type, last_modified, last_indexed); chunks (path, chunk_index, start_line, end_line, content,
        embedding, and, if given, chunk_id and error). Chunks are computed once, by the write of their table; tasks sort their own rows by
        chunk_id, and postings by term, so that lookups read few pages; compaction sorts the whole tables. A file without chunks loses its old ones. A file
        with an error in any chunk is a reject and keeps what it had. rejects are such files as came to nothing before, gone (path) what is to
        be removed by the same change.
        """
        change = {"id": uuid.uuid4().hex, "tables": []}
        given = chunks if "error" in chunks.columns else chunks.withColumn("error", F.lit(None).cast("string"))
        given = given if "chunk_id" in chunks.columns else given.withColumn("chunk_id", chunk_id(F.col("path"), F.col("chunk_index")))
        vector = normalised(F.col("embedding")).cast("array<float>").alias("embedding")
        length = F.size(words(F.coalesce("content", F.lit("")))).cast("long").alias("length")
        given = with_dimension(given, self.dimension).select(*_names(_PIECES), vector, length, "error").sortWithinPartitions("chunk_id")
        errors = Observation()
        written = self._write(change, "chunks", given.observe(errors, F.count("error").alias("n")))
        bad = written.where("error is not null").groupBy("path").agg(F.min("error").alias("reason"))
        bad = bad.unionByName(rejects.select("path", "reason")) if rejects is not None else bad
        none = not errors.get["n"] and (rejects is None or rejects.isEmpty())
        if not none:
            bad = self._write(change, "rejects", bad)
            change["tables"].remove("chunks")
            path = self._path(f"changes/{change['id']}/chunks")
            self._fs().rename(path, self._path(f"changes/{change['id']}/_staged"))
            staged = self.spark.read.schema(written.schema).parquet(f"{self.root}/changes/{change['id']}/_staged")
            written = self._write(change, "chunks", removed(staged, bad, "path").sortWithinPartitions("chunk_id"))
            self._fs().delete(self._path(f"changes/{change['id']}/_staged"), True)
        kept = files.select(_names(WRITTEN["files"]))
        self._write(change, "files", kept if none else removed(kept, bad, "path"))
        self._write(change, "postings", postings(written)[0])
        if gone is not None:
            self._write(change, "gone", gone.select("path").distinct())
        self._commit(lambda live: [*live, change])
        self._compact_if_long()
        return bad if not none else self.spark.createDataFrame([], WRITTEN["rejects"])

    def remove(self, paths: Iterable[str] | DataFrame) -> None:
        given = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
        change = {"id": uuid.uuid4().hex, "tables": []}
        self._write(change, "gone", given.select("path").distinct())
        self._commit(lambda live: [*live, change])
        self._compact_if_long()

    def _compact_if_long(self) -> None:
        if len(self._latest()[1]) >= MOST_CHANGES:
            self.compact()

    def compact(self) -> bool:
        """Writes the live rows as one change; changes that others commit meanwhile stay after it. If another compaction
        was first, its work stands and this one's is thrown away."""
        old, change = self._latest()[1], {"id": uuid.uuid4().hex, "tables": []}
        for name, by in (("files", ["path"]), ("chunks", ["chunk_id"]), ("postings", ["term", "chunk_id"]), ("rejects", ["path"])):
            self._write(change, name, self._live(old, name, WRITTEN[name]).repartitionByRange(*by).sortWithinPartitions(*by))
        done = self._commit(lambda live: [change, *live[len(old) :]] if live[: len(old)] == old else None)
        if not done:
            self._fs().delete(self._path(f"changes/{change['id']}"), True)
        return done

    def vacuum(self) -> None:
        """Deletes changes that the newest log entry doesn't list, and older entries. Nobody may be reading them or writing."""
        self._commit(lambda live: live)  # so that the entry with the highest number is whole
        number, live = self._latest()
        fs = self._fs()
        for folder, keep in (("changes", {c["id"] for c in live}), ("_log", {f"{number:09d}"})):
            for status in fs.listStatus(self._path(folder)):
                if status.getPath().getName() not in keep:
                    fs.delete(status.getPath(), True)

    def stats(self) -> DataFrame:
        """One row: files and chunks."""
        files, lengths = self.tables("files", "lengths")
        return files.agg(F.count(F.lit(1)).alias("files")).join(F.broadcast(lengths.agg(F.count(F.lit(1)).alias("chunks"))))
