"""A streaming source of what happens to the files below a folder."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, change string, kind string, ts timestamp, seq long, modified timestamp, length long"
PARTS = 16


def _place(place: str):
    """A folder's file system, its path there, and what stands before such paths in full names."""
    from pyarrow import fs

    if place.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + place.removeprefix("file:").strip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(place.rstrip("/"))
    return system, inner, place.rstrip("/").removesuffix(inner)


def walked(folder: str) -> Iterator[tuple[str, int, int]]:
    """All files below a folder (path, modified in ns, length), one directory after the other; hidden ones are left out."""
    from pyarrow import fs

    system, root, before = _place(folder)
    todo = [root]
    while todo:
        for found in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
            if found.base_name.startswith("."):
                continue
            if found.type == fs.FileType.Directory:
                todo.append(found.path)
            elif found.is_file:
                yield before + found.path, found.mtime_ns or 0, found.size


class Listings:
    """Numbered listings of files in a folder of their own, each dealt over `parts` files by path."""

    def __init__(self, state: str, parts: int) -> None:
        self.parts = parts
        self.system, self.root, _ = _place(state)

    def numbers(self) -> list[int]:
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def part(self, number: int, part: int) -> dict[str, list[int]]:
        if not number:
            return {}
        with self.system.open_input_stream(f"{self.root}/{number}/{part}") as file:
            return {path: what for path, *what in map(json.loads, file.read().decode().splitlines())}

    def about(self, number: int) -> dict:
        """When the listing was made, and a digest of it, in whatever order its entries came."""
        if not number:
            return {"at": 0.0, "digest": 0}
        with self.system.open_input_stream(f"{self.root}/{number}/about") as file:
            return json.loads(file.read())

    def add(self, entries: Iterator[tuple[str, int, int]]) -> int:
        """The number of a listing of these entries: a new one's, or the newest one's if that has the same entries."""
        newest, aside = max(self.numbers(), default=0), f"{self.root}/.{uuid.uuid4().hex}"
        self.system.create_dir(aside)
        files, digest = [self.system.open_output_stream(f"{aside}/{k}") for k in range(self.parts)], 0
        for entry in entries:
            line = json.dumps(entry).encode()
            files[zlib.crc32(entry[0].encode("utf-8", "surrogatepass")) % self.parts].write(line + b"\n")
            digest ^= int.from_bytes(hashlib.blake2b(line, digest_size=16).digest(), "big")
        for file in files:
            file.close()
        before = self.about(newest)
        if digest == before["digest"]:
            self.system.delete_dir(aside)
            return newest
        with self.system.open_output_stream(f"{aside}/about") as file:
            file.write(json.dumps({"at": max(time.time(), before["at"]), "digest": digest}).encode())
        self.system.move(aside, f"{self.root}/{newest + 1}")
        return newest + 1

    def forget(self, before: int) -> None:
        for number in self.numbers():
            if number < before:
                self.system.delete_dir(f"{self.root}/{number}")


@dataclass
class _Part(InputPartition):
    start: int
    end: int
    part: int


class _Changes(DataSourceStreamReader):
    """An offset is a listing's number, so checkpoints stay small however many files there are."""

    def __init__(self, options: dict) -> None:
        self.folder, self.listings = options["path"], Listings(options["state"], int(options.get("parts", PARTS)))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": self.listings.add(walked(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["listing"], end["listing"]
        return [_Part(a, b, k) for k in range(self.listings.parts)] if a != b else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        before, after = (self.listings.part(n, partition.part) for n in (partition.start, partition.end))
        ts = datetime.fromtimestamp(self.listings.about(partition.end)["at"], timezone.utc)
        for path, (changed, length) in after.items():
            if before.get(path) != [changed, length]:
                at = datetime.fromtimestamp(changed // 1000 / 1e6, timezone.utc)
                yield path, "data" if path in before else "create", "upsert", ts, partition.end, at, length
        for path in before.keys() - after.keys():
            yield path, "remove", "remove", ts, partition.end, None, None

    def commit(self, end: dict) -> None:
        self.listings.forget(end["listing"])


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(dict(self.options))


def file_changes(spark: SparkSession, folder: str, state: str, parts: int = PARTS) -> DataFrame:
    """A stream of events (path, change, kind, ts, seq, modified, length): files that came, changed or went below a folder.

    change is create, data or remove; kind what it comes to, upsert or remove. ts is when the listing was made that showed it, seq
    that listing's number; modified and length are the file's. Each batch is the difference of two listings, so none is lost
    and several changes of a file between them are one. A file counts as changed if its time or length differ.

    The listings are kept in `state`, a folder on shared storage that is this stream's own, like its checkpoint; a stream that
    starts again goes on from the listing its checkpoint names. One process walks the folder and holds one directory's entries at once; the
    differences are taken by `parts` tasks, by a hash of the path. Contents aren't read.
    """
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("state", state).option("parts", parts).load(folder)
