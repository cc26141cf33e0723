"""Tar shards as a Spark data source: ``spark.read.format("tarshards")``.

Each shard is read by one task, member after member, from the shard's own file system. Options:

- ``paths``: the shards' paths, a JSON list
- ``fields``: fields to read (a JSON list); the bytes of others are skipped. A sample without any of them has no fields
- ``on_error``: ``fail``, or ``skip``: what a broken shard held up to the break is kept
- ``mode``: ``members``, ``samples`` (members put together by key, without a shuffle; only those that have
  begun are held) or ``names`` (the fields there are, from the headers)
"""

from __future__ import annotations

import io
import json
import posixpath
import tarfile
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS = "shard string, member string, pos int, content binary, error string"
NAMES = "shard string, field string, error string"
SAMPLES = "shard string, __key__ string, __url__ string, pos int, fields map<string,binary>, error string"


class _Shard(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _open(path: str) -> Any:
    """A file of a local path, or of any file system that pyarrow has; one can seek in it."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def members(path: str, fields: Sequence[str] | None = None, stream: Any = None, content: bool = True) -> Iterator[tuple[str, int, bytes | None]]:
    """(path within the shard's, place, content) of each file in a tar; folders and links are left out.

    Content is None, and isn't read, for fields that aren't among ``fields``, and for all without ``content``.
    """
    with (stream or _open(path)) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
        for pos, entry in enumerate(tar):
            tar.members = []  # else it keeps them all
            if not entry.isfile():
                continue
            name = posixpath.normpath(posixpath.join(path, entry.name))
            wanted = content and (fields is None or field_of(name) in fields)
            yield name, pos, tar.extractfile(entry).read() if wanted else None


def field_of(name: str) -> str:
    return name.rsplit("/", 1)[-1].partition(".")[2]


def last_places(rows: Iterator[tuple[str, int, bytes | None]]) -> dict[str, int]:
    """Where each key's last member is. What lies behind a break isn't seen."""
    last: dict[str, int] = {}
    try:
        for name, pos, _ in rows:
            last[posixpath.basename(name).partition(".")[0]] = pos
    except (tarfile.TarError, OSError, EOFError):
        pass
    return last


def assemble(rows: Iterator[tuple[str, int, bytes | None]], last: dict[str, int] | None = None) -> Iterator[tuple[str, str, int, dict[str, bytes]]]:
    """(key, url, place of the first, fields) of members; those of one key needn't be neighbours. The last of a field counts.

    ``last``: where each key's last member is; so a sample goes as soon as it is whole, and only those
    that have begun are held. Without, all are held to the end.
    """
    held: dict[str, list] = {}
    for name, pos, content in rows:
        url, base = posixpath.split(name)
        key, _, field = base.partition(".")
        sample = held.setdefault(key, [url, pos, {}])
        if content is not None:
            sample[2][field] = content
        if last is not None and pos >= last.get(key, pos):
            yield key, *held.pop(key)
    for key, (url, pos, fields) in held.items():
        yield key, url, pos, fields


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options.get("paths", "[]"))
        self.fields = json.loads(options["fields"]) if options.get("fields") else None
        self.skip = options.get("on_error", "fail") == "skip"
        self.samples, self.names = (options.get("mode", "members") == x for x in ("samples", "names"))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Shard(p) for p in self.paths] or [_Shard("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.path
        if not path:
            return
        broken: list[str] = []

        def each() -> Iterator[tuple[str, int, bytes]]:
            try:
                yield from members(path, self.fields, content=not self.names)
            except (tarfile.TarError, OSError, EOFError) as problem:
                if _empty(path):
                    return
                if not self.skip:
                    raise
                broken.append(f"{type(problem).__name__}: {problem}")

        if self.samples:
            for key, url, pos, fields in assemble(each(), last_places(members(path, content=False))):
                yield path, key, url, pos, fields, None
        elif self.names:
            for field in sorted({field_of(name) for name, _, _ in each()}):
                yield path, field, None
        else:
            for name, pos, content in each():
                if content is not None:
                    yield path, name, pos, content, None
        for message in broken:
            yield (path, *[None] * (4 if self.samples else 1 if self.names else 3), message)


def _empty(path: str) -> bool:
    """A tar without members is nothing but zeros."""
    try:
        with _open(path) as raw:
            return not raw.read(io.DEFAULT_BUFFER_SIZE).strip(b"\0")
    except OSError:
        return False


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return {"samples": SAMPLES, "names": NAMES}.get(self.options.get("mode", "members"), MEMBERS)

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tars(spark: SparkSession, paths: Sequence[str], mode: str = "members", fields: Sequence[str] | None = None, on_error: str = "fail") -> DataFrame:
    """Members or samples of tar shards; broken shards have a row with ``error`` set under ``skip``."""
    spark.dataSource.register(TarShards)
    reader = spark.read.format("tarshards").option("paths", json.dumps(list(paths))).option("mode", mode).option("on_error", on_error)
    if fields is not None:
        reader = reader.option("fields", json.dumps(list(fields)))
    return reader.load()
