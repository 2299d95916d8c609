"""Byte ranges of files as rows, hashed where they are read.

A file is cut into ranges of ``chunk_bytes``; a partition is a list of ranges of about
``partition_bytes`` in all, so a large file is spread over many tasks and no file is
ever one row.  Only names and sizes are listed on the driver, as for any file source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from typing import Any

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_BYTES = 4 << 20
PARTITION_BYTES = 128 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain local path, and the path in it."""
    if re.match(r"file:/(?!//)", path):
        return pafs.LocalFileSystem(), path[5:]
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges        # (path, chunk, offset, length)


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.chunk = int(options.get("chunk_bytes", CHUNK_BYTES))
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.hidden = options.get("hidden", "false").lower() == "true"
        if self.chunk < 1:
            raise ValueError("chunk_bytes must be positive")
        system, self.root = file_system(self.path)
        self.pattern: list[str] = []
        steps = self.root.rstrip("/").split("/")
        wild = next((i for i, x in enumerate(steps) if re.search(r"[*?\[]", x)), None)
        if wild is not None and system.get_file_info(self.root).type == pafs.FileType.NotFound:
            self.root, self.pattern = "/".join(steps[:wild]) or "/", steps[wild:]
        self.cut = len(self.root.rstrip("/")) + 1

    def _files(self) -> list[tuple[str, int]]:
        system, _ = file_system(self.path)
        found = system.get_file_info(pafs.FileSelector(self.root, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and self._named(f.path)
                      and (self.hidden or not f.base_name.startswith(("_", "."))))

    def _named(self, path: str) -> bool:
        """True below what the pattern names, step by step."""
        steps = path[self.cut:].split("/")
        return len(steps) >= len(self.pattern) and all(map(fnmatchcase, steps, self.pattern))

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        now: list[tuple[str, int, int, int]] = []
        held = 0
        for path, size in self._files():
            for i in range(max(1, -(-size // self.chunk))):
                length = min(self.chunk, size - i * self.chunk)
                if now and held + length > self.most:
                    parts.append(_Ranges(now))
                    now, held = [], 0
                now.append((path, i, i * self.chunk, length))
                held += length
        return [*parts, _Ranges(now)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for path, i, offset, length in partition.ranges:        # type: ignore[attr-defined]
            with system.open_input_file(path) as f:
                f.seek(offset)
                data = f.read(length)
            if len(data) != length:
                raise ValueError(f"{path} became shorter while it was hashed")
            yield path[self.cut:], i, length, hashlib.sha256(data).digest()


class FileChunks(DataSource):
    """Rows (name, chunk, n_bytes, digest) for every range of the files below ``path``;
    ``name`` is relative to it, an empty file has one empty range."""

    @classmethod
    def name(cls) -> str:
        return "file_chunks"

    def schema(self) -> str:
        return "name string, chunk long, n_bytes long, digest binary"

    def reader(self, schema: Any) -> DataSourceReader:
        return _ChunkReader(dict(self.options))


def file_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, partition_bytes: int = PARTITION_BYTES,
                hidden: bool = False) -> DataFrame:
    """SHA-256 of every byte range of the files below a shared folder, or below what a
    pattern (``*``, ``?``, ``[...]``) names; names are relative to the folder above the
    pattern. Names that start
    with ``_`` or ``.`` are left out unless ``hidden``."""
    spark.dataSource.register(FileChunks)
    return (spark.read.format("file_chunks").option("path", path).option("chunk_bytes", str(chunk_bytes))
            .option("partition_bytes", str(partition_bytes)).option("hidden", str(hidden).lower()).load())
