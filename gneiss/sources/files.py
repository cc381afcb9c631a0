"""Python data source of the files below a folder (S8-S11): hidden names are listed too, which Spark's own sources skip.

Options: ``includeHidden`` (default false), ``maxBytes``, ``content`` (default true), ``partitions`` (by default one for
each thousand files, eight at least).  Git's ignore
rules are followed where the folder is a work tree and ``gitignore`` isn't false.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAX_BYTES = 5 << 20
FILES_PER_PARTITION, BATCH_BYTES = 1000, 4 << 20
SCHEMA = "path string, size long, content binary"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


@dataclass
class FilesPartition(InputPartition):
    paths: list[str]


def listed(root: str, hidden: bool = False, gitignore: bool = True) -> list[str]:
    """Paths relative to the root, sorted."""
    found: list[str] = []
    if gitignore and os.path.isdir(os.path.join(root, ".git")):
        done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=False)
        if done.returncode == 0:
            found = [p.decode("utf-8", "surrogateescape") for p in done.stdout.split(b"\0") if p]
            found = [p for p in found if os.path.isfile(os.path.join(root, p))]
    if not found:
        for folder, inner, names in os.walk(root):
            inner[:] = sorted(d for d in inner if d != ".git")
            found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names]
    if not hidden:
        found = [p for p in found if not any(part.startswith(".") for part in p.split("/"))]
    return sorted(set(found))


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        flag = lambda name, default: options.get(name.lower(), default).lower() == "true"  # noqa: E731 - Spark hands option names over in lower case
        self.root = options["path"].removeprefix("file://")
        self.hidden, self.content, self.gitignore = flag("includeHidden", "false"), flag("content", "true"), flag("gitignore", "true")
        self.max_bytes, self.parts = int(options.get("maxbytes", MAX_BYTES)), int(options.get("partitions", 0))

    def partitions(self) -> list[FilesPartition]:
        paths = listed(self.root, self.hidden, self.gitignore)
        parts = self.parts or max(8, -(-len(paths) // FILES_PER_PARTITION))
        return [FilesPartition(paths[i::parts]) for i in range(min(parts, max(len(paths), 1)))]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, bytes | None]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

        for path in partition.paths:
            full = os.path.join(self.root, path)
            try:
                size = os.path.getsize(full)
                if size > self.max_bytes:
                    continue
                data = None
                if self.content:
                    with open(full, "rb") as f:
                        data = f.read()
            except OSError:  # gone since it was listed
                continue
            rows.append((path, size, data))
            held += len(data or b"") + 100
            if held > BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gneiss_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FilesReader(dict(self.options))


def read_files(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """(path, size, content) of the files below a folder that all executors can reach."""
    import gneiss.sources.files as module

    cloudpickle.register_pickle_by_value(module)  # planning workers don't get the driver's module path
    spark.dataSource.register(FilesSource)
    reader = spark.read.format("gneiss_files")
    for name, value in options.items():
        reader = reader.option(name, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load(root)
