"""Tables of an analysed history on disk (S12-S17): Parquet folders, upserts by key, and the packed vector file."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES, MAX_VECTORS, MAX_DIM, NAME_BYTES, PATH_BYTES = 1 << 20, 10_000_000, 4096, 1 << 10, 4 << 10
KINDS = ("file", "function", "type", "doc-section")
VECTORS = "path string, chunk_index long, kind string, name string, start_line long, end_line long, values array<float>"


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def export_json(df: DataFrame, folder: str) -> None:
    """A JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` take the place of rows of equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new)


def replace_table(df: DataFrame, folder: str, name: str) -> str:
    """Write a new version of a table beside the old one, so a table can be replaced by one read from it."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def pack_half(values: list[float]) -> bytes:
    """Half-precision little-endian bytes."""
    return np.asarray(values, "<f2").tobytes()


def unpack_half(data: bytes) -> list[float]:
    return np.frombuffer(data, "<f2").astype(np.float32).tolist()


def encode_sidecar(vectors: pd.DataFrame, meta: dict[str, object]) -> bytes:
    """A length-prefixed JSON header, then records by path: path, kind, lines, name, half-precision vector."""
    dim = len(vectors["values"].iloc[0]) if len(vectors) else 0
    head = json.dumps({**meta, "dim": dim, "count": len(vectors)}, sort_keys=True).encode()
    out = [struct.pack("<I", len(head)), head]
    for r in vectors.sort_values(["path", "chunk_index"]).itertuples(index=False):
        path, name = r.path.encode(), (r.name or "").encode()
        if len(r.values) != dim:
            raise ValueError("vectors differ in size")
        out.append(struct.pack("<H", len(path)) + path + struct.pack("<BII", KINDS.index(r.kind), r.start_line, r.end_line) + struct.pack("<H", len(name)) + name + pack_half(r.values))
    return b"".join(out)


def decode_sidecar(data: bytes) -> tuple[dict[str, object], pd.DataFrame]:
    """The header and rows; anything cut short or beyond the limits is an error."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the file is cut short")
        at += n
        return data[at - n : at]

    size = struct.unpack("<I", take(4))[0]
    if size > HEADER_BYTES:
        raise ValueError("the header is too long")
    head = json.loads(take(size))
    dim, count = int(head["dim"]), int(head["count"])
    if not 0 <= dim <= MAX_DIM or not 0 <= count <= MAX_VECTORS:
        raise ValueError("dim or count is beyond its limit")
    if len(data) - at < count * (2 * dim + 13):
        raise ValueError("the file is cut short")
    rows: list[tuple] = []
    seen: dict[str, int] = {}
    for _ in range(count):
        n = struct.unpack("<H", take(2))[0]
        if n > PATH_BYTES:
            raise ValueError("a path is too long")
        path = take(n).decode()
        kind, start, end = struct.unpack("<BII", take(9))
        n = struct.unpack("<H", take(2))[0]
        if n > NAME_BYTES or kind >= len(KINDS):
            raise ValueError("a name is too long or a kind is unknown")
        name = take(n).decode() or None
        rows.append((path, seen.get(path, 0), KINDS[kind], name, start, end, unpack_half(take(2 * dim))))
        seen[path] = seen.get(path, 0) + 1
    if at != len(data):
        raise ValueError("there are bytes after the last record")
    return head, pd.DataFrame(rows, columns=["path", "chunk_index", "kind", "name", "start_line", "end_line", "values"])


def read_sidecars(files: DataFrame) -> DataFrame:
    """Vectors of packed files given as (path, content), decoded on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield decode_sidecar(bytes(content))[1]

    return files.select("content").mapInPandas(run, VECTORS)
