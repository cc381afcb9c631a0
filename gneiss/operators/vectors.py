"""Vector operators (V4-V10, J19, J20, A18): built-in array functions in double precision.

Only the comparison of all pairs is a matrix product on the executors, by blocks; nothing is broadcast by its own size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTLIER_DISTANCE = 0.15
DUPLICATE_SIMILARITY = 0.92
MIN_FILES = 5
BLOCK_ROWS = 2048
PRESETS = {"compact": ("file", 128), "balanced": ("function", 256), "maximum": ("function", 768)}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """V7: similarity, 0 for a zero vector, kept within [-1, 1]."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.when(scale == 0, 1.0).otherwise(scale))))


def truncated(values: Column, dim: int) -> Column:
    """V4: the first ``dim`` components at unit length; a vector of that size stays, a shorter one is an error."""
    head = F.slice(values, 1, dim)
    size = norm(head)
    unit = F.when(size == 0, head.cast("array<double>")).otherwise(F.transform(head, lambda x: x.cast("double") / size))
    short = F.raise_error(F.concat(F.lit(f"dim {dim} exceeds the native size "), F.size(values).cast("string")))
    return F.when(F.size(values) > dim, unit).when(F.size(values) == dim, values.cast("array<double>")).otherwise(short.cast("array<double>"))


def centroids(vectors: DataFrame) -> DataFrame:
    """(path, centroid) by element-wise mean; a file's vectors are of one size."""
    return _means(vectors.select("path", "values", F.lit(1).cast("long").alias("n")), "path").select("path", F.col("mean").alias("centroid"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum a key and batch of (key, values, n), so what is shuffled is in proportion to keys, not to components."""
    for b in batches:
        if not b.num_rows:
            continue
        keys, which = np.unique(b.column("key").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        values, sizes = b.column("values").flatten().to_numpy().astype(float), np.diff(b.column("values").offsets.to_numpy())
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            at = np.repeat(np.cumsum(sizes)[rows] - size, size) + np.tile(np.arange(size), len(rows))
            some, place = np.unique(which[rows], return_inverse=True)
            total = np.zeros((len(some), size))
            np.add.at(total, place, values[at].reshape(len(rows), size))
            n = np.bincount(place, weights=b.column("n").to_numpy()[rows]).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * size).astype(np.int32)), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[some], pa.string()), lists, pa.array(n)], names=["key", "values", "n"])


def _means(rows: DataFrame, key: str) -> DataFrame:
    """(key, mean, n) of the element-wise sums (key, values, n)."""
    schema = "key string, values array<double>, n long"
    part = rows.select(F.col(key).alias("key"), F.col("values").cast("array<double>").alias("values"), "n")
    part = part.mapInArrow(_summed, schema)
    whole = part.repartition("key").sortWithinPartitions("key").mapInArrow(_summed, schema)
    # a key that spans batches has a sum of each
    return whole.groupBy("key").agg(F.collect_list("values").alias("sums"), F.sum("n").alias("n")).select(F.col("key").alias(key), F.transform(F.aggregate(F.slice(F.col("sums"), 2, F.size("sums")), F.col("sums")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y)), lambda x: x / F.col("n")).alias("mean"), "n")


def outliers(vectors: DataFrame, top: int = 10, min_distance: float = OUTLIER_DISTANCE) -> DataFrame:
    """V8: (path, distance, score): the farthest from the mean of means; the cut comes after the top."""
    own = centroids(vectors)
    mean = _means(own.select(F.lit("all").alias("key"), F.col("centroid").alias("values"), F.lit(1).cast("long").alias("n")), "key").select("mean")
    count = own.agg(F.count(F.lit(1)).alias("files"))
    far = own.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(count)).where(F.col("files") >= MIN_FILES)  # one row each
    far = far.select("path", F.round(1 - cosine(F.col("centroid"), F.col("mean")), 6).alias("distance"))
    most = far.agg(F.greatest(F.max("distance"), F.lit(1e-6)).alias("most"))
    best = far.orderBy(F.desc("distance"), "path").limit(top).where(F.col("distance") > min_distance)
    return best.crossJoin(F.broadcast(most)).select("path", "distance", F.round(5 + F.least(F.col("distance") / F.col("most"), F.lit(1.0)) * 4, 6).alias("score"))


_PAIRS = "id_a long, id_b long, path_a string, path_b string, similarity double"


def similar_pairs(vectors: DataFrame, threshold: float = DUPLICATE_SIMILARITY, blocks: int | None = None) -> DataFrame:
    """(id_a, id_b, path_a, path_b, similarity) of vectors in different files, exact; zero vectors have no pair.

    Vectors are dealt into blocks of about ``BLOCK_ROWS`` and each pair of blocks meets in one group, where it is one
    matrix product.  A task holds two blocks whatever the data; the work is quadratic all the same.
    """
    if blocks is None:
        blocks = max(1, math.ceil(vectors.count() / BLOCK_ROWS))
    rows = vectors.select("id", "path", "values", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "path", "values", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def meet(pair: pd.DataFrame) -> pd.DataFrame:
        x, y = pair["x"].iloc[0], pair["y"].iloc[0]
        unit = np.stack(pair["values"].to_numpy()).astype(float)
        size = np.linalg.norm(unit, axis=1)
        pair, unit = pair[size > 0], unit[size > 0] / size[size > 0, None]
        ids, paths, block = pair["id"].to_numpy(), pair["path"].to_numpy(), pair["block"].to_numpy()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        found = []
        for part in np.array_split(left, max(1, len(left) // 512)):
            near = np.round(np.clip(unit[part] @ unit[right].T, -1, 1), 6)
            i, j = np.nonzero(near >= threshold)
            found.append((part[i], right[j], near[i, j]))
        i, j, near = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = (paths[i] != paths[j]) & (ids[i] != ids[j]) & ((x != y) | (ids[i] < ids[j]))
        i, j, near = i[keep], j[keep], near[keep]
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pd.DataFrame({"id_a": ids[i], "id_b": ids[j], "path_a": paths[i], "path_b": paths[j], "similarity": near})

    return rows.groupBy("x", "y").applyInPandas(lambda pair: meet(pair), _PAIRS)


def semantic_duplicates(vectors: DataFrame, top: int = 10, threshold: float = DUPLICATE_SIMILARITY, blocks: int | None = None) -> DataFrame:
    """V9: the most similar pairs of different files, with the score of their similarity."""
    out = similar_pairs(vectors, threshold, blocks).withColumn("score", F.round(6 + 4 * F.col("similarity"), 6))
    return out.orderBy(F.desc("similarity"), "id_a", "id_b").limit(top)


def content_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) by content hash: added, removed, changed or unchanged (Q16)."""
    both = new.select("path", F.col("hash").alias("now")).join(old.select("path", F.col("hash").alias("was")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """V3: a model-free embedder: signed counts of hashed words at unit length; any pandas function can take its place."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    codes = F.transform(words, lambda w: F.xxhash64(w))
    slots = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda s: _sum(F.transform(codes, lambda c: F.when(F.pmod(c, F.lit(dim)) == s, F.when(c.bitwiseAND(1 << 20) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))))
    size = norm(slots)
    return F.when(size == 0, slots).otherwise(F.transform(slots, lambda x: x / size))
