"""Near-duplicate groups: banded MinHash candidates, verified by odd sketches.

1. Each document's word 3-grams give ``SAMPLES`` MinHash samples, the bands' hashes, and an odd sketch: every
   pair (sample number, sample) flips one bit of a bitmap.
2. Documents of equal words are linked to the least of them, which alone goes on.
3. Documents that share a band's hash are candidates.  The bits that differ between two sketches estimate the
   Jaccard similarity: of n bits, z differ, J = 1 + n / (4 samples) ln(1 - 2 z / n).  Within a band a breadth-first
   search compares each document with those not reached yet, which gives the components of the verified graph
   without all pairs of a large group; nothing is capped.
4. A band of more than ``BAND_ROWS`` documents is split into blocks.  All are compared with one of them, and those that
   it doesn't verify are searched within their block and compared with every block.
5. Components over all bands, and the copies of their members, are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import kernels as K
from gneiss.llm.components import components
from gneiss.llm.shared import documents, fresh, written

SHINGLE = 3
BANDS, ROWS = 56, 4
SAMPLES = BANDS * ROWS
BITS = 2048
THRESHOLD = 0.5
#: Documents of a band that one task compares.
BAND_ROWS = 20_000
#: Pairs above ``THRESHOLD - MARGIN`` are accepted: nearly two standard errors of the estimate at the threshold, so that
#: bands and verification together find 0.92 of the pairs there.
MARGIN = 0.06

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, np.uint32)

_SCHEMA = "doc_id long, content long, bands array<long>, sketch binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def shingles(x: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit shingle hashes, bounds by row); a row of fewer words than a shingle has one of all its words."""
    counts = x.counts
    k = SHINGLE
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(x.first[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    gram = K.grams(np.concatenate((x.hash, np.zeros(k - 1, U64))), k)
    value = gram[at] if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        value[bounds[short]] = K.range_hash(x.hash, x.first[short], x.first[short + 1])
    return (value >> U64(32)).astype(np.uint32), bounds


def samples(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash samples (rows x SAMPLES); no row may be empty."""
    out = np.empty((len(bounds) - 1, SAMPLES), np.uint32)
    block = np.empty_like(value)
    for i in range(SAMPLES):
        np.multiply(value, _A[i], out=block)
        block += _B[i]
        out[:, i] = np.minimum.reduceat(block, bounds[:-1])
    return out


def odd_sketches(sample: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x BITS / 64 words) of the pairs (sample number, sample)."""
    if len(sample) > 4096:  # many short rows make a wide table of bits
        return np.concatenate([odd_sketches(sample[i : i + 4096]) for i in range(0, len(sample), 4096)])
    rows = len(sample)
    bit = K.mix(sample.astype(U64) | (np.arange(SAMPLES, dtype=U64) << U64(32))) % U64(BITS)
    flips = np.bincount((np.arange(rows)[:, None] * BITS + bit.astype(np.int64)).ravel(), minlength=rows * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(rows, BITS), axis=1, bitorder="little").view(U64)


def band_hashes(sample: np.ndarray) -> np.ndarray:
    value = np.arange(BANDS, dtype=U64)[None, :] + np.zeros((len(sample), 1), U64)
    for r in range(ROWS):
        value = K.mix(value * U64(0x9E3779B97F4A7C15) + sample[:, r::ROWS].astype(U64))
    return value


def differing_bits(threshold: float) -> int:
    """Most bits in which two sketches of at least this estimated similarity differ."""
    return math.floor(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - threshold) / BITS)))


def estimate(differing: np.ndarray) -> np.ndarray:
    inner = np.maximum(1 - 2 * differing / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(inner)


@K.returning
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for row, end, raw, bounds in K.chunks(b.column("text")):
            x = K.words(raw, bounds)
            some = np.flatnonzero(x.counts > 0)
            if not len(some):
                continue
            value, sb = shingles(x)
            sample = samples(value, np.append(sb[some], sb[-1]))
            content = K.range_hash(x.hash, x.first[some], x.first[some + 1])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(K.signed(band_hashes(sample)).ravel()))
            width = BITS // 8
            sketch = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.arange(len(some) + 1, dtype=np.int32) * width), pa.py_buffer(odd_sketches(sample))])
            yield K.batch(_ARROW, ids[row:end][some].astype(np.int64), K.signed(content), bands, sketch)


def _sketches(column: pa.Array) -> np.ndarray:
    raw, bounds, _ = K.strings(column)
    return np.frombuffer(raw[bounds[0] : bounds[-1]].tobytes(), U64).reshape(-1, BITS // 64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(band, doc_id, sketch) of whole bands, out of rows sorted by band."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in batches:
        sketch = _sketches(b.column("sketch"))
        band, doc = b.column("band").to_numpy(), b.column("doc_id").to_numpy()
        cut = int(np.searchsorted(band, band[-1], "left"))
        if cut == 0 and held and held[-1][0][-1] != band[0]:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held = []
        if cut:
            held.append((band[:cut], doc[:cut], sketch[:cut]))
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held = []
        held.append((band[cut:], doc[cut:], sketch[cut:]))
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def spanning(doc: np.ndarray, sketch: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the graph of sketches that differ in at most ``most`` bits."""
    left = np.arange(len(doc))
    edges = []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, (200 << 20) // (BITS * len(left)))
            now, front = front[:step], front[step:]
            near = _apart(sketch[now][:, None], sketch[left][None]) <= most
            hit = near.any(axis=0)
            if hit.any():
                edges.append((doc[left[hit]], doc[now[near[:, hit].argmax(axis=0)]]))
                front, left = np.concatenate((front, left[hit])), left[~hit]
    return edges


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verify(threshold: float):
    most = differing_bits(threshold)

    @K.returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, doc, sketch in _groups(batches):
            head = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            size = np.diff(np.append(head, len(band)))
            pivot = np.repeat(head, size)
            near = _apart(sketch, sketch[pivot]) <= most
            whole = np.logical_and.reduceat(near, head)
            rows = np.flatnonzero(np.repeat(whole, size))
            out = [(doc[rows], doc[pivot[rows]])]
            for i in np.flatnonzero(~whole):
                part = slice(head[i], head[i] + size[i])
                out += spanning(doc[part], sketch[part], most)
            u, v = (np.concatenate(c) for c in zip(*out, strict=True))
            yield K.batch(_EDGES, u[u != v], v[u != v])

    return run


_NEAR = "band long, block int, doc_id long, sketch binary, pivot_doc long, near boolean"


def _to_pivot(threshold: float):
    """Rows of two sketches with whether they are near."""
    most = differing_bits(threshold)

    @K.returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _apart(_sketches(b.column("sketch")), _sketches(b.column("pivot_sketch"))) <= most
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("band", "block", "doc_id", "sketch", "pivot_doc")), pa.array(near)], names=["band", "block", "doc_id", "sketch", "pivot_doc", "near"])

    return run


def _across(threshold: float):
    """Edges that span the verified graph of a cell: documents left of one block and all of another."""
    most = differing_bits(threshold)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = pa.concat_tables([left.select(["doc_id", "sketch"]), right.select(["doc_id", "sketch"])]).combine_chunks()
        if not left.num_rows or not right.num_rows:
            t = t.slice(0, 0)
        found = spanning(t.column("doc_id").to_numpy(), _sketches(t.column("sketch").combine_chunks()), most) if t.num_rows else []
        u, v = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": u[u != v], "v": v[u != v]}, schema=_EDGES)

    return run


def _hot_edges(member: DataFrame, threshold: float, band_rows: int) -> DataFrame:
    """Edges that span the verified graph of each band of too many documents for one task.

    Two documents that both are near the band's pivot are linked by it; any other pair has a document that isn't, so
    only those meet the other blocks.
    """
    split = member.withColumn("block", F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / band_rows)).cast("int"))
    pivot = member.where("rid = pivot").select("band", F.col("doc_id").alias("pivot_doc"), F.col("sketch").alias("pivot_sketch"))
    known = split.join(pivot, "band").select("band", "block", "doc_id", "sketch", "pivot_doc", "pivot_sketch")
    known = written(known.mapInArrow(_to_pivot(threshold), _NEAR), "hot-bands")
    star = known.where("near and doc_id <> pivot_doc").select(F.col("doc_id").alias("u"), F.col("pivot_doc").alias("v"))
    left = known.where("not near").select("band", F.col("block").alias("part"), "doc_id", "sketch")
    cells = left.select("band", "part").distinct().join(known.select("band", "block").distinct(), "band")
    here = left.join(cells, ["band", "part"]).select("band", "part", "block", "doc_id", "sketch")
    keys = ("band", "part", "block")
    # named anew, as both sides come from one table
    there = known.join(cells, ["band", "block"]).select(*(F.col(c).alias(c) for c in (*keys, "doc_id", "sketch")))
    return star.unionByName(here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(_across(threshold), "u long, v long"))


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD - MARGIN, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, group_id, keep) of every document that has a near copy; group_id is the group's least doc_id, which stays.

    Rows with a null doc_id or text, and texts without a word, are in no group.  Texts of fewer than three words
    match only if equal.  Rows that repeat a doc_id count as one document.  Very long texts are sketched whole.  An
    empty table gives no rows.  A doc_id may be any 64-bit number.  Other columns are ignored.
    """
    sig = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_sketch, _SCHEMA)
    sig = written(sig.withColumn("rid", F.monotonically_increasing_id()), "sketches")
    least = sig.groupBy("content").agg(F.min(F.struct("doc_id", "rid")).alias("one")).select("content", F.col("one.doc_id").alias("least"), "one.rid")
    same = sig.select("doc_id", "content").join(least, "content").where("doc_id <> least").select("doc_id", "least")
    only = sig.join(least.select("rid"), "rid", "left_semi")
    bands = only.select(F.explode("bands").alias("band"), "rid")
    # counted before they are joined, as a band can have a third of all rows
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("pivot")).where("n > 1")
    found = written(bands.join(sizes, "band"), "bands")
    sketches = only.select("rid", "doc_id", "sketch")
    cool = found.where(F.col("n") <= band_rows).select("band", "rid").join(sketches, "rid")
    edges = cool.repartition("band").sortWithinPartitions("band", "doc_id").select("band", "doc_id", "sketch").mapInArrow(_verify(threshold), "u long, v long")
    hot = found.where(F.col("n") > band_rows)
    if hot.limit(1).count():
        edges = edges.unionByName(_hot_edges(hot.join(sketches, "rid"), threshold, band_rows))
    # copies take the group of their representative and stay out of the rounds, unless other rows have their doc_id too
    twice = sig.groupBy("doc_id").agg((F.min("content") != F.max("content")).alias("twice")).where("twice").select("doc_id")
    joined = components(edges.unionByName(same.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))))
    groups = joined.select(F.col("node").alias("least"), "component")
    copies = same.join(groups, "least", "left").select("doc_id", F.coalesce("component", "least").alias("group_id"))
    alone = same.select("least").distinct().join(groups, "least", "left_anti").select(F.col("least").alias("doc_id"), F.col("least").alias("group_id"))
    out = joined.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id")).unionByName(copies).unionByName(alone)
    return out.distinct().select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD - MARGIN) -> DataFrame:
    """The documents less all but one of each group; columns stay.

    Rows with a null doc_id or text stay, as do empty texts and those without a word.  Of rows that repeat both doc_id
    and text one stays.  Very long texts are compared whole.  An empty table stays empty.  Columns may have any names.
    """
    groups = near_duplicate_groups(docs, threshold)
    flag = fresh(docs, "often")
    # both branches below read one shuffle of the documents, which takes filters that are the same in both
    known = docs.where("doc_id is not null")
    often = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias(flag))
    left = known.join(groups.where("not keep").select("doc_id"), "doc_id", "left_anti").join(often, "doc_id", "left").select(*docs.columns, flag)
    once = left.where(F.col(flag)).dropDuplicates(["doc_id", "text"])
    rest = left.where(F.col(flag).isNull()).unionByName(once).drop(flag)
    return docs.where("doc_id is null").unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(documents(spark, sf_dir))
