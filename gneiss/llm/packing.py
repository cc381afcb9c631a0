"""Packing of documents into training windows by non-negative least squares over length combinations.

1. Texts are encoded, and cut into pieces of at most a window.  Piece lengths are rounded up to ``BINS``-ths of a window
   and counted: a histogram of fixed size, whatever the data.  Each task numbers its pieces of a length, and pieces are
   written with their tokens.
2. All combinations of at most ``DEPTH`` binned lengths that fill a window exactly are enumerated.  Non-negative
   least squares gives how often to use each so that the uses of each length come to its count.
3. The solution is rounded down; what is left of the histogram is packed greedily, the longest length that fits first.
4. Pieces of each length take their windows by number, the task's first one added, and meet there: one shuffle of
   tokens, by window.

Tokens are UTF-8 bytes, those of a byte-level model, with a separator after each text, the byte 255, which no text has.
``vocabulary`` gives those of a byte-pair vocabulary file instead.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.llm import kernels as K
from gneiss.llm.shared import documents, written

CAPACITY = 8192
BINS = 64
DEPTH = 4
SEPARATOR = b"\xff"


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(3 * m + 30):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= tolerance * scale * m:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                break
            low = s <= 0
            old = x[at]
            step = np.min(old[low] / np.maximum(old[low] - s[low], 1e-300))
            x[at] = old + step * (s - old)
            gone = at[x[at] <= tolerance * scale]
            if not len(gone):
                gone = at[[int(s.argmin())]]
            x[gone], passive[gone] = 0, False
            if not passive.any():
                s = np.zeros(0)
                break
        x[:] = 0
        x[np.flatnonzero(passive)] = s
    return x


def combinations(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Rows of counts by length (index 0 is length 1) of all multisets of at most ``depth`` lengths that add up to ``bins``."""
    out: list[list[int]] = []

    def grow(parts: list[int], rest: int) -> None:
        if rest == 0:
            out.append(parts)
        elif len(parts) < depth:
            for p in range(min(rest, parts[-1] if parts else rest), 0, -1):
                if p * (depth - len(parts)) < rest:
                    break
                grow([*parts, p], rest - p)

    grow([], bins)
    table = np.zeros((len(out), bins), np.int64)
    for i, parts in enumerate(out):
        np.add.at(table[i], np.array(parts) - 1, 1)
    return table


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, int]]:
    """(counts by length, how many windows of it) that use up the histogram of binned lengths exactly."""
    bins = len(histogram)
    table = combinations(bins, depth)
    times = np.floor(nnls(table.T.astype(float), histogram.astype(float)) + 1e-6).astype(np.int64)
    out, left = [], histogram.astype(np.int64).copy()
    for i in np.argsort(-times, kind="stable"):
        used = table[i] > 0
        n = int(min(times[i], (left[used] // table[i][used]).min()))
        if n > 0:
            out.append((table[i], n))
            left -= n * table[i]
    while left.any():
        counts, room = np.zeros(bins, np.int64), bins
        while room and (fits := np.flatnonzero(left[:room] > counts[:room])).size:
            b = int(fits[-1])
            take = min(int(left[b] - counts[b]), room // (b + 1))
            counts[b] += take
            room -= take * (b + 1)
        used = counts > 0
        n = int((left[used] // counts[used]).min())
        out.append((counts, n))
        left -= n * counts
    return out


def slots(made: list[tuple[np.ndarray, int]], first_window: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, from, to, per window, first window, first slot): pieces numbered [from, to) of a bin go to these windows."""
    rows, at, window = [], {}, first_window
    for counts, n in made:
        slot = 0
        for b in np.flatnonzero(counts)[::-1]:
            start, each = at.get(b, 0), int(counts[b])
            rows.append((int(b) + 1, start, start + each * n, each, window, slot))
            at[b] = start + each * n
            slot += each
        window += n
    return rows


#: The tokens of each text, a separator last, as bytes of a fixed number a token.
Encode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds by text) where each byte is a token."""
    raw, bounds, _ = K.strings(texts)
    sizes = np.diff(bounds)
    out = np.full(int(sizes.sum()) + len(sizes), SEPARATOR[0], np.uint8)
    ends = np.cumsum(sizes + 1)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = raw[bounds[0] : bounds[-1]]
    return out, np.concatenate(([0], ends))


def vocabulary(ranks_path: str, pattern: str) -> Encode:
    """Tokens of a byte-pair vocabulary file (base64 token and rank a line), the number after the last one as separator.

    The file is read where the texts are, so it must be at the same path on every executor.
    """
    made: list[tuple[object, int]] = []

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not made:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            made.append((tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1))
        found, end = made[0]
        rows = [[*found.encode_ordinary(t), end] for t in texts.to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        return np.array([t for r in rows for t in r], np.uint32), bounds

    return encode


_PIECES = "block long, bin int, number long, doc_id long, start long, n int, tokens binary"
_ARROW = pa.schema([("block", pa.int64()), ("bin", pa.int32()), ("number", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])


def _cut(encode: Encode, capacity: int, bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of the texts, numbered by bin within the task, which is a block."""
    unit = capacity // bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, used = TaskContext.get().partitionId(), np.zeros(bins + 1, np.int64)
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for row, end, _, _ in K.chunks(b.column("text")):
                tokens, bounds = encode(b.column("text").slice(row, end - row))
                sizes = np.diff(bounds)
                per = -(-sizes // capacity)
                doc = np.repeat(np.arange(end - row), per)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * capacity
                n = np.minimum(capacity, sizes[doc] - start)
                at = -(-n // unit)
                # pieces of a bin follow each other
                order = np.argsort(at, kind="stable")
                counts = np.bincount(at, minlength=bins + 1)
                number = np.empty(len(at), np.int64)
                number[order] = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(used, counts)
                used += counts
                # the texts follow each other, so their pieces cut the tokens at ever later places
                offsets = np.append(bounds[:-1][doc] + start, len(tokens)) * tokens.itemsize
                data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(tokens)])
                yield K.batch(_ARROW, np.full(len(doc), block), at.astype(np.int32), number, ids[row:end][doc].astype(np.int64), start, n.astype(np.int32), data)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH, encode: Encode = as_bytes) -> DataFrame:
    """(window_id, n_tokens, doc_ids, starts, lengths, tokens): the windows, filled.

    The i-th part of a window has ``lengths[i]`` tokens of the document ``doc_ids[i]``, from its token ``starts[i]`` on;
    ``tokens`` has all parts' one after another, a byte each, or four, little end first, of a vocabulary.  Every token
    of every document, and a separator after its last, is in exactly one window, and no window has more than
    ``capacity``.

    Rows with a null doc_id or text and empty texts are not packed.  Rows that repeat a doc_id, or a text too, are
    packed each.  A text longer than a window fills windows of its own and its rest shares one.  Which of equally long
    pieces share a window is left to the order they are read in.  An empty table gives no rows.  Other columns are
    ignored.
    """
    if capacity % bins:
        raise ValueError("capacity must be a multiple of bins")
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(known.mapInArrow(_cut(encode, capacity, bins), _PIECES), "pieces")
    counts = pieces.groupBy("bin", "block").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("bin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a row a task and length
    offsets = written(counts.select("bin", "block", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset")), "offsets")
    histogram = np.zeros(bins, np.int64)
    for r in offsets.groupBy("bin").agg(F.sum("c").alias("n")).collect():  # at most one row a bin
        histogram[r.bin - 1] = r.n
    table = spark.createDataFrame(slots(plan(histogram, depth)), "bin int, lo long, hi long, each long, window long, slot long")
    numbered = pieces.join(offsets.select("bin", "block", "offset"), ["bin", "block"]).withColumn("number", F.col("number") + F.col("offset"))
    # the table has at most bins x combinations in use rows, so it is broadcast whatever the data
    placed = numbered.join(F.broadcast(table), "bin").where("number >= lo and number < hi")
    part = F.struct(F.expr("slot + (number - lo) % each").alias("slot"), "doc_id", "start", "n", "tokens")
    # a window has at most one capacity of tokens, so what is gathered is bounded
    windows = placed.groupBy(F.expr("window + (number - lo) div each").alias("window_id")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return windows.select("window_id", F.expr("cast(aggregate(parts, 0, (a, p) -> a + p.n) as int)").alias("n_tokens"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"), F.col("parts.n").alias("lengths"), F.expr("aggregate(parts, binary(''), (a, p) -> concat(a, p.tokens))").alias("tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
