"""Benchmark decontamination by winnowing.

Of every window of ``WINDOW`` consecutive word k-grams the least hash is kept as a fingerprint, in documents and in
benchmark items alike.  Fingerprints are joined, and each hit is extended word by word in both directions.  Any span
of at least ``WINDOW + GRAM - 1`` words that a document shares with an item holds a common fingerprint, so none is
missed; shorter spans are not reported.

The benchmark is broadcast while it has at most ``BROADCAST_WORDS`` words, which is checked first; a larger one is
joined by shuffled fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import kernels as K
from gneiss.llm.shared import documents, fresh

GRAM = 6
WINDOW = 8
LENGTH = WINDOW + GRAM - 1
BROADCAST_WORDS = 2_000_000

_HITS = "doc_id long, item_id long, start_word int, end_word int, item_start int, n_words int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())])


def fingerprints(x: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word index) of the fingerprints of each row; rows of fewer than ``LENGTH`` words have none."""
    n = np.maximum(x.counts - LENGTH + 1, 0)
    gram = K.grams(x.hash, GRAM)
    least = K.window_minima(gram, WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + x.first[row]
    chosen = least[at]
    head = np.ones(len(chosen), bool)
    head[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    return gram[chosen[head]], row[head], chosen[head]


class Benchmark:
    """Words and fingerprints of all items."""

    def __init__(self, ids: np.ndarray, texts: pa.Array) -> None:
        raw, bounds, _ = K.strings(texts)
        x = K.words(raw[bounds[0] : bounds[-1]], bounds - bounds[0])
        self.ids, self.words, self.first = ids, x.hash, x.first
        value, row, at = fingerprints(x)
        order = np.argsort(value, kind="stable")
        self.value, self.row, self.at = value[order], row[order], at[order]

    def hits(self, x: K.Words) -> tuple[np.ndarray, ...]:
        """(document row, item row, document word, item word) of equal fingerprints."""
        value, row, at = fingerprints(x)
        lo, hi = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        n = hi - lo
        hit = np.flatnonzero(n)
        n = n[hit]
        which = np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(row[hit], n), self.row[which], np.repeat(at[hit], n), self.at[which]


def extend(x: K.Words, y_hash: np.ndarray, y_first: np.ndarray, row: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal equal spans (row, item, start, end, item start), in words of the row and item, through each (p, q); once each."""
    lo_p, hi_p, lo_q, hi_q = x.first[row], x.first[row + 1], y_first[item], y_first[item + 1]
    back = np.zeros(len(p), np.int64)
    ahead = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        a, b = p[live] - back[live] - 1, q[live] - back[live] - 1
        ok = (a >= lo_p[live]) & (b >= lo_q[live])
        ok[ok] = x.hash[a[ok]] == y_hash[b[ok]]
        live = live[ok]
        back[live] += 1
    live = np.arange(len(p))
    while len(live):
        a, b = p[live] + ahead[live], q[live] + ahead[live]
        ok = (a < hi_p[live]) & (b < hi_q[live])
        ok[ok] = x.hash[a[ok]] == y_hash[b[ok]]
        live = live[ok]
        ahead[live] += 1
    start, end, item_start = p - back - lo_p, p + ahead - lo_p, q - back - lo_q
    found = np.unique(np.stack((row, item, start, end, item_start)), axis=1)
    return tuple(found[:, found[3] - found[2] >= LENGTH])


def _rows(ids: np.ndarray, item_ids: np.ndarray, spans: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    row, item, start, end, item_start = spans
    return K.batch(_ARROW, ids[row].astype(np.int64), item_ids[item].astype(np.int64), start.astype(np.int32), end.astype(np.int32), item_start.astype(np.int32), (end - start).astype(np.int32))


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    bench: Benchmark = shared.value
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for row, end, raw, bounds in K.chunks(b.column("text")):
            x = K.words(raw, bounds)
            doc, item, p, q = bench.hits(x)
            if len(doc):
                yield _rows(ids[row:end], bench.ids, extend(x, bench.words, bench.first, doc, item, p, q))


_PRINTS = pa.schema([("print", pa.int64()), ("id", pa.int64()), ("at", pa.int32())])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for row, end, raw, bounds in K.chunks(b.column(1)):
            x = K.words(raw, bounds)
            value, doc, at = fingerprints(x)
            yield K.batch(_PRINTS, K.signed(value), ids[row:end][doc].astype(np.int64), (at - x.first[doc]).astype(np.int32))


def _extend_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, item_ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "item_id"))
        item_raw, item_bounds, _ = K.strings(b.column("item_text"))
        hits = b.column("hits")
        for row, end, raw, bounds in K.chunks(b.column("text")):
            x = K.words(raw, bounds)
            y = K.words(item_raw[item_bounds[row] : item_bounds[end]], item_bounds[row : end + 1] - item_bounds[row])
            part = hits.slice(row, end - row)
            flat = part.flatten()
            at = np.repeat(np.arange(end - row), np.diff(part.offsets.to_numpy()))
            p, q = x.first[at] + flat.field("p").to_numpy(), y.first[at] + flat.field("q").to_numpy()
            fits = (p < x.first[at + 1]) & (q < y.first[at + 1])  # another row of the same id may be shorter
            fits[fits] = x.hash[p[fits]] == y.hash[q[fits]]
            if fits.any():
                yield _rows(ids[row:end], item_ids[row:end], extend(x, y.hash, y.first, at[fits], at[fits], p[fits], q[fits]))


def _shuffled(docs: DataFrame, items: DataFrame) -> DataFrame:
    prints = "print long, id long, at int"
    left = docs.mapInArrow(_prints, prints).select("print", F.col("id").alias("doc_id"), F.col("at").alias("p"))
    right = items.select("item_id", "text").mapInArrow(_prints, prints).select("print", F.col("id").alias("item_id"), F.col("at").alias("q"))
    pairs = left.join(right, "print").groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("p", "q")).alias("hits"))
    full = pairs.join(docs, "doc_id").join(items.select("item_id", F.col("text").alias("item_text")), "item_id")
    return full.select("doc_id", "item_id", "text", "item_text", "hits").mapInArrow(_extend_pairs, _HITS)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, item_start, n_words): maximal spans of at least ``LENGTH`` equal words.

    Rows with a null id or text, and texts or items of fewer than ``LENGTH`` words, give nothing.  An item that
    occurs twice in a document, or a passage that several items have, gives a row each; repeated rows count once.
    Very long texts are handled whole.  If either table is empty there are no rows.  Other columns are ignored.
    """
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    items, shared = _shared(benchmark, broadcast_words)
    found = _shuffled(known, items) if shared is None else known.mapInArrow(partial(_scan, shared=shared), _HITS)
    return found.distinct()


def _shared(benchmark: DataFrame, broadcast_words: int) -> tuple[DataFrame, Broadcast | None]:
    """The items, and their words and fingerprints as a broadcast if they are few enough."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 6 * broadcast_words:
        return items, None
    table = items.orderBy("item_id", "text").toArrow()
    bench = Benchmark(table.column("item_id").to_numpy(), table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    return items, benchmark.sparkSession.sparkContext.broadcast(bench)


def _clean(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """The rows without a hit that extends far enough."""
    bench: Benchmark = shared.value
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        known = ~b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        for row, _, raw, bounds in K.chunks(b.column("text")):
            x = K.words(raw, bounds)
            doc, item, p, q = bench.hits(x)
            if len(doc):
                hit = row + np.unique(extend(x, bench.words, bench.first, doc, item, p, q)[0])
                keep[hit[known[hit]]] = False
        yield b if keep.all() else b.filter(pa.array(keep))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents that share no span with the benchmark; columns stay.  Rows with a null doc_id or text stay.

    Rows that repeat a doc_id are each judged by their own text.  With a benchmark small enough to broadcast, documents
    aren't shuffled.
    """
    items, shared = _shared(benchmark, broadcast_words)
    if shared is not None:
        return docs.mapInArrow(partial(_clean, shared=shared), docs.schema)
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.xxhash64("doc_id", "text")))
    hits = _shuffled(keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), "text"), items)
    return keyed.join(hits.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, i, array_to_string(w[i + 1 : i + {LENGTH}], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(len(w) - {LENGTH - 1})) AS i FROM d WHERE len(w) >= {LENGTH})),
bg AS (SELECT DISTINCT item_id, i, array_to_string(w[i + 1 : i + {LENGTH}], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(len(w) - {LENGTH - 1})) AS i FROM b WHERE len(w) >= {LENGTH})),
m AS (SELECT doc_id, item_id, dg.i AS p, bg.i AS q,
             dg.i - row_number() OVER (PARTITION BY doc_id, item_id, dg.i - bg.i ORDER BY dg.i) AS island
      FROM dg JOIN bg USING (g))
SELECT doc_id, item_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + {LENGTH} AS INTEGER) AS end_word,
       CAST(min(q) AS INTEGER) AS item_start, CAST(max(p) + {LENGTH} - min(p) AS INTEGER) AS n_words
FROM m GROUP BY doc_id, item_id, p - q, island
"""
