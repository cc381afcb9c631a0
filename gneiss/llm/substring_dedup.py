"""Substring dedup: passages of at least ``length`` words that two or more documents share.

1. Each run of ``length`` words of a document is routed by its least k-gram (winnowing), so equal runs meet
   wherever they stand.  Consecutive runs of one k-gram make a segment; its hash stands for its words.
2. Segments are counted by k-gram.  Only k-grams that two documents have remain, and of their segments one
   representative of each different one gets its words back from the documents.
3. The representatives are split by k-gram into shards.  A shard is indexed as an FM-index (`fm_index`), through
   which the segments are streamed; their matching statistics give the runs that another document holds.
4. A k-gram of more than ``GRAM_SEGMENTS`` different segments is too large for a shard.  The runs of its segments are
   hashed and aggregated instead, which finds the same.
5. Runs go back to all occurrences of their segment and join up to intervals.

Whatever is shuffled is in proportion to the text, and no step needs all occurrences of a k-gram in one place; a
shard's memory is bounded by ``shard_words`` and ``GRAM_SEGMENTS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gneiss.llm import kernels as K
from gneiss.llm.fm_index import FMIndex
from gneiss.llm.shared import documents, fresh, written

LENGTH = 50
GRAM = 8
SHARD_WORDS = 300_000
GRAM_SEGMENTS = 10_000

_SEGMENTS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])
_ARROW_SEGMENTS = pa.schema([("gram", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])


def _segments(length: int, k: int):
    w = length - k + 1

    @K.returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for row, end, raw, bounds in K.chunks(b.column("text")):
                x = K.words(raw, bounds)
                n_runs = np.maximum(x.counts - length + 1, 0)
                if not n_runs.any():
                    continue
                gram = K.grams(x.hash, k)
                least = K.window_minima(gram, w)
                doc = np.repeat(np.arange(end - row), n_runs)
                run_at = np.arange(len(doc)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
                at = x.first[doc] + run_at
                by = least[at]
                head = np.empty(len(at), bool)
                head[:1] = True
                head[1:] = (by[1:] != by[:-1]) | (doc[1:] != doc[:-1])
                i = np.flatnonzero(head)
                n = np.diff(np.append(i, len(at))) + length - 1
                start = at[i]
                yield K.batch(_ARROW_SEGMENTS, K.signed(gram[by[i]]), K.signed(K.range_hash(x.hash, start, start + n)), ids[row:end][doc[i]].astype(np.int64), run_at[i].astype(np.int32), n.astype(np.int32))

    return run


_TEXTS = "gram long, segment long, low long, many boolean, words binary"
_ARROW_TEXTS = pa.schema([("gram", pa.int64()), ("segment", pa.int64()), ("low", pa.int64()), ("many", pa.bool_()), ("words", pa.binary())])


@K.returning
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the wanted segments of each document; a row whose words differ from the segment's hash isn't its source."""
    for b in batches:
        wanted = b.column("wanted")
        for row, end, raw, bounds in K.chunks(b.column("text")):
            x = K.words(raw, bounds)
            part = wanted.slice(row, end - row)
            flat = part.flatten()
            sizes = np.diff(part.offsets.to_numpy())
            doc = np.repeat(np.arange(end - row), sizes)
            field = {f: flat.field(f).to_numpy(zero_copy_only=False) for f in ("gram", "segment", "at", "n", "low", "many")}
            start = x.first[doc] + field["at"]
            stop = start + field["n"]
            fits = stop <= x.first[doc + 1]
            fits[fits] = K.signed(K.range_hash(x.hash, start[fits], stop[fits])) == field["segment"][fits]
            keep = np.flatnonzero(fits)
            if not len(keep):
                continue
            n = field["n"][keep].astype(np.int64)
            where = np.repeat(start[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            data = x.hash[where]
            offsets = np.concatenate(([0], np.cumsum(n * 8))).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield K.batch(_ARROW_TEXTS, *(field[f][keep] for f in ("gram", "segment", "low", "many")), texts)


_RUNS = "gram long, segment long, a int, b int, first_doc long"
_ARROW_RUNS = pa.schema([("gram", pa.int64()), ("segment", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("first_doc", pa.int64())])


def _search(length: int, shard_words: int):
    def shard(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        gram, segment, low = (t.column(c).to_numpy() for c in ("gram", "segment", "low"))
        many = t.column("many").to_numpy(zero_copy_only=False)
        # the same segment can come from two rows of one document
        _, once = np.unique(np.stack((gram, segment)), axis=1, return_index=True)
        once.sort()
        if len(once) < t.num_rows:
            return shard(t.take(pa.array(once)))
        raw, bounds, _ = K.strings(t.column("words"))
        tokens = np.frombuffer(raw[bounds[0] : bounds[-1]].tobytes(), np.uint64)
        index = FMIndex(tokens, np.diff(bounds) // 8, low, many, length)
        which, place, least = index.matching_statistics()
        if not len(which):
            return None
        order = np.lexsort((place, which))
        which, place, least = which[order], place[order], least[order]
        head = np.ones(len(which), bool)
        head[1:] = (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1) | (least[1:] != least[:-1])
        i = np.flatnonzero(head)
        last = np.append(i[1:], len(which)) - 1
        return K.batch(_ARROW_RUNS, gram[which[i]], segment[which[i]], place[i].astype(np.int32), (place[last] + length).astype(np.int32), least[i])

    @K.returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0
        for b in batches:
            gram, at = b.column("gram").to_numpy(), 0
            _, bounds, _ = K.strings(b.column("words"))
            while at < len(gram):
                if words >= shard_words and held[-1].column("gram")[-1].as_py() != gram[at]:
                    if (out := shard(pa.Table.from_batches(held))) is not None:
                        yield out
                    held, words = [], 0
                need = max(shard_words - words, 1) * 8
                end = min(max(int(np.searchsorted(bounds, bounds[at] + need, "right")), at + 1), len(gram))
                while end < len(gram) and gram[end] == gram[end - 1]:
                    end += 1
                held.append(b.slice(at, end - at))
                words += int(bounds[end] - bounds[at]) // 8
                at = end
        if held and (out := shard(pa.Table.from_batches(held))) is not None:
            yield out

    return run


_HASHED = "run long, gram long, segment long, a int, low long, many boolean"
_ARROW_HASHED = pa.schema([("run", pa.int64()), ("gram", pa.int64()), ("segment", pa.int64()), ("a", pa.int32()), ("low", pa.int64()), ("many", pa.bool_())])


def _hash_runs(length: int):
    """Each run of ``length`` words of the segments by its hash."""

    @K.returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, raw, bounds in K.chunks(b.column("words"), 1 << 18):
                tokens, first = np.frombuffer(raw.tobytes(), np.uint64), bounds // 8
                n = np.maximum(np.diff(first) - length + 1, 0)
                which = np.repeat(np.arange(end - row), n)
                a = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = first[which] + a
                own = (b.column(c).slice(row, end - row).take(pa.array(which)) for c in ("gram", "segment", "low", "many"))
                gram, segment, low, many = own
                yield K.batch(_ARROW_HASHED, K.signed(K.range_hash(tokens, start, start + length)), gram, segment, a.astype(np.int32), low, many)

    return run


def _by_hash(texts: DataFrame, length: int) -> DataFrame:
    """What `_search` gives, by aggregates over the runs' hashes: no group is gathered."""
    runs = texts.mapInArrow(_hash_runs(length), _HASHED)
    owners = runs.groupBy("run").agg(F.min("low").alias("first_doc"), F.max("low").alias("high"), F.bool_or("many").alias("shared")).where("shared or first_doc <> high")
    return runs.join(owners.select("run", "first_doc"), "run").select("gram", "segment", "a", (F.col("a") + length).alias("b"), "first_doc").distinct()


def shared_runs(docs: DataFrame, length: int = LENGTH, k: int = GRAM, shard_words: int = SHARD_WORDS, gram_segments: int = GRAM_SEGMENTS) -> DataFrame:
    """Every occurrence (doc_id, start, end, first_doc), in words, of a run of words that two documents share.

    ``first_doc`` is the least doc_id that holds each ``length`` words of it.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = docs.mapInArrow(_segments(length, k), _SEGMENTS)
    # of one occurrence in the least document the place and length, as one number, so that nothing is sorted for it
    one = F.min_by(F.col("at").cast("long") * (1 << 24) + F.col("n"), "doc_id").alias("one")
    by_segment = found.groupBy("gram", "segment").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), one)
    by_segment = written(by_segment, "segments")
    # aggregated before it is joined: a k-gram can have a third of all segments, and a skewed join is split
    grams = by_segment.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most")
    wanted = by_segment.join(grams.select("gram", "kinds"), "gram").withColumn("many", F.col("low") != F.col("high"))
    at, n = F.expr("cast(one div 16777216 as int)").alias("at"), F.expr("cast(one % 16777216 as int)").alias("n")
    wanted = written(wanted.select("gram", "segment", "low", "many", "kinds", at, n), "wanted")
    whole = wanted.where("kinds = 1").select("gram", "segment", F.lit(0).alias("a"), F.col("n").alias("b"), F.col("low").alias("first_doc"))

    def words_of(some: DataFrame) -> DataFrame:
        asked = some.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list(F.struct("gram", "segment", "at", "n", "low", "many")).alias("wanted"))
        return docs.join(asked, "doc_id").select("text", "wanted").mapInArrow(_cut, _TEXTS)

    texts = words_of(wanted.where((F.col("kinds") > 1) & (F.col("kinds") <= gram_segments)))
    runs = whole.unionByName(texts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_search(length, shard_words), _RUNS))
    hot = wanted.where(F.col("kinds") > gram_segments)
    if hot.limit(1).count():
        runs = runs.unionByName(_by_hash(words_of(hot), length))
    return found.join(runs, ["gram", "segment"]).select("doc_id", (F.col("at") + F.col("a")).alias("start"), (F.col("at") + F.col("b")).alias("end"), "first_doc")


def _joined_up(runs: DataFrame, *keys: str) -> DataFrame:
    """Union of overlapping or touching intervals."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= reach, 0).otherwise(1)
    runs = runs.withColumn("island", new).withColumn("island", F.sum("island").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def substring_duplicates(docs: DataFrame, length: int = LENGTH, k: int = GRAM, shard_words: int = SHARD_WORDS, gram_segments: int = GRAM_SEGMENTS) -> DataFrame:
    """Maximal intervals (doc_id, first, start_word, end_word, n_words) covered by runs of ``length`` words that another document has.

    ``first`` tells the intervals of the document with the least doc_id, which would stay, from the later copies.

    Rows whose doc_id or text is null and texts of fewer than ``length`` words give nothing.  Rows that repeat a
    doc_id count as one document: its own repeats are no match.  Very long texts are handled whole.  An empty table
    gives no rows.  Other columns are ignored.
    """
    runs = shared_runs(docs, length, k, shard_words, gram_segments).withColumn("first", F.col("first_doc") >= F.col("doc_id"))
    out = _joined_up(runs.select("doc_id", "first", "start", "end"), "doc_id", "first")
    return out.select("doc_id", "first", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"))


def _without(column: str):
    return lambda batches: _cut_out(batches, column)


@K.returning
def _cut_out(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, spans = b.column("text"), b.column(column)
        new: list[str | None] = [None] * len(texts)
        for row, end, raw, bounds in K.chunks(texts):
            x = K.words(raw, bounds)
            for i in range(row, end):
                if not spans[i].is_valid or not texts[i].is_valid:
                    new[i] = texts[i].as_py()
                    continue
                lo, hi, first, last = bounds[i - row], bounds[i - row + 1], x.first[i - row], x.first[i - row + 1]
                kept, at = [], lo
                for s in sorted(spans[i].as_py(), key=lambda s: s["start"]):
                    a, e = first + s["start"], first + s["end"]
                    if a >= last:
                        continue
                    kept.append(raw[at : x.start[a]].tobytes())
                    at = x.start[e] if e < last else hi
                kept.append(raw[at:hi].tobytes())
                new[i] = b"".join(kept).decode("utf-8", "replace")
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if f.name == "text" else b.column(f.name) for f in b.schema if f.name != column], names=[f.name for f in b.schema if f.name != column])


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents without the passages that a document of lesser doc_id has; n_chars, where there is one, is counted anew.

    A document of which no word is left goes.  Rows with a null doc_id or text stay as they are, and so does a text
    that had no word before, an empty one too.  Rows that repeat a doc_id count as one document, and each stays, cut
    where its own words are the passage's.  Very long texts are cut whole.  An empty table stays empty.  Columns, which
    may have any names, and their order stay.
    """
    name = fresh(docs, "spans")
    runs = shared_runs(docs, length, k, shard_words).where("first_doc < doc_id").select("doc_id", "start", "end")
    spans = _joined_up(runs, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias(name))
    # both branches below read one shuffle of the documents, which takes filters that are the same in both
    joined = docs.where("doc_id is not null").join(spans, "doc_id", "left").select(*docs.columns, name)
    cut = joined.where(F.col(name).isNotNull()).mapInArrow(_without(name), docs.schema).where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10ffff}]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return docs.where("doc_id is null").unionByName(joined.where(F.col(name).isNull()).drop(name)).unionByName(cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(documents(spark, sf_dir))
