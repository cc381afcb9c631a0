"""Toxicity view, learned from the labelled rows in whatever languages they have.

A term is a word, or the beginning of a longer one, that a document has once, twice or three times at least.  Terms
that labelled toxic documents have more often than others, by a test of their log odds ratio, are weighed by a
logistic regression, which is calibrated on held-out labelled documents and set back to the labels' share of toxic ones.

The fit uses at most ``CLASS_DOCS`` labelled documents of either class, chosen by hash.  All documents are scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import kernels as K
from gneiss.llm.shared import written

CLASS_DOCS = 3000
HELD_OUT = 4  # one labelled document in so many
BITS = 18
STEMS = (5, 6, 7, 8, 10)
LEVELS = 3
MIN_Z, MIN_DOCS = 4.0, 3
MAX_TERMS = 4096
TOXIC = 0.5

U64 = np.uint64


def terms(raw: np.ndarray, x: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every word and of every beginning of ``STEMS`` bytes of a longer word."""
    row, size = x.row_of(), x.end - x.start
    rows, values = [row], [x.hash]
    if len(x.hash):
        total = np.concatenate((np.zeros(1, U64), np.cumsum((K.fold(raw).astype(U64) + U64(1)) * K._POWERS.upto(len(raw) + 1)[0][:-1])))
        down = K._POWERS.upto(len(raw) + 1)[1]
        for n in STEMS:
            i = np.flatnonzero(size > n)
            a = x.start[i]
            rows.append(row[i])
            values.append(K.mix((total[a + n] - total[a]) * down[a] + U64(1000 + n)))
    return np.concatenate(rows), (np.concatenate(values) >> U64(64 - BITS)).astype(np.int64)


def _counted(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, level) of each pair, where the level is how often, ``LEVELS`` at most."""
    key, n = np.unique((row << BITS) | term, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.minimum(n, LEVELS)


@dataclass
class Toxicity:
    term: np.ndarray
    #: What a document scores that has the term once, twice, three times at least.
    weight: np.ndarray
    base: float

    def table(self) -> np.ndarray:
        """Place of each term number, -1 where it has no weight."""
        out = np.full(1 << BITS, -1, np.int32)
        out[self.term] = np.arange(len(self.term))
        return out

    def scores(self, raw: np.ndarray, x: K.Words, table: np.ndarray) -> np.ndarray:
        """Log odds by row."""
        row, term = terms(raw, x)
        some = table[term] >= 0
        row, term, level = _counted(row[some], term[some])
        return np.bincount(row, weights=self.weight[table[term], level - 1], minlength=len(x.counts)) + self.base


_TERMS = "doc_id long, toxic int, number int"
_TERMS_ARROW = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("number", pa.int32())])


def _levels(row: np.ndarray, term: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the term and level) of each level that the term reaches."""
    return tuple(np.concatenate(c) for c in zip(*((row[level > k], term[level > k] * LEVELS + k) for k in range(LEVELS)), strict=True))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, toxic = (b.column(c).to_numpy() for c in ("doc_id", "toxic"))
        for first, _, raw, bounds in K.chunks(b.column("text")):
            row, number = _levels(*_counted(*terms(raw, K.words(raw, bounds))))
            yield K.batch(_TERMS_ARROW, ids[first + row], toxic[first + row].astype(np.int32), number.astype(np.int32))


def train(row: np.ndarray, place: np.ndarray, some: np.ndarray, toxic: np.ndarray, held: np.ndarray, share: float) -> Toxicity:
    """Fit on (row, place of a number among ``some``) pairs with labels 0 and 1; share: that of toxic ones where they come from."""
    from gneiss.llm.quality_classifier import _log_odds, fit_logistic, platt

    known = ~held if (~held & (toxic == 1)).any() and (~held & (toxic == 0)).any() else np.ones(len(toxic), bool)
    wide = np.zeros((len(toxic), len(some)), np.float32)
    wide[row, place] = 1
    w = fit_logistic(wide[known], toxic[known].astype(float), penalty=3e-4, steps=500)
    score = wide @ w[:-1] + w[-1]
    check = held if held.any() else known
    slope, shift = platt(score[check], toxic[check].astype(float))
    term, at = np.unique(some // LEVELS, return_inverse=True)
    weight = np.zeros((len(term), LEVELS))
    weight[at, some % LEVELS] = slope * w[:-1]
    # a sample of either class has a share of its own
    return Toxicity(term, weight.cumsum(axis=1), slope * w[-1] + shift + _log_odds(share) - _log_odds(float(toxic.mean())))


def fit(docs: DataFrame, labels: DataFrame, class_docs: int = CLASS_DOCS) -> Toxicity | None:
    """None without labelled documents of both classes.

    Of several labels of a document the highest counts; rows that repeat its doc_id count as one text with the terms of
    all.  Terms are counted and chosen where the texts are; the driver gets numbers of the chosen ones alone.
    """
    h = F.xxhash64("doc_id").alias("h")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    all_of = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(all_of) < 2:
        return None
    chosen = [marks.where(F.col("toxic") == k).select("doc_id", "toxic", h).orderBy("h", "doc_id").limit(class_docs) for k in (0, 1)]
    # at most twice class_docs rows, so the broadcast is bounded
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "toxic")), "doc_id")
    found = written(rows.mapInArrow(_explode, _TERMS).distinct(), "toxic-terms")
    marked = found.select("doc_id", "toxic").distinct().withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)
    table = marked.orderBy("doc_id").toArrow()
    toxic, held = table.column("toxic").to_numpy().astype(np.int64), table.column("held").to_numpy(zero_copy_only=False).astype(bool)
    if len(np.unique(toxic)) < 2:
        return None
    known = ~held if len(np.unique(toxic[~held])) == 2 else np.ones(len(toxic), bool)
    n_bad, n_good = float(toxic[known].sum()), float((1 - toxic[known]).sum())
    of = found if known.all() else found.where(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) != 0)
    counts = of.groupBy("number").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).withColumn("good", F.col("all") - F.col("bad"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = counts.withColumn("z", z).where((F.col("z") >= MIN_Z) & (F.col("bad") >= MIN_DOCS)).orderBy(F.desc("z"), "number").limit(MAX_TERMS).select("number")
    some = np.sort(np.array([r.number for r in best.collect()], np.int64))
    pairs = found.join(F.broadcast(best), "number").select("doc_id", "number").toArrow()
    row = np.searchsorted(table.column("doc_id").to_numpy(), pairs.column("doc_id").to_numpy())
    return train(row, np.searchsorted(some, pairs.column("number").to_numpy()), some, toxic, held, all_of[1] / (all_of[0] + all_of[1]))
