"""Quality classifier by co-training of a text view and a metadata view.

The text view has hashed words and the shares of character classes and repeated words; the metadata view has hashed
source, language, their pair, and a scale of length.  Both are logistic regressions.  In each round both score every
document of the table that isn't in the labelled sample, and the ``PER_ROUND`` different texts that a view is surest of, by class, go to the
other view's training set.  Each view is calibrated on held-out labelled documents, and the calibrated log odds are
added, less those of the prior counted twice.  A third view, of toxicity, is learned from labels of its own and takes
no part in ``keep``.

The fit uses at most ``TRAIN_DOCS`` labelled documents, chosen by hash, of each of which the executors send features, never
its text.  The others are all scored in every round; ``PER_ROUND`` is how far the training sets grow by it.  All
documents are scored, whole.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import kernels as K
from gneiss.llm import toxicity
from gneiss.llm.shared import documents, written

TRAIN_DOCS = 2000
ROUNDS = 3
CONFIDENT = 0.9
PER_ROUND = 200
HELD_OUT = 4  # one labelled document in so many
BITS, META_BITS = 11, 12
KEEP = 0.5

_CLASSES = np.zeros((256, 6), bool)
_CLASSES[65:91, 0] = True
_CLASSES[97:123, 1] = True
_CLASSES[48:58, 2] = True
_CLASSES[[9, 10, 13, 32], 3] = True
for _c in b"#$%&*|~^<>{}=_\\@+/":
    _CLASSES[_c, 4] = True
for _c in b"!?":
    _CLASSES[_c, 5] = True
_KIND = np.where(_CLASSES.any(axis=1), _CLASSES.argmax(axis=1), 6)
DENSE = 7 + 3


def text_features(raw: np.ndarray, bounds: np.ndarray) -> tuple[K.Words, np.ndarray]:
    """(words, dense features by row): shares of byte classes, of adjacent equal words, words a line, word length."""
    x = K.words(raw, bounds)
    rows, sizes = len(bounds) - 1, np.diff(bounds)
    row = np.repeat(np.arange(rows), sizes)
    shares = np.bincount(row * 7 + _KIND[raw], minlength=rows * 7).reshape(rows, 7) / np.maximum(sizes, 1)[:, None]
    word_row = x.row_of()
    same = np.zeros(len(x.hash), bool)
    same[1:] = (x.hash[1:] == x.hash[:-1]) & (word_row[1:] == word_row[:-1])
    n = np.maximum(x.counts, 1)
    lines = np.bincount(row, weights=raw == 10, minlength=rows) + 1
    extra = np.stack((np.bincount(word_row, weights=same, minlength=rows) / n, np.log1p(x.counts / lines), sizes / n / 10), axis=1)
    return x, np.concatenate((shares, extra), axis=1)


def bags(x: K.Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed word, ten times its share of the row's words) of each pair."""
    key, n = np.unique((x.row_of() << BITS) | (x.hash >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    row = key >> BITS
    return row, key & ((1 << BITS) - 1), n * 10 / np.maximum(x.counts, 1)[row]


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """(number of each row's value, the values); null is a value."""
    coded = column.cast(pa.string()).dictionary_encode()
    values = coded.dictionary.to_pylist()
    return coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False).astype(np.int64), [*values, None]


def _hashed(*key: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=4).digest(), "little") & ((1 << META_BITS) - 1)


def meta_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Rows of the numbers of source, language, their pair and scale of length; nulls are a value of their own.

    Each different value is hashed once a batch.
    """
    s, sources = _codes(source)
    g, langs = _codes(lang)
    size = np.nan_to_num(n_chars.to_numpy(zero_copy_only=False).astype(float))
    scale = np.log2(np.clip(size, 1, None)).astype(np.int64)
    pair, which = np.unique(s * len(langs) + g, return_inverse=True)
    scales, level = np.unique(scale, return_inverse=True)
    own = [np.array([_hashed(kind, v) for v in values]) for kind, values in (("s", sources), ("l", langs))]
    both = np.array([_hashed("p", sources[i // len(langs)], langs[i % len(langs)]) for i in pair.tolist()], np.int64)
    return np.stack((own[0][s], own[1][g], both[which], np.array([_hashed("n", v) for v in scales.tolist()], np.int64)[level]), axis=1)


@dataclass
class Features:
    """Sparse rows of both views: (row, column, value) of the text's and columns of the metadata's."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    dense: np.ndarray
    meta: np.ndarray

    def text_matrix(self) -> np.ndarray:
        out = np.zeros((len(self.dense), (1 << BITS) + DENSE))
        out[self.row, self.column] = self.value
        out[:, 1 << BITS :] = self.dense
        return out

    def meta_matrix(self) -> np.ndarray:
        out = np.zeros((len(self.meta), 1 << META_BITS))
        for j in range(self.meta.shape[1]):
            out[np.arange(len(out)), self.meta[:, j]] += 1
        return out


def features(raw: np.ndarray, bounds: np.ndarray, meta: np.ndarray) -> tuple[K.Words, Features]:
    x, dense = text_features(raw, bounds)
    return x, Features(*bags(x, len(bounds) - 1), dense * 4, meta)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights, the intercept last, by Nesterov's accelerated gradient; a column of zeros has no weight and costs nothing."""
    used = np.append(x.any(axis=0), True)
    out = np.zeros(len(used))
    x = np.concatenate((x[:, used[:-1]].astype(np.float32), np.ones((len(x), 1), np.float32)), axis=1)
    w = np.zeros(x.shape[1], np.float32)
    v, rate = w.copy(), 4 / max(float((x**2).sum(axis=1).max(initial=1.0)), 1e-6)
    for t in range(steps):
        p = 1 / (1 + np.exp(-(x @ v)))
        new = v - rate * (x.T @ (p - y) / max(len(y), 1) + penalty * np.append(v[:-1], 0))
        v = new + t / (t + 3) * (new - w)
        w = new
    out[used] = w
    return out


def _log_odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into log odds; Newton steps on smoothed labels."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    good = y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -35, 35)))
        g = np.array([((p - target) * score).sum(), (p - target).sum()])
        h = p * (1 - p)
        hessian = np.array([[(h * score**2).sum() + 1e-6, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float] = (1.0, 0.0)
    meta_scale: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0

    def raw_scores(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the text view and of the metadata view, not calibrated."""
        text = np.bincount(f.row, weights=f.value * self.text[f.column], minlength=len(f.dense))
        return text + f.dense @ self.text[1 << BITS : -1] + self.text[-1], self.meta[f.meta].sum(axis=1) + self.meta[-1]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both."""
        a = self.text_scale[0] * text + self.text_scale[1]
        b = self.meta_scale[0] * meta + self.meta_scale[1]
        return tuple(1 / (1 + np.exp(-np.clip(s, -35, 35))) for s in (a, b, a + b - self.prior))


#: What the driver gets of a document: features of bounded size, whatever its text.
_ROW = "doc_id long, view int, good boolean, sure double, h long, columns binary, values binary, dense binary, meta binary"
_ROW_ARROW = pa.schema([("doc_id", pa.int64()), ("view", pa.int32()), ("good", pa.bool_()), ("sure", pa.float64()), ("h", pa.int64()), ("columns", pa.binary()), ("values", pa.binary()), ("dense", pa.binary()), ("meta", pa.binary())])


def _packed(f: Features, rows: np.ndarray) -> list[list[bytes]]:
    lo, hi = np.searchsorted(f.row, rows, "left"), np.searchsorted(f.row, rows, "right")
    columns, values = f.column.astype(np.uint16), f.value.astype(np.float32)
    return [[columns[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], [values[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], [f.dense[i].astype(np.float32).tobytes() for i in rows], [f.meta[i].astype(np.uint16).tobytes() for i in rows]]


def _unpacked(t: pa.Table) -> Features:
    columns, values = t.column("columns").to_pylist(), t.column("values").to_pylist()
    row = np.repeat(np.arange(t.num_rows), [len(c) // 2 for c in columns])
    dense = np.frombuffer(b"".join(t.column("dense").to_pylist()), np.float32).reshape(-1, DENSE)
    meta = np.frombuffer(b"".join(t.column("meta").to_pylist()), np.uint16).reshape(-1, 4).astype(np.int64)
    return Features(row, np.frombuffer(b"".join(columns), np.uint16).astype(np.int64), np.frombuffer(b"".join(values), np.float32).astype(float), dense.astype(float), meta)


def _content(x: K.Words) -> np.ndarray:
    return K.signed(K.range_hash(x.hash, x.first[:-1], x.first[1:]))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled documents, with the text's hash for `h`."""
    for b in batches:
        meta = meta_features(*(b.column(c) for c in ("source", "lang", "n_chars")))
        for row, end, raw, bounds in K.chunks(b.column("text")):
            x, f = features(raw, bounds, meta[row:end])
            n = end - row
            yield K.batch(_ROW_ARROW, b.column("doc_id").slice(row, n), np.zeros(n, np.int32), b.column("quality").slice(row, n).cast(pa.bool_()), np.ones(n), _content(x), *_packed(f, np.arange(n)))


def _surest(batches: Iterator[pa.RecordBatch], shared: Broadcast, per_class: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Of all documents of the partition, those each view is surest of, by class."""
    model = shared.value
    best: dict[tuple[int, int], dict[int, tuple]] = {(view, good): {} for view in (0, 1) for good in (0, 1)}
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        meta = meta_features(*(b.column(c) for c in ("source", "lang", "n_chars")))
        for row, end, raw, bounds in K.chunks(b.column("text")):
            x, f = features(raw, bounds, meta[row:end])
            content = _content(x)
            for view, score in enumerate(model.raw_scores(f)):
                p = 1 / (1 + np.exp(-np.clip(score, -35, 35)))
                sure = np.maximum(p, 1 - p)
                for good in (0, 1):
                    held, k = best[view, good], per_class[good]
                    mine = np.flatnonzero((sure >= CONFIDENT) & ((p > 0.5) == bool(good)) & (x.counts > 0))
                    if len(mine) > k:
                        # the k surest different texts are among these, as each has at least one row
                        order = mine[np.lexsort((content[mine], -sure[mine]))]
                        _, first = np.unique(content[order], return_index=True)
                        mine = order[np.sort(first)[:k]]
                    if len(held) >= k and k:
                        least = min(v[0] for v in held.values())
                        mine = mine[sure[mine] >= least]
                    for i, *parts in zip(mine, *_packed(f, mine), strict=True):
                        new = (float(sure[i]), int(ids[row + i]), parts)
                        h = int(content[i])
                        if h not in held or new[:2] > held[h][:2]:
                            held[h] = new
                    for h in sorted(held, key=lambda h: (-held[h][0], h))[k:]:
                        del held[h]
    for (view, good), held in best.items():
        if held:
            rows = [(v[1], view, bool(good), v[0], h, *v[2]) for h, v in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW_ARROW, strict=True)], schema=_ROW_ARROW)


def _prior(good: float, rows: int) -> float:
    p = (good + 1) / (rows + 2)
    return _log_odds(p)


def calibrated(model: Model, f: Features, y: np.ndarray, good: float, rows: int) -> Model:
    """The model with scales that turn its views' scores of these rows into log odds."""
    text, meta = model.raw_scores(f)
    return Model(model.text, model.meta, platt(text, y), platt(meta, y), _prior(good, rows))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """Of several labels of a document the highest counts, and of several texts with its doc_id the one of the least hash."""
    spark, h = docs.sparkSession, F.xxhash64("doc_id").alias("h")
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = quality.select("doc_id", "quality", h).orderBy("h", "doc_id").limit(train_docs)
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", "n_chars")
    # at most train_docs rows, so the broadcast is bounded
    mine = known.join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id").mapInArrow(_labelled, _ROW)
    one = mine.groupBy("doc_id").agg(F.min(F.struct("h", "view", "good", "sure", "columns", "values", "dense", "meta")).alias("one")).select("doc_id", F.xxhash64("doc_id").alias("key"), "one.*")
    table = one.toArrow().sort_by([("key", "ascending"), ("doc_id", "ascending")])
    f, y = _unpacked(table), table.column("good").to_numpy(zero_copy_only=False).astype(float)
    held = table.column("key").to_numpy() % HELD_OUT == 0 if table.num_rows else np.zeros(0, bool)
    train = ~held if len(y) and 0 < y[~held].sum() < (~held).sum() else np.ones(len(y), bool)
    share = float(y[train].mean()) if train.any() else 0.5
    per_class = (round(per_round * (1 - share)), round(per_round * share))
    matrices = [f.text_matrix()[train], f.meta_matrix()[train]]
    sets = [[(m, y[train])] for m in matrices]
    used: list[set[int]] = [set(), set()]

    def fitted() -> Model:
        return Model(*(fit_logistic(np.concatenate([m for m, _ in s]), np.concatenate([t for _, t in s])) for s in sets))

    model = fitted()
    # what isn't in the sample is as if it had no label, so no text is shuffled to leave all labelled ones out
    pool = known.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    for r in range(rounds if len(y) else 0):
        # a round asks for as many more as it may have used already
        wide = tuple(n * (r + 1) for n in per_class)
        shared = spark.sparkContext.broadcast(model)
        sure = pool.mapInArrow(partial(_surest, shared=shared, per_class=wide), _ROW)
        # copies of a text count once; aggregated before they are ordered, so that no task sorts the best of all others
        kept = F.max(F.struct("sure", "doc_id", "columns", "values", "dense", "meta")).alias("one")
        # written, as each of the four lists would score all documents for itself
        sure = written(sure.groupBy("view", "good", "h").agg(kept).select("view", "good", "h", "one.*"), "surest")
        best = [sure.where((F.col("view") == view) & (F.col("good") == bool(good))).orderBy(F.desc("sure"), "h").limit(wide[good]) for view in (0, 1) for good in (0, 1)]
        found = reduce(DataFrame.unionByName, best).toArrow().sort_by([("view", "ascending"), ("good", "ascending"), ("sure", "descending"), ("h", "ascending")])
        new = _unpacked(found)
        wides = (new.text_matrix(), new.meta_matrix())
        at = [found.column(c).to_numpy(zero_copy_only=False) for c in ("view", "good", "h")]
        for view, good in itertools.product((0, 1), (0, 1)):
            rows = np.flatnonzero((at[0] == view) & (at[1] == bool(good)))
            take = [i for i in rows if int(at[2][i]) not in used[1 - view]][: per_class[good]]
            used[1 - view].update(int(at[2][i]) for i in take)
            sets[1 - view].append((wides[1 - view][take], np.full(len(take), float(good))))
        model = fitted()
    check = held if held.any() else np.ones(len(y), bool)
    picked = np.flatnonzero(check)
    place = np.full(len(y), -1)
    place[picked] = np.arange(len(picked))
    keep = check[f.row] if len(f.row) else np.zeros(0, bool)
    part = Features(place[f.row[keep]], f.column[keep], f.value[keep], f.dense[picked], f.meta[picked])
    return calibrated(model, part, y[picked], float(y.sum()), len(y))


_ARROW = pa.schema([("doc_id", pa.int64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_()), ("toxic_score", pa.float64()), ("toxic", pa.bool_())])


def _toxic(model: toxicity.Toxicity | None, table: np.ndarray | None, raw: np.ndarray, x: K.Words) -> tuple[pa.Array, pa.Array]:
    """(probability, whether it is high) by row; nulls where none could be learned, 0 for a text without words."""
    rows = len(x.counts)
    if model is None:
        return pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.bool_())
    p = np.where(x.counts > 0, 1 / (1 + np.exp(-np.clip(model.scores(raw, x, table), -35, 35))), 0.0)
    return pa.array(np.round(p, 6)), pa.array(p >= toxicity.TOXIC)


def _apply(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model, toxic = shared.value
    table = toxic.table() if toxic is not None else None
    for b in batches:
        ids = b.column("doc_id")
        meta = meta_features(*(b.column(c) for c in ("source", "lang", "n_chars")))
        _, _, present = K.strings(b.column("text"))
        for row, end, raw, bounds in K.chunks(b.column("text")):
            x, f = features(raw, bounds, meta[row:end])
            a, m, both = model.scores(*model.raw_scores(f))
            both = np.where(present[row:end] & (x.counts > 0), both, 0.0)
            yield K.batch(_ARROW, ids.slice(row, end - row), np.round(a, 6), np.round(m, 6), np.round(both, 6), both >= KEEP, *_toxic(toxic, table, raw, x))


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep, toxic_score, toxic) of every document.

    The first three scores are probabilities of good quality, which alone decides ``keep``; ``toxic_score`` is one of
    toxicity.  It and ``toxic`` are null where the labels don't have documents of both kinds.

    A null, empty or wordless text has score 0 and isn't kept.  A null doc_id, source, lang or n_chars is allowed;
    the latter three are values of their own.  Repeated rows give a row each; of texts that repeat a doc_id one is
    learned from.  Ties of confidence go by the text's hash.  Very long texts are scored whole.
    Without labels all scores come from the prior of one half.  An empty table gives no rows.  Other columns are
    ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast((fit(docs, labels, train_docs, rounds), toxicity.fit(docs, labels)))
    rows = docs.select(F.col("doc_id").cast("long"), "text", "source", "lang", "n_chars")
    return rows.mapInArrow(partial(_apply, shared=model), "doc_id long, text_score double, meta_score double, score double, keep boolean, toxic_score double, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
