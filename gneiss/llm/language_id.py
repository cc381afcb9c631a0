"""Language of words in code-switched text by a linear-chain conditional random field.

A word's features are its affixes of one to three bytes, all its trigrams, and its number in a lexicon of the training
words; weights of the first two are hashed, and the lexicon tells words apart by 18 bits of their hashes.  A chain is a sentence, however long.  Transition weights are learned from
sentences of which half are spliced from two languages.  Forward-backward gives each word's label probabilities; long
chains are walked in blocks at once, whose messages are handed on exactly.

The field tells the languages apart, but not whether a text is in any of them.  That is judged by letter trigrams: a
document goes whose words are much less likely, each in its language, than those of held-out labelled documents.

Everything is learned from all labelled documents, whole.  The lexicon, the letters and what is usual are counted
exactly.  The field is trained in shards of about ``SHARD_BYTES`` of text each, cut by hash and so mixed whatever the
order of the table; each goes over its documents ``EPOCHS`` times, and the weights are then averaged, each shard
counting as much as its documents had to say of a weight.  The fit doesn't depend on how the table is laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import kernels as K
from gneiss.llm.shared import documents

EPOCHS = 3
#: Text that is learned from by one task.
SHARD_BYTES = 32 << 20
#: Text whose sentences are mixed with one another.
LESSON_BYTES = 2 << 20
#: Sentences a step, and this part of those seen so far at least, up to a bound; later steps need less noise.
STEP, STEP_PART, MOST_STEP = 256, 50, 1 << 15
#: Weights that tasks hand on as one row.
SLICE = 1 << 14
#: Of numbers of words that a task keeps so as not to find them again.
MEMO_BYTES = 24 << 20
#: Words that are walked at once; longer chains are joined of such blocks, with the same result.
BLOCK = 64
BUCKETS = 1 << 15
#: Words whose hashes agree in so many bits share a number in the lexicon.
WORD_BITS = 18
#: A document is rejected only if no language has this part of its words.
MIN_SHARE = 1 / 3
#: One labelled document in so many, by hash, calibrates how likely words of a language are.
HELD_OUT = 3
#: Mean log likelihood a letter that a document may lack: so often what one in 20 held-out documents lack, at least
#: the second, and so many standard errors of its words' mean besides.
LACK_TIMES, LEAST_LACK, ERRORS = 6, 0.8, 3
PRIOR, LETTER = 2.0, 1 / 64
#: A power of two, which numbers of either size hold exactly.
FIRST_SEEN = 2.0**-7
PAIRS, TRIPLES = 1 << 16, 1 << 17
#: Mean likelihoods of documents are told apart by this; sums of likelihoods are whole numbers of the other, so that their order doesn't matter.
BIN, UNIT = 2.0**-12, 2.0**-20

U32, U64 = np.uint32, np.uint64
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place in it) of the elements of consecutive runs of these sizes."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _distinct(number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(different ones in order, which of these each is) of numbers below ``size``, without sorting."""
    there = np.zeros(size, bool)
    there[number] = True
    some = np.flatnonzero(there)
    place = np.empty(size, np.int64)
    place[some] = np.arange(len(some))
    return some, place[number]


def _different(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each different hash, in the order of the hashes, which of these each is)."""
    order = np.argsort(value)
    head = np.ones(len(value), bool)
    head[1:] = value[order[1:]] != value[order[:-1]]
    which = np.empty(len(value), np.int64)
    which[order] = np.cumsum(head) - 1
    return order[head], which


def _apart(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of these words alone, a zero after each, starts and ends in these)."""
    size = end - start
    bounds = np.concatenate(([0], np.cumsum(size + 1)))
    place = np.repeat(start - bounds[:-1], size + 1) + np.arange(bounds[-1])
    out = raw[np.minimum(place, len(raw) - 1)]
    out[bounds[1:] - 1] = 0
    return out, bounds[:-1], bounds[1:] - 1


class Memo:
    """Numbers that words have whatever their text, of words met before; those that would share a place with an earlier one are found anew."""

    def __init__(self, columns: int) -> None:
        bits = max(10, min(19, (MEMO_BYTES // (8 * columns + 8)).bit_length() - 1))
        self.shift = U64(64 - bits)
        # a hash whose place is another
        self.hash = (np.arange(1 << bits, dtype=U64) ^ U64(1)) << self.shift
        self.numbers = np.empty((1 << bits, columns))

    def of(self, value: np.ndarray, find: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """A row for each of different hashes in order; ``find`` gives those of some of them."""
        place = (value >> self.shift).astype(np.int64)
        there = self.hash[place] == value
        out = np.take(self.numbers, place, axis=0)
        new = np.flatnonzero(~there)
        if len(new):
            out[new] = find(new)
            # of words with one place the first; where there is one already it stays
            at = place[new]
            free = self.hash[at] >> self.shift != at.astype(U64)
            free[1:] &= at[1:] != at[:-1]
            self.hash[at[free]], self.numbers[at[free]] = value[new[free]], out[new[free]]
        return out


def features(raw: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight numbers of the words one after another, bounds by word); the table's last weight is the absent feature and stays 0."""
    low = K.fold(raw)
    size = end - start

    def letter(at: np.ndarray, some: np.ndarray) -> np.ndarray:
        return np.where(some, low[np.clip(at, 0, len(low) - 1)], 0).astype(U32)

    front = [letter(start + i, i < size) for i in range(3)]
    back = [letter(end - 1 - i, i < size) for i in range(3)]
    n = 7 + np.maximum(size - 2, 0)
    bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(bounds[-1], np.int64)
    for i, (a, b, c) in enumerate((front, back)):
        for j, code in enumerate((a, a << 8 | b, a << 16 | b << 8 | c)):
            out[bounds[:-1] + 3 * i + j] = (code * U32(0x9E3779B1) + U32((3 * i + j) * 0x85EBCA77 & 0xFFFFFFFF)) >> U32(17)
    out[bounds[:-1] + 6] = BUCKETS + len(lexicon)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, value), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == value)
        out[bounds[known] + 6] = BUCKETS + at[known]
    which, j = _within(n - 7)
    at = start[which] + j
    tri = low[at].astype(U32) << 16 | low[at + 1].astype(U32) << 8 | low[at + 2].astype(U32) if len(at) else np.zeros(0, U32)
    out[bounds[which] + 7 + j] = (tri * U32(0x9E3779B1) + U32(0xC2B2AE3D)) >> U32(17)
    return out, bounds


def chains(raw: np.ndarray, x: K.Words) -> np.ndarray:
    """First word of each chain, with one more bound at the end."""
    n = len(x.hash)
    if n == 0:
        return np.zeros(1, np.int64)
    new = np.zeros(n + 1, bool)
    new[np.searchsorted(x.start, np.flatnonzero(_STOP[raw]))] = True
    new[x.first[:-1][x.counts > 0]] = True
    new[n] = True
    return np.flatnonzero(new)


def trigrams(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which word, number of the two letters before, number of the trigram) at each of all words' letters and ends."""
    alone, start, end = _apart(raw, start, end)
    low = K.fold(alone).astype(U32)
    letter = [np.zeros_like(low), np.zeros_like(low), low]
    letter[0][2:], letter[1][1:] = low[:-2], low[:-1]
    letter[0][start] = 0
    which = np.repeat(np.arange(len(start)), end - start + 1)
    before = letter[0] << 8 | letter[1]
    whole = ((before << 8 | letter[2]) * U32(0x9E3779B1)) >> U32(15)
    return which, before.astype(np.int64), whole.astype(np.int64)


@dataclass
class Likelihood:
    """Letter trigrams by language, and what is usual for the words and documents of each."""

    before: np.ndarray
    whole: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    lack: float = LEAST_LACK

    def scores(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mean log likelihood of the letters of each word in each language."""
        if not len(start):
            return np.zeros((0, self.before.shape[1]))
        _, before, whole = trigrams(raw, start, end)
        letters = end - start + 1
        total = np.add.reduceat(self.whole[whole] - self.before[before], np.cumsum(letters) - letters, axis=0, dtype=np.float64)
        return total / letters[:, None]

    def lacks(self, score: np.ndarray, label: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By row, how much less likely the words are than usual, and the standard error of that; ``score`` has each word's in its language."""
        some = np.maximum(n, 1)
        less = np.bincount(row, weights=self.mean[label] - score, minlength=len(n)) / some
        return less, np.sqrt(np.bincount(row, weights=self.spread[label] ** 2, minlength=len(n))) / some


def _numbers(value: np.ndarray) -> np.ndarray:
    """What the lexicon tells words apart by, of their hashes."""
    return value >> U64(64 - WORD_BITS)


def _coded(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, int(np.prod(shape)) * 8, codec="zstd", asbytes=True), np.int64).reshape(shape)


#: Of learned and of held-out documents: letters by trigram, by the two before, words and bytes.
_COUNTS = (2, TRIPLES + PAIRS + 2)
_TOTALS = pa.schema([("lang", pa.string()), ("data", pa.binary())])


def _totals(tables: dict[str | None, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, table in tables.items():
        yield K.batch(_TOTALS, [name], [_packed(table)])


@K.returning
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language, and under null how often, up to twice, each number of the lexicon stands there."""
    seen = np.zeros(1 << WORD_BITS, np.int64)
    tables: dict[str | None, np.ndarray] = {}
    for b in batches:
        held = b.column("held").to_numpy(zero_copy_only=False).astype(np.int64)
        for at, end, raw, bounds in K.chunks(b.column("text")):
            names, code = _coded(b.column("lang").slice(at, end - at))
            group, groups = code * 2 + held[at:end], 2 * len(names)
            x = K.words(raw, bounds)
            first, inverse = _different(x.hash)
            seen += np.bincount(_numbers(x.hash).astype(np.int64), minlength=1 << WORD_BITS)
            n = np.bincount(inverse * groups + group[x.row_of()], minlength=len(first) * groups).reshape(-1, groups)
            _, before, whole = trigrams(raw, x.start[first], x.end[first])
            words, size = np.bincount(group, weights=x.counts, minlength=groups), np.bincount(group, weights=np.diff(bounds), minlength=groups)
            # the letters of each different word once for each group that has it
            word, of = np.nonzero(n)
            letters = x.end[first] - x.start[first] + 1
            which, place = _within(letters[word])
            letter, times, of = (np.cumsum(letters) - letters)[word][which] + place, n[word, of][which], of[which]
            found = np.bincount(of * TRIPLES + whole[letter], weights=times, minlength=groups * TRIPLES).reshape(-1, 2, TRIPLES)
            found_before = np.bincount(of * PAIRS + before[letter], weights=times, minlength=groups * PAIRS).reshape(-1, 2, PAIRS)
            for i, name in enumerate(names):
                table = tables.setdefault(name, np.zeros(_COUNTS, np.int64))
                table[:, :TRIPLES] += found[i].astype(np.int64)
                table[:, TRIPLES:-2] += found_before[i].astype(np.int64)
                table[:, -2] += words[2 * i : 2 * i + 2].astype(np.int64)
                table[:, -1] += size[2 * i : 2 * i + 2].astype(np.int64)
    if tables:
        yield from _totals(tables | {None: np.minimum(seen, 2)})


@K.returning
def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str | None, np.ndarray] = {}
    for b in batches:
        for name, data in zip(b.column("lang").to_pylist(), b.column("data").to_pylist(), strict=True):
            table = _unpacked(data, (1 << WORD_BITS,) if name is None else _COUNTS)
            tables[name] = tables[name] + table if name in tables else table
    yield from _totals(tables)


def counts(known: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(lexicon, counts by language in order) of all labelled documents."""
    rows = known.select("lang", "text", "held").mapInArrow(_count, "lang string, data binary").repartition("lang").mapInArrow(_add, "lang string, data binary").collect()
    lexicon, tables = np.zeros(0, U64), {}
    for name, data in rows:
        if name is None:
            lexicon = np.flatnonzero(_unpacked(data, (1 << WORD_BITS,)) > 1).astype(U64)
        else:
            tables[name] = _unpacked(data, _COUNTS)
    return lexicon, dict(sorted(tables.items()))


_TRIED = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("words", pa.int64()), ("total", pa.int64()), ("squares", pa.int64())])


@K.returning
def _try(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """How likely the words of each document that has any are in its language."""
    usual, labels = shared.value
    number = {name: i for i, name in enumerate(labels)}
    memo = Memo(len(labels))
    for b in batches:
        for at, end, raw, bounds in K.chunks(b.column("text")):
            names, code = _coded(b.column("lang").slice(at, end - at))
            label = np.array([number[name] for name in names])[code]
            x = K.words(raw, bounds)
            row, n = x.row_of(), x.counts
            first, inverse = _different(x.hash)
            score = memo.of(x.hash[first], lambda new, x=x, raw=raw, first=first: usual.scores(raw, x.start[first[new]], x.end[first[new]]))
            score = score.ravel()[inverse * len(labels) + label[row]]
            total = np.bincount(row, weights=np.rint(score / UNIT), minlength=len(n))
            squares = np.bincount(row, weights=np.rint(score**2 / UNIT), minlength=len(n))
            some = np.flatnonzero(n)
            mean = np.rint(total[some] * UNIT / n[some] / BIN)
            yield K.batch(_TRIED, pa.array(names, pa.string()).take(pa.array(code[some])), mean.astype(np.int32), n[some].astype(np.int64), total[some].astype(np.int64), squares[some].astype(np.int64))


def _quantile(value: np.ndarray, times: np.ndarray, part: float) -> float:
    """As numpy has it, of values that stand there several times each."""
    order = np.argsort(value)
    upto, at = np.cumsum(times[order]), part * (int(times.sum()) - 1)
    low, high = (value[order][np.searchsorted(upto, place, "right")] for place in (int(at), int(np.ceil(at))))
    return float(low + (high - low) * (at - int(at)))


def likelihood(known: DataFrame, tables: dict[str, np.ndarray]) -> Likelihood | None:
    """Fit on all labelled documents, some of which are held out for what is usual.

    A language of which no words would be left on either side is learned and tried on all its documents.
    """
    labels, k = list(tables), len(tables)
    if not any(t[:, -2].any() for t in tables.values()):
        return None
    apart = [bool(t[:, -2].all()) for t in tables.values()]
    learned = [t[0] if a else t.sum(axis=0) for t, a in zip(tables.values(), apart, strict=True)]
    whole, before = (np.stack([t[of] for t in learned], axis=1) for of in (slice(0, TRIPLES), slice(TRIPLES, TRIPLES + PAIRS)))
    out = Likelihood(np.log(before + PRIOR).astype(np.float32), np.log(whole + PRIOR * LETTER).astype(np.float32), np.zeros(k), np.zeros(k))
    shared = known.sparkSession.sparkContext.broadcast((out, labels))
    tried = known.where(F.col("held") | F.col("lang").isin([name for name, a in zip(labels, apart, strict=True) if not a])).select("lang", "text")
    tried = tried.mapInArrow(partial(_try, shared=shared), "lang string, bin int, words long, total long, squares long")
    tried = tried.groupBy("lang", "bin").agg(F.count("*").alias("docs"), *(F.sum(c).alias(c) for c in ("words", "total", "squares"))).toArrow()
    label = np.array([labels.index(name) for name in tried.column("lang").to_pylist()], np.int64)
    place, docs, *sums = (tried.column(c).to_numpy() for c in ("bin", "docs", "words", "total", "squares"))
    for i in range(k):
        # whole numbers of any size; a language whose documents have no words is as unlikely as can be
        words, total, squares = (sum(c[label == i].tolist()) for c in sums)
        if words:
            out.mean[i] = total / words * UNIT
            out.spread[i] = np.sqrt(max(0.0, squares / words * UNIT - out.mean[i] ** 2))
    held = np.array(apart)[label]
    if held.any():
        out.lack = max(LEAST_LACK, LACK_TIMES * _quantile(out.mean[label[held]] - place[held] * BIN, docs[held], 0.95))
    return out


@dataclass
class Field:
    labels: list[str]
    lexicon: np.ndarray
    weight: np.ndarray
    change: np.ndarray
    usual: Likelihood | None = None

    def scores(self, feature: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """By label, of the words."""
        if len(bounds) < 2:
            return np.zeros((self.weight.shape[1], 0), self.weight.dtype)
        return np.ascontiguousarray(np.add.reduceat(np.take(self.weight, feature, axis=0), bounds[:-1], axis=0).T)


def _messages(factor: np.ndarray, word: np.ndarray, bounds: np.ndarray, change: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of the blocks that chains are cut into, what comes to each from the left and from the right, whether it continues a chain)."""
    k, sizes = len(factor), np.diff(bounds)
    per = -(-sizes // block)
    chain, place = _within(per)
    start = bounds[:-1][chain] + place * block
    size = np.minimum(block, sizes[chain] - place * block)
    left, right = np.ones((len(start), k)), np.ones((len(start), k))
    many = np.flatnonzero(per[chain] > 1)
    if len(many):
        # the product of each block's steps, the longest blocks first, then one step a block
        many = many[np.argsort(-size[many], kind="stable")]
        live = np.searchsorted(-size[many], -np.arange(block))
        back = np.ascontiguousarray(change.T)
        product = np.eye(k)[:, :, None] * factor[:, word[start[many]]]
        for t in range(1, block):
            n = live[t]
            step = (back @ product[:, :, :n]) * factor[:, word[start[many[:n]] + t]]
            product[:, :, :n] = step / step.sum(axis=(0, 1))
        number = np.empty(len(start), np.int64)
        number[many] = np.arange(len(many))
        product = np.ascontiguousarray(product.transpose(2, 0, 1))
        first = np.cumsum(per) - per
        long = np.flatnonzero(per > 1)
        for t in range(1, int(per.max())):
            i = first[long[per[long] > t]] + t
            came = (left[i - 1][:, None, :] @ product[number[i - 1]] @ change)[:, 0]
            left[i] = came / came.sum(axis=1, keepdims=True)
            i = first[long[per[long] > t]] + per[long[per[long] > t]] - t
            came = (change @ product[number[i]] @ right[i][:, :, None])[:, :, 0]
            right[i - 1] = came / came.sum(axis=1, keepdims=True)
    return np.append(start, bounds[-1]), left, right, place > 0


def walk(factor: np.ndarray, word: np.ndarray, bounds: np.ndarray, change: np.ndarray, pairs: bool = False, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(label probabilities by label of each word of the chains, in the order of their steps; which words these are; the expected label pairs if asked).

    ``factor`` has the positive emission factors of the different words, a row a label, and ``word`` which of these each is.
    """
    bounds, left, right, inner = _messages(factor, word, bounds, change, block)
    length, kind = np.diff(bounds), factor.dtype
    order = np.argsort(-length, kind="stable")
    start, length = bounds[:-1][order], length[order]
    left, right = left[order].T.astype(kind), right[order].T.astype(kind)
    # all first words, then all second ones, and so on, those of the longest blocks first
    place = np.arange(bounds[-1]) - np.repeat(np.cumsum(length) - length, length)
    step = place.astype(np.uint16) if block < 1 << 16 else place
    by_step = np.argsort(step, kind="stable")
    at = (np.repeat(start, length) + place)[by_step]
    live = np.bincount(step)
    upto = np.concatenate(([0], np.cumsum(live)))
    change = change.astype(kind)
    back = np.ascontiguousarray(change.T)
    e = np.take(factor, word[at], axis=1)
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty(e.shape[1], kind)
    for t, n in enumerate(live):
        now = slice(upto[t], upto[t + 1])
        mine = (left if t == 0 else back @ alpha[:, upto[t - 1] : upto[t - 1] + n]) * e[:, now]
        np.divide(1, mine.sum(axis=0), out=scale[now])
        np.multiply(mine, scale[now], out=alpha[:, now])
    beta[:, upto[length - 1] + np.arange(len(length))] = right
    for t in range(len(live) - 1, 0, -1):
        now = slice(upto[t], upto[t + 1])
        b = change @ (e[:, now] * beta[:, now])
        np.multiply(b, 1 / b.sum(axis=0), out=beta[:, upto[t - 1] : upto[t - 1] + live[t]])
    out = alpha * beta
    whole = 1 / out.sum(axis=0)
    out *= whole
    expected = None
    if pairs:
        # what comes to each from its side, over what comes to both
        e *= beta
        e *= whole
        expected = np.zeros((len(change), len(change)))
        for t in range(1, len(live)):
            now = slice(upto[t], upto[t + 1])
            expected += (alpha[:, upto[t - 1] : upto[t - 1] + live[t]] * scale[now]) @ e[:, now].T
        if inner.any():
            # the last words of blocks that are continued, before the first of the next
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            i = np.flatnonzero(inner)
            last = number[i - 1]
            before, b = alpha[:, upto[length[last] - 1] + last], e[:, number[i]]
            expected += (before * (1 / ((back @ before) * b).sum(axis=0))) @ b.T
        expected *= change
    return out, at, expected


def forward_backward(emission: np.ndarray, bounds: np.ndarray, change: np.ndarray, pairs: bool = False, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of each word, given positive emission factors, and the expected label pairs if asked."""
    p, at, expected = walk(np.ascontiguousarray(emission.T), np.arange(len(emission)), bounds, change, pairs, block)
    out = np.empty_like(p)
    out[:, at] = p
    return out.T, expected


def factors(score: np.ndarray) -> np.ndarray:
    """Of scores with a row a label."""
    return np.exp(np.maximum(score - score.max(axis=0), -50))


@dataclass
class Lesson:
    """Texts as training sees them."""

    #: Which of the different words each word is.
    word: np.ndarray
    #: First word of each chain, with one more bound at the end, and the chain's label.
    cut: np.ndarray
    truth: np.ndarray
    #: Weights that the texts have, which of these each different word has, and bounds by word.
    mine: np.ndarray
    feature: np.ndarray
    bounds: np.ndarray


def lessons(texts: pa.Array, language: np.ndarray, lexicon: np.ndarray) -> Iterator[Lesson]:
    for row, end, raw, bounds in K.chunks(texts, LESSON_BYTES):
        x = K.words(raw, bounds)
        if len(x.hash):
            first, inverse = _different(x.hash)
            feature, at = features(raw, x.start[first], x.end[first], _numbers(x.hash[first]), lexicon)
            mine, feature = _distinct(feature, BUCKETS + len(lexicon) + 1)
            cut = chains(raw, x)
            truth = language[row:end][np.searchsorted(x.first, cut[:-1], "right") - 1]
            yield Lesson(*(a.astype(np.int32) for a in (inverse, cut, truth, mine, feature, at)))


def train(parts: list[Lesson], labels: list[str], lexicon: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[Field, np.ndarray, np.ndarray]:
    """Fit on texts of one language each; also how much was seen of each weight and of each change."""
    k = len(labels)
    field = Field(labels, lexicon, np.zeros((BUCKETS + len(lexicon) + 1, k), np.float32), np.zeros((k, k)))
    seen, seen_change, rate, done = np.full(field.weight.shape, FIRST_SEEN, np.float32), np.full((k, k), FIRST_SEEN), 0.3, 0
    rng = np.random.default_rng(seed)
    for x in [x for _ in range(epochs) for x in parts]:
        # the weights of these texts only
        local, local_seen = Field(labels, lexicon, field.weight[x.mine], field.change), seen[x.mine]
        start, size = x.cut[:-1].astype(np.int64), np.diff(x.cut).astype(np.int64)
        other, pick = rng.permutation(len(size)), rng.random(len(size)) < 0.5
        # of each chain a piece of its own, and of half of them the end of another
        from_ = np.stack((start, start[other] + size[other] // 2), axis=1)
        long = np.stack((np.where(pick, (size + 1) // 2, size), np.where(pick, size[other] - size[other] // 2, 0)), axis=1)
        label = np.stack((x.truth, x.truth[other]), axis=1).astype(np.int64)
        order, step = rng.permutation(len(size)), 0
        while step < len(order):
            part = order[step : step + min(MOST_STEP, max(STEP, done // STEP_PART))]
            step, done = step + len(part), done + len(part)
            sizes, ends = long[part].ravel(), np.concatenate(([0], np.cumsum(long[part].sum(axis=1))))
            at = np.repeat(from_[part].ravel() - (np.cumsum(sizes) - sizes), sizes) + np.arange(ends[-1])
            # each different word of the part once, as often as it stands there
            some, which = _distinct(x.word[at], len(x.bounds) - 1)
            n = np.diff(x.bounds)[some]
            upto = np.concatenate(([0], np.cumsum(n)))
            f = x.feature[np.repeat(x.bounds[some] - upto[:-1], n) + np.arange(upto[-1])].astype(np.int64)
            p, at, pairs = walk(factors(local.scores(f, upto)), which, ends, np.exp(field.change), pairs=True)
            of = which[at]
            true = np.bincount(np.repeat(label[part].ravel() * len(some), sizes) + which, minlength=k * len(some)).reshape(k, -1)
            total = [(np.bincount(of, weights=p[i], minlength=len(some)) - true[i]) / len(part) for i in range(k)]
            gradient = np.stack([np.bincount(f, weights=np.repeat(t, n), minlength=len(x.mine)) for t in total], axis=1).astype(np.float32)
            gradient[x.mine == len(field.weight) - 1] = 0
            # labels stay within a piece, and change where another follows
            one, two = label[part].T
            more, less = long[part].T
            pairs -= np.diag(np.bincount(one, weights=more - 1, minlength=k) + np.bincount(two, weights=np.maximum(less - 1, 0), minlength=k))
            pairs -= np.bincount((one * k + two)[less > 0], minlength=k * k).reshape(k, k)
            local_seen += gradient**2
            local.weight -= rate * gradient / np.sqrt(local_seen)
            pairs /= len(part)
            seen_change += pairs**2
            field.change -= rate * pairs / np.sqrt(seen_change)
        field.weight[x.mine], seen[x.mine] = local.weight, local_seen
    return field, (seen.astype(np.float64) - FIRST_SEEN).sum(axis=1), seen_change - FIRST_SEEN


_PART = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("weight", pa.binary()), ("seen", pa.binary())])
_PART_SCHEMA = "part int, shard int, weight binary, seen binary"
#: The part that has the changes of label.
_CHANGE = -1


@K.returning
def _train(batches: Iterator[pa.RecordBatch], shared: Broadcast, epochs: int) -> Iterator[pa.RecordBatch]:
    labels, lexicon = shared.value
    number = {name: i for i, name in enumerate(labels)}
    parts = []
    for b in batches:
        names, code = _coded(b.column("lang"))
        parts += lessons(b.column("text"), np.array([number[name] for name in names], np.int64)[code], lexicon)
    if not parts:
        return
    del b
    K.release()
    shard = TaskContext.get().partitionId()
    field, seen, seen_change = train(parts, labels, lexicon, epochs)
    parts.clear()
    K.release()
    for i in range(0, len(seen), SLICE):
        if seen[i : i + SLICE].any():
            yield K.batch(_PART, [i // SLICE], [shard], [field.weight[i : i + SLICE].tobytes()], [seen[i : i + SLICE].astype(np.float32).tobytes()])
    yield K.batch(_PART, [_CHANGE], [shard], [field.change.astype(np.float32).tobytes()], [seen_change.astype(np.float32).tobytes()])


@K.returning
def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each weight, by how much each shard has seen of it."""
    sums: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for part, weight, seen in zip(b.column("part").to_pylist(), b.column("weight").to_pylist(), b.column("seen").to_pylist(), strict=True):
            n = np.frombuffer(seen, np.float32).astype(np.float64)
            w = np.frombuffer(weight, np.float32).reshape(len(n), -1) * n[:, None]
            if part in sums:
                sums[part][0] += w
                sums[part][1] += n
            else:
                sums[part] = [w, n.copy()]
    for part, (w, n) in sums.items():
        mean = np.divide(w, n[:, None], out=np.zeros_like(w), where=n[:, None] > 0)
        yield K.batch(_PART, [part], [0], [mean.astype(np.float32).tobytes()], [b""])


def word_numbers(field: Field, memo: Memo, raw: np.ndarray, x: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(emission factors and mean log likelihoods by language of the different words, a row a word; which of these each word is)."""
    first, inverse = _different(x.hash)
    value = x.hash[first]

    def find(new: np.ndarray) -> np.ndarray:
        alone = _apart(raw, x.start[first[new]], x.end[first[new]])
        out = factors(field.scores(*features(*alone, _numbers(value[new]), field.lexicon)).astype(np.float64)).T
        return out if field.usual is None else np.concatenate((out, field.usual.scores(*alone)), axis=1)

    return memo.of(value, find), inverse


def fit(docs: DataFrame, epochs: int = EPOCHS) -> Field:
    """Train on all labelled documents."""
    h = F.xxhash64("doc_id", "text")
    known = docs.where("text is not null and lang is not null").select("lang", "text", h.alias("h"), (F.pmod(F.shiftright(h, 32), F.lit(HELD_OUT)) == 0).alias("held"))
    lexicon, tables = counts(known)
    labels, k = list(tables), max(1, len(tables))
    field = Field(labels, lexicon, np.zeros((BUCKETS + len(lexicon) + 1, k), np.float32), np.zeros((k, k)), likelihood(known, tables))
    if len(labels) < 2 or field.usual is None:
        return field
    shards = -(-sum(int(t[:, -1].sum()) for t in tables.values()) // SHARD_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast((labels, lexicon))
    mixed = known.select("lang", "text", "h").repartition(shards, "h").sortWithinPartitions("h", "lang").select("lang", "text")
    trained = mixed.mapInArrow(partial(_train, shared=shared, epochs=epochs), _PART_SCHEMA)
    for part, _, weight, _ in trained.repartition("part").sortWithinPartitions("part", "shard").mapInArrow(_average, _PART_SCHEMA).collect():
        mean = np.frombuffer(weight, np.float32)
        if part == _CHANGE:
            field.change[:] = mean.reshape(k, k)
        else:
            field.weight[part * SLICE : (part + 1) * SLICE] = mean.reshape(-1, k)
    return field


_SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64()), ("n_words", pa.int32()), ("n_switches", pa.int32()), ("spans", pa.list_(_SPAN_TYPE)), ("keep", pa.bool_())])
_SCHEMA = "doc_id long, lang string, share double, confidence double, n_words int, n_switches int, spans array<struct<start:int,end:int,lang:string>>, keep boolean"


def _best(p: np.ndarray) -> np.ndarray:
    """Number of the largest of each column, of equals the first."""
    out, most = np.zeros(p.shape[1], np.int64), p[0].copy()
    for i in range(1, len(p)):
        out[p[i] > most] = i
        np.maximum(most, p[i], out=most)
    return out


def _memo(field: Field) -> Memo:
    return Memo(len(field.labels) * (1 if field.usual is None else 2))


def _verdicts(field: Field, memo: Memo, raw: np.ndarray, bounds: np.ndarray, min_share: float, spans: bool = True) -> dict[str, object]:
    x = K.words(raw, bounds)
    n, rows, k = x.counts, len(bounds) - 1, len(field.labels)
    names = pa.array(field.labels, pa.string())
    out: dict[str, object] = {"n": n, "share": np.zeros(rows), "confidence": np.zeros(rows), "best": np.zeros(rows, np.int64)}
    label = np.zeros(len(x.hash), np.int64)
    row = x.row_of()
    likely = np.ones(rows, bool)
    if k and len(x.hash):
        numbers, word = word_numbers(field, memo, raw, x)
        p, at, _ = walk(np.ascontiguousarray(numbers[:, :k].T), word, chains(raw, x), np.exp(field.change))
        label[at] = _best(p)
        votes = np.bincount(row * k + label, minlength=rows * k).reshape(rows, k)
        best = votes.argmax(axis=1)
        some = np.maximum(n, 1)
        out["best"], out["share"] = best, votes[np.arange(rows), best] / some
        row_at = row[at]
        out["confidence"] = np.bincount(row_at, weights=p.ravel()[best[row_at] * len(at) + np.arange(len(at))], minlength=rows) / some
        if field.usual is not None:
            less, error = field.usual.lacks(numbers.ravel()[word * (2 * k) + k + label], label, row, n)
            likely = less <= field.usual.lack + ERRORS * error
    known = (n > 0) & (k > 0)
    out["lang"] = names.take(pa.array(out["best"], mask=~known)) if k else pa.nulls(rows, pa.string())
    out["keep"] = known & likely & (out["share"] >= min_share)
    if spans:
        head = np.ones(len(label), bool)
        head[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
        i = np.flatnonzero(head) if k else np.zeros(0, np.int64)
        end = np.append(i[1:], len(label)) if len(i) else i
        begin = x.first[row[i]]
        per = np.bincount(row[i], minlength=rows)
        structs = pa.StructArray.from_arrays([pa.array((i - begin).astype(np.int32)), pa.array((end - begin).astype(np.int32)), names.take(pa.array(label[i])) if k else pa.array([], pa.string())], fields=list(_SPAN_TYPE))
        out["spans"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), structs)
        out["switches"] = np.maximum(per - 1, 0)
    return out


@K.returning
def _label(batches: Iterator[pa.RecordBatch], shared: Broadcast, min_share: float) -> Iterator[pa.RecordBatch]:
    memo = _memo(shared.value)
    for b in batches:
        ids = b.column("doc_id")
        for row, end, raw, bounds in K.chunks(b.column("text")):
            v = _verdicts(shared.value, memo, raw, bounds, min_share)
            yield K.batch(_ARROW, ids.slice(row, end - row), v["lang"], np.round(v["share"], 6), np.round(v["confidence"], 6), v["n"].astype(np.int32), v["switches"].astype(np.int32), v["spans"], v["keep"])


def identify(docs: DataFrame, epochs: int = EPOCHS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, lang, share, confidence, n_words, n_switches, spans, keep) of every document.

    ``spans`` has the runs of words of one language, ``lang`` is the commonest (of equals the first by name),
    ``share`` its part of the words and ``confidence`` the mean probability that the field gives it.  ``keep`` is
    whether the share is at least ``min_share`` and the words are about as likely in their languages as those of
    labelled documents are; gibberish and languages that weren't learned go.

    A null, empty or wordless text has a null lang, no words, and isn't kept; a null doc_id stays null.  Repeated
    rows give a row each.  Very long texts are labelled whole.  Without labelled rows no language is known and
    nothing is kept; rows whose lang is null are labelled but not learned from.  Other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, epochs))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_label, shared=field, min_share=min_share), _SCHEMA)


@K.returning
def _filter(batches: Iterator[pa.RecordBatch], shared: Broadcast, min_share: float) -> Iterator[pa.RecordBatch]:
    memo = _memo(shared.value)
    for b in batches:
        keep = [_verdicts(shared.value, memo, raw, bounds, min_share, spans=False)["keep"] for _, _, raw, bounds in K.chunks(b.column("text"))]
        if keep:
            yield b.filter(pa.array(np.concatenate(keep)))


def in_known_language(docs: DataFrame, epochs: int = EPOCHS, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents that ``identify`` keeps, with their columns, whatever their names.

    A null doc_id doesn't matter here.  Null, empty and wordless texts go.  Repeated rows fare alike, very long texts
    are judged whole, and an empty table stays empty.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, epochs))
    return docs.mapInArrow(partial(_filter, shared=field, min_share=min_share), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
