import random

import numpy as np
import pytest

from gneiss.llm import fm_index, kernels, near_dedup, substring_dedup
from gneiss.llm.components import components
from tests.llm.helpers import DOCS, EXTRA, empty, messy, prose, words


def brute_intervals(rows, length):
    runs = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - length + 1):
            runs.setdefault(tuple(w[i : i + length]), set()).add(doc)
    out = set()
    for doc, text in rows:
        w = words(text)
        for first in (True, False):
            at = [i for i in range(len(w) - length + 1) if len(d := runs[tuple(w[i : i + length])]) > 1 and (min(d) == doc) == first]
            span = None
            for i in at:
                if span and i <= span[1]:
                    span[1] = i + length
                else:
                    if span:
                        out.add((doc, first, *span))
                    span = [i, i + length]
            if span:
                out.add((doc, first, *span))
    return out


def overlapping_texts(seed, docs=40, vocabulary=4000):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randrange(8, 40), vocabulary) for _ in range(8)]
    rows = []
    for i in range(docs):
        parts = [prose(rng, rng.randrange(0, 60), vocabulary)]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 20), vocabulary)]
        rows.append((i, " ".join(parts)))
    rows += [(docs, rows[0][1]), (docs + 1, rows[3][1].upper() + " Ä é ñ"), (docs + 2, "a " * 200), (docs + 3, "a " * 130)]
    return rows


@pytest.mark.parametrize(("seed", "vocabulary", "shard_words"), [(1, 4000, 300_000), (2, 4000, 60), (3, 3, 200)])
def test_substring_intervals_match_brute_force(spark, seed, vocabulary, shard_words):
    rows = overlapping_texts(seed, vocabulary=vocabulary)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.substring_duplicates(df, length=10, k=4, shard_words=shard_words).collect()
    got = {(r.doc_id, r.first, r.start_word, r.end_word) for r in found}
    assert len(got) == len(found)
    # a document that both has and repeats a run is judged by the least document of each run
    assert got == brute_intervals(rows, 10)
    assert all(r.n_words == r.end_word - r.start_word for r in found)


def test_suffix_array_and_wavelet_rank():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 300)
    sa, rank = fm_index.suffix_array(text)
    assert sa.tolist() == sorted(range(300), key=lambda i: text[i:].tolist())
    assert (rank[sa] == np.arange(300)).all()
    wavelet = fm_index.WaveletMatrix(text, 4)
    for c in range(4):
        base = wavelet.rank(np.array([c]), np.array([0]))[0]
        for place in (0, 1, 64, 65, 299, 300):
            assert wavelet.rank(np.array([c]), np.array([place]))[0] - base == (text[:place] == c).sum()


def test_without_repeats_cuts_later_copies(spark):
    rng = random.Random(9)
    passage = prose(rng, 30)
    rows = [(1, "alpha " + passage + " beta", "en", "s", 1), (2, "gamma; " + passage + ". Delta", "en", "s", 1), (3, passage, "en", "s", 1), (4, "left alone", "en", "s", 1)]
    out = {r.doc_id: r for r in substring_dedup.without_repeats(spark.createDataFrame(rows, DOCS), length=10, k=4).collect()}
    assert out[1].text == rows[0][1] and out[4].text == "left alone"
    assert words(out[2].text) == ["gamma", "delta"] and out[2].n_chars == len(out[2].text)
    assert 3 not in out


@pytest.mark.parametrize("operator", [substring_dedup.substring_duplicates, near_dedup.near_duplicate_groups])
def test_messy_and_empty_tables(spark, operator):
    assert operator(empty(spark)).count() == 0
    # the same document twice is one document
    assert {r.doc_id for r in operator(messy(spark)).collect()} == set()
    rng = random.Random(4)
    copy = prose(rng, 120)
    assert {r.doc_id for r in operator(messy(spark, [copy, copy])).collect()} == {100, 101}


@pytest.mark.parametrize("operator", [substring_dedup.without_repeats, near_dedup.without_near_duplicates])
def test_filters_keep_columns_and_odd_rows(spark, operator):
    rng = random.Random(4)
    copy = prose(rng, 120)
    docs = messy(spark, [copy, copy])
    out = operator(docs)
    assert out.columns == docs.columns and set(EXTRA) < set(out.columns)
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 2 and {1, 2, 3, 5, 6, 100} <= set(ids) and 101 not in ids and 4 in ids
    assert operator(empty(spark)).count() == 0


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}


def test_near_groups_against_exact_jaccard(spark):
    rng = random.Random(11)
    rows = []
    for base in range(60):
        w = prose(rng, rng.randrange(60, 200)).split()
        rows.append((base * 10, " ".join(w)))
        for c in range(1, 4):
            v = list(w)
            for _ in range(max(1, len(v) * c // 50)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(9999)}"
            rows.append((base * 10 + c, " ".join(v)))
    rows += [(1000 + i, prose(rng, 100)) for i in range(100)] + [(2000, "Two words"), (2001, "two WORDS!"), (2002, "two word")]
    groups = {r.doc_id: r for r in near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    hit = total = 0
    for a in sets:
        for b in sets:
            if a < b:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                same = a in groups and b in groups and groups[a].group_id == groups[b].group_id
                if j >= 0.6:
                    total += 1
                    hit += same
                if j < 0.1:
                    assert not same
    assert total > 100 and hit / total >= 0.95
    assert groups[2001].group_id == 2000 and groups[2000].keep and not groups[2001].keep and 2002 not in groups
    assert all(r.keep == (r.doc_id == r.group_id) for r in groups.values())
    assert not any(1000 <= i < 1100 for i in groups)


def test_lone_pairs_at_the_threshold_are_found(spark):
    rng = random.Random(17)
    rows, pairs = [], 0
    for i in range(3000):
        w = prose(rng, rng.randrange(100, 200), 10**6).split()
        v = list(w)
        for at in rng.sample(range(len(v)), round(len(v) * rng.uniform(0.105, 0.125))):
            v[at] = f"x{rng.randrange(10**6)}"
        a, b = shingle_set(" ".join(w)), shingle_set(" ".join(v))
        if 0.5 <= len(a & b) / len(a | b) < 0.54:
            pairs += 1
            rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    found = near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).where("not keep").count()
    assert pairs > 300 and found >= 0.9 * pairs, (pairs, found)


def test_a_large_group_of_copies(spark):
    rng = random.Random(1)
    text = prose(rng, 50)
    rows = [(i, text) for i in range(3000)]
    out = near_dedup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in out] == [0]


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 1 << 32, (1, near_dedup.SAMPLES), np.uint32)
    for share in (0.6, 0.8, 0.95):
        errors = []
        for _ in range(100):
            other = sample.copy()
            change = rng.random(near_dedup.SAMPLES) > share
            other[0, change] = rng.integers(0, 1 << 32, change.sum(), np.uint32)
            a, b = near_dedup.odd_sketches(sample), near_dedup.odd_sketches(other)
            estimate = near_dedup.estimate(near_dedup._apart(a, b).astype(float))[0]
            errors.append(estimate - (1 - change.mean()))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_ids_near_both_ends_of_a_long(spark):
    rng = random.Random(2)
    ends = [2**63 - 1 - i for i in range(4)] + [-(2**63) + i for i in range(4)]
    text, other = prose(rng, 100), prose(rng, 100)
    near = text.rsplit(" ", 2)[0]
    rows = [(i, t) for i, t in zip(ends, [text, near, text, other] * 2, strict=True)]
    groups = {r.doc_id: r.group_id for r in near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: min(j for j, u in rows if (u == other) == (t == other)) for i, t in rows}
    assert groups == want


@pytest.mark.parametrize("band_rows", [1, 7, 40])
def test_large_bands_give_the_same_groups(spark, band_rows):
    rng = random.Random(8)
    rows = []
    for base in range(4):
        w = prose(rng, 60).split()
        for c in range(40):
            v = list(w)
            for _ in range(rng.randrange(1, 16)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            rows.append((base * 100 + c, " ".join(v)))
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    want = sorted(map(tuple, near_dedup.near_duplicate_groups(docs).collect()))
    assert len(want) > 80 and sorted(map(tuple, near_dedup.near_duplicate_groups(docs, band_rows=band_rows).collect())) == want


def test_a_doc_id_with_two_texts_links_their_groups(spark):
    rng = random.Random(8)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(3, a), (5, a), (5, b), (9, b), (11, b)]
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 11: 3}


@pytest.mark.parametrize("gram_segments", [0, 3])
def test_large_grams_give_the_same_intervals(spark, gram_segments):
    rows = overlapping_texts(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.substring_duplicates(df, length=10, k=4, gram_segments=gram_segments).collect()
    assert {(r.doc_id, r.first, r.start_word, r.end_word) for r in found} == brute_intervals(rows, 10)


def test_window_minima_beyond_the_places_of_a_piece():
    rng = np.random.default_rng(3)
    value = rng.integers(0, 1 << 63, 1000).astype(np.uint64) << np.uint64(1)
    got = kernels.window_minima(value, 7, bits=5)
    rough = value >> np.uint64(5)
    assert got.tolist() == [i + int(rough[i : i + 7].argmin()) for i in range(994)]
