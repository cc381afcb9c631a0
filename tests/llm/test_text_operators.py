import itertools
import random
import re
import time
from html.parser import HTMLParser
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.llm import kernels as K
from gneiss.llm import decontamination, html_extraction, language_id, quality_classifier, quality_rules, quote_linking
from tests.llm.helpers import DOCS, EXTRA, empty, messy, prose, words

# --- benchmark decontamination


def brute_spans(docs, items, length):
    out = set()
    for d, text in docs:
        a = words(text)
        for k, item in items:
            b = words(item)
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        if n >= length:
                            out.add((d, k, i, i + n, j, n))
    return out


@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_spans_match_brute_force(spark, broadcast_words):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(5, 60), 500)) for i in range(12)] + [(20, "same same " * 10)]
    docs = []
    for d in range(30):
        parts = [prose(rng, rng.randrange(0, 30), 500)]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(5, 40)]).upper(), prose(rng, rng.randrange(0, 9), 500)]
        docs.append((d, ", ".join(parts)))
    docs.append((99, "same " * 18))
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    table = spark.createDataFrame(docs + [docs[1]], "doc_id long, text string")
    got = decontamination.contaminated_spans(table, bench, broadcast_words).collect()
    rows = {(r.doc_id, r.item_id, r.start_word, r.end_word, r.item_start, r.n_words) for r in got}
    assert len(rows) == len(got) and rows == brute_spans(docs, items, decontamination.LENGTH)
    clean = {r.doc_id for r in decontamination.without_contaminated(table, bench, broadcast_words).collect()}
    assert clean == {d for d, _ in docs} - {r[0] for r in rows}
    # a second row of a contaminated document's id is judged by its own text
    other = table.unionByName(spark.createDataFrame([(99, "nothing shared here")], "doc_id long, text string"))
    assert [r.text for r in decontamination.without_contaminated(other, bench, broadcast_words).where("doc_id = 99").collect()] == ["nothing shared here"]


@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_decontamination_of_odd_tables(spark, broadcast_words):
    rng = random.Random(2)
    span = prose(rng, 20)
    bench = spark.createDataFrame([(1, span), (None, span), (2, None), (3, ""), (1, span)], "item_id long, text string")
    docs = messy(spark, ["x " + span])
    out = decontamination.without_contaminated(docs, bench, broadcast_words)
    assert out.columns == docs.columns and out.count() == docs.count() - 1
    assert decontamination.contaminated_spans(docs, bench, broadcast_words).count() == 1
    assert decontamination.contaminated_spans(empty(spark), bench, broadcast_words).count() == 0
    assert decontamination.contaminated_spans(docs, bench.limit(0), broadcast_words).count() == 0


# --- HTML extraction


def test_second_pass_against_nearest_search():
    rng = random.Random(1)
    for _ in range(300):
        labels = [rng.choice(["good", "bad", "near", "short"]) for _ in range(rng.randrange(1, 12))]
        want = []
        for i, label in enumerate(labels):
            decided = [(abs(i - j), labels[j] != "bad", labels[j]) for j in range(len(labels)) if labels[j] in ("good", "bad")]
            want.append(label == "good" if label in ("good", "bad") else (min(decided)[2] == "good" if decided else label == "near"))
        assert html_extraction.second_pass(labels, [False] * len(labels)) == want


def test_pages(spark):
    body = "The cat and the dog were in the house when it was time to go and they had been there for all of the day, as one would. " * 2
    html = f"<html lang='en'><head><title>no</title></head><body><div><a href=x>Home</a> <a href=y>All news of the day</a></div><h1>A title</h1><p>{body}</p><p>Short one.</p><p>{body}</p><footer>Copyright &copy; 2020</footer><script>var x = '<p>the of and</p>'</script></body></html>"
    rows = [(1, "u", html), (2, None, None), (None, "u", ""), (3, "u", "<p>a < b <unclosed"), (4, "u", html), (4, "u", html), (5, "u", f"<p>{body * 400}")]
    out = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_good", F.lit(1))).collect()
    by = {r.page_id: r for r in out}
    lines = by[1].text.split("\n")
    assert lines[0] == "A title" and lines[1] == body.strip() and "Short one." in lines and not any("news" in x or "var x" in x for x in lines)
    assert by[2].text is None and by[2].n_blocks == 0 and by[None].text == "" and len(out) == len(rows)
    assert by[5].n_good == 1 and len(by[5].text) > len(body) * 399
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("head", ["<head><meta charset=utf-8><title>no</title><body>", "<head><title>no</title><link rel=x href='a>b'><script>var a</script>", "<HEAD ><style>p {}</style><title>no\n</title>\n<body class=a>", "<head><!-- x --><title>no</title></head><body>"])
def test_a_head_without_its_end_tag_leaves_the_body(head):
    body = "The cat and the dog were in the house when it was time to go and they had been there for all of the day. " * 2
    assert html_extraction.extract(f"<!doctype html><html lang=en>{head}<p>{body}<p>{body}") == (f"{body.strip()}\n{body.strip()}", 2, 2)
    assert html_extraction.extract(f"<html lang=en>{head}<header>{body}</header>")[1:] == (1, 1)


@pytest.mark.parametrize("start", ["<a ", '<a ="', '<a="<a"=', "<!--", "<!doctype ", "<svg ", "<svg>", "<title>", "<html ", "<", "</", "<select><option>", "<a href='", "&#9", "<noscript><p>", "<head>"])
def test_broken_markup_takes_linear_time(start):
    def seconds(n):
        page, began = start * (n // len(start)) + "<p>end", time.perf_counter()
        html_extraction.extract(page)
        return time.perf_counter() - began

    # eight times the page; quadratic time would be 64 times as long
    assert seconds(1 << 20) < 30 * max(seconds(1 << 17), 0.02)
    assert html_extraction.extract("&#" + "9" * 10_000 + ";")[1] == 1


def test_elements_that_are_never_closed_keep_what_follows():
    body = "The cat and the dog were in the house when it was time to go and they had been there for all of the day. " * 2
    for tag in ("<noscript>", "<template>", "<svg>", "<select>", "<a href='x", '<img alt="', "<title>no"):
        assert body.strip() in html_extraction.extract(f"<html lang=en><body>{tag}<p>{body}<p>{body}")[0], tag
    # a script goes on to the page's end, as the standard has it
    assert html_extraction.extract(f"<p>{body}<p>{body}<script>{body}")[1] == 2
    # a language without stop words is judged by lengths and links
    assert html_extraction.extract("<html lang=fi><p>" + "Sana toinen kolmas nelj\u00e4s. " * 20)[2] == 1


class Plain(HTMLParser):
    """Blocks of well-formed pages, found by another parser."""

    def __init__(self):
        super().__init__()
        self.out, self.text, self.linked, self.skip, self.link, self.heading = [], "", 0, 0, 0, False

    def cut(self):
        text = " ".join(self.text.split())
        if text:
            self.out.append((text, self.linked, self.heading))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        self.tag(tag, True)

    def handle_endtag(self, tag):
        self.tag(tag, False)

    def tag(self, tag, start):
        if tag in ("head", "script", "style", "noscript", "template", "svg", "textarea", "select"):
            self.skip += 1 if start else -1
            self.text += " "
        elif self.skip:
            return
        elif tag == "a":
            self.link += 1 if start else -1
        elif tag in html_extraction._BLOCK:
            self.cut()
            if tag in html_extraction._HEADINGS:
                self.heading = start
            elif tag != "br":
                self.heading = False

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.linked += len(" ".join(data.split())) if self.link else 0


def test_pages_of_the_table_by_another_parser_and_all_pairs_of_blocks(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.text, r.n_blocks, r.n_good) for r in html_extraction.query(spark, sf_dir).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        plain.cut()
        stop = html_extraction._STOP.get(re.search('lang="(..)', r.html)[1])
        labels = []
        for text, linked, _ in plain.out:
            tokens = re.findall(r"\w+", text.lower())
            share = len([t for t in tokens if t in stop]) / max(1, len(tokens))
            far = linked / len(text) > html_extraction.MAX_LINK_DENSITY
            short, long = len(text) < html_extraction.SHORT, len(text) > html_extraction.LONG
            labels.append("bad" if far or (short and linked) else "short" if short else "bad" if share < 0.15 else "good" if share >= 0.25 or long else "near")
        good = []
        for i, label in enumerate(labels):
            near = [(abs(i - j), x != "bad", x) for j, x in enumerate(labels) if x in ("good", "bad")]
            good.append(label == "good" if label in ("good", "bad") else min(near)[2] == "good" if near else label == "near")
        for i in range(len(labels) - 2, -1, -1):
            good[i] |= plain.out[i][2] and labels[i] in ("short", "near") and good[i + 1]
        kept = [t for (t, _, _), g in zip(plain.out, good, strict=True) if g]
        assert got[r.page_id] == ("\n".join(kept), len(labels), len(kept)), r.page_id


# --- quality rules


def test_cascade_order_and_independence(spark):
    rng = random.Random(6)
    texts = [prose(rng, 40) + " the and" for _ in range(50)] + ["### $$ ^^ ~~ {{ }}"] * 9 + ["HELLO LOUD WORDS AGAIN"] * 3 + ["you idiot moron"] * 2
    docs = messy(spark, texts)
    ranked = quality_rules.ordered(docs)
    gains = [s / c for _, s, c in ranked]
    assert gains == sorted(gains, reverse=True) and len(ranked) == 8 and all(c > 0 for _, _, c in ranked)
    rows = quality_rules.judge(docs).collect()
    one_row_sample = quality_rules.judge(docs, sample_rows=1).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.keep)
    assert [key(r) for r in sorted(rows, key=key)] == [key(r) for r in sorted(one_row_sample, key=key)]
    by = {r.doc_id: r for r in rows}
    assert by[2].rejected_by == "no_text" and not by[3].keep and len(rows) == docs.count()
    assert by[100].keep and not by[150].keep and not by[159].keep and not by[162].keep
    assert all((r.rejected_by is None) == r.keep for r in rows)
    assert quality_rules.judge(empty(spark)).count() == 0


def test_the_cascade_stops_at_the_first_rule_of_its_order(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    each = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    names = [n for n in each[0].__fields__ if n not in ("doc_id", "keep")]
    for order in (names, names[::-1]):
        monkeypatch.setattr(quality_rules, "ordered", lambda docs, rows, order=order: [(n, 0.5, 1.0) for n in order])
        for r in quality_rules.judge(docs).collect():
            first = next((n for n in order if each[r.doc_id][n]), None)
            assert (r.rejected_by, r.keep) == (first, first is None) and r.keep == each[r.doc_id].keep


def test_a_slower_rule_costs_more_and_comes_later(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fast = lambda text: F.length(text) > 100
    slow = lambda text: F.regexp_count(F.repeat(text, 30), F.lit("(a|b|c)+x")) + F.length(text) > 100
    for names in (("x", "y"), ("y", "x")):
        ranked = quality_rules.ordered(docs, make=lambda text, n, names=names: [quality_rules.Rule(names[0], slow(text)), quality_rules.Rule(names[1], fast(text))])
        assert [r[0] for r in ranked] == [names[1], names[0]] and ranked[1][2] > 3 * ranked[0][2]
        assert ranked[1][1] >= ranked[0][1]


# --- quality classifier


def labelled(spark, n=300):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, 40, 200) if good else " ".join(rng.choice(["$$$", "BUY", "1234", "click!!", f"w{rng.randrange(200)}"]) for _ in range(40))
        docs.append((i, text, rng.choice(["en", "fr"]), "news" if good == (rng.random() < 0.9) else "spam", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def test_co_training_beats_chance_on_held_out(spark):
    docs, labels = labelled(spark)
    out = {r.doc_id: r for r in quality_classifier.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    truth = {d[0]: "$$$" not in d[1] for d in docs}
    held = [i for i in truth if i % 2 == 0]
    assert np.mean([out[i].keep == truth[i] for i in held]) >= 0.95
    assert np.mean([(out[i].meta_score > 0.5) == truth[i] for i in held]) >= 0.75


def test_classifier_on_labels_of_the_test_tables(spark, sf_dir):
    out = quality_classifier.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("keep", "quality").collect()
    assert np.mean([r.keep == bool(r.quality) for r in out]) >= 0.85


def test_classifier_of_odd_tables(spark):
    docs, labels = labelled(spark)
    table = messy(spark, [d[1] for d in docs])
    marks = spark.createDataFrame([(100 + i, q, t) for i, q, t in labels] + [(None, 1, 0), (101, None, None), (101, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(table, marks).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == table.count() and by[2].score == 0 and by[3].score == 0 and by[5].score == 0 and not by[2].keep
    assert quality_classifier.classify(table, marks.limit(0)).count() == table.count()
    assert quality_classifier.classify(empty(spark), marks).count() == 0


def test_scores_against_a_model_recomputed_row_by_row(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    out = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    for r in docs.collect():
        raw = r.text.encode()
        tokens = words("".join(c.lower() if c.isascii() or "\u00c0" <= c <= "\u00de" else c for c in r.text))
        x = K.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if not tokens:
            assert out[r.doc_id].score == 0
            continue
        shares = [sum(c in kind for c in raw) for kind in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"\t\n\r ", b"#$%&*|~^<>{}=_\\@+/", b"!?")]
        shares.append(len(raw) - sum(shares))
        assert len(x.hash) == len(tokens)
        dense = [s / len(raw) for s in shares] + [sum(a == b for a, b in itertools.pairwise(x.hash.tolist())) / len(tokens), np.log1p(len(tokens) / (raw.count(b"\n") + 1)), len(raw) / len(tokens) / 10]
        text = sum(model.text[h >> 53] * 10 / len(tokens) for h in x.hash.tolist()) + 4 * np.dot(dense, model.text[1 << 11 : -1]) + model.text[-1]
        keys = [("s", r.source), ("l", r.lang), ("p", r.source, r.lang), ("n", int(np.log2(max(r.n_chars, 1))))]
        meta = sum(model.meta[quality_classifier._hashed(*k)] for k in keys) + model.meta[-1]
        a, m = model.text_scale[0] * text + model.text_scale[1], model.meta_scale[0] * meta + model.meta_scale[1]
        for name, odds in (("text_score", a), ("meta_score", m), ("score", a + m - model.prior)):
            assert abs(out[r.doc_id][name] - 1 / (1 + np.exp(-odds))) < 2e-6, (r.doc_id, name)


def test_the_surest_texts_of_the_whole_pool_are_exchanged(spark):
    docs, labels = labelled(spark)
    table = spark.createDataFrame([*docs, *docs[:9], (7000, "", "en", "x", 0), (7001, None, "en", "x", 0)], DOCS).repartition(5)
    model = quality_classifier.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rounds=0)

    class Held:
        value = model

    batches = table.where("doc_id is not null and text is not null").select("doc_id", "text", "source", "lang", "n_chars").toArrow().to_batches(max_chunksize=37)
    got = [r for b in quality_classifier._surest(iter(batches), Held, (5, 20)) for r in b.to_pylist()]
    score = [(d, *model.raw_scores(quality_classifier.features(np.frombuffer(d[1].encode(), np.uint8), np.array([0, len(d[1])]), quality_classifier.meta_features(pa.array([d[3]]), pa.array([d[2]]), pa.array([d[4]])))[1])) for d in docs]
    for view in (0, 1):
        for good, k in ((0, 5), (1, 20)):
            p = sorted((1 / (1 + np.exp(-abs(s[1 + view][0]))) for s in score if (s[1 + view][0] > 0) == bool(good)), reverse=True)
            want = [x for x in p if x >= quality_classifier.CONFIDENT][:k]
            mine = sorted((r["sure"] for r in got if r["view"] == view and r["good"] == bool(good)), reverse=True)
            assert np.allclose(mine, want) and len(mine) == len(want)


def test_a_doc_id_that_repeats_is_learned_from_once(spark):
    docs, labels = labelled(spark)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    again = [(1, "other words " * 50, "en", "s", 1)] * 400
    many = spark.createDataFrame([*docs, *again], DOCS)
    sent = []
    real = quality_classifier._unpacked
    quality_classifier._unpacked = lambda t: sent.append(t.num_rows) or real(t)
    try:
        quality_classifier.fit(many, marks, rounds=1)
    finally:
        quality_classifier._unpacked = real
    assert sent[0] == len(labels) and sent[1] <= 8 * quality_classifier.PER_ROUND


def test_toxic_documents_of_every_language_are_found(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    out = quality_classifier.classify(docs, labels.where("doc_id % 4 <> 0"), rounds=0)
    held = out.select("doc_id", F.col("toxic").alias("found")).join(labels.where("doc_id % 4 = 0"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang for r in held} == {"de", "en", "es", "fr"}
    for lang in ("de", "en", "es", "fr"):
        bad, rest = ([r.found for r in held if r.lang == lang and bool(r.toxic) == kind] for kind in (True, False))
        assert len(bad) >= 5 and np.mean(bad) >= 0.7 and np.mean(rest) <= 0.05, (lang, len(bad), np.mean(bad), np.mean(rest))


def test_toxicity_without_labels_of_both_kinds_is_unknown(spark):
    docs, labels = labelled(spark, 40)
    out = quality_classifier.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rounds=0).collect()
    assert {(r.toxic_score, r.toxic) for r in out} == {(None, None)}


# --- language identification


@pytest.mark.parametrize("block", [64, 2, 1, 3])
def test_forward_backward_against_enumeration(block):
    rng = np.random.default_rng(4)
    k, sizes = 3, [1, 5, 3, 7, 2]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    emission, change = rng.random((bounds[-1], k)) + 0.1, rng.random((k, k)) + 0.1
    p, pairs = language_id.forward_backward(emission, bounds, change, pairs=True, block=block)
    want, want_pairs = np.zeros_like(emission), np.zeros((k, k))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        weights = {}
        for path in itertools.product(range(k), repeat=b - a):
            w = np.prod([emission[a + t, s] for t, s in enumerate(path)]) * np.prod([change[s, u] for s, u in itertools.pairwise(path)])
            weights[path] = w
        total = sum(weights.values())
        for path, w in weights.items():
            for t, s in enumerate(path):
                want[a + t, s] += w / total
            for s, u in itertools.pairwise(path):
                want_pairs[s, u] += w / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


LANGUAGES = {"en": "the of and house water king with that", "fr": "le la maison eau roi avec dans pour", "de": "der die haus wasser könig mit dass und"}


def spoken(rng, lang, n):
    return " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(n))


def test_words_of_switched_text(spark):
    rng = random.Random(2)
    rows = [(i, spoken(rng, lang, 30), lang, "s", 1) for i in range(150) for lang in [rng.choice(list(LANGUAGES))]]
    rows += [(500, spoken(rng, "en", 20) + " " + spoken(rng, "fr", 20), None, "s", 1), (501, spoken(rng, "de", 50), None, "s", 1)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert np.mean([out[r[0]].lang == r[2] for r in rows[:150]]) >= 0.98
    assert out[501].lang == "de" and out[501].n_switches == 0 and out[501].keep
    spans = out[500].spans
    assert spans[0].lang == "en" and spans[-1].lang == "fr" and abs(spans[0].end - 20) <= 2 and spans[-1].end == 40
    assert all(a.end == b.start for a, b in itertools.pairwise(spans))


def test_words_that_differ_late_and_long_sentences(spark):
    """Words of over 18 bytes that tell the language only by their middle, in sentences of hundreds of words."""
    rng = random.Random(5)

    def word(lang):
        rest = "".join(rng.choice("abcdefgh") for _ in range(4))
        return "qwertyuiopasdfghjklzx" + {"aa": "mnbv", "bb": "vbnm"}[lang] + rest + "zzz"

    rows = [(i, " ".join(word(lang) for _ in range(300)), lang, "s", 1) for i in range(40) for lang in [("aa", "bb")[i % 2]]]
    rows += [(100, " ".join([word("aa") for _ in range(200)] + [word("bb") for _ in range(200)]), None, "s", 1)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[r[0]].lang == r[2] for r in rows[:40])
    assert [(s.start, s.end, s.lang) for s in out[100].spans] == [(0, 200, "aa"), (200, 400, "bb")]


def test_features_against_slices():
    text = "Été the x of éééééééééééééééééééééé to international".encode()
    raw = np.frombuffer(text, np.uint8)
    x = K.words(raw, np.array([0, len(raw)]))
    flat, bounds = language_id.features(raw, x.start, x.end, x.hash, x.hash[1:2])
    which, _, _ = language_id.trigrams(raw, x.start, x.end)
    low = bytes(K.fold(raw))
    for i, (a, b) in enumerate(zip(x.start, x.end, strict=True)):
        mine = flat[bounds[i] : bounds[i + 1]]
        w = low[a:b]
        codes = [int.from_bytes(w[j : j + 3], "big") for j in range(len(w) - 2)]
        assert mine[7:].tolist() == [((c * 0x9E3779B1 + 0xC2B2AE3D) % 2**32) >> 17 for c in codes]
        assert (which == i).sum() == len(w) + 1


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    unlabelled = docs.where("doc_id % 3 = 0").withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string"))
    rest = docs.where("doc_id % 3 <> 0").withColumn("truth", F.lit(None).cast("string"))
    out = language_id.identify(rest.unionByName(unlabelled)).join(unlabelled.select("doc_id", "truth"), "doc_id").collect()
    assert np.mean([r.lang == r.truth for r in out]) >= 0.9


def test_gibberish_and_unlearned_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    noise = [(10**6 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(60)), None, "s", 1) for i in range(40)]
    table = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang"))).select("doc_id", "text", "lang", "source", "n_chars")
    table = table.unionByName(spark.createDataFrame(noise, DOCS))
    kept = {r.doc_id: r.keep for r in language_id.identify(table).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert not any(kept[r[0]] for r in noise)
    for lang in ("de", "en", "es", "fr"):
        share = np.mean([kept[i] for i, name in truth.items() if name == lang])
        assert share <= 0.05 if lang == "de" else share >= 0.95, (lang, share)
    assert {r.doc_id for r in language_id.in_known_language(table).select("doc_id").collect()} == {i for i, keep in kept.items() if keep}


def test_languages_are_learned_from_all_labelled_documents(spark):
    """A language of documents that no sample by hash of 600 of 1500 would have."""
    rng = random.Random(3)
    ids = [r.id for r in spark.range(1500).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, spoken(rng, lang, 20), lang, "s", 1) for at, i in enumerate(ids) for lang in ["de" if at >= 1470 else rng.choice(["en", "fr"])]]
    rows += [(2000 + i, spoken(rng, "de", 20), None, "s", 1) for i in range(20)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert [out[2000 + i].lang for i in range(20)] == ["de"] * 20
    assert all(out[r[0]].lang == r[2] for r in rows[:1500])


def test_language_counts_and_layout(spark, sf_dir, monkeypatch):
    """Letters are counted in every labelled document; the fit is the same however the table is cut and sorted, in several shards too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = []
    for size in (64 << 20, 100_000):
        monkeypatch.setattr(language_id, "SHARD_BYTES", size)
        fields += [language_id.fit(docs), language_id.fit(docs.repartitionByRange(3, "lang", "n_chars").sortWithinPartitions("lang"))]
    for a, b in (fields[:2], fields[2:]):
        assert np.array_equal(a.weight, b.weight) and np.array_equal(a.change, b.change) and a.usual.lack == b.usual.lack
        assert np.array_equal(a.usual.whole, b.usual.whole) and np.array_equal(a.usual.mean, b.usual.mean)
    assert not np.array_equal(fields[0].weight, fields[2].weight)
    h = F.xxhash64("doc_id", "text")
    _, tables = language_id.counts(docs.select("lang", "text", (h % 3 == 0).alias("held")))
    texts = {lang: [r.text for r in docs.where(F.col("lang") == lang).collect()] for lang in tables}
    for lang, table in tables.items():
        found = [words(t) for t in texts[lang]]
        assert table[:, -2].sum() == sum(map(len, found)) and table[:, -1].sum() == sum(len(t.encode()) for t in texts[lang])
        letters = sum(len(w.encode()) + 1 for ws in found for w in ws)
        assert table[:, : language_id.TRIPLES].sum() == table[:, language_id.TRIPLES : -2].sum() == letters
    monkeypatch.setattr(language_id, "SHARD_BYTES", 100_000)
    out = language_id.identify(docs).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert np.mean([r.lang == r.truth for r in out]) >= 0.95


def test_words_are_scored_once_a_task(monkeypatch):
    """Chunks of the same words: all are labelled, by numbers found for the first alone, and as well where few of these are kept."""
    rng = random.Random(6)
    vocabulary = {lang: [lang + "".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(2000)] for lang in ("xa", "yb")}
    texts = [" ".join(rng.choice(vocabulary[lang]) for _ in range(400)) + "." for lang in ("xa", "yb") * 300]
    known = pa.RecordBatch.from_arrays([pa.array(["xa", "yb"] * 300), pa.array(texts), pa.array([i % 3 == 0 for i in range(600)])], ["lang", "text", "held"])
    assert len(list(K.chunks(known.column("text")))) > 2
    monkeypatch.setattr(language_id.Likelihood, "scores", lambda self, raw, start, end, whole=language_id.Likelihood.scores: scored.append(len(start)) or whole(self, raw, start, end))
    parts = list(language_id.lessons(known.column("text"), np.array([0, 1] * 300), np.zeros(0, np.uint64)))
    field = language_id.train(parts, ["xa", "yb"], np.zeros(0, np.uint64), epochs=1)[0]
    shape = np.random.default_rng(1).random((language_id.TRIPLES, 2)).astype(np.float32)
    field.usual = language_id.Likelihood(shape[: language_id.PAIRS], shape, np.zeros(2), np.ones(2))
    docs = pa.RecordBatch.from_arrays([pa.array(range(600)), known.column("text")], ["doc_id", "text"])
    found = []
    for kept in (None, 0):
        if kept is not None:
            monkeypatch.setattr(language_id, "MEMO_BYTES", kept)
        for run in (lambda: language_id._label(iter([docs]), SimpleNamespace(value=field), 1 / 3), lambda: language_id._try(iter([known]), SimpleNamespace(value=(field.usual, field.labels)))):
            scored = []
            found.append(pa.Table.from_batches(run()))
            assert sum(scored) >= 4000 and (kept is not None or sum(scored) < 4400)
    assert found[0].equals(found[2]) and found[1].equals(found[3])
    assert found[0].column("lang").to_pylist() == ["xa", "yb"] * 300 and min(found[0].column("share").to_pylist()) >= 0.98


def test_walk_of_words_that_repeat():
    rng = np.random.default_rng(8)
    bounds, factor, change = np.array([0, 1, 7, 207, 210]), rng.random((3, 20)) + 0.1, rng.random((3, 3)) + 0.1
    word = rng.integers(0, 20, 210)
    p, at, pairs = language_id.walk(factor, word, bounds, change, pairs=True, block=16)
    want, want_pairs = language_id.forward_backward(factor.T[word], bounds, change, pairs=True, block=1000)
    assert sorted(at) == list(range(210)) and np.allclose(p.T, want[at]) and np.allclose(pairs, want_pairs)


def test_language_of_odd_tables(spark):
    rng = random.Random(2)
    docs = messy(spark, [spoken(rng, "en", 30) for _ in range(30)])
    out = language_id.identify(docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == docs.count() and by[2].lang is None and not by[2].keep and by[3].n_words == 0 and by[5].spans == []
    assert by[4].n_words == 60_000 and by[4].spans[-1].end == 60_000
    kept = language_id.in_known_language(docs)
    assert kept.columns == docs.columns and set(EXTRA) < set(kept.columns)
    assert {2, 3, 5}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language_id.identify(empty(spark)).count() == 0 and language_id.in_known_language(empty(spark)).count() == 0
    bare = spark.createDataFrame([(1, "some words", None, None, None)], DOCS)
    assert [(r.lang, r.keep, r.n_words) for r in language_id.identify(bare).collect()] == [(None, False, 2)]


# --- quotation linking


def quote(text, level=1):
    return "\n".join("> " * level + line for line in text.split("\n"))


def test_reply_tree(spark):
    first, second, third = "How do I bake bread at home?", "Use a hot oven and wait.\n\nThen let it rest.", "What about the salt though?"
    rows = [(1, 0, "user", first), (1, 1, "assistant", f"On Monday, Ann wrote:\n{quote(first)}\n\n{second}"), (1, 2, "user", f"{quote(first)}\n{third}"), (1, 3, "assistant", f"{quote('Use a hot oven and wait.')}\n\nHow hot should it be, then?\n{quote(first, 2)}"), (1, 4, "user", "Thanks a lot.")]
    out = sorted(quote_linking.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.position)
    by = {r.turn: r for r in out}
    assert [by[t].reply_to for t in range(5)] == [None, 0, 0, 1, 3]
    assert [r.turn for r in out] == [0, 1, 3, 4, 2] and [by[t].depth for t in range(5)] == [0, 1, 1, 2, 3]
    assert by[1].text == second and by[2].text == third and by[3].text == "How hot should it be, then?" and by[1].n_linked == 1 and by[4].n_linked == 0


def brute_links(messages):
    """Reply order by comparing every quote with every earlier message, by words."""
    out = {}
    for conv in {m[0] for m in messages}:
        mine = sorted(m for m in messages if m[0] == conv)
        said = {}
        for _, turn, _, own, _ in mine:
            said[turn] = [re.findall(r"\w+", p.lower()) for p in [own, *own.split("\n\n")]]
        parents, linked = [], []
        for i, (_, turn, _, _, quotes) in enumerate(mine):
            found = []
            for level, text in quotes:
                tokens = re.findall(r"\w+", text.lower())
                where = [t for t in said if t < turn and len(tokens) > 1 and tokens in said[t]]
                if where:
                    found.append((level, -max(where)))
            linked.append(len(found))
            parents.append([m[1] for m in mine].index(-min(found)[1]) if found else i - 1)
        depth = []
        for p in parents:
            depth.append(depth[p] + 1 if p >= 0 else 0)

        def below(p, parents=parents):
            return [x for i, q in enumerate(parents) if q == p for x in (i, *below(i))]

        for position, i in enumerate(below(-1)):
            out[conv, mine[i][1]] = (position, depth[i], mine[parents[i]][1] if parents[i] >= 0 else None, mine[i][3], linked[i])
    return out


def test_random_trees_against_a_brute_force_linker(spark):
    rng = random.Random(12)
    messages = []
    for conv in range(25):
        texts, quoted = [], []
        for turn in range(rng.randrange(1, 12)):
            own = prose(rng, rng.randrange(1, 9), 60) + ("\n\n" + prose(rng, 4, 60) if rng.random() < 0.3 else "")
            quotes, body = [], own
            if turn and rng.random() < 0.8:
                s = rng.randrange(turn)
                lines = [f"> {x}" for x in texts[s].split("\n\n")[0].split("\n")]
                quotes = [(1, texts[s].split("\n\n")[0])]
                if quoted[s] and rng.random() < 0.7:
                    deep = quoted[s][0][1]
                    lines = ["> On Sunday, A", "> <a@b.c> wrote:", *(f">> {x}" for x in deep.split("\n")), *lines]
                    quotes.append((2, deep))
                intro = rng.choice([["On Monday, B wrote:"], ["On a day " + "very " * 90 + "long ago,", "B <b@c.d> wrote:"], ["x " * 150 + "wrote:"], []])
                body = "\n".join([*intro, *lines, "", own])
            texts.append(own)
            quoted.append(quotes)
            # the same words quoted at two levels are one passage
            messages.append((conv, turn, body, own, [q for i, q in enumerate(quotes) if q[1].split() not in [p[1].split() for p in quotes[:i]]]))
    df = spark.createDataFrame([(c, t, "user", b) for c, t, b, _, _ in messages], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.position, r.depth, r.reply_to, r.text, r.n_linked) for r in quote_linking.conversations(df).collect()}
    assert got == brute_links(messages) and sum(r[4] for r in got.values()) > 50


def test_quoting_messages_of_the_table(spark, sf_dir):
    plain = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    by = {(r.conv_id, r.turn): r.text for r in plain}
    got = quote_linking.quoting_query(spark, sf_dir).collect()
    assert len(got) == len(by) and sum(r.n_linked for r in got) > len(by) / 4
    for r in got:
        assert r.text == by[r.conv_id, r.turn].strip()
        if r.turn:
            s = (r.turn * 7 + r.conv_id) % r.turn
            tokens = re.findall(r"\w+", by[r.conv_id, s].lower())
            same = [t for t in range(r.turn) if re.findall(r"\w+", by[r.conv_id, t].lower()) == tokens]
            assert r.reply_to == (max(same) if len(tokens) > 1 else r.reply_to)


def test_reply_order_is_depth_first():
    rng = random.Random(5)
    for _ in range(100):
        parents = [-1, *(rng.randrange(i) for i in range(1, 12))]

        def below(p, parents=parents):
            return [x for i, q in enumerate(parents) if q == p for x in (i, *below(i))]

        assert quote_linking.reply_order(parents) == below(-1)


def test_conversations_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, own int, quotes int, position int"
    rows = [(1, 0, None, None, 1, 1, 1), (1, 1, "user", "", 1, 1, 1), (1, 1, "user", "", 1, 1, 1), (1, 2, "user", quote("gone and lost"), 1, 1, 1), (None, 0, "user", "x", 1, 1, 1), (2, None, "user", "x", 1, 1, 1), (3, 5, "user", "word " * 100_000, 1, 1, 1), (3, 5, "assistant", "tie of turns", 1, 1, 1), (3, 5, "assistant", "another tie", 1, 1, 1)]
    out = quote_linking.conversations(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.conv_id, r.turn, r.position) for r in out) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (3, 5, 0), (3, 5, 1), (3, 5, 2)]
    assert next(r for r in out if r.turn == 2).text == ""
    assert quote_linking.conversations(spark.createDataFrame([], schema)).count() == 0
