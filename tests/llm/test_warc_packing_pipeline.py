import base64
import glob
import gzip
import random
import re
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import decontamination, language_id, near_dedup, packing, registry, shared, substring_dedup, warc
from tests.llm.helpers import DOCS, empty, messy, prose

TOKENIZER = sorted(glob.glob("/opt/tokenizers/**/*.tiktoken", recursive=True))[0]
PAGES = "record_id string, target_uri string, payload string, status int"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, compression):
    rows = [(f"<urn:{i}>", f"http://x/{i}" if i % 3 else None, "é\r\n\r\nWARC/1.0 fake\n" * i, i) for i in range(40)] + [("<urn:null>", "http://x/null", None, 1), ("<urn:long>", "http://x/long", "z" * 3_000_000, 1), ("<urn:7>", "http://x/7", "again", 1)]
    path = str(tmp_path / compression)
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), path, compression)
    back = warc.read_warc(spark, path)
    answers = back.where("warc_type = 'response'").collect()
    assert sorted((r.record_id, r.target_uri or "", r.payload) for r in answers) == sorted((a, b or "", c) for a, b, c, _ in rows if c is not None)
    assert all(r.http_status == 200 for r in answers)
    assert back.where("warc_type = 'request'").count() == len(answers)
    assert back.where("warc_type = 'response' and target_uri = 'http://x/7'").count() == 2
    assert back.where("target_uri is null and warc_type = 'response'").count() == 14
    bare = warc.read_warc(spark, path, payload=False).where("warc_type = 'response'")
    assert bare.count() == len(answers) and bare.where("payload is not null").count() == 0


def test_ranges_of_a_file_give_each_record_once(spark, tmp_path):
    rows = [(f"<urn:{i}>", f"http://x/{i}", f"text {i} " * 50, 1) for i in range(300)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), path, "none")
    for size in (700, 5000, 1 << 20):
        found = spark.read.format("gneiss_warc").option("rangeBytes", size).load(path).where("warc_type = 'response'").select("record_id").collect()
        assert sorted(r.record_id for r in found) == sorted(r[0] for r in rows)


@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_ranges_of_a_foreign_file(tmp_path, end):
    rng = random.Random(4)

    def record(ident, body, version):
        lines = ["WARC-Type: resource", f"WARC-Record-ID: {ident}", "Content-Type: text/plain", f"Content-Length: {len(body.encode())}", "WARC-Date: 2024-01-01T00:00:00Z"]
        rng.shuffle(lines)
        return end.join([f"WARC/{version}", *lines, "", body, "", ""])

    inner = "".join(record(f"<urn:false:{i}>", "é" * 30, "1.0") for i in range(6))
    bodies = {f"<urn:{i}>": inner if i % 5 == 0 else f"text {i} " * rng.randrange(60) for i in range(120)}
    (tmp_path / "x.warc").write_bytes("".join(record(k, v, rng.choice(["0.18", "1.0", "1.1"])) for k, v in bodies.items()).encode())
    for size in (100, 700, 5000, 1 << 20):
        reader = warc.WarcReader({"path": str(tmp_path), "rangebytes": str(size)})
        ranges = reader.partitions()
        found = [(r["record_id"], r["payload"]) for part in ranges for b in reader.read(part) for r in b.to_pylist()]
        assert sorted(found) == sorted(bodies.items()) and (len(ranges) > 1) == (size < 1 << 20)


def test_pushed_filters_skip_payloads(spark, tmp_path):
    reader = warc.WarcReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), StringStartsWith(("target_uri",), "http"), GreaterThan(("http_status",), 100)]))
    assert [type(f) for f in left] == [GreaterThan] and len(reader.filters) == 2


def record(body, ident="<urn:a>", kind="response", content="application/http; msgtype=response", length=None):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nContent-Type: {content}\r\n"
    head += "" if length == "" else f"Content-Length: {len(body) if length is None else length}\r\n"
    return head.encode() + b"\r\n" + body + b"\r\n\r\n"


def http(body, *fields):
    return "\r\n".join(["HTTP/1.1 200 OK", *fields, "", ""]).encode() + body


def read(tmp_path, name, data, **options):
    (tmp_path / name).write_bytes(data)
    reader = warc.WarcReader({"path": str(tmp_path / name), **options})
    return [(r["record_id"], r["error"], r["payload"] if options.get("payload") != "binary" else r["body"]) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]


@pytest.mark.parametrize("payload", ["true", "false"])
def test_broken_lengths_cost_one_record(tmp_path, payload):
    good = [record(http(b"one", "Content-Type: text/plain"), "<urn:1>"), record(http(b"two"), "<urn:2>")]
    for bad in ("x", "-5", "", "1e3", "9" * 30, "99999999", "\u0663"):
        data = good[0] + record(http(b"lost"), "<urn:bad>", length=bad) + good[1]
        want = [("<urn:1>", None, "one"), ("<urn:bad>", "length", None), ("<urn:2>", None, "two")]
        if payload == "false":
            want = [(i, e, None) for i, e, _ in want]
        assert read(tmp_path, "a.warc", data, payload=payload) == want, bad
        if bad != "99999999":  # which reads to the end of the file, as a stream has no known size
            assert read(tmp_path, "a.warc.gz", b"".join(map(gzip.compress, (good[0], record(http(b"lost"), "<urn:bad>", length=bad), good[1]))), payload=payload) == want, bad
    short = read(tmp_path, "b.warc.gz", gzip.compress(good[0]) + gzip.compress(record(http(b"cut"), "<urn:3>", length=10**6)), payload=payload)
    assert short[0][0] == "<urn:1>" and short[1][:2] == ("<urn:3>", "truncated")


def test_broken_gzip_costs_its_member(tmp_path):
    packed = [gzip.compress(record(http(f"text {i} ".encode() * 3000), f"<urn:{i}>")) for i in range(4)]
    whole = [f"<urn:{i}>" for i in range(4)]
    assert [r[0] for r in read(tmp_path, "a.warc.gz", b"".join(packed) + b"trailing bytes")] == whole
    assert [r[0] for r in read(tmp_path, "b.warc.gz", b"".join(packed) + b"\0" * 100)] == whole
    spoilt = bytearray(packed[1])
    spoilt[25:60] = b"\xff" * 35
    got = read(tmp_path, "c.warc.gz", packed[0] + bytes(spoilt) + packed[2] + packed[3])
    assert [r[0] for r in got if r[1] is None] == ["<urn:0>", "<urn:2>", "<urn:3>"]
    cut = read(tmp_path, "d.warc.gz", packed[0] + packed[1][: len(packed[1]) // 2])
    assert cut[0][:2] == ("<urn:0>", None) and all(e in ("truncated", "length") for _, e, _ in cut[1:])
    assert read(tmp_path, "e.warc.gz", b"no gzip at all") == []
    inner = read(tmp_path, "f.warc", record(http(b"\x1f\x8b\x08 broken", "Content-Encoding: gzip"), "<urn:x>") + record(http(b"br", "Content-Encoding: br"), "<urn:y>") + record(http(b"sound"), "<urn:z>"))
    assert inner == [("<urn:x>", "encoding gzip", None), ("<urn:y>", "encoding br", None), ("<urn:z>", None, "sound")]


def test_charsets_chunks_and_bytes(tmp_path):
    text = "café – naïve"
    cases = [(text.encode("cp1252"), "Content-Type: text/html; charset=ISO-8859-1"), (text.encode("cp1252"), "Content-Type: text/html"), (text.encode("utf-16"), "Content-Type: text/plain; charset=utf-16"), (text.encode(), "Content-Type: text/html; charset=no-such-thing"), (text.encode("cp1252"), "Content-Type: text/html; charset=utf-8")]
    for body, field in cases:
        assert read(tmp_path, "a.warc", record(http(body, field))) == [("<urn:a>", None, text)], field
    page = '<meta charset="koi8-r"><p>привет'
    assert read(tmp_path, "a.warc", record(http(page.encode("koi8-r"), "Content-Type: text/html")))[0][2] == page
    zipped = gzip.compress(b"x" * 1000)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (zipped[:10], zipped[10:])) + b"0\r\n\r\n"
    fields = ("Transfer-Encoding: chunked", "Content-Encoding: gzip")
    assert read(tmp_path, "a.warc", record(http(chunked, *fields)))[0][2] == "x" * 1000
    # an archive can have undone the chunks, or the encoding too, and left the fields
    assert read(tmp_path, "a.warc", record(http(zipped, *fields)))[0][2] == read(tmp_path, "a.warc", record(http(b"x" * 1000, *fields)))[0][2] == "x" * 1000
    image = bytes(range(256)) * 50
    assert read(tmp_path, "a.warc", record(http(image, "Content-Type: image/png")), payload="binary") == [("<urn:a>", None, image)]


def test_odd_ids_and_addresses_are_written_in_one_line(spark, tmp_path):
    rows = [(None, "http://x/1", "a", 1), ("<urn:\r\nX: y>", "http://x/2\r\nWARC-Type: fake", "b", 1), ("", "", "", 1)]
    warc.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path / "o"))
    back = warc.read_warc(spark, str(tmp_path / "o")).where("warc_type = 'response'").collect()
    assert {(r.target_uri, r.payload) for r in back} == {("http://x/1", "a"), ("http://x/2%0D%0AWARC-Type: fake", "b"), ("", "")}
    assert all(r.error is None and r.record_id is not None and r.record_id != "None" for r in back)


def test_warc_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.read_warc(spark, path).where("warc_type = 'response'").count() == 0


# --- packing


def check_packing(rows, texts, capacity, encode=lambda t: t.encode() + packing.SEPARATOR, width=1):
    """Every text is rebuilt from its windows, whose parts are in order and within capacity."""
    parts, windows = defaultdict(list), set()
    for r in rows:
        assert r.window_id not in windows and 0 < r.n_tokens <= capacity and r.n_tokens == sum(r.lengths)
        windows.add(r.window_id)
        at = 0
        for doc, start, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            parts[doc].append((start, bytes(r.tokens[at : at + n * width])))
            at += n * width
        assert at == len(r.tokens)
    assert windows == set(range(len(windows)))
    whole = defaultdict(list)
    for doc, text in texts:
        data = encode(text)
        whole[doc] += [(i // width, data[i : i + capacity * width]) for i in range(0, len(data), capacity * width)]
    assert {d: sorted(p) for d, p in parts.items()} == {d: sorted(p) for d, p in whole.items()}
    return len(windows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_texts_are_rebuilt_from_their_windows(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 64), rng.randrange(1, 1000), rng.randrange(200, 260), 255, 256, 511, 512]) for _ in range(800)]
    texts = [(i, "".join(rng.choice("abcé ") for _ in range(n))) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, capacity=256, bins=32).collect()
    used = check_packing(rows, texts, 256)
    least = sum(len(t.encode()) + 1 for _, t in texts) / 256
    assert used <= 1.15 * least


def first_fit(sizes, capacity):
    """Windows that first fit of the longest first takes, which is within 11/9 of the fewest."""
    windows = []
    for n in sorted(sizes, reverse=True):
        i = next((i for i, room in enumerate(windows) if room >= n), None)
        if i is None:
            windows.append(capacity)
            i = len(windows) - 1
        windows[i] -= n
    return len(windows)


def test_as_few_windows_as_first_fit(spark):
    rng = random.Random(4)
    texts = [(i, "x" * rng.randrange(1, 250)) for i in range(3000)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), capacity=256, bins=64).collect()
    assert check_packing(rows, texts, 256) <= 1.05 * first_fit([len(t) + 1 for _, t in texts], 256)


def test_windows_of_a_vocabulary(spark, sf_dir):
    """Tokens of a public vocabulary file, by its own encoder and back."""
    import tiktoken

    path, pattern = TOKENIZER, r"\S+|\s+"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, capacity=1024, encode=packing.vocabulary(path, pattern)).collect()
    texts = [(r.doc_id, r.text) for r in docs.where("doc_id is not null and text <> ''").collect()]
    check_packing(rows, texts, 1024, lambda t: np.array([*own.encode_ordinary(t), max(ranks.values()) + 1], "<u4").tobytes(), 4)
    by = defaultdict(list)
    for r in rows:
        at = 0
        for doc, start, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            by[doc].append((start, np.frombuffer(r.tokens, "<u4")[at : at + n].tolist()))
            at += n
    assert all(own.decode([t for _, p in sorted(by[d]) for t in p][:-1]) == text for d, text in texts)


def test_packing_of_odd_tables(spark):
    docs = messy(spark, ["abc", "abc"])
    rows = packing.pack(docs).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.text], packing.CAPACITY)
    assert packing.pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, capacity=100, bins=64)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 10
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and (np.abs(gradient[x > 1e-9]) < 1e-6).all()


def test_plan_uses_the_histogram_up():
    rng = np.random.default_rng(2)
    for _ in range(10):
        histogram = rng.integers(0, 200, 16)
        made = packing.plan(histogram, 3)
        assert (sum(c * n for c, n in made) == histogram).all()
        assert all((c * np.arange(1, 17)).sum() <= 16 for c, _ in made)


def test_combinations_are_all_of_them():
    want = {tuple(sorted(c)) for c in ((a, b, c) for a in range(7) for b in range(7) for c in range(7)) if sum(c) == 6}
    got = {tuple(sorted([0] * (3 - sum(row)) + [i + 1 for i, n in enumerate(row) for _ in range(n)])) for row in packing.combinations(6, 3).tolist()}
    assert got == want


# --- the pipeline


def test_stages(spark, sf_dir):
    docs = shared.documents(spark, sf_dir)
    columns, bench = docs.columns, spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), "test")
        kept[name] = docs
        assert name == "packing" or docs.columns == columns
    assert near_dedup.near_duplicate_groups(kept["near_dedup"]).count() == 0
    assert substring_dedup.substring_duplicates(kept["substring_dedup"]).count() == 0
    assert decontamination.contaminated_spans(kept["decontamination"], bench).count() == 0
    assert 0 < kept["decontamination"].count() < kept["substring_dedup"].count() <= kept["near_dedup"].count() < kept["language_id"].count()
    texts = [(r.doc_id, r.text) for r in kept["decontamination"].where("text <> ''").collect()]
    check_packing(kept["packing"].collect(), texts, packing.CAPACITY)


def test_run_is_the_stages_in_turn(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    docs = shared.documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    parts = lambda df: sorted((d, a, n) for r in df.collect() for d, a, n in zip(r.doc_ids, r.starts, r.lengths, strict=True))
    assert got.columns == docs.columns and got.count() == docs.count() and parts(got) == parts(docs)


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert random.Random(0) and prose


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties and columns of clashing names."""
    rng = random.Random(3)
    copy, span = prose(rng, 120), prose(rng, 20)
    docs = messy(spark, [copy, copy, prose(rng, 60) + " " + span, prose(rng, 90), "Two words", ""])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, span), (None, span), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed = {d for r in rows for d in r.doc_ids}
    assert {1, 4, 100, 103} <= packed and packed.isdisjoint({2, 3, 5, 101, 102, None})
    assert sum(r.n_tokens for r in rows) == sum(sum(r.lengths) for r in rows)


def _unused_mb(batches):
    """MB that this worker holds without using them, which it gives back by this."""
    import ctypes

    def held():
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    for _ in batches:
        pass
    before = held()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    time.sleep(0.5)  # so that each task has a worker of its own
    yield pa.RecordBatch.from_arrays([pa.array([before - held()])], names=["mb"])


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
@pytest.mark.parametrize("stage", [language_id.in_known_language, near_dedup.without_near_duplicates, substring_dedup.without_repeats])
def test_workers_keep_no_memory_for_later_stages(spark, tmp_path, stage):
    rng = random.Random(11)
    shared_part = prose(rng, 120)
    rows = [(i, f"{prose(rng, 300)} {shared_part} {prose(rng, 60)}", ("en", "fr")[i % 2], "a", 1) for i in range(6000)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "docs"))

    def unused():
        return max(r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(_unused_mb, "mb double").collect())

    unused()
    stage(spark.read.parquet(str(tmp_path / "docs"))).write.parquet(str(tmp_path / "out"))
    assert unused() < 32
