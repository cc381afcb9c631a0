import json
import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.functions import predicates as P
from gneiss.operators import chunks, parsing
from gneiss.operators import texts as X
from gneiss.plans import analysis
from gneiss.sources import artifact


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")

    def run(*args, name="Ann"):
        subprocess.run(["git", "-C", str(root), "-c", f"user.name={name}", "-c", "user.email=a@x", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (root / "src").mkdir()
    files = {"src/main.rs": "mod store;\nfn main() { store::open_store(1); }\n", "src/store.rs": "pub fn open_store(x: i32) -> i32 { if x > 0 { 1 } else { 2 } }\npub fn lonely() { let _ = parse(x); }\n", "Cargo.toml": '[package]\nname = "work"\nlicense = "MIT"\n', "README.md": "# Work\n\nCall `open_store` but not `missing_name`.\n", "yarn.lock": ""}
    for name, text in files.items():
        (root / name).write_text(text)
    run("add", "-A")
    run("commit", "-qm", "feat: start")
    for i in range(3):
        (root / "src/main.rs").write_text(files["src/main.rs"] + f"// {i}\n")
        (root / "src/store.rs").write_text(files["src/store.rs"] + f"// {i}\n")
        run("commit", "-qam", f"fix: bug {i}", name="Bob" if i else "Ann")
    return root, run


def test_init_update_and_every_query(spark, repo, tmp_path):
    root, run = repo
    folder = str(tmp_path / "map")
    assert analysis.status(spark, str(root), folder) == "invalid"
    assert analysis.update(spark, str(root), folder) == "invalid" and analysis.status(spark, str(root), folder) == "valid"
    options = analysis.Options(path="src/main.rs", text="open_store", files=["src/main.rs", "new.rs"], min_cochanges=1)
    found = {name: analysis.query(analysis.load(spark, folder), name, options).collect() for name in analysis.QUERIES}
    assert [(r.path, r.changes, r.bug_fixes) for r in found["hotspots"]][:2] == [("src/main.rs", 4, 3), ("src/store.rs", 4, 3)]
    assert [(r.path, r.cochanges) for r in found["coupling"]][:1] == [("src/store.rs", 4)]
    assert [r.path for r in found["find"]] == ["src/store.rs"] or found["find"][0].path == "src/store.rs"
    assert [(r.reference, r.issue) for r in found["stale-docs"]][0] == ("missing_name", "symbol-not-found")
    assert found["stale-docs"][0].suggestion == "Symbol `missing_name` not found in codebase - may have been removed"
    assert found["project-info"][0].license == "MIT" and found["project-info"][0].package_manager == "cargo"
    assert ("src/main.rs", "binary") in {(r.path, r.kind) for r in found["entry-points"]}
    assert {r.name for r in found["symbols"] if r.section == "imports"} == {"src/store.rs"}
    assert [r.known for r in sorted(found["diff-risk"], key=lambda r: r.path)] == [False, True]
    assert sum(r.size for r in found["communities"]) >= 2

    (root / "src/store.rs").write_text("pub fn other() {}\n")
    run("commit", "-qam", "feat: other")
    assert analysis.update(spark, str(root), folder) == "stale"
    whole = str(tmp_path / "whole")
    analysis.init(spark, str(root), whole)
    both = [sorted(map(str, analysis.load(spark, f).file_activity.collect())) for f in (folder, whole)]
    assert both[0] == both[1] and "changes=5" in " ".join(both[0])
    fixes = analysis.query(analysis.load(spark, whole), "slop-fixes").collect()
    assert {r.category for r in fixes} <= {"orphan-export", "empty-catch"}


def test_what_users_set_is_kept(spark, repo, tmp_path):
    root, run = repo
    (root / ".env").write_text("KEY=1\n")
    (root / "keys").mkdir(exist_ok=True)
    (root / "keys/server.pem").write_text("-----BEGIN CERTIFICATE-----\n")
    folder = str(tmp_path / "map")
    analysis.init(spark, str(root), folder, max_commits=1)
    loaded = analysis.load(spark, folder)
    assert loaded.commits.count() == 1
    assert not {r.path for r in loaded.listing.collect()} & {".env", "keys/server.pem"} and "src/main.rs" in {r.path for r in loaded.sources.collect()}
    assert analysis.query(loaded, "summary").count() == 0
    analysis.set_summary(spark, folder, "a", "b", "c")
    analysis.set_summary(spark, folder, "one", "two", "three")
    assert analysis.set_descriptors(spark, folder, {"src/main.rs": "entry gate", "src/store.rs": "old"}) == 2
    assert analysis.set_descriptors(spark, folder, {"src/store.rs": "zebra keeper"}) == 2
    packed = tmp_path / "v.bin"
    packed.write_bytes(artifact.encode_sidecar(pd.DataFrame([("src/main.rs", 0, "file", None, 1, 2, [1.0, 0.0]), ("src/store.rs", 0, "file", None, 1, 2, [1.0, 0.0])], columns=["path", "chunk_index", "kind", "name", "start_line", "end_line", "values"]), {}))
    assert analysis.set_embeddings(spark, folder, str(packed)) == 2
    loaded = analysis.load(spark, folder)
    assert [(r.depth, r.text) for r in analysis.query(loaded, "summary", analysis.Options(depth=3)).collect()] == [(3, "two")]
    assert [r.path for r in analysis.query(loaded, "find", analysis.Options(text="zebra")).collect()] == ["src/store.rs"]
    assert [{r.path_a, r.path_b} for r in analysis.query(loaded, "duplicates").collect()] == [{"src/main.rs", "src/store.rs"}]
    pairs = analysis.query(loaded, "slop-targets", analysis.Options(files=["./src/main.rs"])).collect()
    assert [(set(r.area.split("|")), r.suspect) for r in pairs if r.kind == "area" and "|" in r.area] == [({"src/main.rs", "src/store.rs"}, "semantic-duplicate")]
    assert all("store" not in r.area or "|" in r.area for r in pairs)
    answer = {(r.section, r.name): r.text for r in analysis.query(loaded, "onboard").collect()}
    assert answer["overview", "language"] == "rust" and answer["getting-started", "test"] == "cargo test"
    help_ = {r.section for r in analysis.query(loaded, "can-i-help").collect()}
    assert {"conventions", "recent-activity"} <= help_


def test_many_updates_are_joined_up(spark, repo, tmp_path, monkeypatch):
    root, run = repo
    monkeypatch.setattr(analysis, "MAX_DELTAS", 1)
    folder = str(tmp_path / "map")
    analysis.init(spark, str(root), folder)
    for i in range(3):
        (root / "src/main.rs").write_text(f"fn main() {{}} // again {i}\n")
        run("commit", "-qam", f"feat: again {i}")
        assert analysis.update(spark, str(root), folder) == "stale"
    whole = str(tmp_path / "whole")
    analysis.init(spark, str(root), whole)
    both = [sorted(map(str, analysis.load(spark, f).commits.drop("seq").collect())) for f in (folder, whole)]  # numbered by run
    assert both[0] == both[1]


def test_a_map_of_one_json_document(spark, tmp_path):
    found = {"fileActivity": {"a.rs": {"changes": 3, "authors": ["x"], "lastChanged": "2024-01-02T00:00:00Z", "bugFixChanges": 1}}, "coupling": {"a.rs": {"b.rs": 2}, "b.rs": {"a.rs": 2}}, "symbols": {"a.rs": {"exports": [{"name": "f", "kind": "function", "line": 1}], "definitions": [{"name": "f", "kind": "function", "line": 1, "complexity": 2}], "imports": [{"from": "b", "names": ["g"]}]}}}
    (tmp_path / "map.json").write_text(json.dumps(found))
    analysis.import_json(spark, str(tmp_path / "map.json"), str(tmp_path / "out"))
    read = lambda name: [tuple(r) for r in artifact.read_table(spark, str(tmp_path / "out"), name).collect()]
    assert read("coupling") == [("a.rs", "b.rs", 2)] and read("imports") == [("a.rs", "b", "g")] and len(read("symbols")) == 2
    assert read("file_activity")[0][:3] == ("a.rs", 3, 0)


def test_test_conventions(spark):
    symbols = spark.createDataFrame([("src/a.rs", "definition", "tests", "module"), ("src/a.rs", "definition", "test_one", "function"), ("tests/b.rs", "definition", "test_two", "function"), ("src/c.rs", "definition", "tests", "module"), ("src/c.rs", "definition", "it_works", "function")], "path string, role string, name string, kind string")
    imports = spark.createDataFrame([("x.py", "re", "sub")], "path string, import_from string, name string")
    assert tuple(parsing.test_conventions(symbols, imports).first()) == ("cargo-test", "inline", "test_*")
    more = imports.unionByName(spark.createDataFrame([("y.py", "pytest", "fixture"), ("y.py", "pytest", "mark")], imports.schema))
    assert parsing.test_conventions(symbols, more).first().framework == "pytest"
    assert tuple(parsing.test_conventions(symbols.limit(0), imports.limit(0)).first()) == ("unknown",) * 3


@pytest.mark.parametrize(("path", "secret"), [(".env", True), ("a/.env.local", True), (".env.example", False), ("keys/server.key", True), ("x/id_rsa", True), (".ssh/config", True), ("src/key.rs", False), ("docs/secrets.md", False), ("secrets.yaml", True), ("src/environment.ts", False)])
def test_secret_like(spark, path, secret):
    assert spark.range(1).select(P.is_secret_like(F.lit(path))).first()[0] == secret


def test_chunks(spark):
    rows = [("a.py", "import x\n\ndef f():\n    pass\n\nclass C:\n    pass\n"), ("b.md", "intro\n# One\ntext\n# Two\n"), ("c.ts", "let x\n"), ("d.py", "  \n")]
    files = spark.createDataFrame(rows, "path string, content string")
    symbols = parsing.symbols(parsing.parse_files(files))
    out = {(r.path, r.chunk_index): (r.kind, r.name, r.start_line, r.end_line) for r in chunks.chunks(files, symbols).collect()}
    assert out[("a.py", 0)] == ("function", "f", 3, 5) and out[("a.py", 1)] == ("type", "C", 6, 8)
    assert [out[("b.md", i)][:2] for i in range(3)] == [("doc-section", None), ("doc-section", "One"), ("doc-section", "Two")]
    assert ("d.py", 0) not in out and out[("c.ts", 0)][0] == "file"
    assert {r.kind for r in chunks.chunks(files, symbols, "file").collect()} == {"file"}
    vectors = chunks.embedded(chunks.chunks(files, symbols), 8)
    assert vectors.where(F.size("values") == 8).count() == len(out)
    assert chunks.embeddable(files, 2).count() == 2


def test_manifest_licence(spark):
    rows = [("package.json", '{"license": "ISC"}'), ("Cargo.toml", '[package]\nlicense.workspace = true\n'), ("pyproject.toml", 'license = "MIT"')]
    assert X.manifest_license(spark.createDataFrame(rows, "path string, content string")).first()[0] == "ISC"
