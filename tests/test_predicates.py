import pytest
from pyspark.sql import functions as F

from gneiss.functions import predicates as P
from gneiss.operators import rollups as R
from gneiss.operators import texts as X


def apply(spark, values, function, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select(function(F.col("v")).alias("o"), "i").orderBy("i").drop("i").collect()]


TABLES = [
    (P.is_bot, {"renovate[bot]": True, "Copilot": True, "some-app[bot]": True, "robot": False, "alice": False}),
    (P.is_noise, {"a/dist/x.js": True, "mydist/x": True, "rebuild/x": True, "yarn.lock": True, "a.min.css": True, "src/lib.rs": False, "distance.py": False}),
    (P.is_generated, {"a/generated/b.rs": True, "x/api.pb.go": True, "m_pb2.py": True, "types.d.ts": True, "a/generator/b.rs": False, "src/schema.ts": False}),
    (P.conventional_prefix, {"fix: a": "fix", "feat(x)!: b": "feat", "[fix]: c": None, "Fix: a": None, "no prefix": None, "refactor!: y": "refactor", "": None, "a very long prefix with spaces: z": None}),
    (P.is_bug_fix, {"fix: a": True, "Fixes #12": True, "closes GH-7": True, "resolve org/repo#9": True, "Repair race here": True, "prefix the name": False, "Add typos list": False, "feat: new": False, "revert: x": True, "CRASH on start": True}),
    (P.case_style, {"MAX_SIZE": "SCREAMING_SNAKE", "HttpClient": "PascalCase", "snake_case": "snake_case", "camelCase": "camelCase", "Mixed_Case": "mixed", "with-dash": "unknown", "ab": "snake_case"}),
    (P.identifier_tokens, {"parseHTTPResponse2": ["parse", "http", "response", "2"], "snake_case-name": ["snake", "case", "name"], "X": ["x"], "": []}),
    (P.file_dir, {"a/b/c.rs": "a/b/", "c.rs": "./"}),
    (P.parent_dir, {"a/b/c.rs": "a/b", "c.rs": ""}),
    (P.normalize_path, {"a/./b/../c": "a/c", "../x": "x", "a//b": "a/b", "": ""}),
    (P.normalize_rel_path, {".\\a\\b\\": "a/b", "./x/": "x", "x": "x"}),
    (P.is_test_file, {"a/tests/b.rs": True, "x.test.ts": True, "x.spec.js": True, "src/contest.py": False}),
    (P.looks_like_entry_point, {"src/main.rs": True, "index.ts": True, "pkg/__main__.py": True, "domain.rs": False}),
    (P.artifact_kind, {".DS_Store": "os-metadata", "a/.x.swp": "editor-swap", "a.orig": "backup", "x.log": "root-log", "a/x.log": None, "coverage/i.html": "coverage", "src/a.rs": None}),
    (P.parser_language, {"a.rs": "rust", "a.tsx": "typescript", "a.mjs": "javascript", "a.PY": "python", "a.md": None, "Makefile": None}),
    (X.is_symbol_like, {"parse_file": True, "Vec": False, "map::get": True, "src/main.rs": False, "a.b": True, "config.toml": False, "--flag": False, "a=b": False, "1.2.3": False, "example.com": False, "MAX_SIZE": False, "JSON.parse": False, "x": False, "git.push": False, "Foo<T>": True, "two words": False, "name:": False, "fix": False}),
    (X.clean_symbol, {"areas(map)": "areas", "Vec<AreaEntry>": "AreaEntry", "Option<&mut Foo, B>": "Foo", "HashMap<A, B>": "HashMap", "&*x": "x", "plain": "plain"}),
    (X.candidates, {"binary.ensureIt": ["binary.ensureIt", "ensureIt", "binary.ensure_it"], "plain": ["plain"], "camelCase()": ["camelCase", "camel_case"]}),
    (X.license_name, {"the mit license\npermission is hereby granted, free of charge": "MIT", "MIT License": "unknown", "Apache License, Version 2.0": "Apache-2.0", "BSD 2-Clause": "BSD-2-Clause", "": "unknown"}),
    (X.short_label, {"a\n  b": "a b", "x" * 50: "x" * 37 + "...", "y" * 40: "y" * 40}),
    (R.area_purpose, {"./": "project root", "src/": "source code", "a/tests/": "test suite", "a/odd/": "odd module"}),
    (R.area_tier, {"./": 0, "a/src/": 1, "x/": 2, "docs/": 3, "dist/": 4}),
    (R.is_generated_dir, {"a/coverage/": True, "benchmarks/x/results/y/": True, "src/": False}),
]


@pytest.mark.parametrize(("function", "cases"), TABLES, ids=[t[0].__name__ for t in TABLES])
def test_truth_table(spark, function, cases):
    assert apply(spark, list(cases), function) == list(cases.values())


def test_nulls(spark):
    for function in (P.conventional_prefix, P.file_dir, P.artifact_kind, P.parser_language, P.identifier_tokens):
        assert apply(spark, [None], function) in ([None], ["./"])


def test_scores(spark):
    row = spark.range(1).select(P.hotspot_score(F.lit(3), F.lit(4)), P.pain_score(F.lit(2.0), F.lit(0.5), F.lit(30)), P.risk_score(F.lit(0.5), F.lit(0)), P.commit_size(F.lit(49)), P.commit_size(F.lit(500)), P.default_confidence(F.lit("empty-catch")), P.default_confidence(F.lit("x"))).first()
    assert list(row) == [2.0, 6.0, 0.7, "small", "huge", 0.95, 0.80]


def test_query_terms():
    assert X.query_terms("The io of fs_read, THE x and fs_read") == ["io", "fs_read", "fs_read"]
