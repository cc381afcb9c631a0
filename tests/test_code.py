import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.operators import detectors as D
from gneiss.operators import entry_points as E
from gneiss.operators import parsing as S
from gneiss.operators import targets as T
from gneiss.operators import texts as X
from gneiss.sources import artifact, files, git_log
from gneiss.streaming import incremental as I


def names(language, source, role="definition"):
    return [(n, k, line) for r, n, k, line, _ in S.parse_source(source, language)[0] if r == role]


def test_python_symbols():
    source = "import os, sys as s\nfrom ..a import b, c\n\ndef run(x):\n    if x and s:\n        return 1\n    elif x:\n        pass\n    else:\n        pass\n\nclass Big:\n    def go(self): ...\n    def _no(self): ...\n\ndef _own(): ...\n"
    symbols, imports = S.parse_source(source, "python")
    assert names("python", source, "export") == [("run", "function", 4), ("Big", "class", 12)]
    assert ("definition", "go", "function", 13, 1) in symbols and ("definition", "_own", "function", 16, 1) in symbols
    assert next(s[4] for s in symbols if s[1] == "run") == 5
    assert imports == [("os", ["os"]), ("sys", ["s"]), ("..a", ["b", "c"])]
    assert S.parse_source("def broken(:", "python") == ([], [])


def test_rust_symbols():
    rust = 'use a::{b, c as d};\nmod util;\n/* fn no() {} */\npub struct P { x: i32, pub(crate) y: Vec<(u8, u8)>,\n #[serde(type = "q")] z: [u8; 3] }\npub(crate) enum E { A, B(i32, u8),\n  #[doc] C { q: u8 } = 3 }\ntrait T { fn t(&self); }\nconst N: &str = "fn no2() {}";\nimpl<T> P where T: X {\n    pub fn get(&self) -> i32 { match self.x { 1 => 2, _ => 3 } }\n    type O = u8;\n}\nfn main() -> impl Fn(u8) { fn inner() {} struct I { z: u8 } }\nmod tests { pub async fn t1() { if a && b {} } }\nstruct U(i32);\nstatic mut G: [u8; 2] = [1, 2];\nlazy_static! { static ref X: u8 = 1; }\n'
    want = [("util", "module", 2), ("P", "struct", 4), ("x", "field", 4), ("y", "field", 4), ("z", "field", 5), ("E", "enum", 6), ("A", "enum-variant", 6), ("B", "enum-variant", 6), ("C", "enum-variant", 7), ("T", "trait", 8), ("N", "constant", 9), ("get", "function", 11), ("O", "type-alias", 12), ("main", "function", 14), ("tests", "module", 15), ("t1", "function", 15), ("U", "struct", 16), ("G", "constant", 17)]
    assert names("rust", rust) == want
    assert [n for n, *_ in names("rust", rust, "export")] == ["P", "E", "get", "t1"]
    assert {n: c for r, n, _, _, c in S.parse_source(rust, "rust")[0] if n in ("get", "t1", "x", "P")} == {"get": 3, "t1": 3, "x": 0, "P": 1}
    assert S.parse_source(rust, "rust")[1] == [("a::{b, c as d}", ["b", "c"]), ("util", ["util"])]


def test_typescript_symbols():
    ts = """import x, { a as b } from './m';
import * as ns from "n";
const q = require('fs');
export const f = (x: number): number => x ? 1 : 2;
export const LIMIT = 3, other = function () { if (a) {} };
export default class K extends L<M> {
  private count: number = 0;
  #secret = 1;
  @Input() label?: string;
  constructor(private a: A) { super(); }
  get(a) { if (a) { return 1; } }
  async load<T>(a: T): Promise<T> { return a && b; }
  handler = (e) => { this.go(e); };
}
export interface I extends J { a: string; b?: { c: number }; run(x: number): void
  d: () => void }
type Z = 1 | 2;
enum Color { Red, Green = "g" }
function h() {}
let arrow = async x => x;
const obj = { function: 1, class: 2 };
export { h, arrow as renamed };
export { far } from './far';
(function named() {})();
"""
    want = [("f", "function", 4), ("LIMIT", "constant", 5), ("other", "function", 5), ("K", "class", 6), ("count", "property", 7), ("label", "property", 9), ("get", "function", 11), ("load", "function", 12), ("handler", "property", 13), ("I", "interface", 15), ("a", "property", 15), ("b", "property", 15), ("run", "function", 15), ("d", "property", 16), ("Z", "type-alias", 17), ("Color", "enum", 18), ("Red", "enum-variant", 18), ("Green", "enum-variant", 18), ("h", "function", 19), ("arrow", "function", 20)]
    assert names("typescript", ts) == want
    assert [n for n, *_ in names("typescript", ts, "export")] == ["f", "LIMIT", "other", "K", "I", "h", "arrow", "far"]
    assert {n: c for r, n, _, _, c in S.parse_source(ts, "typescript")[0] if n in ("f", "other", "get", "load", "run")} == {"f": 2, "other": 2, "get": 2, "load": 2, "run": 0}
    assert S.parse_source(ts, "typescript")[1] == [("./m", ["x", "a"]), ("n", ["*"]), ("./far", ["far"]), ("fs", ["q"])]
    js = "function foo() {}\nmodule.exports = { foo, bar: 2, baz() {} };\nmodule.exports.x = qux;\nrequire('side');\nconst c = class Named {};\n"
    assert names("javascript", js) == [("foo", "function", 1)]
    assert [n for n, *_ in names("javascript", js, "export")] == ["foo", "bar", "qux"] and S.parse_source(js, "javascript")[1] == [("side", [])]


def test_go_and_java_symbols():
    go = 'package p\nimport (\n\t"fmt"\n\t"a/b"\n)\ntype S struct {\n\tName string `json:"x"`\n\tX, Y int\n\t*Embedded\n\tFn func(a int) error\n}\ntype R interface {\n\tRead(p []byte) (int, error)\n\tio.Writer\n}\ntype (\n\tA int\n\tB struct { z int }\n)\nfunc (s *S) Do() { for {} }\nfunc low[T any](a struct{ x int }) map[string]int {\n\tif a && b {}\n}\nconst C = 1\n'
    want = [("S", "struct", 6), ("Name", "field", 7), ("X", "field", 8), ("Fn", "field", 10), ("R", "interface", 12), ("Read", "function", 13), ("A", "type-alias", 17), ("B", "struct", 18), ("z", "field", 18), ("Do", "function", 20), ("low", "function", 21)]
    assert names("go", go) == want and S.parse_source(go, "go")[1] == [("fmt", ["fmt"]), ("a/b", ["b"])]
    assert [n for n, *_ in names("go", go, "export")] == ["S", "R", "A", "B", "Do"]
    java = "import java.util.List;\n@Service\npublic class A extends B<C> {\n  private final List<String> xs = new ArrayList<>();\n  public static int N = 3, M;\n  public A(int x) { this.x = x; }\n  public int get(int x) { return x > 0 && x < 3 ? 1 : 2; }\n  private void no() { run(x); }\n  abstract <T> T gen(T t);\n}\ninterface I { int f(); }\nenum E { X, Y }\n"
    assert sorted(names("java", java), key=lambda x: x[2]) == [("A", "class", 3), ("xs", "field", 4), ("N", "field", 5), ("get", "function", 7), ("no", "function", 8), ("gen", "function", 9), ("I", "interface", 11), ("E", "enum", 12)]
    assert names("java", java, "export") == [("A", "class", 3), ("get", "function", 7)] and next(x[4] for x in S.parse_source(java, "java")[0] if x[1] == "get") == 3


def test_parse_files_skips_what_it_should(spark):
    rows = [("a.py", "def f(): ...\n"), ("a.md", "# x"), ("dist/a.py", "def g(): ...\n"), ("big.py", "x = 1\n" * 100_000), ("n.py", None), ("e.py", "")]
    parsed = S.parse_files(spark.createDataFrame(rows, "path string, content string"))
    assert {(r.path, r.role, r.name) for r in S.symbols(parsed).collect()} == {("a.py", "definition", "f"), ("a.py", "export", "f")}


def test_bytes_that_are_no_text(spark):
    files = spark.createDataFrame([("a.py", bytearray(b"def f(): ...\n# \xff\xfe")), ("b.go", bytearray(b"\x00\xff"))], "path string, content binary")
    assert {r.name for r in S.symbols(S.parse_files(files)).collect()} == {"f"}
    assert D.source_findings(files).count() == 0


def test_doc_header():
    assert S.doc_header("// One line\n// Two\nfn main() {}\n// no") == "One line\nTwo"
    assert S.doc_header('"""Module text\nmore."""\nimport x') == "Module text\nmore."
    assert S.doc_header("fn main() {}") == ""


PAIRS = [
    ("typescript", "empty-catch", "try { a(); } catch (e) {}", "try { a(); } catch (e) { log(e); }"),
    ("javascript", "empty-catch", "p.catch(() => {});", "p.catch(() => { log(); });"),
    ("java", "empty-catch", "try { a(); } catch (E e) { }", "try { a(); } catch (E e) { /* fine here */ }"),
    ("python", "empty-catch", "try:\n    a()\nexcept E:\n    pass\n", "try:\n    a()\nexcept E:\n    log()\n"),
    ("rust", "empty-catch", "fn f() { let _ = parse(x); }", "fn f() { let _guard = parse(x); }"),
    ("rust", "empty-catch", "fn f() { if let Err(_) = go() {} }", "fn f() { if let Err(e) = go() { log(e); } }"),
    ("go", "empty-catch", "if err != nil {}", "if err != nil { return err }"),
    ("python", "tautological-test", "def test_a():\n    assert True\n", "def test_a():\n    assert run() is True\n"),
    ("typescript", "tautological-test", "expect(true).toBe(true)", "expect(run()).toBe(true)"),
    ("rust", "tautological-test", "fn t() { assert_eq!(1, 1); }", "fn t() { assert_eq!(run(), 1); }"),
    ("java", "tautological-test", "assertTrue(true);", 'String s = "assertTrue(true)";'),
    ("go", "tautological-test", "assert.True(t, true)", "assert.True(t, ok)"),
    ("python", "always-true-condition", "if x == x:\n    pass\n", "if x == y:\n    pass\n"),
    ("typescript", "always-true-condition", "if (true) { a(); }", "if (ready) { a(); }"),
    ("rust", "always-true-condition", "fn f() { if a && !a { b(); } }", "fn f() { if a && !b { c(); } }"),
    ("go", "always-true-condition", "if x := f(); x == x {\n}", "if x := f(); x == y {\n}"),
    ("java", "always-true-condition", "if (n <= n) { a(); }", "if (next() == next()) { a(); }"),
    ("python", "passthrough-wrapper", "def f(a, b):\n    return g(a, b)\n", "def f(a, b):\n    return g(b, a)\n"),
    ("typescript", "passthrough-wrapper", "function f(a) { return g(a); }", "function f(a) { return this.g(a); }"),
    ("rust", "passthrough-wrapper", "fn f(a: i32) -> i32 { g(a) }", "fn f(a: i32) -> i32 { g(a) + 1 }"),
    ("go", "passthrough-wrapper", "func f(a int) int { return g(a) }", "func (s S) f(a int) int { return s.g(a) }"),
    ("go", "passthrough-wrapper", "func (s *S) f(a, b int, c T) int {\n\treturn os.g(a, b, c)\n}", "func f(a int) int {\n\tlog(a)\n\treturn g(a)\n}"),
    ("go", "passthrough-wrapper", "func f() { g() }", "func f(a ...int) { g(a...) }"),
    ("typescript", "passthrough-wrapper", "const f = (a, b) => g(a, b)", "const f = (a, b) => g(b, a)"),
    ("typescript", "passthrough-wrapper", "const f = (a: string, b = 1): Promise<T> => { return api.g(a, b); };", "const f = <T>(a: T) => g(a);"),
    ("typescript", "passthrough-wrapper", "xs.map((x) => go(x));", "xs.map((x) => go(x) + 1);"),
    ("javascript", "passthrough-wrapper", "async function f(a) { g(a); }", "function f(a) { return await g(a); }"),
    ("javascript", "passthrough-wrapper", "function f() { return a.b(1).c(); }", "function f(a) { /* as the api asks */ return g(a); }"),
    ("rust", "passthrough-wrapper", "impl Y { fn from(x: X) -> Y { build(x) } }", "impl From<X> for Y { fn from(x: X) -> Y { build(x) } }"),
    ("rust", "passthrough-wrapper", "impl Y { fn a(&self, mut x: Vec<u8>) -> R<T, E> { return inner::b(x); } }", "impl Y { fn a(&self, x: u8) -> u8 { self.b(x) } }"),
    ("rust", "passthrough-wrapper", "fn f() { g() }", "fn f<T>(a: T) -> T { g(a) }"),
    ("rust", "passthrough-wrapper", "fn f(a: u8) { g(a); }", "fn f(a: u8) { println!(a) }"),
    ("rust", "passthrough-wrapper", "impl<F> Y where F: for<'a> Fn(&'a u8) { fn f(a: u8) { g(a) } }", "fn f(a: u8) { g(&a) }"),
    ("java", "passthrough-wrapper", "class A { String f(List<String> a, int b) { return other.g(a, b); } }", "class A { String f(int a) { return super.f(a); } }"),
    ("java", "passthrough-wrapper", "class A { void f() { g(); } }", "class A { A f(int a) { return new A(a); } }"),
    ("python", "passthrough-wrapper", "class A:\n    @cached\n    def f(self, a, *b, **c):\n        return g(a, *b, **c)\n", "class A:\n    def f(self, a):\n        return self.g(a)\n"),
    ("python", "passthrough-wrapper", "async def f(a=1):\n    g(a)\n", "def f(a):\n    'Says why.'\n    return g(a)\n"),
    ("python", "passthrough-wrapper", "def f():\n    g()\n", "def f(a):\n    return g(a=a)\n"),
    ("rust", "empty-catch", "fn f() { go().await.ok(); }", "fn f() { let x = go().ok(); }"),
    ("rust", "empty-catch", "fn f() { let _: R = tx.send(1); }", "fn f() { let _ = m.lock().unwrap(); let _ = outcome; let _ = fs::remove_file(p); let _ = word_regex(); }"),
    ("rust", "empty-catch", "fn f() {\n    a\n        .b(|x| { x; })\n        .ok();\n}", "fn f() { let _x = parse(); }"),
    ("go", "empty-catch", "func f() {\n\t_ = g(x)\n}", "func f() {\n\ta, _ := g(x)\n}"),
    ("go", "empty-catch", "if err := g(); err != nil {\n}", "if ok != nil {\n}"),
    ("typescript", "tautological-test", "expect(x).toEqual( x )", "expect(f(x)).toEqual(f(x))"),
    ("javascript", "tautological-test", "expect('a, b').toStrictEqual('a, b')", "expect(x).toBe(y)"),
    ("rust", "tautological-test", 'debug_assert_eq!(a, a, "why {}", a);', "assert_eq!(a.b, a.b);"),
    ("rust", "tautological-test", "assert!(true);", "assert!(truth);"),
    ("java", "tautological-test", 'assertEquals("a, b", "a, b");', "assertEquals(a, b);"),
    ("java", "tautological-test", "assertNull(null); ", "assertNotNull(found);"),
    ("java", "tautological-test", 'assertFalse("why", false);', "assertFalse(failed);"),
    ("go", "tautological-test", "require.Equal(t, want, want)", "require.Equal(t, want, got)"),
    ("go", "tautological-test", 'assert.NotNil(t, "x")', "assert.Nil(t, err)"),
    ("python", "tautological-test", "assert x == x\n", "assert f() == f()\n"),
    ("python", "tautological-test", "assert 1\n", "assert False\n"),
    ("python", "tautological-test", "self.assertFalse(False)\n", "self.assertTrue(False)\n"),
    ("python", "tautological-test", "self.assertIs(a, a)\n", "self.assertIs(a, b)\n"),
    ("java", "passthrough-wrapper", "public int f(int a) { return g(a); }", "public int f(int a) { return g(a, 1); }"),
    ("python", "commented-out-code", "# x = 1\n# for y in z:\n#     go(y)\n", "# This is prose\n# about the thing\n# that follows\n"),
    ("python", "commented-out-code", "def f():\n    #     if x:\n    #         go(x)\n    #     return x\n    pass\n", "# note(\n# this isn't\n# code\n"),
    ("java", "commented-out-code", "/*\n * int a = 1;\n * run(a);\n * return a;\n */\n", "/**\n * int a = 1;\n * run(a);\n * return a;\n */\n"),
    ("typescript", "commented-out-code", "// const a = 1;\n// run(a);\n// return a;\n", "// TODO\n// const a = 1;\n// run(a);\n"),
]


@pytest.mark.parametrize(("language", "category", "bad", "good"), PAIRS)
def test_detectors(language, category, bad, good):
    assert category in [f[3] for f in D.detect(bad, language)]
    assert category not in [f[3] for f in D.detect(good, language)]


def test_stale_suppressions(spark):
    source = "#[allow(dead_code)]\n#[derive(Debug)]\npub struct Used;\n#[allow(unused, unused_must_use)]\n// why\npub(crate) fn helper() {}\n#[allow(dead_code, non_snake_case)]\nfn mixed() {}\n#[cfg_attr(x, allow(dead_code))]\nfn nested() {}\n#![allow(dead_code)]\nfn inner() {}\n#[allow(dead_code)]\nfn alone() {}\n#[allow(dead_code)]\nimpl Used {}\n"
    assert [x[0] for x in D.allowed_names(source)] == ["Used", "helper", "alone"]
    files = spark.createDataFrame([("crates/foo/src/helpers.rs", source), ("other/src/thing.rs", source), ("tests/t.rs", source), ("n.rs", None)], "path string, content string")
    imports = spark.createDataFrame([("a.rs", "crate::helpers::helper", "helper"), ("a.rs", "crate::Used", "Used"), ("b.rs", "far::mixed", "mixed"), ("b.rs", None, "alone"), ("b.rs", "x::nested", "nested")], "path string, import_from string, name string")
    found = D.stale_suppressions(D.suppressions(files), imports)
    assert sorted((r.path, r.start_line, r.end_line) for r in found.collect()) == [("crates/foo/src/helpers.rs", 1, 1), ("crates/foo/src/helpers.rs", 4, 4), ("other/src/thing.rs", 1, 1)]


def test_conditions():
    cases = {"true": "constant", "(False)": "constant", "a == a": "self-comparison", "a && !a": "contradiction", "not a and a": "contradiction", "a == b": None, "f(x) == f(x)": None, "a && (b || !a)": None, "x << 1": None}
    assert {c: D.classify_condition(c) for c in cases} == cases


def test_suppression(spark):
    rows = [("a.rs", 10, "empty-catch"), ("a.rs", 14, "empty-catch"), ("a.rs", 10, "orphan-export"), ("b.rs", 3, "empty-catch"), ("b.rs", None, "tracked-artifact"), ("c.rs", None, "tracked-artifact"), ("c.rs", 1, "empty-catch"), ("d.rs", None, "stale-ci-config")]
    findings = spark.createDataFrame(rows, "path string, line long, category string")
    marks = [("a.rs", 7, "x(); // slop-ignore: dead, empty-catch as it is fine"), ("b.rs", 2, "# slop-ignore-all"), ("c.rs", 8, "// slop-ignore-all"), ("c.rs", 1, "say slop-ignore: empty-catch"), ("d.rs", 5, "-- slop-ignore: stale-ci-config # why")]
    left = T.unsuppressed(findings, T.directives(spark.createDataFrame(marks, "path string, line long, text string")))
    assert {tuple(r) for r in left.collect()} == {("a.rs", 14, "empty-catch"), ("a.rs", 10, "orphan-export"), ("c.rs", None, "tracked-artifact"), ("c.rs", 1, "empty-catch")}


def test_path_detectors(spark):
    listing = spark.createDataFrame([(p,) for p in (".travis.yml", "yarn.lock", "package-lock.json", "biome.json", ".prettierrc")], "path string")
    assert T.stale_ci(listing).count() == 0
    assert {r.path for r in T.duplicate_tooling(listing).collect()} == {"yarn.lock", ".prettierrc"}
    assert {r.path for r in T.stale_ci(listing.unionByName(spark.createDataFrame([(".gitlab-ci.yml",)], "path string"))).collect()} == {".travis.yml"}


def test_documents(spark):
    text = "Title\n=====\n# Head\ntext `parse_file` and map::get_all\n```\n`hidden_name`\n```\n## Next\n\n    `indented_name`\n"
    docs = spark.createDataFrame([("d.md", text), ("r.rst", "Big\n===\nx\n"), ("e.md", "")], "path string, content string")
    assert [(r.path, r.line, r.heading) for r in X.headings(docs).orderBy("path", "line").collect()] == [("d.md", 3, "Head"), ("d.md", 8, "Next"), ("r.rst", 1, "Big")]
    assert [(r.name, r.start_line, r.end_line) for r in X.markdown_sections(docs.where("path = 'd.md'")).orderBy("start_line").collect()] == [(None, 1, 2), ("Head", 3, 7), ("Next", 8, 11)]
    refs = X.code_references(docs)
    assert {(r.line, r.text, r.context) for r in refs.collect()} == {(4, "parse_file", "inline-code"), (4, "map::get_all", "api-mention")}
    symbols = spark.createDataFrame([("z.rs", "get_all"), ("a.rs", "get_all")], "path string, name string")
    activity = spark.createDataFrame([("a.rs", 9), ("z.rs", 1)], "path string, changes long")
    out = X.stale_docs(refs, symbols, activity).collect()
    assert [(r.reference, r.issue) for r in out] == [("parse_file", "symbol-not-found"), ("map::get_all", "references-hotspot")]
    assert [(r.references, r.references_hot_files) for r in X.doc_hotness(refs, symbols, activity).collect()] == [(2, True)]


def test_find(spark):
    symbols = spark.createDataFrame([("src/cache/store.rs", "export", "CacheStore", "struct", 1, 0), ("src/cache.rs", "export", "other", "function", 1, 0), ("x.rs", "export", "y", "function", 1, 0)], "path string, role string, name string, kind string, line long, complexity long")
    imports = spark.createDataFrame([("x.rs", "crate::cache", "CacheStore")], "path string, import_from string, name string")
    heads = spark.createDataFrame([("x.rs", "a cache"), ("src/cache.rs", "none")], "path string, header string")
    told = spark.createDataFrame([("src/cache.rs", "the Cache")], "path string, descriptor string")
    out = X.find(symbols, imports, "the cache", 0, heads, told).collect()
    assert [(r.path, r.score) for r in out] == [("src/cache.rs", 7.5), ("src/cache/store.rs", 5.0), ("x.rs", 3.5)]
    assert out[1].why == "path matches; exports `CacheStore`" and out[2].why == "module doc mentions term; imports `CacheStore`, `crate::cache`"
    assert X.find(symbols, imports, "the of").count() == 0


def test_project_metadata(spark):
    listing = spark.createDataFrame([("README.rst",), ("readme.md",), ("go.mod",), ("Jenkinsfile",), ("a.go",), ("b.go",), ("c.py",), ("x.unknown",)], "path string")
    contents = spark.createDataFrame([("README.rst", "Head\n====\n"), ("LICENSE", "ISC License\nPermission to use, copy, modify")], "path string, content string")
    row = X.project_info(listing, contents).first()
    assert (row.readme, row.sections, row.license, row.ci, row.package_manager, row.languages) == ("README.rst", "Head", "ISC", "jenkins", "go", "Go,Python")
    assert [(r.language, round(r.percentage, 1)) for r in X.languages(listing).collect()] == [("Go", 66.7), ("Python", 33.3)]
    assert X.ci(listing.limit(0)).count() == 0


def test_entry_points(spark):
    paths = ["Cargo.toml", "src/main.rs", "src/bin/tool.rs", "src/bin/nested/main.rs", "tests/it.rs", "crates/c/Cargo.toml", "crates/c/src/main.rs", "pkg/sub/__main__.py", "next.config.mjs", "lonely/tests/x.rs", "lonely/src/main.rs", "vendor/__main__.py"]
    contents = [("Cargo.toml", '[package]\nname = "top"\n[workspace]\nmembers = ["crates/*", "x"]\n'), ("lonely/Cargo.toml", '[package]\nname = "l"\n'), ("crates/c/Cargo.toml", '[package]\nname = "c"\n[[bin]]\nname = "cc"\npath = "src/main.rs"\n'), ("package.json", '{"name": "n", "bin": {"cli": "./bin/c.js"}, "scripts": {"build": "x"}}'), ("pyproject.toml", '[project.scripts]\nrun = "a:b"\n'), ("bad/Cargo.toml", "[[")]
    symbols = spark.createDataFrame([("src/main.rs", "definition", "main", "function", 3, 1), ("k.rs", "definition", "main", "struct", 3, 1)], "path string, role string, name string, kind string, line long, complexity long")
    out = E.entry_points(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(contents, "path string, content string"), symbols).collect()
    assert [(r.kind, r.path, r.name) for r in out] == [
        ("binary", "bin/c.js", "cli"),
        ("binary", "crates/c/src/main.rs", "cc"),
        ("binary", "pyproject.toml", "run"),
        ("binary", "src/bin/nested/main.rs", "nested"),
        ("binary", "src/bin/tool.rs", "tool"),
        ("binary", "src/main.rs", "top"),
        ("binary", "tests/it.rs", "it"),
        ("main", "pkg/sub/__main__.py", "sub"),
        ("main", "src/main.rs", "main"),
        ("npm-script", "package.json", "build"),
        ("framework-config", "next.config.mjs", "next.config.mjs"),
    ]
    assert E.workspace_members('[workspace]\nmembers = ["crates/*", "x", "./y/", "a/*/b", "*"]') == [("=", ""), ("*", "crates"), ("=", "x"), ("=", "y"), ("*", "")]


# --- sources


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "r"
    root.mkdir()

    def run(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=a@x", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (root / "a.py").write_text("one\ntwo\n")
    (root / "__init__.py").write_text("")
    (root / ".hidden").write_text("x")
    (root / ".gitignore").write_text("skip.txt\n")
    (root / "skip.txt").write_text("x")
    run("add", "-A")
    run("commit", "-qm", "feat: start\n\nSome body text.\n\nReviewed-by: Bob")
    (root / "a.py").write_text("one\nthree\nfour\n")
    run("commit", "-qam", "fix: it")
    run("mv", "a.py", "b.py")
    run("commit", "-qam", "move it")
    run("commit", "-q", "--allow-empty", "-m", "nothing")
    return str(root), run


def test_git_history(spark, repo):
    root, run = repo
    log = git_log.read_log(spark, root)
    commits = git_log.commits(log).orderBy("seq").collect()
    assert [c.subject for c in commits] == ["nothing", "move it", "fix: it", "feat: start"]
    assert commits[3].trailers == ["Reviewed-by: Bob"] and commits[3].body.startswith("Some body") and commits[2].trailers == [] and commits[0].author_name == "Ann"
    changes = {(r.path, r.additions, r.deletions) for r in git_log.file_changes(log).join(log.where("message = 'fix: it'").select("hash"), "hash").collect()}
    assert changes == {("a.py", 2, 1)}
    assert [r.path for r in git_log.deletions(log).collect()] == ["a.py"]
    assert [(r.old_path, r.new_path) for r in git_log.renames(git_log.read_log(spark, root, renames=True)).collect()] == [("a.py", "b.py")]
    first = commits[3].hash
    assert git_log.commits(git_log.read_log(spark, root, since=first)).count() == 3
    assert git_log.status(root, git_log.head(root)) == "valid" and git_log.status(root, first) == "stale" and git_log.status(root, "0" * 40) == "invalid" and git_log.status(root, None) == "invalid"
    assert not git_log.is_shallow(root) and git_log.has_commit(root, first)


def test_git_stream_reads_each_commit_once(spark, repo, tmp_path):
    root, run = repo
    git_log.register(spark)
    seen = []
    for _ in range(2):
        stream = spark.readStream.format("gneiss_git_log").load(root)
        query = stream.writeStream.foreachBatch(lambda df, n: seen.extend(r.message for r in df.dropDuplicates(["hash"]).collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        run("commit", "-q", "--allow-empty", "-m", "later")
    assert sorted(seen) == sorted(["nothing", "move it", "fix: it", "feat: start\n\nSome body text.\n\nReviewed-by: Bob", "later"])


def test_file_listing(spark, repo):
    root, _ = repo
    assert sorted(r.path for r in files.read_files(spark, root).collect()) == ["__init__.py", "b.py"]
    assert sorted(r.path for r in files.read_files(spark, root, includeHidden=True, content=False).collect()) == [".gitignore", ".hidden", "__init__.py", "b.py"]
    assert {r.path for r in files.read_files(spark, root, gitignore=False).collect()} >= {"skip.txt"}
    assert [r.path for r in files.read_files(spark, root, maxBytes=3).collect()] == ["__init__.py"]


def test_sidecar():
    rows = pd.DataFrame([("b.rs", 0, "file", None, 1, 9, [0.5, -1.0]), ("a.rs", 0, "function", "é", 2, 3, [0.25, 2.0])], columns=["path", "chunk_index", "kind", "name", "start_line", "end_line", "values"])
    data = artifact.encode_sidecar(rows, {"model": "m"})
    head, back = artifact.decode_sidecar(data)
    assert head == {"model": "m", "dim": 2, "count": 2} and back["path"].tolist() == ["a.rs", "b.rs"] and back["values"].tolist() == [[0.25, 2.0], [0.5, -1.0]] and back["name"].tolist() == ["é", None]
    for bad in (data[:-1], data + b"x", data[:3], b"\xff\xff\xff\xff" + data[4:], data.replace(b'"count": 2', b'"count": 9')):
        with pytest.raises(ValueError):
            artifact.decode_sidecar(bad)


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, descriptor string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, descriptor string")
    assert {tuple(r) for r in artifact.upsert(old, new, "path").collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    artifact.write_tables({"d": old}, str(tmp_path))
    assert artifact.read_table(spark, str(tmp_path), "d").count() == 2
    assert spark.read.parquet(artifact.replace_table(new, str(tmp_path), "d")).count() == 2
    artifact.export_json(old, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


# --- streaming


def test_stream_result_is_the_batch_result(spark, sf_dir, tmp_path):
    changes = I.event_changes(spark.read.parquet(f"{sf_dir}/events.parquet"))
    source = tmp_path / "in"
    for i, part in enumerate(changes.randomSplit([1.0, 1.0, 1.0], 5)):
        part.write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(changes.schema).parquet(str(source))
        I.update(stream, str(tmp_path / "state"), str(tmp_path / "offsets")).awaitTermination()
        assert len(list((tmp_path / "state").glob("batch=*"))) == i + 1
    key = lambda df: sorted(map(str, df.collect()))
    want = key(I.merged(I.daily(changes), 7))
    assert key(I.activity(spark, str(tmp_path / "state"), 7)) == want
    I.compact(spark, str(tmp_path / "state"), str(tmp_path / "compact"))
    assert key(I.activity(spark, str(tmp_path / "compact"), 7)) == want


def test_windows_on_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = I.windows(stream).writeStream.format("memory").queryName("windows_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("windows_out").collect())) == sorted(map(str, I.windows(events).collect()))
    assert I.sessions(events).agg(F.sum("n")).first()[0] == events.count()
