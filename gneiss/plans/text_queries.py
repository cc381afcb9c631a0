"""Registered queries over documents, search and project metadata, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import predicates as P
from gneiss.operators import graph as G
from gneiss.operators import texts as X
from gneiss.plans.history_queries import _BASE, Query, _on_repo, _with
from gneiss.plans.repo import Repo, oracle_tables

SEARCH = "the base handler of copper parts"


def _q(text: str) -> str:
    return text.replace("'", "''")


_LINES = oracle_tables("docs") + ", lines AS (SELECT path, i AS line, string_split(content, chr(10))[i] AS text FROM (SELECT path, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM docs))"
_HEAD = "CASE WHEN regexp_matches(text, '^#{1,6}([ \\t]|$)') THEN trim(regexp_replace(text, '^#+', '')) END"
_LIKE = f"""(strlen(text) BETWEEN 2 AND 100 AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '{_q(X.REJECTED)}')
  AND NOT (NOT contains(text, '::') AND regexp_matches(text, '{_q(X.REJECTED_UNQUALIFIED)}')) AND text NOT IN ({", ".join(f"'{w}'" for w in X.WORDS)}))"""
_REFS = f"""fenced AS (SELECT path, line, text, regexp_matches(text, '^ {{0,3}}(```|~~~)') AS fence FROM lines),
open AS (SELECT path, line, text, fence, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS fences FROM fenced),
prose AS (SELECT path, line, text FROM open WHERE NOT fence AND fences % 2 = 0 AND NOT regexp_matches(text, '^(    |\\t)')),
found AS (SELECT path AS doc, line, unnest(regexp_extract_all(text, '{X.INLINE_CODE}', 1)) AS text, 'inline-code' AS context FROM prose
          UNION ALL SELECT path, line, unnest(regexp_extract_all(regexp_replace(text, '{X.INLINE_CODE}', ' ', 'g'), '{X.API_MENTION}', 1)), 'api-mention' FROM prose),
refs AS (SELECT doc, line, text, context FROM found WHERE {_LIKE})"""
# the references of the documents are calls, wrapped types and qualified names; the tests cover the other rules
_MATCH = """cleaned AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '[(].*$', ''), '^Option<(.*)>$', '\\1'), '<.*$', '') AS bare FROM refs),
snaked AS (SELECT *, ltrim(lower(regexp_replace(bare, '([A-Z])', '_\\1', 'g')), '_') AS snake, regexp_extract(bare, '([^.:]*)$', 1) AS name1 FROM cleaned),
names AS (SELECT name, min(path) AS file FROM symbols GROUP BY name),
matched AS (SELECT r.*, coalesce(a.file, b.file, c.file) AS file FROM snaked r LEFT JOIN names a ON a.name = r.name1 LEFT JOIN names b ON b.name = regexp_extract(r.bare, '[.]([^.]*)$', 1) LEFT JOIN names c ON c.name = regexp_extract(r.snake, '([^.:]*)$', 1)),
hot AS (SELECT path, changes FROM (SELECT path, changes, row_number() OVER (ORDER BY changes DESC, path) AS k, count(*) OVER () AS n FROM fa) WHERE k <= greatest(1, ceil(n * 0.1)))"""


def _refs(r: Repo) -> DataFrame:
    return X.code_references(r.docs)


def _imports_resolved(r: Repo) -> DataFrame:
    """Every import written as a relative module path and looked up among the files."""
    rows = r.imports.where(F.col("path").rlike(r"\.(?:ts|js)$")).select("path", F.concat(F.lit("../../"), F.regexp_replace("import_from", r"^(.*?)\.[^/]*$", "$1")).alias("import_from"))
    rows = rows.withColumn("import_from", F.concat(F.lit("../"), "import_from"))
    return G.resolve_imports(rows, r.listing)


def _find_sql() -> str:
    terms = X.query_terms(SEARCH)
    low = "lower({})"
    base = "regexp_extract(lower(path), '([^/]*)$', 1)"
    parts = []
    for t in terms:
        hit = f"CAST(contains({base}, '{t}') AS INTEGER)"
        parts.append(f"5 * {hit} + 3 * greatest(len(list_filter(string_split(lower(path), '/'), lambda x: contains(x, '{t}'))) - {hit}, 0)")
        parts.append(f"2 * least(len(list_filter(exports, lambda x: contains({low.format('x')}, '{t}'))), 3) + len(list_filter(names, lambda x: contains({low.format('x')}, '{t}'))) + len(list_filter(modules, lambda x: contains({low.format('x')}, '{t}')))")
    return _with(
        oracle_tables("symbols", "imports"),
        "ex AS (SELECT path, list(name) AS exports FROM symbols WHERE role = 'export' GROUP BY path)",
        "im AS (SELECT path, list(name) AS names, list(DISTINCT import_from) AS modules FROM imports GROUP BY path)",
        "f AS (SELECT path, coalesce(exports, []) AS exports, coalesce(names, []) AS names, coalesce(modules, []) AS modules FROM (SELECT path FROM symbols UNION SELECT path FROM imports) LEFT JOIN ex USING (path) LEFT JOIN im USING (path))",
    ) + f"SELECT path, CAST({' + '.join(parts)} AS DOUBLE) AS score FROM f WHERE {' + '.join(parts)} > 0"


_LICENSE = "CASE " + " ".join("WHEN " + " AND ".join(f"contains(upper(content), '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in X.LICENSES.items()) + " ELSE 'unknown' END"
_LANG = "CASE regexp_extract(path, '\\.([^./]*)$', 1) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in X.EXTENSIONS.items()) + " END"

QUERIES: dict[str, tuple[Query, str]] = {
    "headings": (_on_repo(lambda r: X.headings(r.docs)), _with(_LINES) + "SELECT path, line, trim(regexp_replace(text, '^#+', '')) AS heading FROM lines WHERE starts_with(text, '#') AND trim(regexp_replace(text, '^#+', '')) <> ''"),
    "markdown_sections": (
        _on_repo(lambda r: X.markdown_sections(r.docs)),
        _with(_LINES, f"h AS (SELECT path, line, text, {_HEAD} AS name FROM lines)", "p AS (SELECT *, sum(CASE WHEN name IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line) AS part FROM h)")
        + "SELECT path, arg_min(name, line) FILTER (name IS NOT NULL) AS name, min(line) AS start_line, max(line) AS end_line FROM p GROUP BY path, part HAVING bool_or(trim(text) <> '')",
    ),
    "code_references": (_on_repo(_refs), _with(_LINES, _REFS) + "SELECT doc, line, text, context FROM refs"),
    "doc_matches": (
        _on_repo(lambda r: X.match_references(_refs(r), r.symbols).select("doc", "line", "text", "file", "exists")),
        _with(_LINES, _REFS, oracle_tables("symbols"), _BASE, _MATCH) + "SELECT doc, line, text, file, file IS NOT NULL AS exists FROM matched",
    ),
    "stale_docs": (
        _on_repo(lambda r: X.stale_docs(_refs(r), r.symbols, r.file_activity).drop("suggestion")),
        _with(_LINES, _REFS, oracle_tables("symbols"), _BASE, _MATCH)
        + """SELECT doc, line, text AS reference, CASE WHEN file IS NULL THEN 'symbol-not-found' ELSE 'references-hotspot' END AS issue FROM matched LEFT JOIN hot ON hot.path = file WHERE file IS NULL OR changes IS NOT NULL
        ORDER BY CASE WHEN file IS NULL THEN 2 ELSE 3 END, doc, line, reference LIMIT 20""",
    ),
    "doc_hotness": (
        _on_repo(lambda r: X.doc_hotness(_refs(r), r.symbols, r.file_activity)),
        _with(_LINES, _REFS, oracle_tables("symbols"), _BASE, _MATCH) + 'SELECT doc, count(*) AS "references", bool_or(changes IS NOT NULL) AS references_hot_files FROM matched LEFT JOIN hot ON hot.path = file GROUP BY doc',
    ),
    "hot_files": (_on_repo(lambda r: X.hot_files(r.file_activity)), _with(_BASE) + "SELECT path FROM (SELECT path, row_number() OVER (ORDER BY changes DESC, path) AS k, count(*) OVER () AS n FROM fa) WHERE k <= greatest(1, ceil(n * 0.1))"),
    "license_texts": (_on_repo(lambda r: r.docs.select("path", X.license_name(F.col("content")).alias("license"))), _with(oracle_tables("docs")) + f"SELECT path, {_LICENSE} AS license FROM docs"),
    "languages": (
        _on_repo(lambda r: X.languages(r.listing)),
        _with(oracle_tables("listing"))
        + f"SELECT language, count(*) AS file_count, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100, 6) AS percentage FROM (SELECT {_LANG} AS language FROM listing WHERE NOT regexp_matches(path, '{P.NOISE}')) WHERE language IS NOT NULL GROUP BY language",
    ),
    "project_info": (
        _on_repo(lambda r: X.project_info(r.listing, r.docs.where("path = 'docs/1.md'").select(F.lit("README.md").alias("path"), F.lit("# One\n\n## Two\n").alias("content")))),
        _with(
            oracle_tables("listing"),
            f"l AS (SELECT language, count(*) AS n FROM (SELECT {_LANG} AS language FROM listing WHERE NOT regexp_matches(path, '{P.NOISE}')) WHERE language IS NOT NULL GROUP BY language)",
        )
        + "SELECT 'README.md' AS readme, 'One|Two' AS sections, CAST(NULL AS VARCHAR) AS license, 'github-actions' AS ci, 'cargo' AS package_manager, string_agg(language, ',' ORDER BY n DESC, language) AS languages FROM l",
    ),
    "find": (_on_repo(lambda r: X.find(r.symbols, r.imports, SEARCH).drop("why")), _find_sql() + " ORDER BY score DESC, path LIMIT 10"),
    "find_all": (_on_repo(lambda r: X.find(r.symbols, r.imports, SEARCH, 0).drop("why")), _find_sql()),
    "import_resolution": (
        _on_repo(_imports_resolved),
        _with(
            oracle_tables("symbols", "imports", "listing"),
            "a AS (SELECT DISTINCT path, regexp_replace(import_from, '^(.*?)\\.[^/]*$', '\\1') AS stem FROM imports WHERE regexp_matches(path, '\\.(ts|js)$'))",
        )
        + "SELECT a.path, concat('../../../', stem) AS import_from, coalesce(l.path, concat('../../../', stem)) AS resolved FROM a LEFT JOIN listing l ON l.path = concat(stem, '.ts')",
    ),
}
