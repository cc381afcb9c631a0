"""Registered graph, symbol, vector and target queries, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import predicates as P
from gneiss.operators import graph as G
from gneiss.operators import history as H
from gneiss.operators import targets as T
from gneiss.operators import vectors as V
from gneiss.plans.history_queries import _BASE, _PAIRS, TEST, Query, _on_repo, _with
from gneiss.plans.repo import Repo, oracle_tables
from gneiss.session import written

#: The test vectors have no pair above the default.
THRESHOLD = 0.4
NAME = "getCopper_21"


def _edges(r: Repo, min_jaccard: float = G.MIN_JACCARD, min_cochanges: int = 3) -> DataFrame:
    return G.cochange_edges(r.coupled(min_cochanges), r.file_activity, min_jaccard, min_cochanges)


def _groups(r: Repo) -> DataFrame:
    return G.communities(_edges(r, 0.02, 2))


def _boundaries(r: Repo) -> DataFrame:
    """The edges are written once, as both the paths and the communities read them."""
    edges = written(_edges(r, 0.02, 2), "edges")
    return G.boundaries(G.betweenness(edges), G.communities(edges))


def _health(r: Repo) -> DataFrame:
    """The activity is written once, with the newest authors, as the edges and the communities read it."""
    activity = H.file_activity(r.commits, r.file_changes, newest=True)
    activity = written(activity.select("path", "changes", "recent_changes", "bug_fix_changes", "newest_author"), "activity")
    groups = G.communities(G.cochange_edges(r.coupled(2), activity, 0.02, 2))
    return G.community_health(groups, activity, activity.select("path", F.col("newest_author").alias("author")), r.contributors)


def _first_member(r: Repo) -> DataFrame:
    groups = _groups(r)
    first = groups.agg(F.min("path").alias("path"))
    sizes = groups.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return groups.join(first, "path").join(sizes, "community").select(F.col("path").alias("file"), "community", "size")


def _chain_edges(r: Repo) -> DataFrame:
    """Each part's file imports the next part's, but for every sixth."""
    k = F.regexp_extract("path", r"/part_(\d+)", 1)
    files = r.listing.where(k != "").select("path", k.try_cast("long").alias("k"))
    return files.where("k % 6 <> 0").select(F.col("path").alias("src"), (F.col("k") + 1).alias("k")).join(files.select(F.col("path").alias("dst"), "k"), "k").select("src", "dst")


def _named_symbols(r: Repo) -> DataFrame:
    found = G.symbols_of(r.symbols, r.imports, r.imports.agg(F.min("import_from")).first()[0])
    return found.select("section", "name", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("line", F.lit(0)).alias("line"))


def _first_symbol(r: Repo) -> str:
    return r.imports.agg(F.min("name")).first()[0]


def _delta(r: Repo) -> DataFrame:
    """Content hashes of the documents against an older state, in which every seventh is missing and every fifth differs."""
    new = r.docs.select("path", V.content_hash(F.col("content")).alias("hash"))
    n = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    old = new.where(n % 7 != 0).withColumn("hash", F.when(n % 5 == 0, "sha256:old").otherwise(F.col("hash"))).unionByName(new.where(n % 11 == 0).select(F.concat("path", F.lit(".old")).alias("path"), "hash"))
    return V.content_delta(old, new)


def _truncated(r: Repo) -> DataFrame:
    unit = V.truncated(F.col("values"), 16)
    return r.vectors.select("id", F.array_join(F.transform(unit, lambda x: F.format_number(x, 4)), " ").alias("head"), F.round(V.norm(unit), 6).alias("norm"))


_EDGES = """edges AS (SELECT a, b, n AS cochanges, CAST(n AS DOUBLE) / (x.changes + y.changes - n) AS jaccard FROM pairs JOIN fa x ON x.path = a JOIN fa y ON y.path = b
          WHERE n >= {least} AND CAST(n AS DOUBLE) / (x.changes + y.changes - n) >= {jaccard})"""
_IMPORT_EDGES = f"{oracle_tables('symbols', 'imports')}, e AS (SELECT DISTINCT path AS src, import_from AS dst FROM imports)"
_CHAIN = oracle_tables("listing") + ", k AS (SELECT path, CAST(regexp_extract(path, '/part_([0-9]+)', 1) AS BIGINT) AS k FROM listing WHERE regexp_matches(path, '/part_[0-9]+'))"
_MEANS = f"""{oracle_tables('vectors')},
each AS (SELECT path, i, avg(CAST(values[i] AS DOUBLE)) AS x FROM vectors, unnest(range(1, 65)) AS t(i) GROUP BY path, i),
mean AS (SELECT i, avg(x) AS m FROM each GROUP BY i),
far AS (SELECT path, round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS distance FROM each JOIN mean USING (i) GROUP BY path)"""
_UNIT = f"{oracle_tables('vectors')}, near AS (SELECT a.id AS id_a, b.id AS id_b, a.path AS path_a, b.path AS path_b, round(list_cosine_similarity(CAST(a.values AS DOUBLE[]), CAST(b.values AS DOUBLE[])), 6) AS similarity FROM vectors a JOIN vectors b ON a.id < b.id AND a.path <> b.path)"
_TOKENS = "string_split(trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[_-]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'))), ' ')"
_CLICHES = "[" + ", ".join(f"'{c}'" for c in T.CLICHES) + "]"
_CLUSTERS = f"""clusters AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS area, count(*) AS hits FROM symbols
             WHERE role = 'export' AND kind IN ('function', 'class', 'struct') AND list_has_any({_TOKENS}, {_CLICHES}) GROUP BY 1 HAVING count(*) >= 3)"""


def _rank(column: str) -> str:
    return f"coalesce((SELECT v FROM (SELECT {column} AS v, row_number() OVER (ORDER BY {column}) AS k, count(*) OVER () AS n FROM plain) WHERE k = CAST(round((n - 1) * 0.95) AS BIGINT) + 1), 0)"


_FILE_TARGETS = f"""plain AS (SELECT path, changes, fixes, additions FROM fa WHERE NOT regexp_matches(path, '{P.GENERATED}')),
hands AS (SELECT path, count(DISTINCT author) AS n, count(DISTINCT CASE WHEN is_bot THEN author END) AS bots FROM who JOIN people ON name = author GROUP BY path),
parts AS (SELECT path, least(changes / CAST({_rank("changes")} AS DOUBLE), 2.0) AS hot, CASE WHEN {_rank("fixes")} > 0 THEN least(fixes / CAST({_rank("fixes")} AS DOUBLE), 2.0) ELSE 0.0 END AS bug, least(additions / CAST(500 AS DOUBLE), 2.0) AS size, bots / CAST(n AS DOUBLE) AS bot FROM plain JOIN hands USING (path))
SELECT path, round(hot + bug * CAST(1.5 AS DOUBLE) + size * CAST(0.7 AS DOUBLE) + bot * CAST(0.8 AS DOUBLE), 6) AS score,
  CASE WHEN bug >= hot AND bug >= bot THEN 'defensive-cargo-cult' WHEN bot >= hot THEN 'bot-authored' WHEN size >= 1 THEN 'could-be-shorter' ELSE 'defensive-cargo-cult' END AS suspect
FROM parts WHERE hot + bug * 1.5 + size * 0.7 + bot * 0.8 >= 1.5 ORDER BY score DESC, path LIMIT 10"""

QUERIES: dict[str, tuple[Query, str]] = {
    "cochange_edges": (
        _on_repo(lambda r: _edges(r, 0.02, 2).withColumn("jaccard", F.round("jaccard", 6))),
        _with(_BASE, _PAIRS.format(least=2), _EDGES.format(least=2, jaccard=0.02)) + "SELECT a, b, cochanges, round(jaccard, 6) AS jaccard FROM edges",
    ),
    "communities": (_on_repo(lambda r: G.community_list(_groups(r))), ""),
    "boundaries": (_on_repo(_boundaries), ""),
    "area_of": (_on_repo(_first_member), ""),
    "community_health": (_on_repo(_health), ""),
    "wrapper_chains": (
        _on_repo(lambda r: G.wrapper_chains(_chain_edges(r))),
        _with(_CHAIN, "i AS (SELECT path, k, (k - 2) // 6 AS g FROM k WHERE k % 6 <> 0 AND (k - 1) % 6 <> 0 AND k > 1 AND k + 1 IN (SELECT k FROM k))", "w AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS position FROM i)")
        + "SELECT first_value(path) OVER (PARTITION BY g ORDER BY k) AS head, path, position, n AS length FROM w WHERE n >= 3",
    ),
    "single_importers": (
        _on_repo(lambda r: G.single_importers(_chain_edges(r), r.symbols.withColumn("kind", F.when(F.col("kind") == "struct", "interface").otherwise(F.col("kind"))))),
        _with(_CHAIN, oracle_tables("symbols"), "e AS (SELECT a.path AS src, b.path AS dst FROM k a JOIN k b ON b.k = a.k + 1 AND a.k % 6 <> 0)")
        + """SELECT path, importer, n AS abstractions, CAST(6 + least(n, 4) AS DOUBLE) AS score FROM (SELECT path, count(*) AS n FROM symbols WHERE role = 'export' AND kind = 'struct' GROUP BY path)
        JOIN (SELECT dst AS path, min(src) AS importer FROM e GROUP BY dst HAVING count(*) = 1) USING (path)""",
    ),
    "dependents": (
        _on_repo(lambda r: G.dependents(r.symbols, r.imports, _first_symbol(r))),
        _with(_IMPORT_EDGES)
        + """SELECT DISTINCT name AS symbol, (SELECT min(path) FROM symbols s WHERE s.name = i.name) AS defined_in, path AS used_by FROM imports i WHERE name = (SELECT min(name) FROM imports)""",
    ),
    "symbols": (
        _on_repo(lambda r: _named_symbols(r)),
        _with(_IMPORT_EDGES, "f AS (SELECT min(import_from) AS p FROM imports)")
        + """SELECT concat(role, 's') AS section, name, kind, line FROM symbols, f WHERE path = p
        UNION ALL SELECT DISTINCT 'imports', import_from, '', 0 FROM imports, f WHERE path = p
        UNION ALL SELECT DISTINCT 'imported_by', path, '', 0 FROM imports, f WHERE import_from = p OR ends_with(p, import_from)""",
    ),
    "orphan_exports": (
        _on_repo(lambda r: T.orphan_exports(r.symbols, G.import_edges(r.imports))),
        _with(_IMPORT_EDGES)
        + f"""SELECT path, name, kind, line FROM symbols WHERE role = 'export' AND NOT regexp_matches(path, '{P.ENTRY_POINT}') AND NOT {TEST.format("path")} AND NOT regexp_matches(path, '{P.RUST_TEST_FILE}')
        AND path NOT IN (SELECT dst FROM e)""",
    ),
    "slop_file_targets": (_on_repo(lambda r: T.file_targets(r.file_activity, r.contributors)), _with(_BASE) + ", " + _FILE_TARGETS),
    "cliche_clusters": (
        _on_repo(lambda r: T.cliche_clusters(r.symbols)),
        _with(oracle_tables("symbols"), _CLUSTERS) + "SELECT area, hits, CAST(least(hits, 8) + 1 AS DOUBLE) AS score FROM clusters",
    ),
    "slop_area_targets": (_on_repo(lambda r: T.area_targets(r.symbols, G.import_edges(r.imports), _groups(r.stored("file_activity")), r.file_activity, 50)), ""),
    "slop_path_fixes": (
        _on_repo(lambda r: T.tracked_artifacts(r.listing).unionByName(T.stale_ci(r.listing)).unionByName(T.duplicate_tooling(r.listing))),
        """SELECT * FROM (VALUES ('debug.log', 'tracked-artifact', 'root-log', 0.97), ('src/a.swp', 'tracked-artifact', 'editor-swap', 0.97), ('coverage/index.html', 'tracked-artifact', 'coverage', 0.97),
        ('docs/.DS_Store', 'tracked-artifact', 'os-metadata', 0.97), ('old/main.rs.bak', 'tracked-artifact', 'backup', 0.97), ('.travis.yml', 'stale-ci-config', 'another service is active', 0.9),
        ('.eslintrc.json', 'duplicate-tooling', 'its successor is configured too', 0.85), ('yarn.lock', 'duplicate-tooling', 'another lock file is kept', 0.85)) AS t(path, category, reason, confidence)""".replace("0.97", "CAST(0.97 AS DOUBLE)").replace("0.9)", "CAST(0.9 AS DOUBLE))").replace("0.85", "CAST(0.85 AS DOUBLE)"),
    ),
    "stylistic_outliers": (
        _on_repo(lambda r: V.outliers(r.vectors)),
        _with(_MEANS) + "SELECT path, distance, round(5 + least(distance / (SELECT greatest(max(distance), CAST(1e-6 AS DOUBLE)) FROM far), 1.0) * 4, 6) AS score FROM far WHERE distance > 0.15 ORDER BY distance DESC, path LIMIT 10",
    ),
    "semantic_duplicates": (
        _on_repo(lambda r: V.semantic_duplicates(r.vectors, 10, THRESHOLD)),
        _with(_UNIT) + f"SELECT id_a, id_b, path_a, path_b, similarity, round(6 + 4 * similarity, 6) AS score FROM near WHERE similarity >= {THRESHOLD} ORDER BY similarity DESC, id_a, id_b LIMIT 10",
    ),
    "similar_pairs": (_on_repo(lambda r: V.similar_pairs(r.vectors, THRESHOLD)), _with(_UNIT) + f"SELECT * FROM near WHERE similarity >= {THRESHOLD}"),
    "slop_vector_targets": (
        _on_repo(lambda r: T.vector_targets(r.vectors, 10, THRESHOLD)),
        _with(_MEANS, _UNIT[_UNIT.index("near AS") :])
        + f"""SELECT * FROM (SELECT 'file' AS kind, path AS area, round(5 + least(distance / (SELECT greatest(max(distance), CAST(1e-6 AS DOUBLE)) FROM far), 1.0) * 4, 6) AS score, 'defensive-cargo-cult' AS suspect FROM far WHERE distance > 0.15 ORDER BY distance DESC, path LIMIT 10)
        UNION ALL SELECT * FROM (SELECT 'area', concat(path_a, '|', path_b), round(6 + 4 * similarity, 6), 'semantic-duplicate' FROM near WHERE similarity >= {THRESHOLD} ORDER BY similarity DESC, id_a, id_b LIMIT 10)""",
    ),
    "vector_heads": (
        _on_repo(_truncated),
        _with(oracle_tables("vectors"), "h AS (SELECT id, list_transform(values[1:16], lambda x: CAST(x AS DOUBLE)) AS v FROM vectors)", "n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM h)")
        + "SELECT id, array_to_string(list_transform(v, lambda x: printf('%.4f', x / s)), ' ') AS head, CAST(1.0 AS DOUBLE) AS norm FROM n",
    ),
    "content_delta": (
        _on_repo(_delta),
        _with(oracle_tables("docs"), "n AS (SELECT path, CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS k FROM docs)")
        + "SELECT path, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM n UNION ALL SELECT concat(path, '.old'), 'removed' FROM n WHERE k % 11 = 0",
    ),
}


def entry_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at the reference's own thresholds; no edges on the largest test tables."""
    return _edges(Repo.from_star_schema(spark, sf_dir))


QUERIES["cochange_edges_default"] = (
    lambda spark, sf_dir: entry_defaults(spark, sf_dir).withColumn("jaccard", F.round("jaccard", 6)),
    _with(_BASE, _PAIRS.format(least=3), _EDGES.format(least=3, jaccard=0.05)) + "SELECT a, b, cochanges, round(jaccard, 6) AS jaccard FROM edges",
)
