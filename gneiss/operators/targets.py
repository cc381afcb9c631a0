"""Where to look for poor code: file and area targets (T1-T7, A15-A17, J16, J21) and path detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions import predicates as P
from gneiss.operators import graph, vectors

CLICHES = sorted("abstract bar base baz common dao data dto dummy foo generic handler helper helpers impl info manager misc pojo processor qux scratch shared stuff temp thing things tmp util utilities utility utils vo wrapper".split())
FILE_CUT = 1.5
TOP_LEVEL = ("class", "constant", "enum", "function", "interface", "static", "struct", "trait", "type-alias")


def nearest_rank(df: DataFrame, column: str, p: float = 0.95) -> DataFrame:
    """One row: the value at rank round((n - 1) p), from counts by value rather than sorted rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))  # a row for each value
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    ranked = counts.select(column, upto.alias("upto"), total.alias("total"))
    return ranked.agg(F.coalesce(F.min(F.when(F.col("upto") > F.round((F.col("total") - 1) * p), F.col(column))), F.lit(0)).cast("double").alias(f"{column}_p"))


def file_targets(activity: DataFrame, contributors: DataFrame, top: int = 10) -> DataFrame:
    """(path, score, suspect) of files that are hot, often fixed, large or written by bots."""
    files = activity.where("not generated")
    bots = contributors.where("is_bot").select("name")
    by_bot = files.select("path", F.explode("authors").alias("name")).join(bots, "name", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("bots"))
    cuts = F.broadcast(nearest_rank(files, "changes").crossJoin(nearest_rank(files, "bug_fix_changes")))  # one row
    rows = files.join(by_bot, "path", "left").crossJoin(cuts)

    def capped(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.least(part.cast("double") / whole, F.lit(2.0))).otherwise(0.0)

    hot, bug = capped(F.col("changes"), F.col("changes_p")), capped(F.col("bug_fix_changes"), F.col("bug_fix_changes_p"))
    size = F.least(F.col("additions").cast("double") / 500, F.lit(2.0))
    hands = F.size(F.array_compact("authors"))
    bot = F.when(hands > 0, F.coalesce("bots", F.lit(0)).cast("double") / hands).otherwise(0.0)
    rows = rows.select("path", hot.alias("hot"), bug.alias("bug"), size.alias("size"), bot.alias("bot"))
    score = F.col("hot") + F.col("bug") * 1.5 + F.col("size") * 0.7 + F.col("bot") * 0.8
    suspect = F.when((F.col("bug") >= F.col("hot")) & (F.col("bug") >= F.col("bot")), "defensive-cargo-cult").when(F.col("bot") >= F.col("hot"), "bot-authored").when(F.col("size") >= 1, "could-be-shorter").otherwise("defensive-cargo-cult")
    out = rows.select("path", F.round(score, 6).alias("score"), suspect.alias("suspect")).where(F.col("score") >= FILE_CUT)
    return out.orderBy(F.desc("score"), "path").limit(top)


def cliche_clusters(symbols: DataFrame, least: int = 3) -> DataFrame:
    """(area, hits, score) of directories with several exports of worn-out names."""
    rows = symbols.where("role = 'export' and kind in ('function', 'class', 'struct')")
    worn = F.arrays_overlap(P.identifier_tokens(F.col("name")), F.array(*(F.lit(c) for c in CLICHES)))
    by = rows.where(worn).groupBy(P.parent_dir(F.col("path")).alias("area")).agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
    return by.select("area", "hits", (F.least(F.col("hits"), F.lit(8)) + 1).cast("double").alias("score"))


def bug_communities(groups: DataFrame, activity: DataFrame, least_files: int = 3, least_fixes: int = 5) -> DataFrame:
    """(community, files, fixes, score) of the tenth of communities with the most fixes."""
    by = groups.join(activity.select("path", "bug_fix_changes"), "path").groupBy("community").agg(F.count(F.lit(1)).alias("files"), F.sum("bug_fix_changes").alias("fixes")).where(F.col("files") >= least_files)
    everyone = Window.partitionBy(F.lit(0))  # a row a community
    rank = F.row_number().over(everyone.orderBy(F.desc("fixes"), "community"))
    cut = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(everyone) * 0.1))
    out = by.select("community", "files", "fixes", rank.alias("rank"), cut.alias("cut")).where((F.col("rank") <= F.col("cut")) & (F.col("fixes") >= least_fixes))
    return out.select("community", "files", "fixes", F.least(F.col("fixes").cast("double") / 10, F.lit(10.0)).alias("score"))


def area_targets(symbols: DataFrame, edges: DataFrame, groups: DataFrame, activity: DataFrame, top: int = 10) -> DataFrame:
    """T2-T5 together: (kind, area, score, suspect) by score."""
    cliche = cliche_clusters(symbols).select("area", "score", F.lit("cliche-names").alias("suspect"))
    tower = graph.wrapper_chains(edges).groupBy("head").agg(F.max("length").alias("n")).select(F.col("head").alias("area"), F.least(F.col("n"), F.lit(10)).cast("double").alias("score"), F.lit("wrapper-tower").alias("suspect"))
    single = graph.single_importers(edges, symbols).select(F.col("path").alias("area"), "score", F.lit("single-impl").alias("suspect"))
    buggy = bug_communities(groups, activity).select(F.concat(F.lit("#"), "community").alias("area"), "score", F.lit("high-bug-community").alias("suspect"))
    out = cliche.unionByName(tower).unionByName(single).unionByName(buggy)
    return out.select(F.lit("area").alias("kind"), "area", F.round("score", 6).alias("score"), "suspect").orderBy(F.desc("score"), "area", "suspect").limit(top)


def vector_targets(vecs: DataFrame, top: int = 10, threshold: float = vectors.DUPLICATE_SIMILARITY) -> DataFrame:
    """(kind, area, score, suspect) of outlying files and of alike pairs."""
    far = vectors.outliers(vecs, top).select(F.lit("file").alias("kind"), F.col("path").alias("area"), "score", F.lit("defensive-cargo-cult").alias("suspect"))
    alike = vectors.semantic_duplicates(vecs, top, threshold).select(F.lit("area").alias("kind"), F.concat_ws("|", "path_a", "path_b").alias("area"), "score", F.lit("semantic-duplicate").alias("suspect"))
    return far.unionByName(alike)


def touching(targets: DataFrame, files: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Targets that touch one of the files: that are one, are a folder or a pair with one, or a community with one."""
    asked = files.select(P.normalize_rel_path(F.col("path")).alias("asked")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("asked", "/"))), lambda i: F.array_join(F.slice(F.split("asked", "/"), F.lit(1), i), "/"))
    keys = asked.select(F.explode(above).alias("key"))
    if groups is not None:
        keys = keys.unionByName(groups.join(asked, groups["path"] == asked["asked"], "left_semi").select(F.concat(F.lit("#"), "community").alias("key")))
    named = targets.withColumn("key", F.explode(F.split("area", r"\|"))).join(keys.distinct(), "key", "left_semi").drop("key")
    return named.distinct()


def tracked_artifacts(files: DataFrame) -> DataFrame:
    """(path, category, reason, confidence)."""
    kind = P.artifact_kind(F.col("path"))
    return files.select("path", F.lit("tracked-artifact").alias("category"), kind.alias("reason"), P.default_confidence(F.lit("tracked-artifact")).alias("confidence")).where("reason is not null")


_ACTIVE_CI = r"^(?:\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.yml|\.circleci/config\.ya?ml)$"
_STALE_CI = (".travis.yml", "appveyor.yml", ".appveyor.yml", "circle.yml")


def stale_ci(files: DataFrame) -> DataFrame:
    """Configuration of abandoned services where an active one is there."""
    active = files.agg(F.bool_or(F.col("path").rlike(_ACTIVE_CI)).alias("active"))
    rows = files.where(F.col("path").isin(*_STALE_CI)).crossJoin(F.broadcast(active)).where("active")
    return rows.select("path", F.lit("stale-ci-config").alias("category"), F.lit("another service is active").alias("reason"), P.default_confidence(F.lit("stale-ci-config")).alias("confidence"))


_LOCKS = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb")
_BIOME = r"^biome\.jsonc?$"
_OLD_LINT = r"^(?:\.eslintrc(?:\.[a-z]+)?|eslint\.config\.[cm]?[jt]s|\.prettierrc(?:\.[a-z]+)?|prettier\.config\.[cm]?[jt]s)$"


def duplicate_tooling(files: DataFrame) -> DataFrame:
    """D3: an older linter beside its successor, and every lock file but the first of the list."""
    rank = F.array_position(F.array(*(F.lit(x) for x in _LOCKS)), F.col("path"))
    facts = F.broadcast(files.agg(F.bool_or(F.col("path").rlike(_BIOME)).alias("biome"), F.min(F.when(rank > 0, rank)).alias("kept")))
    rows = files.crossJoin(facts).where((F.col("biome") & F.col("path").rlike(_OLD_LINT)) | (rank > F.col("kept")))
    reason = F.when(rank > 0, "another lock file is kept").otherwise("its successor is configured too")
    return rows.select("path", F.lit("duplicate-tooling").alias("category"), reason.alias("reason"), P.default_confidence(F.lit("duplicate-tooling")).alias("confidence"))


def orphan_exports(symbols: DataFrame, edges: DataFrame, entry_points: DataFrame | None = None) -> DataFrame:
    """(path, name, kind, line) of top-level exports of files that nothing imports and nothing starts from."""
    rows = symbols.where("role = 'export'").where(F.col("kind").isin(*TOP_LEVEL)).where(~P.looks_like_entry_point(F.col("path")) & ~P.is_test_file(F.col("path")) & ~P.is_rust_test_file(F.col("path")))
    rows = rows.join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")
    if entry_points is not None:
        rows = rows.join(entry_points.select("path").distinct(), "path", "left_anti")
    return rows.select("path", "name", "kind", "line")


DIRECTIVE = "slop-ignore"
HEADER_LINES = 5


def directives(source_lines: DataFrame, word: str = DIRECTIVE) -> DataFrame:
    """(path, line, category) of suppression comments in (path, line, text), a row a category; null is all of them.

    ``// word: one, two`` names categories and ``// word-all`` takes all; a remark may follow each.
    """
    marker = rf"(?:^|\s)(?://|#|--)\s*{word}"
    named = F.regexp_extract("text", rf"{marker}:([^#]*)", 1)
    names = F.filter(F.transform(F.split(named, ","), lambda c: F.regexp_extract(c, r"(\S+)", 1)), lambda c: c != "")
    every = F.col("text").rlike(rf"{marker}-all(?:\s|$)")
    rows = source_lines.where(every | F.col("text").rlike(f"{marker}:"))
    return rows.select("path", "line", F.explode(F.when(every, F.array(F.lit(None).cast("string"))).otherwise(names)).alias("category"))


def unsuppressed(findings: DataFrame, marks: DataFrame, reach: int = 3) -> DataFrame:
    """Findings (path, line, category, ...) that no directive covers.

    A finding on a line is covered by one on it or up to ``reach`` lines above, a finding on a whole file, whose line is
    null, by one in the file's first lines.
    """
    m = marks.select(F.col("path").alias("m_path"), F.col("line").alias("m_line"), F.col("category").alias("m_category"))
    near = F.when(F.col("line").isNull(), F.col("m_line") <= HEADER_LINES).otherwise(F.col("m_line").between(F.col("line") - reach, F.col("line")))
    condition = (F.col("path") == F.col("m_path")) & near & (F.col("m_category").isNull() | (F.col("m_category") == F.col("category")))
    return findings.join(m, condition, "left_anti")


def by_file(findings: DataFrame) -> DataFrame:
    """(path, n, categories)."""
    return findings.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
