"""Analysis of a git repository: init, update, status and the named queries over its tables in a folder.

A table of the history has a folder for each run, named by the commit it goes up to, so a run that is repeated replaces
its own.  Tables of the working tree are written anew each time.  The mark is written last.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import predicates as P
from gneiss.operators import chunks, detectors, entry_points, graph, history, parsing, rollups, targets, texts, vectors
from gneiss.plans.repo import Repo
from gneiss.sources import artifact, files, git_log

HISTORY = ("commits", "file_changes", "deletions", "renames")
TREE = ("symbols", "imports", "docs", "vectors", "listing", "sources")
DERIVED = ("file_activity", "file_authors", "coupling")
#: Folders of updates that are read before they are joined up.
MAX_DELTAS = 20


def _working_tree(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    found = files.read_files(spark, root, includeHidden=True)
    found = found.where(~P.is_secret_like(F.col("path")))  # neither listed nor stored
    listing = found.select("path")
    plain = found.where(~F.col("path").rlike(r"(?:^|/)\."))
    parsed = parsing.parse_files(plain)
    imports = parsing.imports(parsed)
    resolved = graph.resolve_imports(imports, listing)
    symbols = parsing.symbols(parsed)
    pieces = chunks.chunks(chunks.embeddable(plain), symbols, "file")
    return {
        "symbols": symbols,
        "imports": imports.join(resolved, ["path", "import_from"]).select("path", F.col("resolved").alias("import_from"), "name"),
        "docs": plain.where("path like '%.md'").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")),
        "vectors": chunks.embedded(pieces).withColumn("id", F.xxhash64("path", "chunk_index")),
        "listing": listing,
        "sources": plain.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")),
    }


def _history(spark: SparkSession, root: str, since: str | None, max_commits: int = 0) -> dict[str, DataFrame]:
    log, moved = git_log.read_log(spark, root, since, max_commits=max_commits), git_log.read_log(spark, root, since, renames=True, max_commits=max_commits)
    return {"commits": git_log.commits(log), "file_changes": git_log.file_changes(log), "deletions": git_log.deletions(log), "renames": git_log.renames(moved)}


def _mark(spark: SparkSession, folder: str) -> str | None:
    try:
        row = spark.read.json(f"{folder}/mark").first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return row["analyzed_up_to"] if row else None


def _run(spark: SparkSession, root: str, folder: str, since: str | None, max_commits: int = 0) -> None:
    head = git_log.head(root)
    for name, df in _history(spark, root, since, max_commits).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}-{'full' if since is None else 'delta'}-{head}")
    artifact.write_tables(_working_tree(spark, root), folder)
    since_full = head if since is None else spark.read.json(f"{folder}/mark").first()["full"]
    deltas = [] if since is None else [*(spark.read.json(f"{folder}/mark").first()["deltas"] or []), head]
    if len(deltas) > MAX_DELTAS:
        # one folder an update would be read for ever, so they are joined up
        mark = (f"{head}-joined", [])
        for name in HISTORY:
            _parts(spark, folder, name, since_full, deltas).write.mode("overwrite").parquet(f"{folder}/{name}-full-{mark[0]}")
        since_full, deltas = mark
    spark.createDataFrame([(head, since_full, deltas)], "analyzed_up_to string, full string, deltas array<string>").coalesce(1).write.mode("overwrite").json(f"{folder}/mark")
    _derive(load(spark, folder), folder, head)


def _derive(repo: Repo, folder: str, head: str) -> None:
    """What most queries are made of is stored once a run."""
    repo.file_activity.write.mode("overwrite").parquet(f"{folder}/file_activity-{head}")
    repo.file_authors.write.mode("overwrite").parquet(f"{folder}/file_authors-{head}")
    repo.coupling.write.mode("overwrite").parquet(f"{folder}/coupling-{head}")


def init(spark: SparkSession, root: str, folder: str, max_commits: int = 0) -> None:
    """Analyse the history, or its newest ``max_commits`` commits, and the working tree."""
    _run(spark, root, folder, None, max_commits)


def status(spark: SparkSession, root: str, folder: str) -> str:
    """valid, stale or invalid."""
    return git_log.status(root, _mark(spark, folder))


def update(spark: SparkSession, root: str, folder: str) -> str:
    """Add the commits since the mark; a mark that the history lost starts over.  Returns the status before."""
    before = status(spark, root, folder)
    if before != "valid":
        _run(spark, root, folder, _mark(spark, folder) if before == "stale" else None)
    return before


def _parts(spark: SparkSession, folder: str, name: str, full: str, deltas: list[str]) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}-full-{full}", *(f"{folder}/{name}-delta-{d}" for d in deltas))


def _optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table there, or an empty one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load(spark: SparkSession, folder: str) -> Repo:
    mark = spark.read.json(f"{folder}/mark").first()
    tree = {name: artifact.read_table(spark, folder, name) for name in TREE}
    given = _pointer(spark, folder, "vectors")
    if given is not None:
        tree["vectors"] = spark.read.parquet(given)
    none = spark.createDataFrame([], "tag string, ts timestamp")
    repo = Repo(**{name: _parts(spark, folder, name, mark["full"], mark["deltas"] or []) for name in HISTORY}, release_tags=none, event_log=none, **tree)
    for name in DERIVED:
        stored = _optional(spark, f"{folder}/{name}-{mark['analyzed_up_to']}", "none int")
        if "none" not in stored.columns:
            repo.__dict__[name] = stored  # in place of what the property would work out
    repo.__dict__["descriptors"] = _optional(spark, _pointer(spark, folder, "descriptors") or f"{folder}/descriptors", DESCRIPTORS)
    repo.__dict__["summaries"] = _optional(spark, _pointer(spark, folder, "summary") or f"{folder}/summary", SUMMARY)
    return repo


def _pointer(spark: SparkSession, folder: str, name: str) -> str | None:
    """Where the newest version of a table that users set is."""
    found = _optional(spark, f"{folder}/{name}-at", "path string")
    row = found.agg(F.max_by("path", "stamp")).first() if "stamp" in found.columns else None
    return row[0] if row else None


def _replace(spark: SparkSession, folder: str, name: str, df: DataFrame) -> None:
    """A new version of a table, which counts once its place is noted."""
    path = artifact.replace_table(df, folder, name)
    spark.createDataFrame([(path,)], "path string").withColumn("stamp", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/{name}-at")


DESCRIPTORS = "path string, descriptor string"
SUMMARY = "depth1 string, depth3 string, depth10 string, analyzed_up_to string"


def set_descriptors(spark: SparkSession, folder: str, found: dict[str, str]) -> int:
    """Keep texts that describe files, in place of older ones of the same files; how many there are then."""
    new = spark.createDataFrame(list(found.items()), DESCRIPTORS)
    old = _optional(spark, _pointer(spark, folder, "descriptors") or f"{folder}/descriptors", DESCRIPTORS)
    _replace(spark, folder, "descriptors", artifact.upsert(old, new, "path"))
    return spark.read.parquet(_pointer(spark, folder, "descriptors")).count()


def set_summary(spark: SparkSession, folder: str, depth1: str, depth3: str, depth10: str) -> None:
    """Keep the summary of the repository in three lengths, with the commit it was made for."""
    _replace(spark, folder, "summary", spark.createDataFrame([(depth1, depth3, depth10, _mark(spark, folder))], SUMMARY))


def set_embeddings(spark: SparkSession, folder: str, sidecar: str) -> int:
    """Take the vectors of a packed file in place of the stored ones; how many there are."""
    content = spark.read.format("binaryFile").load(sidecar).select("path", "content")
    vectors_ = artifact.read_sidecars(content).withColumn("id", F.xxhash64("path", "chunk_index"))
    _replace(spark, folder, "vectors", vectors_)
    return spark.read.parquet(_pointer(spark, folder, "vectors")).count()


def import_json(spark: SparkSession, path: str, folder: str) -> None:
    """Tables of a map that is one JSON document: commits are not in it, so the files' counts are taken as they are."""
    with open(path.removeprefix("file://"), encoding="utf-8") as f:
        found = json.load(f)
    pick = lambda d, *names: next((d[n] for n in names if n in d), None)
    rows = [(p, pick(a, "changes") or 0, pick(a, "recentChanges", "recent_changes") or 0, pick(a, "authors") or [], pick(a, "created"), pick(a, "lastChanged", "last_changed"), pick(a, "additions") or 0, pick(a, "deletions") or 0, pick(a, "bugFixChanges", "bug_fix_changes") or 0, pick(a, "refactorChanges", "refactor_changes") or 0, pick(a, "lastBugFix", "last_bug_fix"), bool(pick(a, "generated"))) for p, a in (pick(found, "fileActivity", "file_activity") or {}).items()]
    schema = "path string, changes long, recent_changes long, authors array<string>, created string, last_changed string, additions long, deletions long, bug_fix_changes long, refactor_changes long, last_bug_fix string, generated boolean"
    activity = spark.createDataFrame(rows, schema)
    for c in ("created", "last_changed", "last_bug_fix"):
        activity = activity.withColumn(c, F.try_to_timestamp(c))
    pairs = [(min(a, b), max(a, b), int(pick(n, "cochanges") if isinstance(n, dict) else n)) for a, near in (pick(found, "coupling") or {}).items() for b, n in near.items() if a != b]
    symbols = [(p, role, s["name"], s.get("kind"), int(s.get("line") or 0), int(s.get("complexity") or 0)) for p, own in (pick(found, "symbols") or {}).items() for role, key in (("definition", "definitions"), ("export", "exports")) for s in own.get(key) or []]
    imports = [(p, i["from"], n) for p, own in (pick(found, "symbols") or {}).items() for i in own.get("imports") or [] for n in i.get("names") or [None]]
    artifact.write_tables({"file_activity": activity, "coupling": spark.createDataFrame(pairs, "a string, b string, cochanges long").distinct(), "symbols": spark.createDataFrame(symbols, "path string, role string, name string, kind string, line long, complexity long"), "imports": spark.createDataFrame(imports, "path string, import_from string, name string")}, folder)


@dataclass
class Options:
    top: int = 10
    path: str = ""
    text: str = ""
    files: list[str] = field(default_factory=list)
    min_changes: int = 2
    min_cochanges: int = history.MIN_COCHANGES
    min_jaccard: float = graph.MIN_JACCARD
    community: int | None = None
    depth: int | None = None


def _edges(r: Repo, o: Options) -> DataFrame:
    return graph.cochange_edges(r.coupling, r.file_activity, o.min_jaccard, o.min_cochanges)


def _groups(r: Repo, o: Options) -> DataFrame:
    return graph.communities(_edges(r, o))


def _areas(r: Repo) -> DataFrame:
    return history.areas(r.file_activity, r.contributors, r.deletions, r.renames, r.symbols)


def _files(r: Repo, o: Options) -> DataFrame:
    given = r.listing.sparkSession.createDataFrame([(f,) for f in o.files], "path string")
    return given.select(P.normalize_rel_path(F.col("path")).alias("path")).distinct()


def _asked(r: Repo, o: Options, found: DataFrame) -> DataFrame:
    return found.join(_files(r, o), "path", "left_semi") if o.files else found


def _health(r: Repo, o: Options) -> DataFrame:
    out = graph.community_health(_groups(r, o), r.file_activity, graph.newest_author(r.commits, r.file_changes), r.contributors)
    return out if o.community is None else out.where(F.col("community") == o.community)


def _fixes(r: Repo, o: Options) -> DataFrame:
    found = detectors.source_findings(r.sources).withColumn("line", F.col("start_line"))
    orphans = targets.orphan_exports(r.symbols, graph.import_edges(r.imports), entry_points.entry_points(r.listing, r.sources, r.symbols))
    lines = [orphans.select("path", "line", F.lit("orphan-export").alias("category"), F.concat(F.lit("nothing imports "), "name").alias("reason"), F.lit(0.75).alias("confidence"))]
    lines += [f.withColumn("line", F.lit(None).cast("long")) for f in (targets.tracked_artifacts(r.listing), targets.stale_ci(r.listing), targets.duplicate_tooling(r.listing))]
    stale = detectors.stale_suppressions(detectors.suppressions(r.sources), r.imports)
    found = found.unionByName(stale.withColumn("line", F.col("start_line")))
    for f in lines:
        found = found.unionByName(f.withColumns({"action": F.when(F.col("line").isNull(), "delete").otherwise("review"), "start_line": F.col("line"), "end_line": F.col("line")}))
    left = targets.unsuppressed(found, targets.directives(texts.lines(r.sources))).drop("line")
    return _asked(r, o, left).orderBy("path", "start_line", "category")


def _targets(r: Repo, o: Options) -> DataFrame:
    single = targets.file_targets(r.file_activity, r.contributors, o.top).select(F.lit("file").alias("kind"), F.col("path").alias("area"), "score", "suspect")
    groups = _groups(r, o)
    out = single.unionByName(targets.area_targets(r.symbols, graph.import_edges(r.imports), groups, r.file_activity, o.top)).unionByName(targets.vector_targets(r.vectors, o.top))
    return targets.touching(out, _files(r, o), groups) if o.files else out


def _repo_map(r: Repo, o: Options) -> DataFrame:
    """Definitions, exports and imports by file."""
    own = r.symbols.groupBy("path").agg(F.count_if(F.col("role") == "definition").alias("definitions"), F.count_if(F.col("role") == "export").alias("exports"), F.sum(F.when(F.col("role") == "definition", F.col("complexity"))).alias("complexity"))
    uses = r.imports.groupBy("path").agg(F.count_distinct("import_from").alias("imports"))
    return own.join(uses, "path", "left").select("path", "definitions", "exports", F.coalesce("imports", F.lit(0)).alias("imports"), "complexity").orderBy("path")


QUERIES: dict[str, Callable[[Repo, Options], DataFrame]] = {
    "hotspots": lambda r, o: history.hotspots(r.file_activity, o.top),
    "coldspots": lambda r, o: history.coldspots(r.file_activity, o.top),
    "bugspots": lambda r, o: history.bugspots(r.file_activity, o.top),
    "painspots": lambda r, o: history.painspots(r.file_activity, r.contributors, r.deletions, r.renames, r.symbols, o.top),
    "coupling": lambda r, o: history.coupling(r.coupling, r.file_activity, o.path, o.min_cochanges),
    "ownership": lambda r, o: history.ownership(r.file_authors, r.file_activity, r.contributors, r.last, o.path),
    "bus-factor": lambda r, o: history.critical_owners(r.contributors),
    "at-risk-areas": lambda r, o: history.at_risk_areas(r.file_authors, r.contributors),
    "norms": lambda r, o: history.conventions(r.commits),
    "conventions": lambda r, o: history.conventions(r.commits),
    "areas": lambda r, o: _areas(r).orderBy(F.desc("hotspot_score"), "area"),
    "contributors": lambda r, o: history.contributors(r.contributors, o.top),
    "release-info": lambda r, o: history.release_info(r.commits, r.release_tags),
    "health": lambda r, o: history.health(r.commits, r.contributors),
    "file-history": lambda r, o: history.file_history(r.file_activity, o.path),
    "test-gaps": lambda r, o: history.test_gaps(r.file_activity, r.coupling, o.top, o.min_changes, o.min_cochanges),
    "diff-risk": lambda r, o: history.diff_risk(r.listing.sparkSession.createDataFrame([(f,) for f in o.files], "path string"), r.file_activity),
    "doc-drift": lambda r, o: history.doc_drift(r.file_activity, r.coupling, o.top, o.min_cochanges),
    "onboard": lambda r, o: rollups.onboard_answer(r.file_activity, r.commits, r.contributors, r.listing, _areas(r), rollups.folders(r.listing), o.top),
    "key-areas": lambda r, o: rollups.key_areas(_areas(r), top=o.top),
    "pain-points": lambda r, o: rollups.pain_points(_areas(r), r.contributors, o.top),
    "can-i-help": lambda r, o: rollups.can_i_help_answer(_areas(r), r.commits, r.contributors, rollups.folders(r.listing)),
    "good-first-areas": lambda r, o: rollups.good_first_areas(_areas(r)),
    "needs-help": lambda r, o: rollups.needs_help(_areas(r)),
    "recent-activity": lambda r, o: rollups.recent_activity(r.commits, r.contributors),
    "symbols": lambda r, o: graph.symbols_of(r.symbols, r.imports, o.path),
    "dependents": lambda r, o: graph.dependents(r.symbols, r.imports, o.text, o.path or None),
    "find": lambda r, o: texts.find(r.symbols, r.imports, o.text, o.top, parsing.doc_headers(r.sources), r.descriptors),
    "stale-docs": lambda r, o: texts.stale_docs(texts.code_references(r.docs), r.symbols, r.file_activity, o.top),
    "project-info": lambda r, o: texts.project_info(r.listing, r.sources),
    "entry-points": lambda r, o: _asked(r, o, entry_points.entry_points(r.listing, r.sources, r.symbols)),
    "communities": lambda r, o: graph.community_list(_groups(r, o)),
    "boundaries": lambda r, o: graph.boundaries(graph.betweenness(_edges(r, o)), _groups(r, o), o.top),
    "area-of": lambda r, o: graph.area_of(_groups(r, o), o.path),
    "community-health": _health,
    "summary": lambda r, o: rollups.summary(r.summaries, o.depth),
    "test-conventions": lambda r, o: parsing.test_conventions(r.symbols, r.imports),
    "repo-map": _repo_map,
    "languages": lambda r, o: texts.languages(r.listing),
    "sync-check": lambda r, o: texts.stale_docs(texts.code_references(r.docs), r.symbols, r.file_activity, o.top),
    "slop-fixes": _fixes,
    "slop-targets": _targets,
    "duplicates": lambda r, o: vectors.semantic_duplicates(r.vectors, o.top),
}


def query(repo: Repo, name: str, options: Options | None = None) -> DataFrame:
    """A named query over the tables of ``load``."""
    return QUERIES[name](repo, options or Options())
