"""Guidance for newcomers and helpers (A14, A22, F13 and the onboard and can-i-help queries), a section a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions import predicates as P
from gneiss.operators import history as H

_TIERS = {
    1: "api app apps bin cmd commands components controllers core crates handlers internal lib middleware models modules packages pkg plugins routes server services src views",
    3: "__tests__ benchmark benchmarks doc docs documentation e2e example examples fixtures fuzz fuzzer integration spec specs test testdata tests",
    4: "assets build coverage dist images imgs public reports results static",
}
_PURPOSES = {
    "source code": "src", "library code": "lib", "public packages": "pkg", "internal packages (not exported)": "internal", "workspace crates": "crates", "test suite": "__tests__ spec specs test tests",
    "documentation": "doc docs documentation", "usage examples": "example examples", "benchmarks": "bench benches benchmark benchmarks", "command-line interface": "cli cmd commands", "build and helper scripts": "script scripts tools",
    "HTTP interface": "api routes server", "user interface components": "components ui views", "data models": "entities models schema schemas", "business services": "services", "configuration": "conf config configs",
    "static files": "assets public static", "extensions": "extensions plugins", "shared helpers": "common helpers shared util utils", "database migrations": "migrations", "test data": "fixtures testdata", "request handling": "controllers handlers middleware",
}
_NAMES = {leaf: text for text, leaves in _PURPOSES.items() for leaf in leaves.split()}
#: Extensions that tell nothing of the language of a repository's code.
_NO_CODE = "csv gitignore ico jpg json lock md png svg toml txt yaml yml".split()
_LANGUAGES = {"c": "c h", "c#": "cs", "c++": "cc cpp cxx hpp", "css": "css less scss", "go": "go", "html": "htm html", "java": "java", "javascript": "cjs js jsx mjs", "kotlin": "kt kts", "php": "php", "python": "py", "ruby": "rb", "rust": "rs", "shell": "bash sh", "swift": "swift", "typescript": "ts tsx"}
LANGUAGE = {e: name for name, all_of in _LANGUAGES.items() for e in all_of.split()}


def _leaf(area: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(area, "/+$", ""), r"([^/]*)$", 1)


def is_generated_dir(area: Column) -> Column:
    """F13."""
    low = F.lower(area)
    return F.lower(_leaf(area)).isin("__snapshots__", "coverage", "reports", "results", "snapshots") | (low.contains("benchmark") & low.contains("results"))


def area_tier(area: Column) -> Column:
    """0 for the root, 1 for source, 2 for others, 3 for tests and documents, 4 for made files."""
    leaf = F.lower(_leaf(area))
    tier = F.when(leaf == ".", 0)
    for rank, names in _TIERS.items():
        tier = tier.when(leaf.isin(names.split()), rank)
    return tier.otherwise(2)


def area_purpose(area: Column) -> Column:
    """what a directory is for, by its name."""
    leaf = _leaf(area)
    found = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    return F.when(leaf == ".", "project root").otherwise(F.coalesce(F.try_element_at(found, F.lower(leaf)), F.concat(leaf, F.lit(" module"))))


def key_areas(areas: DataFrame, existing: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(path, purpose, files, hotspot_score) of the directories to read first; ``existing`` (path) limits them."""
    area = F.col("area")
    hidden = (area.startswith(".") & (area != "./")) | area.contains("/.") | area.startswith("adapters/")
    rows = areas.where(~hidden & (F.col("files") >= 2) & ~is_generated_dir(area))
    if existing is not None:
        rows = rows.join(existing.select(F.col("path").alias("area")), "area", "left_semi")
    out = rows.select(area.alias("path"), area_purpose(area).alias("purpose"), "files", "hotspot_score", area_tier(area).alias("tier"))
    return out.orderBy("tier", F.desc("hotspot_score"), "path").limit(top).drop("tier")


def pain_points(areas: DataFrame, contributors: DataFrame, top: int = 10) -> DataFrame:
    """(path, reason); a directory without an owner isn't stale here."""
    solo = F.broadcast(contributors.where("not is_bot").agg((F.count(F.lit(1)) <= 1).alias("solo")))
    rows = areas.crossJoin(solo).where("files >= 2 and bug_fix_rate >= 0.3")
    stale, single, very = F.col("owner_stale") & F.col("owners").isNotNull(), ~F.col("solo") & (F.coalesce("n_owners", F.lit(0)) <= 1), F.col("bug_fix_rate") >= 0.5
    reason = F.concat_ws(", ", F.when(very, "very high bug-fix rate").otherwise("high bug-fix rate"), F.when(stale, "primary owner inactive"), F.when(single, "single owner"))
    out = rows.where(stale | single | very).select(F.col("area").alias("path"), reason.alias("reason"), very.alias("very"), "hotspot_score")
    return out.orderBy(F.desc("very"), F.desc("hotspot_score"), "path").limit(top).select("path", "reason")


def good_first_areas(areas: DataFrame) -> DataFrame:
    """(path, reason, files, hotspot_score) of calm directories with an active owner, else of documents and examples."""
    calm = areas.where(~F.col("owner_stale") & (F.col("hotspot_score") < 1.5) & (F.col("bug_fix_rate") < 0.3) & ~is_generated_dir(F.col("area")))
    reason = F.concat_ws(", ", F.when(F.col("hotspot_score") < 1, "low churn"), F.lit("low bug rate"), F.lit("active maintainer for review"))
    good = calm.select(F.col("area").alias("path"), reason.alias("reason"), "files", "hotspot_score")
    count = F.broadcast(good.agg(F.count(F.lit(1)).alias("found")))
    other = areas.where(F.lower(_leaf(F.col("area"))).isin("contrib", "doc", "docs", "example", "examples", "site") & ~is_generated_dir(F.col("area"))).crossJoin(count).where("found = 0")
    return good.unionByName(other.select(F.col("area").alias("path"), F.lit("documentation or examples - approachable for newcomers").alias("reason"), "files", "hotspot_score"))


def needs_help(areas: DataFrame) -> DataFrame:
    """(path, reason, bug_fix_rate, owner_stale) of directories with an inactive owner or many fixes."""
    stale, buggy = F.col("owner_stale") & F.col("owners").isNotNull(), F.col("bug_fix_rate") >= 0.3
    reason = F.concat_ws(", ", F.when(buggy, "high bug-fix rate"), F.when(stale, "primary owner inactive"))
    return areas.where((stale | buggy) & ~is_generated_dir(F.col("area"))).select(F.col("area").alias("path"), reason.alias("reason"), "bug_fix_rate", stale.alias("owner_stale"))


def primary_language(activity: DataFrame) -> DataFrame:
    """One row: the language of the commonest extension of code files, an unknown one by itself; unknown without any."""
    by = activity.select(P.extension(F.col("path")).alias("e")).where((F.col("e") != "") & ~F.col("e").isin(_NO_CODE)).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    named = F.create_map(*[F.lit(x) for pair in LANGUAGE.items() for x in pair])
    best = F.min_by("e", F.struct(-F.col("n"), "e"))
    return by.agg(best.alias("e")).select(F.coalesce(F.try_element_at(named, F.col("e")), F.col("e"), F.lit("unknown")).alias("language"))


_STRUCTURES = [("workspace crates", r"^crates/"), ("plugins", r"^plugins/"), ("Go layout", r"^(?:cmd|internal|pkg)/"), ("packages", r"^packages/"), ("Maven", r"^src/main/java/"), ("src and lib", ""), ("src", r"^src/"), ("lib", r"^lib/")]


def structure(activity: DataFrame) -> DataFrame:
    """One row: the first layout of the list that the paths show, else flat."""
    here = {name: F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False)) for name, p in _STRUCTURES if p}
    found = F.when(F.lit(False), "")
    for name, p in _STRUCTURES:
        found = found.when(here[name] if p else here["src"] & here["lib"], name)
    return activity.agg(found.otherwise("flat").alias("structure"))


_COMMANDS = [("Cargo.toml", "cargo build", "cargo test"), ("package.json", "npm install", "npm test"), ("go.mod", "go build ./...", "go test ./..."), ("pyproject.toml", "pip install -e .", "pytest"), ("pom.xml", "mvn package", "mvn test"), ("build.gradle", "gradle build", "gradle test"), ("Makefile", "make", "make test")]


def commands(files: DataFrame) -> DataFrame:
    """One row (build, test) by the first manifest at the root; without one, see the readme."""
    rank = F.when(F.lit(False), -1)
    for i, (name, _, _) in enumerate(_COMMANDS):
        rank = rank.when(F.col("path") == name, i)
    first = F.min(rank)
    pick = lambda at: F.coalesce(F.element_at(F.array(*(F.lit(c[at]) for c in _COMMANDS)), F.col("first") + 1), F.lit("see README"))
    return files.agg(first.alias("first")).select(pick(1).alias("build"), pick(2).alias("test"))


def health_label(commits: DataFrame, contributors: DataFrame) -> DataFrame:
    """One row (health, bus_factor, contributors, total_commits)."""
    people = contributors.where("not is_bot").agg(F.count(F.lit(1)).alias("contributors"))
    rows = H.bus_factor(contributors).crossJoin(people).crossJoin(commits.agg(F.count(F.lit(1)).alias("total_commits")))
    n, b, c = F.col("contributors"), F.col("bus_factor"), F.col("total_commits")
    label = F.when(c == 0, "inactive").when((n <= 1) & (c > 100), "active").when(n <= 1, "early-stage").when(b >= 3, "healthy").when(b >= 2, "moderate").otherwise("at-risk")
    return rows.select(label.alias("health"), "bus_factor", "contributors", "total_commits")


def onboard(activity: DataFrame, commits: DataFrame, contributors: DataFrame, files: DataFrame) -> DataFrame:
    """One row of the scalar parts; total_symbols is 0 always (Q14)."""
    total = activity.agg(F.count(F.lit(1)).alias("total_files"), F.lit(0).cast("long").alias("total_symbols"))
    style = H.conventions(commits).agg(F.max("style").alias("commit_style"), F.bool_or("uses_scopes").alias("uses_scopes"))
    return primary_language(activity).crossJoin(structure(activity)).crossJoin(total).crossJoin(health_label(commits, contributors)).crossJoin(style).crossJoin(commands(files))


def _scalars(row: DataFrame, section: str) -> DataFrame:
    """Each column of one row as a row of an answer."""
    each = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(c).cast("string").alias("text")) for i, c in enumerate(row.columns)))
    out = row.select(F.explode(each).alias("s")).select(F.lit(section).alias("section"), "s.*")
    return out.select("section", "position", "name", "text", F.lit(None).cast("long").alias("files"), F.lit(None).cast("double").alias("score"))


def _ranked(rows: DataFrame, section: str, text: str, order: list[Column], files: str | None = None, score: str | None = None) -> DataFrame:
    """The rows of a section of an answer, numbered."""
    position = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.select(F.lit(section).alias("section"), position.alias("position"), F.col("path").alias("name"), F.col(text).alias("text"), (F.col(files) if files else F.lit(None)).cast("long").alias("files"), (F.col(score) if score else F.lit(None)).cast("double").alias("score"))


def onboard_answer(activity: DataFrame, commits: DataFrame, contributors: DataFrame, files: DataFrame, areas: DataFrame, existing: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(section, position, name, text, files, score): the overview, conventions, key areas, pain points and how to start."""
    row = onboard(activity, commits, contributors, files)
    overview = _scalars(row.select("language", "structure", "total_files", "total_symbols", "bus_factor", "health"), "overview")
    style, start = _scalars(row.select("commit_style", "uses_scopes"), "conventions"), _scalars(row.select("build", "test"), "getting-started")
    # both lists are cut before they are numbered
    keys = _ranked(key_areas(areas, existing, top).withColumn("tier", area_tier(F.col("path"))), "key-areas", "purpose", [F.col("tier"), F.desc("hotspot_score"), F.col("path")], "files", "hotspot_score")
    pains = pain_points(areas, contributors, top).join(areas.select(F.col("area").alias("path"), "hotspot_score"), "path")
    pains = _ranked(pains, "pain-points", "reason", [F.desc(F.col("reason").startswith("very high")), F.desc("hotspot_score"), F.col("path")])
    return overview.unionByName(style).unionByName(keys).unionByName(pains).unionByName(start)


def can_i_help_answer(areas: DataFrame, commits: DataFrame, contributors: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(section, position, name, text, files, score): conventions, first areas, areas that need help, recent activity.

    Areas aren't numbered, as there can be many; their score is the hotspot score, or the rate of fixes where they need help.
    """
    style = H.conventions(commits).agg(F.max("style").alias("commit_style"), F.bool_or("uses_scopes").alias("uses_scopes"))
    if existing is not None:
        areas = areas.join(existing.select(F.col("path").alias("area")), "area", "left_semi")
    none = F.lit(None).cast("int").alias("position")
    first = good_first_areas(areas).select(F.lit("good-first-areas").alias("section"), none, F.col("path").alias("name"), F.col("reason").alias("text"), F.col("files").cast("long").alias("files"), F.col("hotspot_score").cast("double").alias("score"))
    help_ = needs_help(areas).select(F.lit("needs-help").alias("section"), none, F.col("path").alias("name"), F.col("reason").alias("text"), F.lit(None).cast("long").alias("files"), F.col("bug_fix_rate").cast("double").alias("score"))
    return _scalars(style, "conventions").unionByName(first).unionByName(help_).unionByName(_scalars(recent_activity(commits, contributors), "recent-activity"))


def folders(files: DataFrame) -> DataFrame:
    """(path) of every folder of the listed files, with a slash at its end, the root as ``./``."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    deep = files.where(F.col("path").contains("/")).select(F.explode(above).alias("path"))
    return deep.distinct().unionByName(files.select(F.lit("./").alias("path")).limit(1))


def recent_activity(commits: DataFrame, contributors: DataFrame) -> DataFrame:
    """One row (active_contributors, total_commits, bus_factor)."""
    active = contributors.where(~F.col("is_bot") & ~P.is_stale(F.col("last_seen"), F.col("last"))).agg(F.count(F.lit(1)).alias("active_contributors"))
    return active.crossJoin(commits.agg(F.count(F.lit(1)).alias("total_commits"))).crossJoin(H.bus_factor(contributors))


def summary(table: DataFrame, depth: int | None = None) -> DataFrame:
    """The stored text of a depth (1, 3 or 10), or of all, of a one-row table (depth1, depth3, depth10)."""
    if depth not in (None, 1, 3, 10):
        raise ValueError("depth is 1, 3 or 10")
    wanted = [1, 3, 10] if depth is None else [depth]
    return table.select(F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.col(f"depth{d}").alias("text")) for d in wanted))).alias("s")).select("s.depth", "s.text").where("text is not null")
