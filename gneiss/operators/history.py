"""Aggregates and queries over commits and file changes (A1-A11, J1-J11, A20-A22 and the history queries of 2.8).

Sorted results get a total order: ties go by path or name.  One-row frames, such as the last commit's time, are
broadcast whatever the data, as their size is fixed; all other joins are left to the optimizer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions import predicates as P
from gneiss.session import written

MIN_COCHANGES = 3
LARGE_REPO_FILES = 10_000
#: Changes that a task pairs, on average; it holds them and their pairs.
ROWS_A_TASK = 250_000
#: Rows of a repeated file that are made at a time.
REPEATED = 4096


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(0.0)


def _last(commits: DataFrame) -> DataFrame:
    return F.broadcast(commits.agg(F.max("ts").alias("last")))


def _touched(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    return file_changes.where(~P.is_noise(F.col("path"))).join(commits, "hash")


def contributor_stats(commits: DataFrame) -> DataFrame:
    """A1 and A3: (name, is_bot, commits, recent_commits, first_seen, last_seen, last) by author."""
    recent = F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {P.RECENT_DAYS} DAYS")
    out = commits.crossJoin(_last(commits)).groupBy(F.col("author_name").alias("name")).agg(F.count(F.lit(1)).alias("commits"), F.count_if(recent).alias("recent_commits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("last").alias("last"))
    return out.withColumn("is_bot", P.is_bot(F.col("name")))


def file_activity(commits: DataFrame, file_changes: DataFrame, newest: bool = False) -> DataFrame:
    """A2 and A3: one row a file that isn't noise; fixes don't count in generated files, and an unknown author comes last.

    ``newest`` adds the author of the newest change (Q20), which takes no pass of its own then.
    """
    subject = F.col("subject")
    recent = F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {P.RECENT_DAYS} DAYS")
    marked = commits.select("hash", "ts", "author_name", P.is_bug_fix(subject).alias("fix"), F.coalesce(P.conventional_prefix(subject) == "refactor", F.lit(False)).alias("refactor"))
    rows = _touched(marked, file_changes).crossJoin(_last(commits))
    by = (
        rows.groupBy("path")
        .agg(
            F.count(F.lit(1)).alias("changes"),
            F.count_if(recent).alias("recent_changes"),
            F.array_sort(F.collect_set("author_name")).alias("authors"),
            F.bool_or(F.col("author_name").isNull()).alias("unnamed"),
            F.min("ts").alias("created"),
            F.max("ts").alias("last_changed"),
            F.sum("additions").alias("additions"),
            F.sum("deletions").alias("deletions"),
            F.count_if("fix").alias("bug_fix_changes"),
            F.count_if("refactor").alias("refactor_changes"),
            F.max(F.when(F.col("fix"), F.col("ts"))).alias("last_bug_fix"),
            *([F.max_by("author_name", F.struct("ts", "hash")).alias("newest_author")] if newest else []),
        )
        .withColumn("generated", P.is_generated(F.col("path")))  # once a file rather than once a change
    )
    nobody = F.array(F.lit(None).cast("string"))
    by = by.withColumn("authors", F.when(F.col("unnamed"), F.concat("authors", nobody)).otherwise(F.col("authors"))).drop("unnamed")
    by = by.withColumn("bug_fix_changes", F.when(F.col("generated"), 0).otherwise(F.col("bug_fix_changes")).cast("long"))
    return by.withColumn("last_bug_fix", F.when(~F.col("generated"), F.col("last_bug_fix")))


def file_authors(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """(path, author, changes): each author is credited with all changes of the file (Q4)."""
    rows = _touched(commits.select("hash", F.col("author_name").alias("author")), file_changes)
    each = rows.groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"))
    return each.select("path", "author", F.sum("n").over(Window.partitionBy("path")).alias("changes"))


def coupling_counts(file_changes: DataFrame, max_files_per_commit: int | None = None, least: int = 1, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(a, b, cochanges) of pairs of files changed together at least ``least`` times, a < b.

    The pairs of a commit are quadratic in its files, so files that changed fewer times are left out before they are
    paired.  ``max_files_per_commit`` leaves larger commits out, and is off unless asked for.  Files are numbered for
    that, and their numbers written, so that pairs are of two numbers; a task pairs ``rows_a_task`` changes on average.
    """
    rows = file_changes.where(~P.is_noise(F.col("path"))).select("hash", "path")
    names = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    names = written(names.withColumn("id", F.monotonically_increasing_id()), "paths")
    tasks = max(1, math.ceil((names.agg(F.sum("n")).first()[0] or 0) / rows_a_task))
    rows = rows.join(names.select("path", "id"), "path").select("hash", "id")
    if max_files_per_commit is not None:
        rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("hash"))).where(F.col("n") <= max_files_per_commit).drop("n")
    rows = rows.repartition(tasks, "hash")
    left, right = rows.withColumnRenamed("id", "i"), rows.withColumnRenamed("id", "j")
    # few pairs repeat within a task, so they are counted after the shuffle only
    pairs = left.join(right, "hash").where("i < j").select("i", "j").repartition(tasks, "i", "j")
    pairs = pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("cochanges")).where(F.col("cochanges") >= least)
    pairs = pairs.join(names.select(F.col("id").alias("i"), F.col("path").alias("p")), "i").join(names.select(F.col("id").alias("j"), F.col("path").alias("q")), "j")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "cochanges")


def both_ways(coupling: DataFrame, min_cochanges: int = MIN_COCHANGES) -> DataFrame:
    """(path, other, cochanges) of the pairs that are kept, in both directions."""
    kept = coupling.where(F.col("cochanges") >= min_cochanges)
    return kept.select(F.col("a").alias("path"), F.col("b").alias("other"), "cochanges").unionByName(kept.select(F.col("b").alias("path"), F.col("a").alias("other"), "cochanges"))


def hotspots(activity: DataFrame, top: int = 10) -> DataFrame:
    score = P.hotspot_score(F.col("recent_changes"), F.col("changes"))
    out = activity.select("path", "changes", "recent_changes", F.round(score, 6).alias("score"), F.concat_ws(",", "authors").alias("authors"), F.col("bug_fix_changes").alias("bug_fixes"))
    return out.orderBy(F.desc("score"), "path").limit(top)


def coldspots(activity: DataFrame, top: int = 10) -> DataFrame:
    """Oldest last change first; nothing is filtered (Q11)."""
    return activity.select("path", "last_changed").orderBy("last_changed", "path").limit(top)


def bugspots(activity: DataFrame, top: int = 10) -> DataFrame:
    rows = activity.where("bug_fix_changes > 0 and changes > 0")
    rate = F.round(_rate("bug_fix_changes", "changes"), 6).alias("bug_fix_rate")
    out = rows.select("path", rate, F.col("changes").alias("total_changes"), F.col("bug_fix_changes").alias("bug_fixes"), "last_bug_fix")
    return out.orderBy(F.desc("bug_fix_rate"), "path").limit(top)


def coupling(coupling_table: DataFrame, activity: DataFrame, path: str, min_cochanges: int = MIN_COCHANGES) -> DataFrame:
    """Files changed together with one; strength is of the asked file's changes, of which an unknown file has 1."""
    pairs = both_ways(coupling_table, min_cochanges).where(F.col("path") == path)
    known = pairs.join(activity.where(F.col("path") == path).select("path", "changes"), "path", "left")
    strength = F.col("cochanges").cast("double") / F.coalesce("changes", F.lit(1))
    return known.select(F.col("other").alias("path"), F.round(strength, 6).alias("strength"), "cochanges").orderBy(F.desc("cochanges"), "path")


def _with_staleness(owners: DataFrame, contributors: DataFrame, last: DataFrame, author: str = "author") -> DataFrame:
    """Add last_active and stale."""
    seen = contributors.select(F.col("name").alias(author), F.col("last_seen").alias("last_active"))
    return owners.join(seen, author, "left").crossJoin(F.broadcast(last)).withColumn("stale", P.is_stale(F.col("last_active"), F.col("last")))


def ownership(authors: DataFrame, activity: DataFrame, contributors: DataFrame, last: DataFrame, prefix: str) -> DataFrame:
    """(path, author, commits, pct, last_active, stale, is_primary, bus_factor_risk) under a raw path prefix (Q5)."""
    rows = authors.where(F.col("path").startswith(prefix)).groupBy("author").agg(F.sum("changes").alias("commits"))
    total = activity.where(F.col("path").startswith(prefix)).agg(F.sum("changes").alias("total"))
    rows = _with_staleness(rows, contributors, last).crossJoin(F.broadcast(total))
    everyone = Window.partitionBy(F.lit(0))
    # authors under a prefix are few; one task ranks them
    rank = F.row_number().over(everyone.orderBy(F.desc("commits"), "author"))
    risk = F.count_if(~F.col("stale")).over(everyone) <= 1
    return rows.select(F.lit(prefix).alias("path"), "author", "commits", F.round(F.col("commits").cast("double") / F.col("total") * 100, 6).alias("pct"), "last_active", "stale", (rank == 1).alias("is_primary"), risk.alias("bus_factor_risk"))


def critical_owners(contributors: DataFrame) -> DataFrame:
    """Humans by commits until four fifths of all are covered; coverage adds up (Q8)."""
    humans = contributors.where("not is_bot")
    # added up by number of commits first, of which there are few; only authors of the numbers that count are ranked
    by = humans.groupBy("commits").agg(F.sum("commits").alias("own"))
    more = Window.orderBy(F.desc("commits")).rowsBetween(Window.unboundedPreceding, -1)
    by = by.select("commits", F.coalesce(F.sum("own").over(more), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy(F.lit(0))).alias("total")).where("before < 0.8 * total")
    rank = F.row_number().over(Window.partitionBy("commits").orderBy("name"))
    rows = humans.join(by, "commits").withColumn("upto", F.col("before") + F.col("commits") * rank).where("(upto - commits) < 0.8 * total")
    return rows.select("name", "commits", F.round(F.col("upto").cast("double") / F.col("total") * 100, 6).alias("coverage"), "last_seen", P.is_stale(F.col("last_seen"), F.col("last")).alias("stale"))


def bus_factor(contributors: DataFrame) -> DataFrame:
    return critical_owners(contributors).agg(F.count(F.lit(1)).alias("bus_factor"))


def at_risk_areas(authors: DataFrame, contributors: DataFrame) -> DataFrame:
    """Directories whose largest contributor is a stale human."""
    by = authors.groupBy(P.file_dir(F.col("path")).alias("area"), "author").agg(F.sum("changes").alias("n"))
    top = by.groupBy("area").agg(F.min(F.struct(-F.col("n"), "author")).alias("top")).select("area", F.col("top.author").alias("name"))
    stale = contributors.where(~F.col("is_bot") & P.is_stale(F.col("last_seen"), F.col("last"))).select("name")
    return top.join(stale, "name", "left_semi").select("area")


def conventions(commits: DataFrame) -> DataFrame:
    """A5: (style, uses_scopes, prefix, n); a history without prefixes has one row with nulls."""
    marked = commits.select(P.conventional_prefix(F.col("subject")).alias("prefix"), (F.col("subject").contains("(") & F.col("subject").contains(")")).alias("scoped"))
    counts = marked.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.bool_or("scoped").alias("scoped"))
    everything = Window.partitionBy(F.lit(0))  # as many rows as there are prefixes
    prefixed = F.sum(F.when(F.col("prefix").isNotNull(), F.col("n")).otherwise(0)).over(everything)
    ratio = prefixed / F.sum("n").over(everything)
    style = F.when(prefixed == 0, "unknown").when(ratio > 0.5, "conventional").otherwise("mixed")
    out = counts.select(style.alias("style"), F.bool_or("scoped").over(everything).alias("uses_scopes"), "prefix", F.when(F.col("prefix").isNotNull(), F.col("n")).alias("n"))
    return out.where("prefix is not null or style = 'unknown'")


def contributors(stats: DataFrame, top: int = 20) -> DataFrame:
    humans = stats.where("not is_bot")
    total = F.broadcast(humans.agg(F.sum("commits").alias("total")))
    out = humans.crossJoin(total).select("name", "commits", F.round(F.col("commits").cast("double") / F.col("total") * 100, 6).alias("pct"), F.col("recent_commits").alias("recent_activity"), P.is_stale(F.col("last_seen"), F.col("last")).alias("stale"))
    return out.orderBy(F.desc("commits"), "name").limit(top)


def release_info(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """(cadence, last_release, unreleased, tags): an empty tag table leaves all commits unreleased (Q13)."""
    last = F.broadcast(tags.agg(F.max(F.struct("ts", "tag")).alias("t"), F.count(F.lit(1)).alias("tags")))
    since = F.col("t.ts").isNull() | (F.col("ts") > F.col("t.ts"))
    return commits.crossJoin(last).agg(F.lit("unknown").alias("cadence"), F.max("t.tag").alias("last_release"), F.count_if(since).alias("unreleased"), F.max("tags").alias("tags"))


def health(commits: DataFrame, stats: DataFrame) -> DataFrame:
    totals = commits.agg(F.count(F.lit(1)).alias("n"))
    return totals.crossJoin(bus_factor(stats)).select((F.col("n") > 0).alias("active"), "bus_factor", F.col("n").cast("double").alias("commit_frequency"))


def file_history(activity: DataFrame, path: str) -> DataFrame:
    return activity.where(F.col("path") == path).withColumn("authors", F.concat_ws(",", "authors"))


def test_gaps(activity: DataFrame, coupling_table: DataFrame, top: int = 10, min_changes: int = 2, min_cochanges: int = MIN_COCHANGES) -> DataFrame:
    """Often changed files that no test file changes with."""
    tested = both_ways(coupling_table, min_cochanges).where(P.is_test_file(F.col("other"))).select("path")
    rows = activity.where((F.col("changes") >= min_changes) & ~P.is_test_file(F.col("path"))).join(tested, "path", "left_anti")
    out = rows.select("path", "changes", "recent_changes", F.col("bug_fix_changes").alias("bug_fixes"), F.concat_ws(",", "authors").alias("authors"))
    return out.orderBy(F.desc("changes"), "path").limit(top)


def diff_risk(files: DataFrame, activity: DataFrame) -> DataFrame:
    """Risk of each file of a list (path); repeated and unknown ones stay.

    A repeated file is looked up and sorted once, with its number, and repeated after that, some rows at a time.
    """
    listed = files.groupBy("path").agg(F.count(F.lit(1)).alias("times"))
    known = listed.join(activity.withColumn("known", F.lit(True)), "path", "left")
    humans = F.size(F.filter("authors", lambda a: ~P.is_bot(a)))
    rate = _rate("bug_fix_changes", "changes")
    there = F.coalesce("known", F.lit(False))
    out = known.select(
        "path",
        F.round(F.when(there, P.risk_score(rate, humans)).otherwise(0.5), 6).alias("risk_score"),
        F.round(F.when(there, rate).otherwise(0.0), 6).alias("bug_fix_rate"),
        F.coalesce(F.col("additions") + F.col("deletions"), F.lit(0)).alias("churn"),
        F.when(there, humans).otherwise(0).cast("long").alias("author_count"),
        there.alias("known"),
        "times",
    )
    ordered = out.repartition("path").orderBy(F.desc("risk_score"), "path")  # sorting reads its input twice, so that is shuffled first
    some = ordered.withColumn("left", F.explode(F.sequence("times", F.lit(1), F.lit(-REPEATED))))
    return some.withColumn("time", F.explode(F.sequence(F.lit(1), F.least("left", F.lit(REPEATED))))).drop("times", "left", "time")


def doc_drift(activity: DataFrame, coupling_table: DataFrame, top: int = 10, min_cochanges: int = MIN_COCHANGES) -> DataFrame:
    """Markdown files that change least together with code."""
    code = both_ways(coupling_table, min_cochanges).where(F.col("path").endswith(".md") & ~F.col("other").endswith(".md")).groupBy("path").agg(F.sum("cochanges").alias("c"))
    out = activity.where(F.col("path").endswith(".md")).join(code, "path", "left").select("path", F.coalesce("c", F.lit(0)).alias("code_coupling"), "last_changed", "changes")
    return out.orderBy("code_coupling", "path").limit(top)


def surviving(activity: DataFrame, deletions: DataFrame, renames: DataFrame) -> DataFrame:
    """Files neither deleted nor renamed away."""
    gone = deletions.select("path").unionByName(renames.select(F.col("old_path").alias("path")))
    return activity.join(gone, "path", "left_anti")


def _by_area(files: DataFrame) -> DataFrame:
    """(area, own, author, commits, files, fixes, hotspot_score): sums of each directory, and after it of each of its authors.

    Both come out of one pass over the files, each of which is credited to all its authors (Q4); ``own`` marks the directory's.
    """
    score = P.hotspot_score(F.col("recent_changes"), F.col("changes"))
    rows = files.select(P.file_dir(F.col("path")).alias("area"), "changes", "bug_fix_changes", score.alias("score"), F.concat(F.array(F.lit(None).cast("string")), "authors").alias("who"))
    each = rows.select("area", "changes", "bug_fix_changes", "score", F.posexplode("who").alias("at", "author"))
    return each.groupBy("area", (F.col("at") == 0).alias("own"), "author").agg(F.sum("changes").alias("commits"), F.count(F.lit(1)).alias("files"), F.sum("bug_fix_changes").alias("fixes"), F.max("score").alias("hotspot_score"))


def _marked_stale(by: DataFrame, contributors: DataFrame) -> DataFrame:
    stale = contributors.select(F.col("name").alias("author"), P.is_stale(F.col("last_seen"), F.col("last")).alias("stale"))
    return by.join(stale, "author", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


def area_owners(files: DataFrame, contributors: DataFrame) -> DataFrame:
    """(area, author, commits, pct, stale, rank) of the authors of each directory."""
    by, area = _by_area(files), Window.partitionBy("area")
    rank = F.row_number().over(area.orderBy(F.desc("own"), F.desc("commits"), F.asc_nulls_last("author"))) - 1
    rows = by.withColumns({"rank": rank, "total": F.max(F.when(F.col("own"), F.col("commits"))).over(area)}).where("not own")
    pct = F.round(F.col("commits").cast("double") / F.col("total") * 100, 6).alias("pct")
    return _marked_stale(rows, contributors).select("area", "author", "commits", pct, "stale", "rank")


def areas(activity: DataFrame, contributors: DataFrame, deletions: DataFrame, renames: DataFrame, symbols: DataFrame, active_only: bool = False, large: int = LARGE_REPO_FILES) -> DataFrame:
    """One row a directory; the files are read once, and sides are aggregated before they are joined."""
    files = surviving(activity, deletions, renames)
    if active_only:
        count = F.broadcast(activity.agg(F.count(F.lit(1)).alias("all_files")))
        files = files.crossJoin(count).where((F.col("all_files") <= large) | (F.col("recent_changes") > 0)).drop("all_files")
    area = P.file_dir(F.col("path")).alias("area")
    defined = symbols.where("role = 'definition'").groupBy(area).agg(F.count(F.lit(1)).alias("total_symbols"), F.percentile(F.when(F.col("complexity") > 0, F.col("complexity")), 0.5).alias("median"), F.max(F.when(F.col("complexity") > 0, F.col("complexity"))).alias("most"))
    own = {name: F.max(F.when(F.col("own"), F.col(of))).alias(name) for name, of in (("files", "files"), ("changes", "commits"), ("fixes", "fixes"), ("hotspot_score", "hotspot_score"))}
    author = F.struct((-F.col("commits")).alias("order"), F.col("author").isNull().alias("unknown"), "author", "stale")
    stats = _marked_stale(_by_area(files), contributors).groupBy("area").agg(*own.values(), F.array_sort(F.collect_list(F.when(~F.col("own"), author))).alias("ranked"))
    names = F.array_join(F.transform("ranked", lambda o: o["author"]), ",")
    some = F.size("ranked") > 0
    stats = stats.select("area", *own, F.when(some, names).alias("owners"), F.when(some, F.size("ranked").cast("long")).alias("n_owners"), F.try_element_at("ranked", F.lit(1))["stale"].alias("stale"))
    rate = _rate("fixes", "changes")
    stale = F.coalesce("stale", F.lit(True))
    state = F.when(stale & (rate >= 0.3), "at-risk").when(stale | (rate >= 0.3), "needs-attention").otherwise("healthy")
    joined = stats.join(defined, "area", "left")
    return joined.select("area", "files", F.coalesce("total_symbols", F.lit(0)).alias("total_symbols"), "owners", "n_owners", stale.alias("owner_stale"), F.round("hotspot_score", 6).alias("hotspot_score"), F.round(rate, 6).alias("bug_fix_rate"), F.round(F.coalesce("median", F.lit(0.0)), 6).alias("complexity_median"), F.coalesce("most", F.lit(0)).alias("complexity_max"), state.alias("health"))


def painspots(activity: DataFrame, contributors: DataFrame, deletions: DataFrame, renames: DataFrame, symbols: DataFrame, top: int = 10) -> DataFrame:
    """J5, J7, F15; the owner asked for staleness is the first by name (Q6)."""
    files = surviving(activity, deletions, renames)
    complexity = symbols.where("role = 'definition'").groupBy("path").agg(F.max("complexity").alias("c"))
    stale = contributors.where("not is_bot").select(F.col("name").alias("owner"), P.is_stale(F.col("last_seen"), F.col("last")).alias("s"))
    rows = files.join(complexity, "path", "left").withColumn("owner", F.element_at("authors", 1)).join(stale, "owner", "left")
    hotspot, rate, most = P.hotspot_score(F.col("recent_changes"), F.col("changes")), _rate("bug_fix_changes", "changes"), F.coalesce("c", F.lit(0))
    out = rows.select("path", F.round(P.pain_score(hotspot, rate, most), 6).alias("pain_score"), F.round(hotspot, 6).alias("hotspot_score"), F.round(rate, 6).alias("bug_fix_rate"), most.alias("complexity_max"), F.concat_ws(",", "authors").alias("owners"), F.coalesce("s", F.lit(False)).alias("owner_stale"))
    return out.orderBy(F.desc("pain_score"), "path").limit(top)
