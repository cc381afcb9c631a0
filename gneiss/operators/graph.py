"""Co-change graph, communities, centrality, wrapper chains and import resolution.

Edges are cut by thresholds before anything sequential sees them.  Local moves run in one task, whose input is checked
against ``MAX_EDGES``; betweenness spreads its sources over the cluster and shares a graph of at most that size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions import predicates as P
from gneiss.operators.history import MIN_COCHANGES
from gneiss.session import shared_folder

MIN_JACCARD = 0.05
RESOLUTION = 1.0
MIN_COMMUNITY = 3
MAX_PASSES = 20
MAX_EDGES = 5_000_000


def cochange_edges(coupling: DataFrame, activity: DataFrame, min_jaccard: float = MIN_JACCARD, min_cochanges: int = MIN_COCHANGES) -> DataFrame:
    """(a, b, cochanges, jaccard) of the pairs above both cuts."""
    kept = coupling.where(F.col("cochanges") >= min_cochanges)
    changes = activity.select("path", "changes")
    kept = kept.join(changes.select(F.col("path").alias("a"), F.col("changes").alias("ca")), "a").join(changes.select(F.col("path").alias("b"), F.col("changes").alias("cb")), "b")
    jaccard = F.col("cochanges").cast("double") / (F.col("ca") + F.col("cb") - F.col("cochanges"))
    return kept.select("a", "b", "cochanges", jaccard.alias("jaccard")).where(F.col("jaccard") >= min_jaccard)


def local_moves(links: list[tuple[int, int, float]], n: int, resolution: float = RESOLUTION) -> list[int]:
    """Community of each node after single-level modularity moves in node order; links as first seen."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    degree, loop, whole = [0.0] * n, [0.0] * n, 0.0
    for u, v, w in links:
        if w <= 0:
            continue
        whole += w
        near[u].append((v, w))
        degree[u] += w
        degree[v] += w
        if u == v:
            loop[u] += w
        else:
            near[v].append((u, w))
    home, total, inner = list(range(n)), degree[:], loop[:]
    if whole <= 0:
        return home

    def modularity() -> float:
        return sum(i / whole - resolution * (t / (2 * whole)) ** 2 for i, t in zip(inner, total, strict=True) if t)

    best_q = modularity()
    for _ in range(MAX_PASSES):
        moved = False
        for node in range(n):
            to: dict[int, float] = {}
            for other, w in near[node]:
                if other != node:
                    to[home[other]] = to.get(home[other], 0.0) + w
            old, k = home[node], degree[node]
            total[old] -= k
            inner[old] -= to.get(old, 0.0) + loop[node]
            new, gain = old, 0.0
            for c, weight in to.items():
                g = weight - resolution * (k * total[c]) / (2 * whole)
                if g > gain + 1e-12:
                    new, gain = c, g
            total[new] += k
            inner[new] += to.get(new, 0.0) + loop[node]
            home[node] = new
            moved |= new != old
        if not moved:
            break
        q = modularity()
        if q <= best_q + 1e-9:
            break
        best_q = q
    return home


def merge_small(links: list[tuple[int, int, float]], home: list[int], least: int = MIN_COMMUNITY) -> list[int]:
    """Communities below ``least`` join their strongest neighbour; it ends at the first that has none (Q25)."""
    home = list(home)
    while least > 1:
        sizes: dict[int, int] = {}
        for c in home:
            sizes[c] = sizes.get(c, 0) + 1
        small = [(s, c) for c, s in sizes.items() if s < least]
        if not small:
            break
        victim = min(small)[1]
        bridge: dict[int, float] = {}
        for u, v, w in links:
            if (home[u] == victim) != (home[v] == victim):
                c = home[v] if home[u] == victim else home[u]
                bridge[c] = bridge.get(c, 0.0) + w
        if not bridge:
            break
        into = min(bridge, key=lambda c: (-bridge[c], c))
        home = [into if c == victim else c for c in home]
    return home


def numbered(home: list[int]) -> list[int]:
    """Dense community ids by the community's first node."""
    ids: dict[int, int] = {}
    return [ids.setdefault(c, len(ids)) for c in home]


def communities(edges: DataFrame, resolution: float = RESOLUTION, least: int = MIN_COMMUNITY, max_edges: int = MAX_EDGES) -> DataFrame:
    """(path, community) of each node of the co-change graph; no edges give no rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > max_edges:
            raise ValueError(f"the graph has {len(rows)} edges, more than max_edges; raise min_jaccard or min_cochanges")
        rows = rows.sort_values(["a", "b"])
        nodes: dict[str, int] = {}
        links = [(nodes.setdefault(a, len(nodes)), nodes.setdefault(b, len(nodes)), w) for a, b, w in zip(rows["a"], rows["b"], rows["jaccard"], strict=True)]
        home = numbered(merge_small(links, local_moves(links, len(nodes), resolution), least))
        return pd.DataFrame({"path": list(nodes), "community": home})

    return edges.select("a", "b", "jaccard", F.lit(0).alias("g")).groupBy("g").applyInPandas(lambda rows: run(rows), "path string, community long")


def source_dependencies(near: list[list[int]], source: int) -> list[float]:
    """How much each node lies on shortest paths from the source; the source itself has 0."""
    n = len(near)
    depth, ways = [-1] * n, [0.0] * n
    depth[source], ways[source] = 0, 1.0
    seen, queue = [], deque([source])
    while queue:
        v = queue.popleft()
        seen.append(v)
        for w in near[v]:
            if depth[w] < 0:
                depth[w] = depth[v] + 1
                queue.append(w)
            if depth[w] == depth[v] + 1:
                ways[w] += ways[v]
    share = [0.0] * n
    for w in reversed(seen):
        for v in near[w]:
            if depth[v] == depth[w] - 1:
                share[v] += ways[v] / ways[w] * (1 + share[w])
    share[source] = 0.0
    return share


def betweenness(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(path, betweenness) of every node, unweighted; fewer than three nodes all have 0.

    The thresholded edges are counted before they are collected and shared; sources are spread over the tasks.
    """
    spark = edges.sparkSession
    pairs = edges.select("a", "b").where("a <> b").distinct()
    found = pairs.limit(max_edges + 1).toPandas()
    if len(found) > max_edges:
        raise ValueError("the graph has more than max_edges edges; raise min_jaccard or min_cochanges")
    names = sorted(set(found["a"]) | set(found["b"]))
    number = {p: i for i, p in enumerate(names)}
    near: list[set[int]] = [set() for _ in names]
    for a, b in zip(found["a"], found["b"], strict=True):
        near[number[a]].add(number[b])
        near[number[b]].add(number[a])
    shared = spark.sparkContext.broadcast(([sorted(x) for x in near], names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, labels = shared.value
        total = np.zeros(len(graph))
        for rows in batches:
            for s in rows.column("id").to_pylist():
                total += source_dependencies(graph, s)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([labels[i] for i in some], pa.string()), pa.array(total[some])], names=["path", "part"])

    parts = spark.range(len(names)).mapInArrow(run, "path string, part double")
    every = pairs.select(F.col("a").alias("path")).unionByName(pairs.select(F.col("b").alias("path"))).distinct().withColumn("part", F.lit(0.0))
    return parts.unionByName(every).groupBy("path").agg(F.round(F.sum("part") / 2, 9).alias("betweenness"))


def boundaries(scores: DataFrame, groups: DataFrame, top: int = 10) -> DataFrame:
    out = scores.where("betweenness > 0").join(groups, "path", "left")
    return out.select("path", "betweenness", "community").orderBy(F.desc("betweenness"), "path").limit(top)


def community_list(groups: DataFrame) -> DataFrame:
    """(id, size, files) by size."""
    out = groups.groupBy(F.col("community").alias("id")).agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))
    return out.orderBy(F.desc("size"), "id")


def area_of(groups: DataFrame, path: str) -> DataFrame:
    """(file, community, size) of one file; no row for a file outside the graph."""
    mine = groups.where(F.col("path") == path).select(F.col("path").alias("file"), "community")
    sizes = groups.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return mine.join(sizes, "community").select("file", "community", "size")


def newest_author(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Q20: (path, author) of the newest change; of equal times the greatest hash."""
    rows = file_changes.select("hash", "path").join(commits.select("hash", "ts", "author_name"), "hash")
    return rows.groupBy("path").agg(F.max_by("author_name", F.struct("ts", "hash")).alias("author"))


def community_health(groups: DataFrame, activity: DataFrame, newest: DataFrame, contributors: DataFrame) -> DataFrame:
    """(community, files, total_changes, recent_changes, bug_fixes, bug_fix_rate, stale_owner_files)."""
    stale = contributors.where("not is_bot").select(F.col("name").alias("author"), P.is_stale(F.col("last_seen"), F.col("last")).alias("stale"))
    owners = newest.join(stale, "author", "left").select("path", F.coalesce("stale", F.lit(False)).alias("stale"))
    rows = groups.join(activity, "path").join(owners, "path", "left")
    out = rows.groupBy("community").agg(
        F.count(F.lit(1)).alias("files"), F.sum("changes").alias("total_changes"), F.sum("recent_changes").alias("recent_changes"), F.sum("bug_fix_changes").alias("bug_fixes"), F.count_if("stale").alias("stale_owner_files")
    )
    return out.withColumn("bug_fix_rate", F.round(F.when(F.col("total_changes") > 0, F.col("bug_fixes").cast("double") / F.col("total_changes")).otherwise(0.0), 6))


def import_edges(imports: DataFrame) -> DataFrame:
    """(src, dst), once each."""
    return imports.select(F.col("path").alias("src"), F.col("import_from").alias("dst")).distinct()


def wrapper_chains(edges: DataFrame, least: int = 3, max_rounds: int = 40) -> DataFrame:
    """(head, path, position, length) of maximal runs of files with one importer and one import each.

    Pointers are doubled, so a chain of n files takes log2(n) joins.  A ring starts at its least path.
    """
    edges = edges.where("src is not null and dst is not null").distinct()
    out_degree = edges.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("o"))
    in_degree = edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("i"))
    inner = out_degree.where("o = 1").join(in_degree.where("i = 1"), "path").select("path")
    step = edges.join(inner.withColumnRenamed("path", "src"), "src", "left_semi").join(inner.withColumnRenamed("path", "dst"), "dst", "left_semi").where("src <> dst")
    # each file, the file `hops` before it, and the least path met on the way (that settles rings)
    state = inner.join(step.select(F.col("dst").alias("path"), F.col("src").alias("prev")), "path", "left")
    state = state.select("path", "prev", F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.least("path", "prev").alias("low"), F.coalesce("prev", "path").alias("last"))
    shared_folder(edges.sparkSession)
    state = state.checkpoint()  # each round reads the one before twice
    rounds = min(max_rounds, max(1, state.count().bit_length()))
    for _ in range(rounds):
        if state.where("prev is not null").isEmpty():
            break
        ahead = state.select(F.col("path").alias("prev"), F.col("prev").alias("prev2"), F.col("hops").alias("hops2"), F.col("low").alias("low2"), F.col("last").alias("last2"))
        state = state.join(ahead, "prev", "left").select("path", F.col("prev2").alias("prev"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.least("low", "low2").alias("low"), F.coalesce("last2", "last").alias("last"))
        state = state.checkpoint()
    state = state.select("path", "hops", F.col("prev").isNotNull().alias("ring"), F.when(F.col("prev").isNull(), F.col("last")).otherwise(F.col("low")).alias("head"))
    w = Window.partitionBy("head")
    placed = state.withColumn("length", F.count(F.lit(1)).over(w)).where(F.col("length") >= least)
    # in a ring hops say nothing; its files come in the order of their paths
    position = F.when(F.col("ring"), F.row_number().over(w.orderBy("path")) - 1).otherwise(F.col("hops")).cast("long")
    return placed.select("head", "path", position.alias("position"), "length")


def single_importers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, importer, abstractions, score) of files that export traits or interfaces and have one importer."""
    kinds = symbols.where("role = 'export' and kind in ('trait', 'interface')").groupBy("path").agg(F.count(F.lit(1)).alias("abstractions"))
    lone = edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("importer")).where("n = 1")
    return kinds.join(lone, "path").select("path", "importer", "abstractions", (F.lit(6.0) + F.least(F.col("abstractions"), F.lit(4))).alias("score"))


def symbols_of(symbols: DataFrame, imports: DataFrame, path: str) -> DataFrame:
    """(section, name, kind, line) of a file's exports, definitions, imports and importers."""
    own = symbols.where(F.col("path") == path).select(F.concat("role", F.lit("s")).alias("section"), "name", "kind", "line")
    uses = imports.where(F.col("path") == path).select(F.lit("imports").alias("section"), F.col("import_from").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("line")).distinct()
    # the suffix test is on a literal, so it is a filter rather than a nested loop
    by = imports.where((F.col("import_from") == path) | F.lit(path).endswith(F.col("import_from"))).select(F.lit("imported_by").alias("section"), F.col("path").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("line")).distinct()
    return own.unionByName(uses).unionByName(by)


def dependents(symbols: DataFrame, imports: DataFrame, name: str, defined_in: str | None = None) -> DataFrame:
    """(symbol, defined_in, used_by) of a name; of several defining files the least path (Q26)."""
    where = symbols.where(F.col("name") == name)
    if defined_in is not None:
        where = where.where(F.col("path") == defined_in)
    home = where.agg(F.min("path").alias("defined_in"))
    users = imports.where(F.col("name") == name).select(F.col("path").alias("used_by")).distinct()
    return users.crossJoin(F.broadcast(home)).select(F.lit(name).alias("symbol"), "defined_in", "used_by")


def _joined(folder: Column, rest: Column) -> Column:
    return P.normalize_path(F.concat_ws("/", folder, rest))


def import_candidates(imports: DataFrame) -> DataFrame:
    """(path, import_from, candidates) of files that an import may mean, the likeliest first."""
    path, text = F.col("path"), F.col("import_from")
    folder, ext = P.parent_dir(path), P.extension(path)
    stem = F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)
    inside = F.when(stem.isin("mod", "lib", "main"), folder).otherwise(_joined(folder, stem))
    rust = F.array(*(F.concat(_joined(at, text), F.lit(tail)) for at in (inside, folder) for tail in (".rs", "/mod.rs")))
    relative = _joined(folder, text)
    script = F.when(text.startswith("."), F.concat(F.array(relative), *(F.array(*(F.concat(relative, F.lit(tail + e)) for e in ("ts", "tsx", "js", "jsx", "mjs", "cjs"))) for tail in (".", "/index."))))
    dots = F.length(F.regexp_extract(text, r"^(\.*)", 1))
    dotted = F.replace(F.regexp_replace(text, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise("")
    base = F.when(dots > 0, P.normalize_path(F.concat(folder, F.lit("/"), up, dotted))).otherwise(dotted)
    python = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    found = F.when(ext == "rs", rust).when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs"), script).when(ext == "py", python)
    return imports.select("path", "import_from").distinct().select("path", "import_from", F.filter(found, lambda c: c.isNotNull()).alias("candidates"))


def resolve_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(path, import_from, resolved): the first candidate that exists, else the text as it stands (Q23)."""
    asked = import_candidates(imports)
    each = asked.select("path", "import_from", F.posexplode("candidates").alias("pos", "candidate"))
    hits = each.join(known.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path", "import_from").agg(F.min_by("candidate", "pos").alias("hit"))
    return asked.select("path", "import_from").join(hits, ["path", "import_from"], "left").select("path", "import_from", F.coalesce("hit", "import_from").alias("resolved"))
