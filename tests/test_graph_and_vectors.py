import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gneiss.operators import graph as G
from gneiss.operators import history as H
from gneiss.operators import targets as T
from gneiss.operators import vectors as V

TRIANGLES = [("a", "b", 5), ("a", "c", 5), ("b", "c", 5), ("d", "e", 5), ("d", "f", 5), ("e", "f", 5), ("a", "d", 3)]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def triangles(spark):
    activity = table(spark, [(p, 6, i) for i, p in enumerate("abcdef")], "path string, changes long, bug_fix_changes long")
    return G.cochange_edges(table(spark, TRIANGLES, "a string, b string, cochanges long"), activity), activity


def test_two_triangles(triangles):
    edges, activity = triangles
    assert {(r.a, r.b): round(r.jaccard, 3) for r in edges.collect()}[("a", "b")] == 0.714
    groups = G.communities(edges)
    assert {r.path: r.community for r in groups.collect()} == dict(zip("abcdef", [0, 0, 0, 1, 1, 1], strict=True))
    scores = {r.path: r.betweenness for r in G.betweenness(edges).collect()}
    assert scores == {"a": 6.0, "d": 6.0, "b": 0.0, "c": 0.0, "e": 0.0, "f": 0.0}
    assert [(r.path, r.community) for r in G.boundaries(G.betweenness(edges), groups).collect()] == [("a", 0), ("d", 1)]
    assert [(r.id, r.size, r.files) for r in G.community_list(groups).collect()] == [(0, 3, "a,b,c"), (1, 3, "d,e,f")]
    assert [(r.file, r.community, r.size) for r in G.area_of(groups, "e").collect()] == [("e", 1, 3)] and G.area_of(groups, "zz").count() == 0
    assert [(r.community, r.fixes) for r in T.bug_communities(groups, activity).collect()] == [(1, 12)]


@pytest.mark.parametrize(("edges", "want"), [([("a", "b"), ("b", "c"), ("c", "d")], {"a": 0, "b": 2, "c": 2, "d": 0}), ([("h", x) for x in "abcd"], {"h": 6, **dict.fromkeys("abcd", 0)}), ([("a", "b"), ("c", "d")], dict.fromkeys("abcd", 0)), ([("a", "a"), ("a", "b")], {"a": 0, "b": 0}), ([], {})])
def test_betweenness_of_shapes(spark, edges, want):
    assert {r.path: r.betweenness for r in G.betweenness(table(spark, edges, "a string, b string")).collect()} == want


def test_limits_and_empty_graphs(spark):
    edges = table(spark, [("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, jaccard double")
    with pytest.raises(ValueError):
        G.betweenness(edges, max_edges=1)
    with pytest.raises(Exception, match="max_edges"):
        G.communities(edges, max_edges=1).collect()
    assert G.communities(edges.limit(0)).count() == 0


def test_small_communities_merge_until_one_has_no_neighbour():
    links = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 0.1)]
    assert G.merge_small(links, [0, 0, 0, 3]) == [0, 0, 0, 0]
    # the pair 4-5 has no neighbour and the smaller single node comes first
    assert G.merge_small([*links, (4, 5, 1.0)], [0, 0, 0, 3, 4, 4]) == [0, 0, 0, 0, 4, 4]
    # a pair of a lower id without a neighbour ends it, so the other pair stays
    assert G.merge_small([(0, 1, 1.0), (2, 3, 1.0), (3, 4, 0.1), (4, 5, 1.0), (5, 6, 1.0)], [0, 0, 2, 2, 4, 4, 4]) == [0, 0, 2, 2, 4, 4, 4]


def test_modularity_never_falls():
    rng = random.Random(4)
    for _ in range(20):
        links = [(a, b, rng.random() + 0.1) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.3]
        home = G.local_moves(links, 14)
        whole = sum(w for *_, w in links)

        def q(c, links=links, whole=whole):
            degree = [0.0] * 14
            for a, b, w in links:
                degree[a] += w
                degree[b] += w
            return sum(w for a, b, w in links if c[a] == c[b]) / whole - sum((sum(d for d, x in zip(degree, c, strict=True) if x == k) / (2 * whole)) ** 2 for k in set(c))

        assert q(home) >= q(list(range(14))) - 1e-9


def test_wrapper_chains(spark):
    edges = [("x", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("y", "d"), ("d", "e"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("s", "s")]
    rows = {(r.head, r.path, r.position, r.length) for r in G.wrapper_chains(table(spark, edges, "src string, dst string")).collect()}
    assert rows == {("a", "a", 0, 3), ("a", "b", 1, 3), ("a", "c", 2, 3), ("r1", "r1", 0, 3), ("r1", "r2", 1, 3), ("r1", "r3", 2, 3)}
    assert G.wrapper_chains(table(spark, [], "src string, dst string")).count() == 0
    long = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)]
    out = G.wrapper_chains(table(spark, long, "src string, dst string")).collect()
    assert len(out) == 69 and {r.head for r in out} == {"n001"} and {r.path: r.position for r in out}["n069"] == 68


SYMBOLS = "path string, role string, name string, kind string, line long, complexity long"
IMPORTS = "path string, import_from string, name string"


def test_symbols_and_dependents(spark):
    symbols = table(spark, [("src/lib.rs", "export", "Base", "trait", 1, 0), ("src/lib.rs", "definition", "Base", "trait", 1, 0), ("src/a.rs", "export", "Base", "struct", 3, 0), ("src/a.rs", "export", "data_helper", "function", 9, 1)], SYMBOLS)
    imports = table(spark, [("src/a.rs", "src/lib.rs", "Base"), ("x.rs", "lib.rs", "Base"), ("x.rs", "src/a.rs", "other")], IMPORTS)
    assert {(r.section, r.name) for r in G.symbols_of(symbols, imports, "src/lib.rs").collect()} == {("exports", "Base"), ("definitions", "Base"), ("imported_by", "src/a.rs"), ("imported_by", "x.rs")}
    assert {(r.defined_in, r.used_by) for r in G.dependents(symbols, imports, "Base").collect()} == {("src/a.rs", "src/a.rs"), ("src/a.rs", "x.rs")}
    assert {r.defined_in for r in G.dependents(symbols, imports, "Base", "src/lib.rs").collect()} == {"src/lib.rs"}
    edges = G.import_edges(imports)
    assert [(r.path, r.importer, r.score) for r in G.single_importers(edges, symbols).collect()] == [("src/lib.rs", "src/a.rs", 7.0)]
    assert T.orphan_exports(symbols.where("path = 'src/a.rs'"), edges.where("dst <> 'src/a.rs'")).count() == 2
    many = table(spark, [(f"u/{n}.ts", "export", n, "function", 1, 1) for n in ("utilA", "DataThing", "helper", "clean")], SYMBOLS)
    assert [(r.area, r.hits, r.score) for r in T.cliche_clusters(many).collect()] == [("u", 3, 4.0)]


def test_import_resolution(spark):
    imports = [("src/app.rs", "util"), ("src/lib.rs", "util"), ("src/app.rs", "deep"), ("w/a.ts", "./b"), ("w/a.ts", "../c"), ("w/a.ts", "./d"), ("w/a.ts", "react"), ("p/m/x.py", ".y"), ("p/m/x.py", "..z"), ("p/m/x.py", "p.m"), ("p/m/x.py", "os")]
    known = ["src/util.rs", "src/app/deep.rs", "w/b.tsx", "c/index.js", "w/d.js", "w/d.ts", "p/m/y.py", "p/z/__init__.py", "p/m/__init__.py"]
    out = {(r.path, r.import_from): r.resolved for r in G.resolve_imports(table(spark, imports, "path string, import_from string"), table(spark, [(k,) for k in known], "path string")).collect()}
    assert [out[i] for i in imports] == ["src/util.rs", "src/util.rs", "src/app/deep.rs", "w/b.tsx", "c/index.js", "w/d.ts", "react", "p/m/y.py", "p/z/__init__.py", "p/m/__init__.py", "os"]


# --- history on hand-built commits


@pytest.fixture(scope="module")
def small(spark):
    day = "timestamp '2024-03-{} 00:00:00'"
    commits = spark.sql(" UNION ALL ".join(f"SELECT '{h}' AS hash, '{a}' AS author_name, {day.format(d)} AS ts, '{s}' AS subject" for h, a, d, s in [("1", "ann", 10, "feat: start"), ("2", "ann", 11, "fix: bug"), ("3", "ann", 12, "feat: more"), ("4", "bob", 13, "feat: else")]))
    changes = table(spark, [("1", "e.rs", 100, 0), ("1", "e_test.rs", 50, 0), ("2", "e.rs", 5, 2), ("2", "e_test.rs", 10, 0), ("3", "e.rs", 20, 5), ("3", "conf.rs", 30, 0), ("3", "e_test.rs", 15, 0), ("4", "u.rs", 40, 0)], "hash string, path string, additions long, deletions long")
    return commits, changes


def test_small_history(small, spark):
    commits, changes = small
    activity = H.file_activity(commits, changes)
    e = activity.where("path = 'e.rs'").first()
    assert (e.changes, e.bug_fix_changes, e.additions, e.deletions, e.authors) == (3, 1, 125, 7, ["ann"])
    pairs = H.coupling_counts(changes)
    assert [(r.a, r.b) for r in pairs.where("cochanges >= 3").collect()] == [("e.rs", "e_test.rs")]
    assert H.coupling_counts(changes, max_files_per_commit=2).where("cochanges = 3").count() == 0
    people = H.contributor_stats(commits)
    assert H.bus_factor(people).first()[0] == 2
    risk = H.diff_risk(table(spark, [("e.rs",), ("none.rs",), ("e.rs",)], "path string"), activity).collect()
    assert [(r.path, r.known) for r in risk] == [("e.rs", True), ("e.rs", True), ("none.rs", False)] and risk[0].risk_score == round(0.6 / 3 + 0.4, 6)
    assert {(r.path, r.author) for r in G.newest_author(commits, changes).collect()} == {("e.rs", "ann"), ("e_test.rs", "ann"), ("conf.rs", "ann"), ("u.rs", "bob")}


@pytest.mark.parametrize("least", [1, 2])
def test_pairs_are_of_numbers_and_of_few_changes_a_task(spark, least):
    rng = random.Random(5)
    rows = sorted({(str(rng.randrange(30)), rng.choice("zyxwvutsrq") + f"{rng.randrange(4)}.rs") for _ in range(200)}) + [("1", "yarn.lock"), ("2", "yarn.lock"), ("1", None), (None, "z0.rs")]
    want = Counter()
    for h in {h for h, _ in rows if h}:
        mine = sorted(p for g, p in rows if g == h and p and not p.endswith(".lock"))
        want.update(itertools.combinations(mine, 2))
    want = {pair: n for pair, n in want.items() if n >= least}
    changes = table(spark, rows, "hash string, path string").repartition(4)
    for rows_a_task in (40, 10_000):
        found = H.coupling_counts(changes, least=least, rows_a_task=rows_a_task)
        assert {(r.a, r.b): r.cochanges for r in found.collect()} == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        tasks = {int(n) for n in re.findall(r"RepartitionByExpression \[i#\d+L, j#\d+L\], (\d+)", plan)}
        assert len(tasks) == 1 and (min(tasks) == 1) == (rows_a_task > 40)


def test_risk_of_files_listed_often(small, spark):
    activity = H.file_activity(*small)
    asked = {"e.rs": 9000, "u.rs": 4096, "none.rs": 8193, None: 2}
    files = spark.createDataFrame(list(asked.items()), "path string, n int").select("path", F.explode(F.sequence(F.lit(1), "n"))).select("path").repartition(3)
    out = H.diff_risk(files, activity)
    assert Counter(r.path for r in out.collect()) == asked
    # the list is counted before it meets the activity and is sorted
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Sort") < plan.index("Join") < plan.index("count(1) AS times")
    order = [(-r.risk_score, r.path or "") for r in out.collect()]
    assert order == sorted(order)


def test_directories_by_hand(spark):
    rows = [("1", "ann", 0), ("2", "bob", 100), ("3", None, 100), ("4", "bob", 180)]
    commits = spark.createDataFrame(rows, "hash string, author_name string, day int").select("hash", "author_name", F.timestamp_seconds(F.col("day") * 86400).alias("ts"), F.lit("fix: it").alias("subject"))
    changes = table(spark, [("1", "d/a.rs", 1, 0), ("2", "d/a.rs", 1, 0), ("3", "d/b.rs", 1, 0), ("1", "old/c.rs", 1, 0), ("4", "d/gone.rs", 1, 0)], "hash string, path string, additions long, deletions long")
    activity, people = H.file_activity(commits, changes), H.contributor_stats(commits)
    gone, none = table(spark, [("d/gone.rs",)], "path string"), table(spark, [], "old_path string")
    symbols = table(spark, [("d/a.rs", "definition", 5), ("d/a.rs", "definition", 8)], "path string, role string, complexity long")
    got = {r.area: r for r in H.areas(activity, people, gone, none, symbols).collect()}
    d, old = got["d/"], got["old/"]
    # an author without a name is one of the owners, after those of as many changes, and isn't listed
    assert (d.files, d.owners, d.n_owners, d.owner_stale, d.bug_fix_rate, d.complexity_median, d.total_symbols) == (2, "ann,bob", 3, True, 1.0, 6.5, 2)
    assert (old.files, old.owners, old.n_owners, old.owner_stale, old.total_symbols, old.health) == (1, "ann", 1, True, 0, "at-risk")
    assert set(H.areas(activity, people, gone, none, symbols, active_only=True, large=2).toPandas()["area"]) == {"d/"}
    owners = [(r.author, r.commits, r.pct, r["rank"]) for r in H.area_owners(H.surviving(activity, gone, none), people).where("area = 'd/'").orderBy("rank").collect()]
    assert owners == [("ann", 2, 66.666667, 1), ("bob", 2, 66.666667, 2), (None, 1, 33.333333, 3)]


# --- vectors


VECTORS = "id long, path string, values array<float>"


def test_cosine_and_truncation(spark):
    row = spark.createDataFrame([([3.0, 4.0, 12.0], [0.0, 0.0, 0.0])], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("a")).alias("one"), V.cosine(F.col("a"), F.col("b")).alias("zero"), V.truncated(F.col("a"), 2).alias("two"), V.truncated(F.col("a"), 3).alias("all"), V.truncated(F.col("b"), 2).alias("none")).first()
    assert math.isclose(row.one, 1) and row.zero == 0 and row.two == pytest.approx([0.6, 0.8]) and row["all"] == [3, 4, 12] and row.none == [0, 0]
    with pytest.raises(Exception, match="exceeds"):
        spark.createDataFrame([([1.0],)], "a array<float>").select(V.truncated(F.col("a"), 2)).collect()


def test_outliers_and_duplicates(spark):
    rows = [(i, f"x{i}", [1.0, 0.01 * i, 0.0]) for i in range(5)] + [(9, "y", [0.0, 0.0, 1.0])]
    out = V.outliers(table(spark, rows, VECTORS)).collect()
    assert out[0].path == "y" and out[0].score == 9.0 and all(r.distance > 0.15 for r in out)
    assert V.outliers(table(spark, rows[:4], VECTORS)).count() == 0
    pairs = table(spark, [(1, "a", [1.0, 0.0]), (2, "b", [2.0, 0.0]), (3, "b", [1.0, 0.0]), (4, "c", [0.0, 1.0]), (5, "d", [0.0, 0.0])], VECTORS)
    assert {(r.id_a, r.id_b) for r in V.similar_pairs(pairs, blocks=3).collect()} == {(1, 2), (1, 3)}
    top = V.semantic_duplicates(pairs, 1).collect()
    assert [(r.id_a, r.id_b, r.score) for r in top] == [(1, 2, 10.0)]


def test_content_delta(spark):
    old = table(spark, [("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = table(spark, [("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {(r.path, r.state) for r in V.content_delta(old, new).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")}


def test_hashed_embedding(spark):
    out = table(spark, [("the cat",), ("cat, THE",), ("",)], "t string").select(V.hashed_embedding(F.col("t"), 8).alias("v")).collect()
    assert out[0].v == pytest.approx(out[1].v) and sum(x * x for x in out[0].v) == pytest.approx(1) and out[2].v == [0.0] * 8


def shortest_paths(near, s, t):
    """All of them, by breadth."""
    paths, found = [[s]], []
    while paths and not found:
        paths = [[*p, v] for p in paths for v in near[p[-1]] if v not in p]
        found = [p for p in paths if p[-1] == t]
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_betweenness_of_random_graphs_by_all_shortest_paths(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(14)})
    near = {i: [b for a, b in pairs if a == i] + [a for a, b in pairs if b == i] for i in range(9)}
    want = {f"n{i}": 0.0 for i in range(9) if near[i]}
    for s, t in itertools.combinations(range(9), 2):
        found = shortest_paths(near, s, t)
        for p in found:
            for v in p[1:-1]:
                want[f"n{v}"] += 1 / len(found)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "a string, b string")
    got = {r.path: r.betweenness for r in G.betweenness(edges).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def modularity(links, home):
    whole = sum(w for _, _, w in links)
    degree = {}
    for u, v, w in links:
        degree[u] = degree.get(u, 0) + w
        degree[v] = degree.get(v, 0) + w
    return sum(w / whole for u, v, w in links if home[u] == home[v]) - sum((sum(degree.get(i, 0) for i, c in enumerate(home) if c == k) / (2 * whole)) ** 2 for k in set(home))


@pytest.mark.parametrize("seed", range(6))
def test_no_single_move_of_a_random_graph_adds_modularity(seed):
    rng = random.Random(seed)
    n = 14
    links = [(a, b, round(rng.random() + 0.1, 3)) for a, b in sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(26)})]
    home = G.local_moves(links, n)
    start = modularity(links, home)
    assert start >= modularity(links, list(range(n)))
    for node in range(n):
        for c in {home[v if u == node else u] for u, v, _ in links if node in (u, v)}:
            assert modularity(links, [c if i == node else x for i, x in enumerate(home)]) <= start + 1e-9
    merged = G.merge_small(links, home, 3)
    linked = {x for u, v, _ in links for x in (u, v)}
    sizes = [merged.count(c) for c in {merged[i] for i in linked}]
    # a small community stays only if it has no neighbour left, or another such was met first
    assert min(sizes) >= 3 or any(not any((merged[u] == c) != (merged[v] == c) for u, v, _ in links) for c in set(merged) if merged.count(c) < 3)


def test_health_and_area_of_communities_by_hand(spark, sf_dir):
    from gneiss.plans import graph_queries as Q
    from gneiss.plans.repo import Repo

    r = Repo.from_star_schema(spark, sf_dir)
    groups = {x.path: x.community for x in Q._groups(r).collect()}
    activity = {x.path: x for x in r.file_activity.collect()}
    commits = {x.hash: x for x in r.commits.collect()}
    people = {x.name: x for x in r.contributors.collect()}
    newest = {}
    for x in r.file_changes.collect():
        c = commits[x.hash]
        newest[x.path] = max(newest.get(x.path, ()), (c.ts, c.hash, c.author_name))
    days = lambda a, b: (b - a).total_seconds() / 86400
    for row in Q._health(r).collect():
        mine = [p for p, c in groups.items() if c == row.community]
        own = [activity[p] for p in mine if p in activity]
        assert row.files == len(own) and row.total_changes == sum(a.changes for a in own) and row.bug_fixes == sum(a.bug_fix_changes for a in own)
        stale = [p for p in mine if p in activity and not people[newest[p][2]].is_bot and days(people[newest[p][2]].last_seen, people[newest[p][2]].last) > 90]
        assert row.stale_owner_files == len(stale)
    first = Q._first_member(r).collect()
    assert [(x.file, x.community, x.size) for x in first] == [(min(groups), groups[min(groups)], list(groups.values()).count(groups[min(groups)]))] if groups else first == []


def test_centroids_by_hand(spark):
    rng = random.Random(2)
    rows = [(i, f"f{i % 7}", [rng.random() for _ in range(5)]) for i in range(60)]
    got = {r.path: r.centroid for r in V.centroids(spark.createDataFrame(rows, "id long, path string, values array<float>").repartition(4)).collect()}
    for path, mean in got.items():
        mine = [v for _, p, v in rows if p == path]
        assert all(abs(m - sum(v[i] for v in mine) / len(mine)) < 1e-6 for i, m in enumerate(mean))
    assert len(got) == 7
