"""Logical tables of a repository's history, and how they come out of the star-schema test tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators import history
from gneiss.session import written

_PATH = """concat(lower(p_type), '/', replace(p_brand, '#', ''), '/part_', CAST(p_partkey AS STRING),
  CASE WHEN p_size % 7 = 0 THEN '_test' ELSE '' END,
  CASE WHEN p_size = 49 THEN '.min.js' WHEN p_size = 48 THEN '.pb.go' WHEN p_size % 6 = 0 THEN '.rs' WHEN p_size % 6 = 1 THEN '.ts'
       WHEN p_size % 6 = 2 THEN '.py' WHEN p_size % 6 = 3 THEN '.go' WHEN p_size % 6 = 4 THEN '.md' ELSE '.java' END)"""

#: Text that both Spark and the oracle run, so both sides start from the same rows.
COMMITS = """SELECT o_orderkey AS hash, o_orderdate AS ts,
  concat(n_name, CASE WHEN n_nationkey % 2 = 0 AND o_orderdate < TIMESTAMP '2001-04-01 00:00:00' THEN ' early' ELSE '' END,
         CASE WHEN n_regionkey = 4 THEN '[bot]' ELSE '' END) AS author_name,
  CASE WHEN o_orderpriority = '1-URGENT' THEN concat('fix: order ', CAST(o_orderkey AS STRING), ' was off')
       WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0 THEN concat('Repair race in order ', CAST(o_orderkey AS STRING))
       WHEN o_orderpriority = '2-HIGH' THEN concat('feat(orders): add ', CAST(o_orderkey AS STRING))
       WHEN o_orderpriority = '3-MEDIUM' THEN concat('refactor: tidy ', CAST(o_orderkey AS STRING))
       ELSE concat('Update notes on ', CAST(o_orderkey AS STRING)) END AS subject
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

FILE_CHANGES = f"""SELECT l_orderkey AS hash, {_PATH} AS path, CAST(sum(l_quantity) AS BIGINT) AS additions, count(*) AS deletions
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1, 2"""

DELETIONS = f"SELECT DISTINCT {_PATH} AS path FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_partkey % 97 = 0"

RENAMES = f"SELECT {_PATH} AS old_path, concat({_PATH}, '.new') AS new_path FROM {{part}} WHERE p_partkey % 101 = 0"

RELEASE_TAGS = """SELECT concat('v', CAST(year(o_orderdate) AS STRING), '.', CAST(quarter(o_orderdate) AS STRING)) AS tag, min(o_orderdate) AS ts
FROM {orders} GROUP BY 1"""

SYMBOLS = f"""SELECT {_PATH} AS path, CASE WHEN p_size % 3 = 0 THEN 'definition' ELSE 'export' END AS role,
  concat(CASE WHEN p_size % 5 = 0 THEN 'Base' WHEN p_size % 5 = 1 THEN 'handle_' ELSE 'get' END, upper(substring(p_name, 1, 1)), replace(substring(p_name, 2), ' ', '_'), CAST(p_partkey % 40 AS STRING)) AS name,
  CASE WHEN p_size % 4 = 0 THEN 'struct' ELSE 'function' END AS kind, CAST(p_size AS BIGINT) AS line, CAST(p_size % 23 AS BIGINT) AS complexity
FROM {{part}}"""

IMPORTS = f"""SELECT a.path AS path, b.path AS import_from, b.name AS name
FROM (SELECT {_PATH} AS path, p_partkey AS k FROM {{part}}) a
JOIN (SELECT s.path, s.name, t.k FROM ({SYMBOLS}) s JOIN (SELECT {_PATH} AS path, p_partkey AS k FROM {{part}}) t ON s.path = t.path) b
  ON b.k = a.k * 3 % 61 + 1 AND a.k % 4 <> 0 AND a.k <> b.k"""

DOCS = """SELECT concat('docs/', CAST(doc_id AS STRING), '.md') AS path,
  concat('# Notes on ', p_type, chr(10), chr(10), text, chr(10), chr(10), '## See also', chr(10), chr(10), '`get', upper(substring(p_name, 1, 1)), replace(substring(p_name, 2), ' ', '_'), CAST(p_partkey % 40 AS STRING),
         '(x)` and `Option<Gone', CAST(p_partkey AS STRING), '>`, as in api::part_', CAST(p_partkey AS STRING), chr(10)) AS content
FROM {documents} JOIN {part} ON p_partkey = doc_id % 200 + 1 WHERE text IS NOT NULL"""

VECTORS = "SELECT vec_id AS id, concat('file_', CAST(label AS STRING)) AS path, embedding AS values FROM {embeddings}"

#: A listing of a project's root beside the source files.
LISTING = f"""SELECT {_PATH} AS path FROM {{part}} UNION ALL SELECT path FROM (VALUES ('README.md'), ('LICENSE'), ('Cargo.toml'), ('package-lock.json'), ('yarn.lock'), ('.travis.yml'), ('.github/workflows/ci.yml'),
  ('biome.json'), ('.eslintrc.json'), ('debug.log'), ('src/a.swp'), ('coverage/index.html'), ('docs/.DS_Store'), ('old/main.rs.bak')) AS t(path)"""

SOURCES = f"""SELECT path, CASE ext
  WHEN 'py' THEN concat('import os', chr(10), chr(10), chr(10), 'def part_', k, '(x):', chr(10), '    if x and os:', chr(10), '        return 1', chr(10), '    return 0', chr(10))
  WHEN 'rs' THEN concat('use std::fmt;', chr(10), chr(10), 'pub fn part_', k, '(x: i32) -> i32 {{{{', chr(10), '    if x > 0 {{{{ 1 }}}} else {{{{ 2 }}}}', chr(10), '}}}}', chr(10),
    CASE CAST(k AS INT) % 3 WHEN 0 THEN concat('/// Holds {{{{', chr(10), 'struct S', k, '<T> {{{{ pub a: Vec<(T, T)>, b: &str }}}}', chr(10))
      WHEN 1 THEN concat('#[derive(Debug)]', chr(10), 'pub enum E', k, ' {{{{', chr(10), '    One,', chr(10), '    Two(u8, u8),', chr(10), '}}}}', chr(10)) ELSE concat('impl From<u8> for P {{{{', chr(10), '    fn from(v: u8) -> P {{{{ make(v) }}}}', chr(10), '}}}}', chr(10)) END)
  WHEN 'ts' THEN concat('import {{{{ a }}}} from "./a";', chr(10), chr(10), 'export function part_', k, '(x) {{{{', chr(10), '  try {{{{ a(x, 1); }}}} catch (e) {{{{}}}}', chr(10), '  return x ? 1 : 0;', chr(10), '}}}}', chr(10),
    CASE CAST(k AS INT) % 3 WHEN 0 THEN concat('export const pass', k, ' = (a, b) => call(a, b);', chr(10)) WHEN 1 THEN concat('export interface I', k, ' {{{{ size: number; go(): void }}}}', chr(10)) ELSE concat('class C', k, ' {{{{', chr(10), '  held = 1;', chr(10), '  run() {{{{ return `class No {{{{}}}}`; }}}}', chr(10), '}}}}', chr(10), 'module.exports = {{{{ C', k, ' }}}};', chr(10)) END)
  WHEN 'go' THEN concat('package p', chr(10), chr(10), 'import "fmt"', chr(10), chr(10), 'func Part', k, '(x int) int {{{{', chr(10), '  if true {{{{', chr(10), '    return 1', chr(10), '  }}}}', chr(10), '  return x', chr(10), '}}}}', chr(10),
    CASE CAST(k AS INT) % 3 WHEN 0 THEN concat('type T', k, ' struct {{{{', chr(10), '  Name string', chr(10), '  io.Reader', chr(10), '}}}}', chr(10)) WHEN 1 THEN concat('type (', chr(10), '  a', k, ' int', chr(10), '  B', k, ' interface {{{{ Go(x int) }}}}', chr(10), ')', chr(10)) ELSE concat('func (t *T) do(x int) {{{{', chr(10), '  os.Do(x)', chr(10), '}}}}', chr(10)) END)
  WHEN 'java' THEN concat('import java.util.List;', chr(10), chr(10), 'public class Part', k, ' {{{{', chr(10), '    public int get(int x) {{{{', chr(10), '        return other(x);', chr(10), '    }}}}', chr(10),
    CASE CAST(k AS INT) % 2 WHEN 0 THEN concat('    private final Map<String, Integer> held = null;', chr(10)) ELSE concat('    Part', k, '(int x) {{{{ super(x); }}}}', chr(10)) END, '}}}}', chr(10))
  END AS content
FROM (SELECT {_PATH} AS path, CAST(p_partkey AS STRING) AS k, regexp_extract({_PATH}, '([a-z]+)$', 1) AS ext FROM {{part}})""".replace("{{{{", "{{").replace("}}}}", "}}")

EVENTS = "SELECT * FROM {events}"

TABLES = {"commits": COMMITS, "file_changes": FILE_CHANGES, "deletions": DELETIONS, "renames": RENAMES, "release_tags": RELEASE_TAGS, "symbols": SYMBOLS, "imports": IMPORTS}
MORE = {"docs": DOCS, "vectors": VECTORS, "listing": LISTING, "sources": SOURCES, "event_log": EVENTS}
_SOURCES = ("orders", "customer", "nation", "lineitem", "part", "documents", "embeddings", "events")


def oracle_tables(*names: str) -> str:
    """The logical tables as common table expressions over the star-schema tables."""
    bare = {s: s for s in _SOURCES}
    return ",\n".join(f"{n} AS ({(TABLES | MORE)[n].format(**bare)})" for n in names)


def _file_changes(lineitem: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of ``FILE_CHANGES``, with a path made once a part.

    One shuffle and sort by commit and path does for the sums, which hold no table of the paths, and for joins by commit.
    """
    rows = lineitem.join(paths, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("hash"), "path", "l_quantity")
    same = Window.partitionBy("hash", "path")
    sums = {"additions": F.sum("l_quantity").over(same).cast("long"), "deletions": F.count(F.lit(1)).over(same), "first": F.row_number().over(same.orderBy("path"))}
    return rows.repartition("hash").withColumns(sums).where("first = 1").select("hash", "path", "additions", "deletions")


@dataclass(frozen=True)
class Repo:
    """Fact and dimension tables of one history; everything else is derived lazily."""

    commits: DataFrame
    file_changes: DataFrame
    deletions: DataFrame
    renames: DataFrame
    release_tags: DataFrame
    symbols: DataFrame
    imports: DataFrame
    docs: DataFrame
    vectors: DataFrame
    listing: DataFrame
    sources: DataFrame
    event_log: DataFrame

    @classmethod
    def from_star_schema(cls, spark: SparkSession, sf_dir: str) -> Repo:
        views = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in _SOURCES}

        def table(text: str) -> DataFrame:
            return spark.sql(text, **{s: v for s, v in views.items() if "{" + s + "}" in text})

        tables = {name: table(text) for name, text in (TABLES | MORE).items() if name != "file_changes"}
        return cls(file_changes=_file_changes(views["lineitem"], table(f"SELECT p_partkey, {_PATH} AS path FROM {{part}}")), **tables)

    @cached_property
    def last(self) -> DataFrame:
        return self.commits.agg(F.max("ts").alias("last"))

    @cached_property
    def file_activity(self) -> DataFrame:
        return history.file_activity(self.commits, self.file_changes)

    @cached_property
    def file_authors(self) -> DataFrame:
        return history.file_authors(self.commits, self.file_changes)

    @cached_property
    def contributors(self) -> DataFrame:
        return history.contributor_stats(self.commits)

    @cached_property
    def coupling(self) -> DataFrame:
        return history.coupling_counts(self.file_changes)

    def coupled(self, least: int) -> DataFrame:
        """Pairs of at least so many common changes, for which rarely changed files aren't paired."""
        if "coupling" in self.__dict__:  # stored or worked out already
            return self.coupling.where(F.col("cochanges") >= least)
        return history.coupling_counts(self.file_changes, least=least)

    def stored(self, *names: str) -> Repo:
        """Write derived tables that a query reads more than once, each of which would be worked out anew otherwise."""
        for name in names:
            self.__dict__[name] = written(getattr(self, name), name)
        return self
