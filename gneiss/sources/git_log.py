"""Python data source of a git history (S1-S7): a row a commit and changed file, read through the git command.

Merges are skipped; ``since`` is an exclusive lower bound.  Commits are planned into ranges of the walk, each read by a
task of its own.  As a stream, the offset is the hash of the last commit that was read.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "seq long, hash string, author_name string, author_email string, ts timestamp, message string, status string, path string, old_path string, additions long, deletions long"
RANGE = 500
_FORMAT = "--format=%x01%H%x00%an%x00%ae%x00%ct%x00%B%x02"


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def head(root: str) -> str:
    return git(root, "rev-parse", "HEAD").strip()


def is_shallow(root: str) -> bool:
    return git(root, "rev-parse", "--is-shallow-repository").strip() == "true"


def has_commit(root: str, commit: str) -> bool:
    """Whether the object database has the commit; it needn't be an ancestor of HEAD."""
    return subprocess.run(["git", "-C", root, "cat-file", "-e", f"{commit}^{{commit}}"], capture_output=True, check=False).returncode == 0


def walk(root: str, since: str | None = None, until: str = "HEAD", most: int = 0) -> list[str]:
    """Commits that aren't merges, the newest ``most`` of them if it isn't 0."""
    return git(root, "rev-list", "--topo-order", "--no-merges", *([f"--max-count={most}"] if most else []), until, *([f"^{since}"] if since else [])).split()


@dataclass
class CommitRange(InputPartition):
    first: int
    hashes: list[str]


def _commit(text: str, first: int, order: dict[str, int]) -> Iterator[tuple]:
    head_part, _, diff = text.partition("\x02")
    sha, name, mail, seconds, message = head_part.split("\0", 4)
    base = (first + order[sha], sha, name, mail, datetime.fromtimestamp(int(seconds), UTC), message.strip())
    stats: dict[str, list] = {}
    fields = [f.lstrip("\n") for f in diff.split("\0")]
    i = 0
    while i < len(fields):
        f = fields[i]
        if f.startswith(":"):
            status = f.rsplit(" ", 1)[-1][:1]
            if status in "RC":
                stats[fields[i + 2]] = [status, fields[i + 2], fields[i + 1], 0, 0]
                i += 3
            else:
                stats[fields[i + 1]] = [status, fields[i + 1], None, 0, 0]
                i += 2
        elif f.count("\t") == 2:
            added, deleted, path = f.split("\t")
            if path:
                i += 1
            else:
                path, i = fields[i + 2], i + 3
            if path in stats:
                stats[path][3:] = [int(added) if added != "-" else 0, int(deleted) if deleted != "-" else 0]
        else:
            i += 1
    if not stats:
        yield (*base, None, None, None, None, None)
    for row in stats.values():
        yield (*base, *row)


def _read(root: str, part: CommitRange, renames: bool) -> Iterator[tuple]:
    if not part.hashes:
        return
    asked = "\n".join(part.hashes).encode()
    done = subprocess.run(["git", "-C", root, "log", "--no-walk=unsorted", "--stdin", "--root", "-z", "--raw", "--numstat", "-M" if renames else "--no-renames", _FORMAT], input=asked, capture_output=True, check=True)
    order = {h: i for i, h in enumerate(part.hashes)}
    for text in done.stdout.decode("utf-8", "replace").split("\x01")[1:]:
        yield from _commit(text, part.first, order)


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.since = options["path"].removeprefix("file://"), options.get("since") or None
        self.renames, self.most = options.get("renames", "false").lower() == "true", int(options.get("maxcommits", 0))

    def partitions(self) -> list[CommitRange]:
        hashes = walk(self.root, self.since, most=self.most)
        return [CommitRange(i, hashes[i : i + RANGE]) for i in range(0, len(hashes), RANGE)] or [CommitRange(0, [])]

    def read(self, partition: CommitRange) -> Iterator[tuple]:
        yield from _read(self.root, partition, self.renames)


class GitStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.renames = options["path"].removeprefix("file://"), options.get("renames", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {"sha": ""}

    def latestOffset(self) -> dict:
        return {"sha": head(self.root)}

    def partitions(self, start: dict, end: dict) -> list[CommitRange]:
        hashes = walk(self.root, start["sha"] or None, end["sha"])
        return [CommitRange(i, hashes[i : i + RANGE]) for i in range(0, len(hashes), RANGE)] or [CommitRange(0, [])]

    def read(self, partition: CommitRange) -> Iterator[tuple]:
        yield from _read(self.root, partition, self.renames)

    def commit(self, end: dict) -> None:
        pass


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gneiss_git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return GitReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GitStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    import gneiss.sources.git_log as module

    cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(GitSource)


def read_log(spark: SparkSession, root: str, since: str | None = None, renames: bool = False, max_commits: int = 0) -> DataFrame:
    """One row a commit and file; a commit without files has one row with a null path."""
    register(spark)
    return spark.read.format("gneiss_git_log").option("since", since or "").option("renames", str(renames).lower()).option("maxCommits", str(max_commits)).load(root)


def commits(log: DataFrame) -> DataFrame:
    """S3: (hash, author_name, author_email, ts, subject, body, trailers, seq)."""
    rows = log.dropDuplicates(["hash"])
    paragraphs = F.split("message", r"\n[ \t]*\n")
    last = F.split(F.element_at(paragraphs, -1), "\n")
    trailer = F.filter(last, lambda x: x.rlike(r"^[A-Za-z0-9 -]+: .+$"))
    body = F.regexp_replace(F.regexp_replace("message", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")
    some = (F.size(paragraphs) > 1) & (F.size(trailer) == F.size(last))
    return rows.select("hash", "author_name", "author_email", "ts", F.regexp_extract("message", r"^([^\n]*)", 1).alias("subject"), body.alias("body"), F.when(some, trailer).otherwise(F.array().cast("array<string>")).alias("trailers"), "seq")


def file_changes(log: DataFrame) -> DataFrame:
    """(hash, path, additions, deletions)."""
    return log.where("path is not null").select("hash", "path", "additions", "deletions")


def deletions(log: DataFrame) -> DataFrame:
    """(path, commit, ts), of a log read without renames, so that a rename is a deletion too."""
    return log.where("status = 'D'").select("path", F.col("hash").alias("commit"), "ts")


def renames(log: DataFrame) -> DataFrame:
    """(old_path, new_path, commit, ts), of a log read with renames."""
    return log.where("status = 'R'").select("old_path", F.col("path").alias("new_path"), F.col("hash").alias("commit"), "ts")


def status(root: str, analyzed: str | None) -> str:
    """Valid, stale, or invalid where the mark is unknown to the history."""
    if not analyzed or not has_commit(root, analyzed):
        return "invalid"
    return "valid" if head(root) == analyzed else "stale"
