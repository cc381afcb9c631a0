"""Entry points of a project (C17): manifests, conventional files, framework configurations and ``main`` functions.

Manifests are parsed on the executors; everything else is joins and filters of the listing.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import predicates as P

MAX_DEPTH = 8
KINDS = ("binary", "main", "npm-script", "framework-config")
_CONFIGS = "astro ava babel cypress drizzle esbuild eleventy ember-cli-build eslint expo gatsby-config gridsome gulpfile hardhat jest karma knexfile metro next nuxt playwright postcss prettier quasar react-router remix rollup rspack rsbuild snowpack storybook svelte tailwind truffle tsup unocss vite vitest vue webpack wxt".split()
FRAMEWORK_CONFIG = r"(?:^|/)(?:(?:" + "|".join(_CONFIGS) + r")(?:\.config)?|gatsby-(?:node|browser|ssr)|conftest|manage|wsgi|asgi|setup|noxfile|docusaurus\.config)\.(?:[cm]?[jt]s|py)$"
_SCHEMA = "path string, line long, kind string, name string"


def _cargo(folder: str, text: str) -> Iterator[tuple]:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    at = f"{folder}/" if folder else ""
    name = data.get("package", {}).get("name")
    for b in data.get("bin", []):
        if isinstance(b, dict) and b.get("name"):
            yield at + b.get("path", f"src/bin/{b['name']}.rs"), None, "binary", b["name"]
    if name and not data.get("bin"):
        yield at + "src/main.rs", None, "binary", name


def _npm(text: str) -> Iterator[tuple]:
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        return
    bins = data.get("bin") if isinstance(data, dict) else None
    if isinstance(bins, str):
        yield bins.removeprefix("./"), None, "binary", data.get("name", "bin")
    elif isinstance(bins, dict):
        yield from ((str(v).removeprefix("./"), None, "binary", k) for k, v in bins.items())
    scripts = data.get("scripts") if isinstance(data, dict) else None
    for k in scripts if isinstance(scripts, dict) else ():
        yield "package.json", None, "npm-script", k


def _pyproject(text: str) -> Iterator[tuple]:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    for table in (data.get("project", {}).get("scripts", {}), data.get("tool", {}).get("poetry", {}).get("scripts", {})):
        yield from (("pyproject.toml", None, "binary", k) for k in table)


_MEMBERS = "kind string, folder string"


def workspace_members(root_manifest: str) -> list[tuple[str, str]]:
    """(``=``, folder) of a member and (``*``, folder) for all folders in one, of the workspace and the root crate itself."""
    out = [("=", "")]
    try:
        wanted = tomllib.loads(root_manifest).get("workspace", {}).get("members", [])
    except tomllib.TOMLDecodeError:
        return out
    for w in (str(w).rstrip("/").removeprefix("./") for w in wanted):
        folder, _, last = w.rpartition("/")
        if last == "*" and "*" not in folder:
            out.append(("*", folder))
        elif "*" not in w:
            out.append(("=", w))
    return out


def crates_of(contents: DataFrame, folders: DataFrame) -> DataFrame:
    """(crate) of the folders (crate) that the root manifest makes part of its workspace; none without such a manifest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([m for text in b["content"] for m in workspace_members(text)], columns=["kind", "folder"])

    members = contents.where("path = 'Cargo.toml' and content is not null").select("content").mapInPandas(run, _MEMBERS)
    whole, inside = F.struct(F.lit("=").alias("kind"), F.col("crate").alias("folder")), F.struct(F.lit("*").alias("kind"), P.parent_dir(F.col("crate")).alias("folder"))
    keyed = folders.select("crate", F.explode(F.when(F.col("crate") == "", F.array(whole)).otherwise(F.array(whole, inside))).alias("k")).select("crate", "k.kind", "k.folder")
    return keyed.join(members, ["kind", "folder"], "left_semi").select("crate").distinct()


def manifest_entries(files: DataFrame) -> DataFrame:
    """Entry points that manifests among (path, content) declare; a guessed path counts only if the listing has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, text in zip(b["path"], b["content"], strict=True):
                folder, _, name = path.rpartition("/")
                rows += _cargo(folder, text) if name == "Cargo.toml" else _npm(text) if path == "package.json" else _pyproject(text) if path == "pyproject.toml" else []
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "name"]).astype({"line": "Int64"})

    manifests = files.where(F.col("path").isin("package.json", "pyproject.toml") | F.col("path").rlike(r"(?:^|/)Cargo\.toml$")).where("content is not null")
    return manifests.select("path", "content").mapInPandas(run, _SCHEMA)


def entry_points(listing: DataFrame, contents: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(path, line, kind, name), once each, by kind, path and name."""
    near = listing.select("path").distinct().where((F.size(F.split("path", "/")) <= MAX_DEPTH) & ~P.is_noise(F.col("path")))
    none = F.lit(None).cast("long").alias("line")
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    cargo, folder = F.col("path").rlike(r"(?:^|/)Cargo\.toml$"), P.parent_dir(F.col("path"))
    crates = crates_of(contents, near.select("path").unionByName(contents.select("path")).where(cargo).select(folder.alias("crate")).distinct())
    ours = contents.where(cargo).withColumn("crate", folder).join(crates, "crate", "left_semi").select(*contents.columns)
    declared = manifest_entries(contents.where(~cargo).unionByName(ours))
    there = declared.where("path like '%.rs'").join(near, "path", "left_semi").unionByName(declared.where("path not like '%.rs'"))
    auto = near.where(F.col("path").rlike(r"(?:^|/)(?:src/bin|tests|benches|examples)/(?:[^/]+\.rs|[^/]+/main\.rs)$"))
    auto = auto.withColumn("crate", F.regexp_replace("path", r"/?(?:src/bin|tests|benches|examples)/(?:[^/]+\.rs|[^/]+/main\.rs)$", "")).join(crates, "crate", "left_semi")
    name = F.when(stem == "main", F.regexp_extract("path", r"([^/]*)/main\.rs$", 1)).otherwise(stem)
    autos = auto.select("path", none, F.lit("binary").alias("kind"), name.alias("name"))
    mains = near.where(F.col("path").rlike(r"(?:^|/)__main__\.py$")).select("path", none, F.lit("main").alias("kind"), F.when(P.parent_dir(F.col("path")) == "", "__main__").otherwise(F.regexp_extract("path", r"([^/]*)/__main__\.py$", 1)).alias("name"))
    configs = near.where(F.col("path").rlike(FRAMEWORK_CONFIG)).select("path", none, F.lit("framework-config").alias("kind"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    found = there.unionByName(autos).unionByName(mains).unionByName(configs)
    if symbols is not None:
        main = symbols.where("role = 'definition' and name = 'main' and kind = 'function'")
        found = found.unionByName(main.select("path", "line", F.lit("main").alias("kind"), "name"))
    once = found.groupBy("kind", "path", "name").agg(F.min("line").alias("line")).select("path", "line", "kind", "name")
    return once.orderBy(F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")), "path", "name")
