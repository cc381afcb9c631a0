"""Pieces of files to embed (V1-V5, S10): whole files, declarations or Markdown sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions import predicates as P
from gneiss.operators import texts, vectors

MAX_FILES = 500
EXTENSIONS = "cjs go java js jsx md mjs py rs ts tsx".split()


def embeddable(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """(path, content, hash) of at most ``most`` files of known kinds, by path; the limit is the walk's own."""
    text = F.make_valid_utf8(F.col("content").cast("string")) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    known = files.where(P.extension(F.col("path")).isin(EXTENSIONS) & F.col("content").isNotNull() & ~P.is_noise(F.col("path")))
    return known.orderBy("path").limit(most).select("path", text.alias("content"), vectors.content_hash(F.col("content")).alias("hash"))


def chunks(files: DataFrame, symbols: DataFrame, granularity: str = "function") -> DataFrame:
    """V1: (path, chunk_index, kind, name, start_line, end_line, text) of (path, content).

    By file there is one chunk each.  By function, Markdown is cut at headings and code at its declarations, each of
    which reaches to the next; a file without any is one chunk.  Blank chunks are left out.
    """
    if granularity not in ("file", "function"):
        raise ValueError("granularity is file or function")
    count = F.size(F.split("content", "\n")).cast("long")
    whole = files.select("path", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(1).cast("long").alias("start_line"), count.alias("end_line"))
    if granularity == "file":
        spans = whole
    else:
        sections = texts.markdown_sections(files.where("path like '%.md'")).select("path", F.lit("doc-section").alias("kind"), "name", "start_line", "end_line")
        declared = symbols.where("role = 'definition' and kind not in ('field', 'property', 'enum-variant')").groupBy("path", "line").agg(F.min("name").alias("name"), F.min_by("kind", "name").alias("of"))
        following = F.lead("line").over(Window.partitionBy("path").orderBy("line")) - 1
        declared = declared.withColumn("next", following).join(files.select("path", count.alias("n")), "path")
        kind = F.when(F.col("of") == "function", "function").otherwise("type")
        parts = sections.unionByName(declared.select("path", kind.alias("kind"), "name", F.col("line").alias("start_line"), F.coalesce("next", "n").alias("end_line")))
        spans = parts.unionByName(whole.join(parts.select("path").distinct(), "path", "left_anti"))
    text = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    cut = spans.join(files.select("path", "content"), "path").withColumn("text", text).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    index = (F.row_number().over(Window.partitionBy("path").orderBy("start_line", "name")) - 1).cast("long")
    return cut.select("path", index.alias("chunk_index"), "kind", "name", "start_line", "end_line", "text")


def embedded(pieces: DataFrame, dim: int = 64, embed: Column | None = None) -> DataFrame:
    """V3 and V4: vectors of chunks; ``embed`` is any Column of the text, such as a pandas function over a model."""
    values = vectors.hashed_embedding(F.col("text"), dim) if embed is None else embed
    return pieces.select("path", "chunk_index", "kind", "name", "start_line", "end_line", vectors.truncated(values, dim).cast("array<float>").alias("values"))
