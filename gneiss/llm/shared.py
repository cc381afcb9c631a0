"""Tables written into the folder that all executors share, and other helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.session import made, release, shared_folder, written

__all__ = ["documents", "fresh", "hash_sample", "made", "present", "release", "shared_folder", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def present(df: DataFrame, *names: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & df[name].isNotNull()
    return condition


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, rows: int, counted: DataFrame) -> DataFrame:
    """The ``rows`` rows whose doc_id has the least 64-bit hashes, as far as a hash range expected to hold four times as many has them.

    The range keeps what one task has to sort from growing with the table.  ``counted`` has about as many rows as
    ``df``; where it asks nothing of the text, the text isn't read to be counted.  Ties go by the hash of the text.
    """
    share = min(1.0, 4 * rows / max(counted.count(), 1))
    top = min(int(share * 2**64) - 2**63, 2**63 - 1)
    h = F.xxhash64("doc_id")
    return df.where(h <= F.lit(top)).withColumn("h", h).orderBy("h", "doc_id", F.xxhash64("text")).limit(rows)
