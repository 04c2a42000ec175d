"""What the operators share: staging in the shared folder, hashing, text words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space of the contracts: space, and tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset in local mode (tests), a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumagrid-"))
        known = spark.sparkContext.getCheckpointDir()
    return str(known).rstrip("/")


class Staging:
    """Tables written to the shared folder, so that lineage ends at files any executor can read.

    A result still reads some of them, so they are deleted when the driver ends (or before, by ``drop``).
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        # What was exchanged to make the table isn't needed once it is written.
        before = self.spark.conf.get(CLEANUP, None)
        if before is not None:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a staged table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the number as decimal text, modulo n (null for a null)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def learned_from(col: Column, n: int, out: int) -> Column:
    """False for rows of the held-out fold and for null ids."""
    return F.coalesce(crc_mod(col, n) != out, F.lit(False))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone; F.lower would also change other letters."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
