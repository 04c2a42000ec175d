"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every input partition is one run: its rows of (digest, witness, id), sorted by digest when they are staged. In each
round the runs whose number agrees after dropping ``FAN_BITS`` binary digits are merged, FAN_BITS binomial levels at
once. A round is a sort-based aggregation on both sides of one exchange (the minimum is that of a struct, which has no
hash form): each task walks its sorted run and sends one row for each of its digests, so a text that makes up a third
of the rows is one row a task; the receiving side merges what arrives in the order of digests and keeps the smallest
id. A round is spread over digests: also the last merge, to a single run, uses all tasks. There are
ceil(log2(runs) / FAN_BITS) rounds, of some 70 bytes for each distinct digest of a run; texts are never exchanged.

Verification: a run's key is (sha256, byte length) of the normalised text; each row also carries a hash of another
family as a witness, and at every level a merge in which witnesses differ is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Staging
from .joins import join_hot

#: Binomial levels that one merge does (it merges up to 2 ** FAN_BITS runs).
FAN_BITS = 4

KEY = ["__sha", "__bytes"]


def _digested(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the key of the normalised text and its witness."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_CLASS, " ")
    return docs.withColumn("__text", text).withColumns({"__sha": F.unhex(F.sha2(F.col("__text").cast("binary"), 256)), "__bytes": F.octet_length("__text").cast("long"), "__witness": F.xxhash64("__text")}).drop("__text")


def merge_runs(runs: DataFrame, highest: int) -> DataFrame:
    """(__run, key, __witness, __id, __n) -> one row per key: (key, __keep, __group); runs are numbered up to highest."""
    while True:
        highest >>= FAN_BITS
        smallest = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id")))
        runs = (
            runs.withColumn("__run", F.shiftright("__run", FAN_BITS))
            .groupBy("__run", *KEY)
            .agg(smallest.alias("__least"), F.sum("__n").alias("__n"), F.min("__witness").alias("__witness"), F.max("__witness").alias("__other"))
            .select("__run", *KEY, F.expr("IF(__witness = __other, __witness, CAST(raise_error('different texts have one digest') AS LONG))").alias("__witness"), F.col("__least.id").alias("__id"), "__n")
        )
        if highest == 0:
            return runs.select(*KEY, F.when(F.col("__witness").isNotNull(), F.col("__id")).alias("__keep"), F.col("__n").alias("__group"))


def _merged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(staged sorted runs of (__id, key), staged groups, number of rows)."""
    store = Staging(docs.sparkSession, "exact")
    rows = _digested(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t").select("__id", *KEY, "__witness", F.spark_partition_id().alias("__run"))
    rows = store.put(rows.sortWithinPartitions(*KEY))
    highest, total = rows.agg(F.max("__run"), F.count("*")).first()
    return rows, store.put(merge_runs(rows.withColumn("__n", F.lit(1).cast("long")), highest or 0)), total


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal if identical after each run of white space became one
    space. A null id never stays while its group has another id. Rows that repeat an id and its text all
    say kept (they are one document); other columns are ignored. An empty table gives no rows.
    """
    rows, groups, total = _merged(docs, id_col, text_col)
    return join_hot(rows.select("__id", *KEY), groups, KEY, F.col("__group"), total).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__group").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group of equal texts the row with the smallest id.

    Ids needn't be unique: a row stays by its own text. Of rows that repeat id and (normalised) text, any one stays.
    """
    rows, groups, _ = _merged(docs, id_col, text_col)
    there, distinct = rows.count(), groups.count()
    if there == distinct:
        return docs
    stays = groups.select(F.col("__sha").alias("__k1"), F.col("__bytes").alias("__k2"), "__keep")
    keyed = _digested(docs, text_col).drop("__witness")
    kept = keyed.join(stays, (F.col("__sha") == F.col("__k1")) & (F.col("__bytes") == F.col("__k2")) & F.col(id_col).eqNullSafe(F.col("__keep")), "left_semi")
    repeated = rows.groupBy("__id", *KEY).count().filter("count > 1").limit(1).count()
    kept = kept.dropDuplicates(KEY) if repeated else kept
    return kept.select(*docs.columns)
