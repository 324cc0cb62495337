"""Operator 4: exact duplicates by progressive refinement.

Normalised texts (A-Z lower-cased, nothing else) are grouped by byte length, then by length and a
hash of their first ``PREFIX`` characters, and only rows of groups that still hold several are hashed
in full.  What is grouped are keys and hashes of a few bytes: texts never move.  Which rows are read
again for their full hash is told to the scan by their keys (``common.picked``).  Groups are counted
with partial aggregation, and groups with a large share of the rows meet them by broadcast (fewer than
1,000).

Cases: a null text counts as empty; very long texts are hashed as a stream of bytes; of equal texts
the row with the largest id stays (a null id is less than any other).  Rows are told apart by a key of
their own, so an id may repeat, with equal or different texts: of repeated rows ``drop_duplicates``
keeps one, and in ``exact_groups``, where ids name rows, all rows with the largest id count as kept.
An empty table gives no row; other columns are pruned, and kept by ``drop_duplicates``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, bounded_batches, id_and_text, join_groups, keyed, picked, work_dir, written

PREFIX = 256


def _group() -> Column:
    """A number for the byte length and the prefix; two groups that share it cost a needless hash and no error."""
    return F.xxhash64(F.octet_length("_text"), ascii_lower(F.substring("_text", 1, PREFIX)))


def _full(rows: DataFrame) -> DataFrame:
    """Adds the full hash of (.., raw) as ``sha``, in place of ``raw``."""
    schema = rows.drop("raw").schema.add("sha", "string")

    def run(batches):
        for batch in batches:
            sha = [hashlib.sha256(x.as_buffer().to_pybytes().lower()).hexdigest() for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sha, pa.string())], names=[*batch.schema.names[:-1], "sha"])

    return rows.mapInArrow(run, schema)


def refined(measured: DataFrame) -> DataFrame:
    """The rows of (_row, _id, g, ..) with ``several``: whether others share their length and prefix.

    Both refinements take one pass: a length that occurs once is a group of one as well.
    """
    groups = measured.groupBy("g").agg(F.count("*").alias("g_rows")).where("g_rows > 1").withColumnRenamed("g", "g_g")
    return join_groups(measured, "g", groups, "g_g", "g_rows").select(*measured.columns, F.col("g_rows").isNotNull().alias("several"))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Each row of (_row, _id, sha) with keep_id, keep_row and group_size."""
    least = -(1 << 63)
    groups = rows.groupBy("sha").agg(F.max("_id").alias("keep_id"), F.max_by("_row", F.coalesce("_id", F.lit(least))).alias("keep_row"), F.count("*").alias("group_size")).where("group_size > 1")
    found = join_groups(rows, "sha", groups.withColumnRenamed("sha", "g_sha"), "g_sha", "group_size")
    alone = F.col("g_sha").isNull()
    return found.select(
        "_row", "_id", "sha",
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_row", "_row").alias("keep_row"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    As the result holds every row's hash, all rows are hashed in the pass that measures them; rows that
    are alone with their length and prefix pass by the groups of full hashes.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    bounded_batches(spark)
    rows = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("_row"), "_id", _group().alias("g"), F.col("_text").cast("binary").alias("raw"))
    measured = written(refined(written(_full(rows), folder, "measured")), folder, "refined")
    groups = duplicate_groups(measured.where("several").drop("several", "g"))
    lone = measured.where("not several").select("_row", "_id", "sha", F.col("_id").alias("keep_id"), F.col("_row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    return groups.unionByName(lone).select(F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    bounded_batches(spark)
    rows, own = keyed(docs, folder)
    named = lambda df: df.select(df[own].alias("_row"), df[id_col].cast("long").alias("_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("_text"))
    measured = written(named(rows).select("_row", "_id", _group().alias("g")), folder, "measured")
    several = refined(measured).where("several").select("_row")
    again = picked(rows.select(own, id_col, text_col), own, several, folder, "several")
    hashed = written(_full(named(again).select("_row", "_id", F.col("_text").cast("binary").alias("raw"))), folder, "hashed")
    gone = duplicate_groups(hashed).where("_row <> keep_row").select("_row")
    return picked(rows, own, gone, folder, "gone", but=True).drop(own)
