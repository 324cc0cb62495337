"""Shared plumbing: the shared working folder, written tables, bounded Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most, so that a Python worker's memory doesn't follow the text lengths.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a temporary folder takes its place in local mode (tests); on a cluster
    that is an error, as executors would write elsewhere.  No setting of the session is changed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of the shared folder that no later plan reads."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; a lower setting of the user's stays."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


_worker: tuple[str, dict] = ("", {})


def worker_cache(owner: str) -> dict:
    """What ``owner`` keeps in this Python worker from task to task.

    Workers outlive a stage and then serve another operator's: whoever asks first makes the worker let go of what the
    last one kept, so that the caches of a chain of operators don't add up.
    """
    global _worker
    if _worker[0] != owner:
        _worker = (owner, {})
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _worker[1]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, under internal names; a null text counts as empty.

    Extra columns, whatever they are called, are pruned here and so can't clash.
    """
    return docs.select(
        docs[id_col].cast("long").alias("_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"),
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(names: list[str]) -> str:
    """A column name that none of ``names`` clashes with."""
    return "_" + "_".join(names)


def keyed(docs: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """``docs`` written with a key to each row, and the key's name.

    The key holds the writing task's number in its upper bits and the row's place there in the lower 33;
    once written it stays, whatever is read again.
    """
    own = fresh(docs.columns)
    return written(docs.withColumn(own, F.monotonically_increasing_id()), folder, "keyed"), own


def picked(rows: DataFrame, own: str, some: DataFrame, folder: str, name: str, but: bool = False) -> DataFrame:
    """The rows of a ``keyed`` table whose key is in the one column of ``some`` (or, with ``but``, isn't).

    The keys are written to a folder for each task number, and who reads rows of that number reads the
    folder: each row meets its own part's keys alone.  Nothing is broadcast, and no row of the table moves.
    """
    spark, part = rows.sparkSession, 33
    path = f"{folder}/{name}"
    keys = some.toDF("key").withColumn("part", F.shiftright("key", part))
    # all keys of a part come together: as many as a task wrote rows
    keys.repartition("part").sortWithinPartitions("part").write.partitionBy("part").option("compression", "zstd").parquet(path)
    at = rows.columns.index(own)

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = file_system(path)
        held: dict[int, np.ndarray] = {}

        def keys_of(number: int) -> np.ndarray:
            if number not in held:
                if len(held) > 8:
                    held.clear()
                files = store.get_file_info(fs.FileSelector(f"{root}/part={number}", allow_not_found=True))
                read = [pq.read_table(f.path, filesystem=store, columns=["key"], partitioning=None).column("key").to_numpy() for f in files if f.path.endswith(".parquet")]
                held[number] = np.sort(np.concatenate(read)) if read else np.empty(0, np.int64)
            return held[number]

        for batch in batches:
            key = batch.column(at).to_numpy()
            hit = np.zeros(len(key), bool)
            for number in np.unique(key >> part).tolist():
                own_keys, mine = keys_of(number), key >> part == number
                place = np.searchsorted(own_keys, key[mine])
                hit[mine] = (place < len(own_keys)) & (own_keys[np.minimum(place, len(own_keys) - 1)] == key[mine]) if len(own_keys) else False
            yield batch.filter(pa.array(hit != but))

    return rows.mapInArrow(run, rows.schema)


def file_system(uri: str):
    """Any store that pyarrow knows (file, hdfs, s3, gs) and the path there, by its address."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri if uri.startswith("/") else uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


#: Keys with over this share of all rows are hot; there are fewer than its inverse of them.
HOT_SHARE = 1 / 1000


def join_groups(rows: DataFrame, key: str, groups: DataFrame, group_key: str, size: str) -> DataFrame:
    """Left join of a written table's rows to the groups they form, ``size`` being a group's count of rows.

    Hot groups, fewer than 1,000 by arithmetic, are broadcast, so that one key with a large share of all
    rows doesn't meet in one task; all others meet by shuffle.
    """
    most = rows.count() * HOT_SHARE
    hot = rows.join(F.broadcast(groups.where(F.col(size) > most)), F.col(key) == F.col(group_key), "left")
    cold = hot.where(F.col(group_key).isNull()).select(*rows.columns).join(groups.where(F.col(size) <= most), F.col(key) == F.col(group_key), "left")
    return hot.where(F.col(group_key).isNotNull()).unionByName(cold)
