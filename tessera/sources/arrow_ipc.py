"""Arrow IPC files as a Python data source: one partition to a file, batches straight to Spark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, inner = _store(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        return [inner]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.rsplit(".", 1)[-1] in ("arrow", "ipc", "feather"))


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def partitions(self):
        return [OneFile(f) for f in _files(self.path)]

    def read(self, partition):
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as f:
            reader = pa.ipc.open_file(f)
            for k in range(reader.num_record_batches):
                yield reader.get_batch(k).select(self.names)


class ArrowWriter(DataSourceArrowWriter):
    """Each task writes one file under a name of its own."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        import uuid

        store, inner = _store(self.path)
        store.create_dir(inner, recursive=True)
        out = None
        name = f"{inner}/part-{uuid.uuid4().hex}"
        with store.open_output_stream(name + ".tmp") as f:
            for batch in iterator:
                out = out or pa.ipc.new_file(f, batch.schema)
                out.write_batch(batch)
            if out:
                out.close()
        if out:
            store.move(name + ".tmp", name + ".arrow")
        else:
            store.delete_file(name + ".tmp")
        return WriterCommitMessage()


class ArrowSource(DataSource):
    @classmethod
    def name(cls):
        return "arrow_ipc"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        store, _ = _store(self.options["path"])
        with store.open_input_file(_files(self.options["path"])[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema):
        return ArrowReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        if overwrite:
            store, inner = _store(self.options["path"])
            store.create_dir(inner, recursive=True)
            store.delete_dir_contents(inner)
        return ArrowWriter(self.options["path"])


def read_arrow(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(ArrowSource)
    reader = spark.read.format("arrow_ipc")
    return (reader.schema(schema) if schema else reader).load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    from pyspark.sql import Observation

    df.sparkSession.dataSource.register(ArrowSource)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("arrow_ipc").mode(mode).save(path)
    return seen.get["n"]
