"""``parquet_metadata``: row groups and column chunks of Parquet files, read from their footers only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "filename string, row_group_id long, row_group_num_rows long, row_group_num_columns long, row_group_bytes long, column_id long, path_in_schema string, type string, num_values long, stats_null_count long, stats_min string, stats_max string, compression string, total_compressed_size long, total_uncompressed_size long"


def _chunks(path: str, meta) -> list[tuple]:
    out = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            stats = col.statistics if col.is_stats_set else None
            known = stats is not None and stats.has_min_max
            out.append((path, g, group.num_rows, group.num_columns, group.total_byte_size, c, col.path_in_schema, col.physical_type, col.num_values, stats.null_count if stats is not None and stats.has_null_count else None, str(stats.min) if known else None, str(stats.max) if known else None, col.compression, col.total_compressed_size, col.total_uncompressed_size))
    return out


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row to a column chunk; the footers are read by tasks, one file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def footers(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for p in batch.column(0).to_pylist():
                uri = "file://" + p[5:] if p.startswith("file:/") and not p.startswith("file://") else p
                store, inner = fs.FileSystem.from_uri(uri)
                with store.open_input_file(inner) as f:
                    rows = _chunks(p, pq.ParquetFile(f).metadata)
                names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
                kinds = [pa.int64() if x.strip().endswith("long") else pa.string() for x in SCHEMA.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(footers, SCHEMA)
