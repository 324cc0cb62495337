"""Readers and writers of files: Parquet, CSV, NDJSON, ORC, text, Avro (where its package is there) and Arrow IPC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Options of the engine by Spark's.
CSV = {"has_header": "header", "delimiter": "sep", "quote": "quote", "escape": "escape", "comment": "comment", "newlines_in_values": "multiLine", "null_value": "nullValue", "compression": "compression", "terminator": "lineSep", "date_format": "dateFormat", "timestamp_format": "timestampFormat"}
CODECS = {"gzip": "gzip", "gz": "gzip", "bzip2": "bzip2", "bz2": "bzip2", "zstd": "zstd", "uncompressed": "none", "snappy": "snappy", "lz4": "lz4", "zstd(3)": "zstd"}


def form_of(path: str) -> str:
    """The format by a file's extension; a compression suffix is passed over."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix in (".gz", ".bz2", ".zst", ".zstd"):
        name = name.removesuffix(suffix)
    form = name.rsplit(".", 1)[-1] if "." in name else "parquet"
    return {"ndjson": "json", "jsonl": "json", "feather": "arrow", "ipc": "arrow", "tsv": "csv", "txt": "text"}.get(form, form)


def read(spark: SparkSession, path: str, form: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """A table of files; hive-style partition folders become columns, files of other schemas are filled with NULL."""
    form = (form or form_of(path)).lower().replace("ndjson", "json")
    if form == "arrow":
        from tessera.sources.arrow_ipc import read_arrow

        return read_arrow(spark, path, schema)
    reader = spark.read.format(form)
    if schema:
        reader = reader.schema(schema)
    null_regex = options.pop("null_regex", None)
    if form == "csv":
        options.setdefault("has_header", "true")
        if not schema:
            reader = reader.option("inferSchema", "true")
        limit = int(options.pop("schema_infer_max_rec", 0) or 0)
        if limit and not schema:  # names and types from the first rows alone
            first = spark.createDataFrame(spark.read.text(path).limit(limit + 1).collect(), "value string")
            guess = spark.read.option("inferSchema", "true").options(**{CSV.get(k, k): v for k, v in options.items() if k != "compression"})
            reader = reader.schema(guess.csv(first).schema)
    if form == "parquet" and not schema:
        reader = reader.option("mergeSchema", str(options.pop("merge_schema", "false")))
    for key, value in options.items():
        if key == "compression":
            continue  # readers go by the extension
        reader = reader.option(CSV.get(key, key), value)
    df = reader.load(path)
    if null_regex:  # texts that match stand for NULL
        df = df.select(*(F.when(F.col(f"`{c}`").rlike(null_regex), None).otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))
    return df


def write(df: DataFrame, path: str, form: str, partition_by: list[str] | None = None, mode: str = "overwrite", **options) -> int:
    """Write and return the number of rows, observed while they are written."""
    from pyspark.sql import Observation

    form = form.lower().replace("ndjson", "json")
    if form == "arrow":
        from tessera.sources.arrow_ipc import write_arrow

        return write_arrow(df, path, mode)
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.format(form).mode(mode)
    if form == "parquet":
        options.setdefault("compression", "zstd")
    if form == "csv":
        options.setdefault("has_header", "true")
    for key, value in options.items():
        key = key.split("::")[0]
        if key == "compression":
            value = CODECS.get(str(value).lower(), value)
        elif key in ("max_rows_per_file", "soft_max_rows_per_output_file"):
            key = "maxRecordsPerFile"
        writer = writer.option(CSV.get(key, key) if form == "csv" else key, value)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return seen.get["n"]
