"""Operator 1: token ids in seekable Zstandard shards.

Each shard is a plain Zstandard stream of independent frames, one to a document (a document of more
than ``FRAME_TOKENS`` ids takes several), followed by two skippable frames: a document index and, last
in the file, the seek table of the public "zstd seekable format" (compressed size, decompressed size
and the low 32 bits of XXH64 of each frame).  A reader takes the seek table from the end of the file,
finds the index after the frames (their sizes add up to its place), looks a document up there and
decompresses only that document's frames; every frame's checksum is verified.

Texts are encoded where they lie and the ids written to the shared folder; one range exchange of the
ids, about a third of the texts' bytes, then puts them in order.  Equal ids are told apart by a hash of
the token ids and the place of encoding, so that an id with many rows is split over shards as well.

Cases: a null text counts as empty and yields only the end id; very long texts take several frames;
rows with equal ids (repeated rows, or different texts) are each written, in the order of their hashes;
rows with a null id are written first; an empty table gives no shard and no row; other columns are
pruned.  No other ties arise.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, clear, file_system, id_and_text, work_dir, written
from tessera.llm.segments import encoded_batches

# Fixed values of the Zstandard and zstd seekable formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_TOKENS = 1 << 20

_INDEX = np.dtype([("doc", "<i8"), ("null", "u1"), ("start", "<i8"), ("tokens", "<i8"), ("frame", "<i8"), ("frames", "<i8")])
MANIFEST = "shard int, path string, docs long, tokens long"


class ShardWriter:
    """Writes one shard; the final name appears only once the file is whole."""

    def __init__(self, uri: str, attempt: str, width: int, level: int = 3):
        import zstandard

        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temporary = f"{self.path}.{attempt}.part"
        self.out = self.fs.open_output_stream(self.temporary)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.width, self.frames, self.index, self.tokens = width, [], [], 0

    def add(self, doc: int | None, ids: bytes) -> None:
        import xxhash

        n, first = len(ids) // self.width, len(self.frames)
        for at in range(0, max(len(ids), 1), FRAME_TOKENS * self.width):
            raw = ids[at : at + FRAME_TOKENS * self.width]
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((doc or 0, doc is None, self.tokens, n, first, len(self.frames) - first))
        self.tokens += n

    def close(self) -> None:
        index = self.zstd.compress(np.array(self.index, _INDEX).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 1) + bytes([self.width]) + index)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.path)

    def abandon(self) -> None:
        """Remove what a failed attempt has written."""
        self.out.close()
        self.fs.delete_file(self.temporary)


class ShardReader:
    """Random access to one shard."""

    def __init__(self, uri: str):
        import zstandard

        self.fs, self.path = file_system(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        self.zstd = zstandard.ZstdDecompressor()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9)) if size > 17 else (0, 0, 0)
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = size - 17 - 12 * count
        self.frames = np.frombuffer(self.file.read_at(12 * count, table + 8), "<u4").reshape(-1, 3)
        at = int(self.frames[:, 0].sum(dtype=np.int64))
        tail = self.file.read_at(table - at, at)
        magic, n = struct.unpack_from("<II", tail)
        if magic != SKIPPABLE_INDEX or n + 8 != len(tail):
            raise ValueError(f"{uri} isn't a token shard")
        self.width = tail[8]
        self.index = np.frombuffer(self.zstd.decompress(tail[9:]), _INDEX)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])

    def ids(self, row: int) -> np.ndarray:
        """The ids of the index's row ``row``, from its own frames alone."""
        import xxhash

        entry, raw = self.index[row], []
        for k in range(entry["frame"], entry["frame"] + entry["frames"]):
            part = self.zstd.decompress(self.file.read_at(int(self.frames[k, 0]), int(self.offsets[k])), max_output_size=int(self.frames[k, 1]) or 1)
            if len(part) != self.frames[k, 1] or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"{self.path}: frame {k} is damaged")
            raw.append(part)
        return np.frombuffer(b"".join(raw), f"<u{self.width}")

    def rows_of(self, doc: int) -> list[int]:
        return np.flatnonzero((self.index["doc"] == doc) & (self.index["null"] == 0)).tolist()


_ENCODED = "_id long, ids binary, width int, h long, part int, at long"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents in ascending id order over the shards; returns the shards' manifest.

    Each task of the range exchange sorts (spilling) and writes one shard.  A task that runs again
    writes the same bytes under the same name.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or work_dir(spark)

    def encode(batches):
        import xxhash

        part, at = TaskContext.get().partitionId(), 0
        for keys, enc, texts in encoded_batches(batches, tokenizer_path, end_id):
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            n, at = len(keys), at + len(keys)
            same = [pa.array(np.full(n, v, np.int32)) for v in (enc.dtype.itemsize, part)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.binary()), same[0], pa.array(hashes), same[1], pa.array(np.arange(at - n, at))], names=["_id", "ids", "width", "h", "part", "at"])

    def write(batches):
        task = TaskContext.get()
        uri, out = f"{folder}/shard-{task.partitionId():06d}.zst", None
        try:
            for batch in batches:
                keys, texts, widths = (c.to_pylist() for c in batch.columns[:3])
                if keys:
                    out = out or ShardWriter(uri, str(task.taskAttemptId()), widths[0])
                for key, ids in zip(keys, texts):
                    out.add(key, ids)
        except BaseException:
            if out:
                out.abandon()
            raise
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [uri], "docs": [len(out.index)], "tokens": [out.tokens]})

    encoded = written(id_and_text(docs, id_col, text_col).mapInArrow(encode, _ENCODED), folder, "encoded")
    order = ("_id", "h", "part", "at")
    manifest = written(encoded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST), folder, "manifest")
    clear(spark, folder, "encoded")
    return manifest


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read all documents back: id, ids before it, ids (as array) through the seek tables."""
    return _read(manifest, "_id long, start long, ids array<long>", lambda key, start, ids: {"_id": key, "start": start, "ids": ids.astype(np.int64)})


def token_file_digest(manifest: DataFrame) -> DataFrame:
    """As ``read_token_files``, with the count and CRC-32 (of 32-bit little-endian ids) in place of the ids."""
    return _read(manifest, "_id long, start long, n_tokens long, ids_crc32 long", lambda key, start, ids: {"_id": key, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})


def _read(manifest: DataFrame, schema: str, row) -> DataFrame:
    spark = manifest.sparkSession
    # one row to a shard: prefix sums over the shards' totals give each its first position
    starts = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("path", F.coalesce(starts, F.lit(0)).alias("base"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                reader = ShardReader(shard["path"])
                rows, held = [], 0
                for k, entry in enumerate(reader.index):
                    ids = reader.ids(k)
                    rows.append(row(None if entry["null"] else int(entry["doc"]), shard["base"] + int(entry["start"]), ids))
                    held += len(ids)
                    if len(rows) >= 2000 or held > 1 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return shards.repartition(parts).mapInArrow(read, schema)


_ARROW = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _ARROW[t]) for n, t in fields], names=[n for n, _ in fields])
