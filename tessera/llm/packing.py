"""Operator 10: concatenate and cut.

Pass one encodes the documents, notes each one's offset within its partition and writes the ids as
a table.  The partitions' totals (one row to a partition) are summed up to the partitions' global
bases.  Pass two adds the base and cuts the one long stream of ids into fixed windows; a document
that crosses a window's end leaves a boundary record in each window it touches.  No document is
shuffled, and only the very last sequence can need padding.

Cases: a null text counts as empty and yields its end id; very long texts fill several windows;
rows with a null id, with one id and different texts, and repeated rows are packed each (a null id stays
null); an empty table gives no piece; other columns are pruned.  Documents are laid out in the order of
the table's partitions, so no ties arise.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, id_and_text, work_dir, written
from tessera.llm.segments import encoded_batches

SEQUENCE = 2048
_TOKENS = "part int, within long, doc_id long, n long, width int, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: ids of each document with its place in its partition, written to the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def encode(batches):
        part, within = TaskContext.get().partitionId(), 0
        for keys, enc, texts in encoded_batches(batches, tokenizer_path, end_id):
            n = np.array([len(x) // enc.dtype.itemsize for x in texts], np.int64)
            starts = within + np.cumsum(n) - n
            within += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(keys, pa.int64()), pa.array(n), pa.array(np.full(len(n), enc.dtype.itemsize, np.int32)), pa.array(texts, pa.binary())],
                names=["part", "within", "doc_id", "n", "width", "ids"],
            )

    return written(id_and_text(docs, id_col, text_col).mapInArrow(encode, _TOKENS), work_dir(spark), "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """Adds each document's global position: its partition's base and its place there."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row to a partition of the writing job: its number is bounded by that job's tasks
    bases = totals.select(F.col("part"), F.coalesce(base, F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("within"))


def _cut(at: int, n: int, window: int):
    """(start in the document, length, sequence, offset there) of the pieces of n ids from position at."""
    start = 0
    while start < n:
        sequence, offset = divmod(at + start, window)
        length = min(window - offset, n - start)
        yield start, length, sequence, offset
        start += length


def _pieces(tokens: DataFrame, window: int, schema: str, names: list[str], last) -> DataFrame:
    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, n, width, ids, at in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "n", "width", "ids", "at"))):
                values = np.frombuffer(ids, f"<u{width}").astype("<u4")
                for start, length, sequence, offset in _cut(at, n, window):
                    for column, value in zip(out, (doc, start, length, n, sequence, offset, last(values[start : start + length]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:6]] + [pa.array(out[6])], names=names)

    return placed(tokens).select("doc_id", "n", "width", "ids", "at").mapInArrow(cut, schema)


def packed_pieces(tokens: DataFrame, window: int = SEQUENCE) -> DataFrame:
    """Pass two: one row to a piece, with the CRC-32 of its ids."""
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    return _pieces(tokens, window, _PIECES, names, lambda ids: zlib.crc32(ids.tobytes()))


def packed_sequences(tokens: DataFrame, window: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: exactly ``window`` ids each, the last one padded.

    Groups the pieces by sequence; a group holds ``window`` ids at most.
    """
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<long>"
    pieces = _pieces(tokens, window, schema, names, lambda ids: ids.astype(np.int64))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    return (
        pieces.groupBy("sequence_id")
        .agg(whole.alias("ids"), F.sum("length").alias("n_tokens"))
        .withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), (F.lit(window) - F.col("n_tokens")).cast("int"))))
    )
