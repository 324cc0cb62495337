"""Operator 3: byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``CHUNK`` characters is cut into chunks that overlap by ``OVERLAP``; the chunks are
dealt to all tasks and pre-tokenised in parallel.  A pre-token depends only on the text from its start
on (the pattern looks ahead, never behind), so once two neighbouring chunks share one boundary in
their overlap, all later boundaries agree: the first shared one is the stitch.  The pieces between
stitches are encoded independently and their ids concatenated; decoding concatenates the pieces'
bytes.  Where neighbours share no boundary (one pre-token fills the whole overlap), that document is
put together again and encoded as one piece, so the result is exact in every case.

Cases: a null text counts as empty and has no token; a null id stays null; very long texts are handled
piecewise; rows of one id with different texts and repeated rows are each encoded; no ties arise; an
empty table gives no row; other columns are pruned.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, id_and_text

CHUNK, OVERLAP = 32_768, 2_048
#: The longest contraction in the pattern, in characters.
_LONGEST_LITERAL = 3
_PIECES = "_row long, _id long, k int, last boolean, ids binary"

_loaded: dict[tuple[str, str], object] = {}


def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file, one to a worker process."""
    if (ranks_path, pattern) not in _loaded:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        _loaded[ranks_path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[ranks_path, pattern]


def certain_boundaries(pattern, chunk: str, is_last: bool) -> list[int]:
    """Ends of pre-tokens (and 0) that no text after the chunk can move."""
    out = [0]
    for m in pattern.finditer(chunk):
        if not is_last and (m.end() >= len(chunk) or m.start() + _LONGEST_LITERAL > len(chunk)):
            break
        out.append(m.end())
    return out


def _cut(batches):
    """Overlapping chunks of long texts."""
    for batch in batches:
        for row, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            count = -(-len(text) // CHUNK)
            for k in range(count):
                yield pa.RecordBatch.from_pydict(
                    {"_row": pa.array([row], pa.int64()), "_id": pa.array([key], pa.int64()), "k": pa.array([k], pa.int32()), "last": [k == count - 1], "chunk": [text[k * CHUNK : (k + 1) * CHUNK + OVERLAP]]}
                )


def _pretokenise(pattern_text: str):
    def run(batches):
        import regex

        pattern = regex.compile(pattern_text)
        for batch in batches:
            k, last, chunks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "last", "chunk"))
            heads, tails = [], []
            for number, is_last, chunk in zip(k, last, chunks):
                ends = certain_boundaries(pattern, chunk, is_last)
                heads.append([number * CHUNK + e for e in ends if e < OVERLAP] if number else [])
                tails.append([number * CHUNK + e for e in ends if e >= CHUNK])
            whole = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, whole), pa.array(tails, whole)], names=[*batch.schema.names, "head", "tail"])

    return run


def _encode(ranks_path: str, pattern: str):
    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("piece")
            ids = [array("I", enc.encode_ordinary(x)).tobytes() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(ids, pa.binary())], names=["_row", "_id", "k", "last", "ids"])

    return run


def encode_pieces(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Ids (little-endian unsigned 32-bit) of the pieces: of texts of one chunk, and of longer ones.

    Columns: _row (a number for each input row), _id, k (the piece's place), last, ids.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("_row"), "_id", "_text")
    encode = _encode(ranks_path, pattern)
    short = rows.where(F.length("_text") <= CHUNK).select("_row", "_id", F.lit(0).alias("k"), F.lit(True).alias("last"), F.col("_text").alias("piece"))

    chunks = rows.where(F.length("_text") > CHUNK).mapInArrow(_cut, "_row long, _id long, k int, last boolean, chunk string")
    dealt = chunks.repartition("_row", "k")
    cut = dealt.mapInArrow(_pretokenise(pattern), "_row long, _id long, k int, last boolean, chunk string, head array<long>, tail array<long>")
    by_row = Window.partitionBy("_row").orderBy("k")
    stitch = F.array_min(F.array_intersect("tail", F.lead("head").over(by_row)))
    stitched = (
        cut.withColumn("until", F.when(F.col("last"), F.lit(1 << 60)).otherwise(stitch))
        .withColumn("since", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lag("until").over(by_row)))
        .withColumn("sound", F.min(F.col("until").isNotNull()).over(Window.partitionBy("_row")))
    )
    start = F.col("since") - F.col("k") * CHUNK
    piece = F.substring("chunk", (start + 1).cast("int"), F.least(F.col("until") - F.col("since"), F.lit(2 * CHUNK)).cast("int"))
    sound = stitched.where("sound").select("_row", "_id", "k", "last", piece.alias("piece"))
    whole = (
        stitched.where("not sound")
        .groupBy("_row", "_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring("chunk", 1, CHUNK).alias("own")))), lambda c: c["own"]), "").alias("piece"))
        .select("_row", "_id", F.lit(0).alias("k"), F.lit(True).alias("last"), "piece")
    )
    return short.mapInArrow(encode, _PIECES), sound.unionByName(whole).mapInArrow(encode, _PIECES)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<long>) of every row."""
    short, long_ = encode_pieces(docs, ranks_path, pattern, id_col, text_col)

    def join(batches):
        for key, ids in _documents(batches, lambda: [], lambda a, ids: a + [ids]):
            yield _one(key, {"ids": pa.array([array("I", b"".join(ids)).tolist()], pa.list_(pa.int64()))})

    return _folded(short, long_, join, "doc_id long, ids array<long>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The raw bytes of (doc_id, ids array<long>): each id's bytes, concatenated."""

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            keys, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "ids"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([enc.decode_bytes(x or []) for x in ids], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: folded piece by piece, never a whole document's ids at once."""
    short, long_ = encode_pieces(docs, ranks_path, pattern, id_col, text_col)

    def fold(batches):
        enc = encoding(ranks_path, pattern)

        def add(state, raw):
            n, of_ids, of_bytes = state
            of_ids.update(raw)
            of_bytes.update(enc.decode_bytes(array("I", raw).tolist()))
            return n + len(raw) // 4, of_ids, of_bytes

        held: list[tuple] = []
        for key, (n, of_ids, of_bytes) in _documents(batches, lambda: (0, hashlib.sha256(), hashlib.sha256()), add):
            held.append((key, n, of_ids.hexdigest(), of_bytes.hexdigest()))
            if len(held) == 1000:
                yield _rows(held)
                held = []
        if held:
            yield _rows(held)

    return _folded(short, long_, fold, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _folded(short: DataFrame, long_: DataFrame, fold, schema: str) -> DataFrame:
    """``fold`` over the pieces in order: short texts as they stand, the rest gathered by document."""
    gathered = long_.repartition("_row").sortWithinPartitions("_row", "k")
    return short.mapInArrow(fold, schema).unionByName(gathered.mapInArrow(fold, schema))


def _documents(batches, start, add):
    """Folds consecutive pieces of one document; yields (id, state) after its last piece."""
    state = None
    for batch in batches:
        for key, last, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_id", "last", "ids"))):
            state = add(start() if state is None else state, raw)
            if last:
                yield key, state
                state = None


def _one(key, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([key], pa.int64()), **columns})


def _rows(held: list[tuple]) -> pa.RecordBatch:
    keys, n, ids, decoded = zip(*held)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})
