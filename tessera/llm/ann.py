"""Operator 2: approximate nearest neighbours by multi-index hashing.

Codes: rotations learned by iterative quantisation on a bounded sample (``FIT_ROWS`` rows, the smallest
by hash of the id: a documented bound; every row is indexed) turn a vector into as many bits as the
index needs, in general more than it has dimensions.  A code is split into m substrings of
``SUBSTRING_BITS`` bits, and each substring has a table of buckets.  Search: the substrings within a
small radius r of a query's are enumerated and their buckets read.  Two codes that differ in fewer than
m (r + 1) bits agree to within r in at least one substring, so every code within that Hamming radius is
retrieved.  m and r follow from the sample: of its true neighbours ``TARGET`` must be retrieved, by as
few probes as possible.  What is found is reranked by the cosine of the original vectors in double
precision.

Rows are dealt by a hash of their id to shards that fit a task, each with its tables.  The queries, a
stated set, visit every shard in blocks and get k rows from each, so no bucket, cluster or common
vector can swell a task.  Scores are summed up in one order for every row, so that equal vectors have
equal scores.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null id; vectors of another length than the most common one (ties: the longer) take no part;
ties go to the smaller id; a query that finds fewer than k rows of a shard is compared with all of them; repeated rows are each a candidate, but a query never finds rows of its own id;
an empty table gives no row; other columns are pruned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, work_dir, written

FIT_ROWS = 20_000
#: Rows of the sample that rotations are learned from, and that are asked for their neighbours.
ROTATION_ROWS, ASKED_ROWS = 5_000, 256
SUBSTRING_BITS = 16
RADII = (0, 1, 2, 3, 4)
TABLES_MAX = 96
#: Share of true neighbours that the probes must retrieve on the sample, whose rows lie further apart than all rows do.
TARGET = 0.95
SHARD_ROWS_MIN, SHARD_ROWS_MAX = 2048, 1 << 18
PAIRS = 1 << 18


def learn_rotation(sample: np.ndarray, rounds: int = 8, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (principal axes, then iterative quantisation) of unit vectors."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    projected = centred @ axes
    d = sample.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        signs = np.where(projected @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        turn = (left @ right).T
    return mean, axes @ turn


def tables_needed(units: np.ndarray, k: int) -> tuple[int, int]:
    """(tables, radius) of fewest probed buckets that retrieve ``TARGET`` of the sample's neighbours.

    A bit of a random rotation parts two vectors with the probability of their angle over pi.
    """
    asked = units[:ASKED_ROWS]
    near = np.sort(asked @ units.T, axis=1)[:, -k - 1 : -1] if len(units) > k + 1 else asked @ units.T
    same = 1 - np.arccos(np.clip(near, -1, 1)).ravel() / math.pi
    best = None
    for radius in RADII:
        hit = sum(math.comb(SUBSTRING_BITS, i) * same ** (SUBSTRING_BITS - i) * (1 - same) ** i for i in range(radius + 1))
        for m in range(4, TABLES_MAX + 1):
            if (1 - (1 - hit) ** m).mean() >= TARGET:
                cost = m * sum(math.comb(SUBSTRING_BITS, i) for i in range(radius + 1))
                best = min(best or (cost, m, radius), (cost, m, radius))
                break
    return best[1:] if best else (TABLES_MAX, RADII[-1])


def learn_codes(sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, rotations side by side, radius) for unit vectors like those of the sample."""
    m, radius = tables_needed(sample, k)
    turns = -(-m * SUBSTRING_BITS // sample.shape[1])
    learned = [learn_rotation(sample[:ROTATION_ROWS], seed=7 + i) for i in range(turns)]
    return learned[0][0], np.hstack([r for _, r in learned])[:, : m * SUBSTRING_BITS], radius


def codes_of(units: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The codes' substrings, one 16-bit column to a table."""
    out = [np.packbits((units[at : at + 8192] - mean) @ rotation > 0, axis=1, bitorder="little").view("<u2") for at in range(0, max(len(units), 1), 8192)]
    return np.concatenate(out)


def neighbours(radius: int) -> np.ndarray:
    """All differences of substrings with at most ``radius`` bits."""
    every = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


class MultiIndex:
    """The tables of one shard's codes: for each substring value the rows that hold it."""

    def __init__(self, codes: np.ndarray):
        self.size, self.m = codes.shape
        self.rows = np.argsort(codes, axis=0, kind="stable").astype(np.int32).T.copy()
        self.ends = np.stack([np.cumsum(np.bincount(codes[:, j], minlength=1 << SUBSTRING_BITS)) for j in range(self.m)]).astype(np.int32)

    def probe(self, query: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The rows of all buckets whose value differs from the query's substring by one of ``near``."""
        values = query[:, None] ^ near[None, :]
        table = np.arange(self.m)[:, None]
        high = self.ends[table, values]
        low = np.where(values > 0, self.ends[table, np.maximum(values, 1) - 1], 0)
        t, at = np.nonzero(high > low)
        low, count = low[t, at], (high - low)[t, at]
        # all places of all hit buckets in one array
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found = np.zeros(self.size, bool)
        found[self.rows[np.repeat(t, count), np.repeat(low, count) + inside]] = True
        return np.flatnonzero(found)


def dots(flat: np.ndarray, rows: np.ndarray, asked: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Dot products of pairs, each summed up over the dimensions in their order."""
    out = np.zeros(len(rows))
    for d in range(flat.shape[0]):
        out += flat[d, rows] * asked[which, d]
    return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    length = np.zeros(len(scaled))
    for d in range(scaled.shape[1]):
        length += scaled[:, d] ** 2
    return scaled / np.sqrt(length)[:, None]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v) of the rows that can take part, in double precision."""
    v = F.col("_v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(vectors[id_col].cast("long").alias("_id"), vectors[vector_col].cast("array<double>").alias("_v"))
        .where(F.col("_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(fine & F.exists(v, lambda x: x != 0))
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best_of(flat: np.ndarray, unit: np.ndarray, q: np.ndarray, held: list[int], found: list[np.ndarray], keys: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of the rows found for each query, ties to the smaller id (rows are in the order of ids)."""
    score = dots(unit, np.concatenate(found), q, np.repeat(held, [len(r) for r in found]))
    out: list[list] = [[], [], []]
    ends = np.cumsum([len(r) for r in found])
    for i, rows_, end in zip(held, found, ends):
        own = score[end - len(rows_) : end]
        if len(own) > k:  # all that tie with the k-th
            some = np.flatnonzero(own >= np.partition(own, -k)[-k])
            rows_, own = rows_[some], own[some]
        best = np.lexsort((flat[rows_], -own))[:k]
        out[0] += [int(keys[i])] * len(best)
        out[1] += flat[rows_[best]].tolist()
        out[2] += own[best].tolist()
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """k nearest by cosine of each query row: query_id, rank, vec_id, score.

    ``is_query`` turns the id column into a boolean column.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "query_id long, vec_id long, score double"
    result = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).head()
    if top is None:
        return spark.createDataFrame([], result)
    dim, n = top["d"], top["n"]
    rows = rows.where(F.size("_v") == dim)
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS).toPandas()
    mean, rotation, radius = learn_codes(unit_rows(np.vstack(sample["_v"].to_numpy())), k)
    near = neighbours(radius)

    parallel = spark.sparkContext.defaultParallelism
    per_shard = min(SHARD_ROWS_MAX, max(SHARD_ROWS_MIN, -(-n // (4 * parallel))))
    shards = max(1, -(-n // per_shard))
    queries = rows.where(is_query(F.col("_id"))).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("role"), "_id", "_v")
    held = rows.select(F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "_id", "_v")

    def search(batches):
        shard, ids, found, index, flat, unit = None, [], [], None, None, None
        for batch in batches:
            where = batch.column(0).to_numpy()
            role = batch.column(1).to_numpy()
            keys = batch.column(2).to_numpy()
            vec = _matrix(batch.column(3), dim)
            for s in np.unique(where).tolist():
                if s != shard:
                    shard, ids, found, index = s, [], [], None
                own = (where == s) & (role == 0)
                if own.any():
                    ids.append(keys[own])
                    found.append(vec[own])
                asks = np.flatnonzero((where == s) & (role == 1))
                if not len(asks) or not ids:
                    continue
                if index is None:
                    flat, all_v = np.concatenate(ids), unit_rows(np.concatenate(found))
                    order = np.argsort(flat, kind="stable")
                    flat, all_v = flat[order], all_v[order]
                    index, ids, found = MultiIndex(codes_of(all_v, mean, rotation)), [flat], []
                    unit = np.ascontiguousarray(all_v.T)
                q = unit_rows(vec[asks])
                codes = codes_of(q, mean, rotation)
                held, held_rows, count = [], [], 0
                for i, at_row in enumerate(asks):
                    rows_ = index.probe(codes[i], near)
                    rows_ = rows_[flat[rows_] != keys[at_row]]
                    if len(rows_) < k:
                        rows_ = np.flatnonzero(flat != keys[at_row])
                    held.append(i)
                    held_rows.append(rows_)
                    count += len(rows_)
                    if count >= PAIRS or i == len(asks) - 1:
                        yield best_of(flat, unit, q, held, held_rows, keys[asks], k)
                        held, held_rows, count = [], [], 0

    parts = max(parallel, min(shards, 20_000))
    dealt = held.unionByName(queries).repartition(parts, "shard").sortWithinPartitions("shard", "role")
    best = written(dealt.mapInArrow(search, schema), work_dir(spark), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
