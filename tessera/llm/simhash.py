"""Operator 8: SimHash near-duplicates by tiled exact comparison.

Fingerprints: 64-bit majority of the XXH64 of word shingles.  Linking works on distinct fingerprints.
A tile holds the fingerprints with the same population counts in each of ``PARTS`` sub-words; one
differing bit moves one of these counts by one, so tiles whose counts differ by more than the radius
in sum can't hold a link and are never paired.  Tiles with many rows are cut into blocks and their
visitors into batches of bounded size (from the tile sizes, of which there are at most
``(64 / PARTS + 1) ** PARTS``), and the rest is numpy: exclusive-or and bit counts of a block against
its visitors.  A block reports a spanning forest of the links found, not all pairs; the forests are
joined to components by distributed star steps.

Cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any
other; fewer words than a shingle form one shingle; very long texts are hashed whole in slices;
repeated rows, and rows of one id with different texts, each have their own fingerprint; an empty table
gives no row; rows with a null id get a component by their component's other rows (null if there are
none); other columns are pruned.  ``drop_near_duplicates`` tells rows apart by a key of their own: it
keeps one row of each component, that with the least id (a null id only where there is no other; of
rows that share that id one).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, id_and_text, join_groups, keyed, picked, work_dir, written
from tessera.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
PARTS = 4
BLOCK, VISITORS = 4096, 32_768
_SIDE = 64 // PARTS + 1
_SLICE = 1 << 15


def shingle_hashes(text: bytes, width: int = SHINGLE):
    """XXH64 of each shingle of lower-cased words, in bounded slices."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()
    if not words:
        return
    if len(words) <= width:
        yield np.array([h(b" ".join(words), SEED)], np.uint64)
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    for at in range(0, n, _SLICE):
        a, b = starts[at : min(n, at + _SLICE)].tolist(), ends[at + width - 1 : min(n, at + _SLICE) + width - 1].tolist()
        yield np.fromiter((h(joined[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingle hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(_row, _id, fp) of (_row, _id, _text); fp is the fingerprint's bits as a signed long."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            row, keys, texts = batch.columns
            found = np.array([fingerprint(t.as_buffer().to_pybytes(), width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([row, keys, pa.array(found.view(np.int64))], names=["_row", "_id", "fp"])

    return rows.select("_row", "_id", F.col("_text").cast("binary").alias("_text")).mapInArrow(run, "_row long, _id long, fp long")


def tile_of(fps: np.ndarray) -> np.ndarray:
    """Population counts of the sub-words, (rows, PARTS)."""
    words = np.ascontiguousarray(fps).view(f"<u{64 // PARTS // 8}").reshape(-1, PARTS)
    return np.bitwise_count(words).astype(np.int64)


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Moves between tiles that may hold a link: no move, and one of each opposite two."""
    moves = [m for m in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, m)) <= radius]
    return [m for m in moves if m >= (0,) * PARTS]


_WEIGHTS = np.array([_SIDE**i for i in range(PARTS)], np.int64)


def _mixed(fps: np.ndarray) -> np.ndarray:
    x = fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


class Tiles:
    """Blocks and visitor batches of each tile, from the tile sizes."""

    def __init__(self, sizes: np.ndarray, radius: int):
        self.steps = _steps(radius)
        self.blocks = np.maximum(1, -(-sizes // BLOCK))
        visiting = np.zeros_like(sizes)
        at = np.flatnonzero(sizes)
        where = np.stack([at // w % _SIDE for w in _WEIGHTS], axis=1)
        for step in self.steps:
            to = where + np.array(step)
            fine = ((to >= 0) & (to < _SIDE)).all(axis=1)
            np.add.at(visiting, to[fine] @ _WEIGHTS, sizes[at[fine]])
        self.batches = np.maximum(1, -(-visiting // VISITORS))
        self.occupied = sizes > 0

    def units(self, fps: np.ndarray):
        """(tile, block, batch, role, fingerprint) rows: role 0 at home, 1 visiting."""
        where, mixed = tile_of(fps), _mixed(fps)
        out = []
        for step in self.steps:
            to = where + np.array(step)
            rows = np.flatnonzero(((to >= 0) & (to < _SIDE)).all(axis=1))
            tile = to[rows] @ _WEIGHTS
            held = self.occupied[tile]
            rows, tile = rows[held], tile[held]
            batch = (mixed[rows] % self.batches[tile].astype(np.uint64)).astype(np.int64)
            for block in range(int(self.blocks[tile].max(initial=0))):
                some = self.blocks[tile] > block
                out.append((tile[some], np.full(some.sum(), block), batch[some], np.ones(some.sum(), np.int64), fps[rows[some]]))
        tile = where @ _WEIGHTS
        block = ((mixed >> np.uint64(7)) % self.blocks[tile].astype(np.uint64)).astype(np.int64)
        for batch in range(int(self.batches[tile].max(initial=0))):
            some = self.batches[tile] > batch
            out.append((tile[some], block[some], np.full(some.sum(), batch), np.zeros(some.sum(), np.int64), fps[some]))
        return [np.concatenate(c) for c in zip(*out)]


def forest(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between a block and its visitors, each node with its root."""
    nodes, index = np.unique(np.concatenate([home, visitors]), return_inverse=True)
    h, v = index[: len(home)], index[len(home) :]
    root = np.arange(len(nodes))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    step = max(1, (1 << 21) // max(1, len(home)))
    a = home.view(np.uint64)
    for at in range(0, len(visitors), step):
        b = visitors[at : at + step].view(np.uint64)
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        p, q = h[i], v[at + j]
        apart = p != q
        p, q = p[apart], q[apart]
        while len(p):
            # roots of both ends at once; hook greater roots to lesser ones until none differ
            while (root[root] != root).any():
                root[:] = root[root]
            rp, rq = root[p], root[q]
            differ = rp != rq
            p, q, rp, rq = p[differ], q[differ], rp[differ], rq[differ]
            np.minimum.at(root, np.maximum(rp, rq), np.minimum(rp, rq))
    while (root[root] != root).any():
        root[:] = root[root]
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def links(distinct: DataFrame, radius: int, folder: str) -> DataFrame:
    """(a, b) fingerprints: a spanning forest of each block's links within the radius."""
    spark = distinct.sparkSession

    def count(batches):
        sizes = np.zeros(_SIDE**PARTS, np.int64)
        for batch in batches:
            np.add.at(sizes, tile_of(batch.column(0).to_numpy()) @ _WEIGHTS, 1)
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes[at])], names=["tile", "n"])

    counted = distinct.select("fp").mapInArrow(count, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n"))
    sizes = np.zeros(_SIDE**PARTS, np.int64)
    for row in counted.toLocalIterator():  # one row to a tile, of which there are _SIDE ** PARTS at most
        sizes[row["tile"]] = row["n"]
    tiles = spark.sparkContext.broadcast(Tiles(sizes, radius))

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            if len(fps):
                tile, block, part, role, fp = tiles.value.units(fps)
                # tile, block, batch and role in one sortable number
                yield pa.RecordBatch.from_arrays([pa.array(((tile << 20 | block) << 20 | part)), pa.array(role.astype(np.int8)), pa.array(fp)], names=["unit", "role", "fp"])

    def compare(batches):
        unit, home, visitors = None, [], []

        def done():
            if home and visitors:
                a, b = forest(np.concatenate(home), np.concatenate(visitors), radius)
                if len(a):
                    yield a, b

        def packed(found):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

        for batch in batches:
            units, role, fp = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero(np.diff(units)) + 1
            found: list[tuple] = []
            for s, e in zip([0, *edges], [*edges, len(units)]):
                if s == e:
                    continue
                if units[s] != unit:
                    found += done()
                    unit, home, visitors = units[s], [], []
                cut = s + int(np.searchsorted(role[s:e], 1))
                if cut > s:
                    home.append(fp[s:cut])
                if e > cut:
                    visitors.append(fp[cut:e])
            yield from packed(found)
        yield from packed(list(done()))

    dealt = distinct.select("fp").mapInArrow(deal, "unit long, role byte, fp long").repartition("unit").sortWithinPartitions("unit", "role")
    return dealt.mapInArrow(compare, "a long, b long")


def _least(column: str, by: str) -> Column:
    """The value of ``column`` at the least ``by``; nulls there come last."""
    return F.coalesce(F.min_by(column, by), F.min(column))


def grouped(rows: DataFrame, folder: str, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """_row, _id, fp, component_id and keep_row (the row that stands for the component) of (_row, _id, _text)."""
    marked = written(fingerprints(rows, width), folder, "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("_id").alias("least"), _least("_row", "_id").alias("row"), F.count("*").alias("size")), folder, "classes")
    joined = components(links(classes, radius, folder), folder)  # (fingerprint, least fingerprint of its component)
    # fingerprints without a link are components of their own
    ends = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    with_ids = classes.join(ends, classes["fp"] == ends["node"])
    least = with_ids.groupBy("component").agg(F.min("least").alias("component_id"), _least("row", "least").alias("keep_row"))
    member = ends.join(least, "component").select(F.col("node").alias("m_fp"), "component_id", "keep_row")
    place = classes.join(member, classes["fp"] == member["m_fp"], "left").select(F.col("fp").alias("c_fp"), F.coalesce("component_id", "least").alias("component_id"), F.coalesce("keep_row", "row").alias("keep_row"), "size")
    place = written(place, folder, "places")
    return join_groups(marked, "fp", place, "c_fp", "size").select("_row", "_id", "fp", "component_id", "keep_row")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed bits), component_id of every row."""
    rows = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("_row"), "_id", "_text")
    return grouped(rows, work_dir(docs.sparkSession), width, radius).select(F.col("_id").alias("doc_id"), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns."""
    folder = work_dir(docs.sparkSession)
    rows, own = keyed(docs, folder)
    named = rows.select(rows[own].alias("_row"), rows[id_col].cast("long").alias("_id"), F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("_text"))
    gone = grouped(named, folder, width, radius).where("_row <> keep_row").select("_row")
    return picked(rows, own, gone, folder, "gone", but=True).drop(own)
