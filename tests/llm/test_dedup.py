"""Operators 4 and 8 against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash

from tessera.llm import exact_dedup, simhash
from tessera.llm.common import work_dir


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@pytest.mark.parametrize("which", ["docs", "awkward", "nothing"])
def test_exact(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, lower(r.text)) for r in df.collect()]
    got = sorted(map(tuple, exact_dedup.exact_groups(df).collect()), key=str)
    want = []
    for key, text in rows:
        same = [k for k, t in rows if t == text]
        keep = max((k for k in same if k is not None), default=None)
        want.append((key, keep, len(same), key == keep, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    left = exact_dedup.drop_duplicates(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, lower(r.text)) for r in left.collect()), key=str) == sorted({(w[1], t) for w, (_, t) in zip(want, rows)}, key=str)


def test_rows_not_ids(spark):
    """Rows that share an id, or have none, are told apart."""
    rows = [(1, "A"), (1, "B"), (5, "a"), (7, "Q"), (7, "Q"), (None, "z"), (9, "z"), (None, "n"), (None, "n")]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, _row int").repartition(4)
    left = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_duplicates(df).collect()), key=str)
    assert left == sorted([(1, "B"), (5, "a"), (7, "Q"), (9, "z"), (None, "n")], key=str)
    near = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect()), key=str)
    assert near == sorted([(1, "A"), (1, "B"), (7, "Q"), (9, "z"), (None, "n")], key=str)


def slow_fingerprint(text, width=3):
    words = [w for w in text.encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    parent = {k: k for k, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(pairs):
        for b, g in pairs[:i]:
            if (f ^ g).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in parent}


@pytest.mark.parametrize("which", ["docs", "awkward", "nothing"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, slow_fingerprint(r.text or "")) for r in df.collect()]
    component = slow_components([(i, f) for i, (_, f) in enumerate(rows)])
    ids = {}
    for i, c in component.items():
        ids.setdefault(c, []).append(rows[i][0])
    least = {c: min((k for k in v if k is not None), default=None) for c, v in ids.items()}
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(df).collect()), key=str)
    assert got == sorted(((k, f, least[component[i]]) for i, (k, f) in enumerate(rows)), key=str)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least.values(), key=str)


def test_links_of_crowded_tiles(spark, monkeypatch):
    """Chains, crowded tiles and near neighbours, with blocks small enough to be cut."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set(rng.integers(0, 1 << 63, 500, dtype=np.uint64).tolist())
    for b in base.tolist():
        x = b
        for _ in range(120):
            x ^= 1 << int(rng.integers(0, 64))
            if rng.random() < 0.5:
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    want = slow_components([(i, int(f)) for i, f in enumerate(fps)])
    monkeypatch.setattr(simhash, "BLOCK", 2)
    monkeypatch.setattr(simhash, "VISITORS", 8)
    sizes = np.zeros(simhash._SIDE**simhash.PARTS, np.int64)
    np.add.at(sizes, simhash.tile_of(fps) @ simhash._WEIGHTS, 1)
    tiles = simhash.Tiles(sizes, 2)
    assert tiles.blocks.max() > 1 or tiles.batches.max() > 1
    tile, block, part, role, fp = tiles.units(fps.view(np.int64))
    number = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for unit in sorted(set(zip(tile.tolist(), block.tolist(), part.tolist()))):
        own = (tile == unit[0]) & (block == unit[1]) & (part == unit[2])
        a, b = simhash.forest(fp[own & (role == 0)], fp[own & (role == 1)], 2)
        assert len(a) < own.sum()
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(number[x]), find(number[y])
            root[max(p, q)] = min(p, q)
    assert {i: find(i) for i in range(len(fps))} == want
    df = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64))], "least long, fp long")
    monkeypatch.undo()
    from tessera.llm.components import components

    folder = work_dir(spark)
    found = {r.node: r.component for r in components(simhash.links(df, 2, folder), folder).collect()}
    groups = {}
    for f, i in number.items():
        groups.setdefault(found.get(f, f), []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == want
