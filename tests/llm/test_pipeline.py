"""The pipeline's stages: each against the brute force of its operator, on what came before."""

import zlib

import numpy as np
import public_tokenizers
from test_dedup import slow_components, slow_fingerprint
from test_pii import slow_base
from test_tokens import plain

import corpus_pipeline
from tessera.llm import toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    out, now = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, sf)
        rows = now.collect()
        if k < 4:
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
            assert {r.doc_id for r in rows} <= set(before)
        out[name] = (before, rows)
        now = spark.createDataFrame(rows, now.schema)
    before, rows = out["toxicity"]
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, spark.read.parquet(f"{sf}/labels.parquet"), trains=lambda k: ~toxicity.held_out(k)).collect()}
    assert {r.doc_id for r in rows} == {k for k, s in scores.items() if s < toxicity.THRESHOLD}

    before, rows = out["exact dedup"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for k in sorted(before):
        last[(before[k].text or "").translate(lower)] = k
    assert {r.doc_id for r in rows} == set(last.values())

    before, rows = out["near dedup"]
    least = slow_components([(k, slow_fingerprint(r.text or "")) for k, r in sorted(before.items())])
    assert {r.doc_id for r in rows} == set(least.values())

    before, rows = out["personal data"]
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        old = before[r.doc_id].text
        assert not slow_base(r.text or "") and (r.text == old) == (not slow_base(old or "")) and r.n_chars == (None if r.text is None else len(r.text))

    before, rows = out["packing"]
    t = plain()
    total = 0
    for k, r in before.items():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = sorted((p for p in rows if p.doc_id == k), key=lambda p: p.start)
        assert sum(p.length for p in mine) == len(ids) == mine[0].doc_tokens
        for p in mine:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        total += len(ids)
    assert sorted(p.sequence_id * 2048 + p.offset + i for p in rows for i in range(p.length)) == list(range(total))
    assert names == ["toxicity", "exact dedup", "near dedup", "personal data", "packing"]
