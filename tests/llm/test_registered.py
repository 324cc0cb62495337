"""The registered queries and the pipeline as a whole: columns, parameters, SQL, and awkward tables from end to end."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import awkward_rows
from test_dedup import slow_components, slow_fingerprint
from test_tokens import plain

import corpus_pipeline
from tessera.llm import queries, toxicity

COLUMNS = {
    "op1_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op2_mih_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op3_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6_warc_revisits": ["record_id", "canonical_url", "status", "source_id", "headers", "payload_sha256"],
    "op7_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert set(COLUMNS[name]) <= set(df.columns)
    rows = df.collect()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.sql(queries.ORACLE_SQL[name])
        order = sorted(want.columns)
        assert sorted(df.columns) == order
        at = [want.columns.index(c) for c in order]
        assert sorted((tuple(r[c] for c in order) for r in rows), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    if name not in ("op2_mih_neighbours", "op6_warc_revisits"):
        assert {r.doc_id for r in rows} == ids and (name == "op10_packing" or len(rows) == len(ids))
    if name == "op9_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    if name == "op8_simhash":
        assert all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in rows)
    if name == "op1_token_files":
        assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


def written(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, kept string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 0, int(k == 6)) for k in range(1, 12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, ids without and with several texts, clashing columns."""
    rows = [(*r[:5], i, "x") for i, r in enumerate(awkward_rows())]
    folder = written(spark, tmp_path, rows)
    now = docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.collect()
        now = stage(spark, now, folder)
        assert now.dtypes == docs.dtypes
        kept = now.collect()
        if name == "toxicity":
            scores = toxicity.scored(docs, spark.read.parquet(f"{folder}/labels.parquet"), trains=lambda k: ~toxicity.held_out(k)).collect()
            assert len(kept) == sum(s.score < toxicity.THRESHOLD for s in scores)
        if name == "exact dedup":
            assert len(kept) == len({(r.text or "").lower() for r in before})
        if name == "near dedup":
            assert len(kept) == len(set(slow_components([(i, slow_fingerprint(r.text or "")) for i, r in enumerate(before)]).values()))
        if name == "personal data":
            assert len(kept) == len(before)
        now = spark.createDataFrame(kept, now.schema)
    last = now.collect()
    pieces = corpus_pipeline.run(spark, folder).collect()
    t = plain()
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in last)
    assert sorted(p.doc_tokens for p in pieces if p.start == 0) == want and sum(p.length for p in pieces) == sum(want)
    assert sorted((p.sequence_id * 2048 + p.offset) for p in pieces)[0] == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).count() == 0


def test_pipeline_as_registered(spark, sf):
    import __spark_entry__

    pieces = __spark_entry__.queries()["pipeline"](spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(pieces.columns)
    rows = pieces.collect()
    places = np.sort(np.array([p.sequence_id * 2048 + p.offset for p in rows]))
    assert len(set(places.tolist())) == len(rows) and places[0] == 0 and sum(p.length for p in rows) == max(p.sequence_id * 2048 + p.offset + p.length for p in rows)
    assert public_tokenizers.path("byte_bpe_50k.json")
