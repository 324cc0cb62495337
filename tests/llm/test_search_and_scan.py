"""Operators 2 and 5 against brute force."""

import base64
import json
import math
import re

import numpy as np
import pandas as pd

from tessera.llm import ann, secret_scan


def exact(rows, k=5):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in rows]), np.vstack([v / np.linalg.norm(v) for _, v in rows])
    out = {}
    for i, v in zip(ids, m):
        if i % 50 == 0:
            s = m @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in ann.nearest(df, lambda c: c % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(x) == 5 for x in got.values())


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(0, 40)]
    rows += [(100 + i, rows[0][1]) for i in range(8)]  # ties
    rows += [(50, None), (200, [0.0] * 64), (250, [float("nan")] * 64), (300, [None] * 64), (350, [float("inf")] + [1.0] * 63), (400, []), (450, [1.0]), (None, rows[0][1]), (100, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, role int, shard int")
    got = {}
    for r in ann.nearest(df, lambda c: c % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == [0, 100] and got[0] == [100, 101, 102, 103, 104]
    assert 100 not in got[100]
    assert ann.nearest(df.limit(0), lambda c: c % 50 == 0).count() == 0


def test_probing_misses_nothing():
    """Every code within m (r + 1) - 1 bits is retrieved, and exactly the rows of the probed buckets."""
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    codes[250:] = codes[:250] ^ np.where(rng.random((250, 4)) < 0.5, np.uint16(1) << rng.integers(0, 16, (250, 4)).astype(np.uint16), np.uint16(0))
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 2, 3):
        near = ann.neighbours(radius)
        assert len(near) == sum(math.comb(16, i) for i in range(radius + 1))
        for q in codes[::25]:
            apart = np.bitwise_count(q ^ codes)
            found = index.probe(q, near)
            assert found.tolist() == np.flatnonzero((apart <= radius).any(axis=1)).tolist()
            assert set(np.flatnonzero(apart.sum(axis=1) < 4 * (radius + 1))) <= set(found)


def test_recall_over_shards(spark):
    """50,000 isotropic and clustered vectors over many shards: recall, share of rows reranked, ties across shards."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(50_000, 64))
    v[30_000:] = v[rng.integers(0, 200, 20_000)] + 0.3 * v[30_000:]
    v[40_000:40_400] = v[7]  # one vector, in every shard
    table = pd.DataFrame({"vec_id": np.arange(50_000), "embedding": v.tolist()})
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann.nearest(df, lambda c: c % 500 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 50_000, 500):
        s = unit @ unit[q]
        s[q] = -2
        want = np.argsort(-s, kind="stable")[:5]
        hits += len({i for i, _ in got[q]} & set(want.tolist()))
        for i, x in got[q]:
            assert abs(s[i] - x) < 1e-12
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * 500
    assert [i for i, _ in got[40_000]] == [7, 40_001, 40_002, 40_003, 40_004] and len({x for _, x in got[40_000]}) == 1
    m, radius = ann.tables_needed(ann.unit_rows(v[:20_000]), 5)
    share = 1 - (1 - len(ann.neighbours(radius)) / 65536) ** m
    print(f"tables {m}, radius {radius}, recall {hits / 500:.3f}, share of isotropic rows reranked {share:.3f}")
    assert share < 0.2


def der():
    body = b"\x02\x01\x00" + b"\x30\x0d" + b"\x06\x09" + bytes(range(1, 10)) + b"\x05\x00" + b"\x04\x20" + bytes(range(32))
    return b"\x30" + bytes([len(body)]) + body


def slow_base(text):
    out = []
    for kind, pattern, flags, ok in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), kind, m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def openssh():
    field = lambda x: len(x).to_bytes(4, "big") + x
    public = field(b"ssh-ed25519") + field(bytes(32))
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(b"abcdabcd" + bytes(16))


def slow_added(text):
    """Keys and tokens by trying every start and end of encoded runs: for short texts."""
    out = set()
    for i in range(len(text)):
        if i and (text[i - 1].isascii() and (text[i - 1].isalnum() or text[i - 1] in "+/")):
            continue
        for j in range(i + 40, len(text) + 1):
            run = text[i:j]
            if j < len(text) and text[j - 1].isalnum() and text[j].isascii() and text[j].isalnum():
                continue
            if not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", run):
                break
            if re.match(r"[A-Za-z0-9+/=]" if run[-1] != "=" else "=" if run[-2] != "=" else "$^", text[j:]):
                continue  # the run goes on
            raws = [base64.b64decode(run.rstrip("=") + "=" * (-len(run.rstrip("=")) % 4))] if len(run.rstrip("=")) % 4 != 1 else []
            raws += [bytes.fromhex(run)] if re.fullmatch(r"(?:[0-9a-f]{2})+", run) else []
            for kind, parses in (("der", secret_scan.der_sequence), ("ssh", secret_scan.ssh_key)):
                out |= {(kind, i, j)} if any(map(parses, raws)) else set()
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_added_spans_by_brute_force():
    rng = np.random.default_rng(4)
    parts = [base64.b64encode(der()).decode(), der().hex(), base64.b64encode(openssh()).decode(), "QUJD" * 12, "word", " ", "\n", "é", base64.b64encode(der() + b"x").decode()]
    for _ in range(25):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), 6))
        if re.search("[A-Za-z0-9+/=]\n[A-Za-z0-9+/=]", text):
            continue  # lines are joined, which the slow finder doesn't try
        assert [(secret_scan.KINDS[k], s, e) for s, k, e in secret_scan.spans_of(text) if k >= 5] == slow_added(text)


def test_secrets(spark, docs, awkward):
    url = lambda raw: base64.urlsafe_b64encode(raw).decode().rstrip("=")
    token = url(json.dumps({"alg": "HS256"}).encode()) + "." + url(b'{"a":1}') + "." + "c2ln"
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))
    pem = f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(der()).decode()}\n-----END PRIVATE KEY-----"
    texts = {
        1: f"é {token}.", 2: f"x {url(b'{not json}')}.{url(b'{}')}.abc", 3: f"key {base64.b64encode(der()).decode()}", 4: f"h {der().hex()} ", 5: pem,
        6: f"ssh-ed25519 {base64.b64encode(ssh).decode()} me", 7: "QUJD" * 20, 8: "PASSWORD = 'abcdefgh1' token=token:abcdefghij paſſword=abcdefghijk AKIA" + "A1" * 8, 9: None, 10: "", 11: "a" * 300_000, 12: "token" + " " * 50_000 + "=x",
    }
    wrapped = base64.b64encode(der() * 1 + b"").decode()
    long_der = bytes([0x30, 0x81, 2 + 0x80]) + b"\x04\x7d" + bytes(range(125)) + b"\x02\x01\x05"
    lines = re.findall(".{1,64}", base64.b64encode(long_der).decode())
    texts |= {
        20: "see\n" + "\n".join(lines) + "\nNext words", 21: "u " + url(der() .replace(bytes(32), b"\xfb\xef\xbe" * 10 + b"\xff\xff")) + " v", 22: "x " + base64.b64encode(b"openssh-key-v1\0" + b"junk" * 20).decode(),
        23: "x " + base64.b64encode(openssh()).decode(), 24: f"y {url(json.dumps({'alg': 'some'}).encode())}.{url(b'{}')}.abc",
        25: "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + base64.b64encode(bytes(range(64))).decode() + "\n-----END RSA PRIVATE KEY-----",
        26: f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(b'not a key' * 9).decode()}\n-----END PRIVATE KEY-----", 27: "-----BEGIN A-----" * 2000 + "a:b\n" * 3000, 28: "A" * 64 + "\n" + ("A" * 64 + "\n") * 3000, 29: wrapped + "A",
    }
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(1, texts[1], 2)], "doc_id long, text string, spans int")
    kinds = {}
    for r in secret_scan.find_secrets(df).collect():
        kinds[r.doc_id] = [s.kind for s in r.spans]
    assert kinds[1] == ["jwt"] and kinds[2] == [] and kinds[3] == ["der"] and kinds[4] == ["hex", "der"] and "pem" in kinds[5]
    assert kinds[6] == ["ssh"] and kinds[7] == [] and kinds[9] == kinds[10] == [] and kinds[11] == ["hex"] and kinds[12] == []
    added = {k: [x for x in v if x not in ("assign", "access", "hex")] for k, v in kinds.items() if k >= 20}
    assert added == {20: ["der"], 21: ["der"], 22: [], 23: ["ssh"], 24: [], 25: ["pem"], 26: [], 27: [], 28: [], 29: []}
    for frame in (df, docs, docs.limit(0), awkward):
        rows = sorted([(r.doc_id, str([(s.kind, s.start, s.end) for s in r.spans if s.kind in ("assign", "access", "hex")])) for r in secret_scan.find_secrets(frame).collect()], key=str)
        assert rows == sorted([(r.doc_id, str(slow_base(r.text or ""))) for r in frame.collect()], key=str)
    digest = secret_scan.digest(secret_scan.find_secrets(df)).where("doc_id = 4").head()
    assert digest.n_hex == 1 and digest.spans.startswith("hex:2:") and digest.spans.count(",") == 1
