"""Operator 5: secret scan with structural confirmation.

Base kinds (assign, access, hex) are matched by pattern.  The method adds spans that survive a look
inside: signed tokens whose header decodes to JSON naming an algorithm, PEM blocks and base64 or hex
runs whose bytes parse as DER with nested lengths that add up, and OpenSSH key encodings whose
length-prefixed fields are consistent.  A cheap vectorised search picks the texts worth a close look.

Cases: a null text counts as empty and has no span; very long texts are scanned whole, in linear
time; a null id stays null; rows of one id with different texts and repeated rows are each reported;
spans that start together stand in the order of ``KINDS``; an empty table gives no row; other columns are pruned.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import bounded_batches, id_and_text

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\s*+[A-Za-z0-9-]++:[^\n]*+\n)*+)([A-Za-z0-9+/=\s]*+)-----END \1-----")
#: A run of at least 40 characters of base64, and one of its URL-safe alphabet.
_B64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_URL64 = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{40,}={0,2}")
_LINE = {False: re.compile(r"\r?\n([A-Za-z0-9+/]+={0,2})(?![A-Za-z0-9+/=])"), True: re.compile(r"\r?\n([A-Za-z0-9_-]+={0,2})(?![A-Za-z0-9_=-])")}
#: Algorithms of signed tokens (fixed values of JSON Web Algorithms).
_ALGORITHMS = frozenset("none HS256 HS384 HS512 RS256 RS384 RS512 ES256 ES256K ES384 ES512 PS256 PS384 PS512 EdDSA Ed25519 Ed448".split())
_PREFILTER = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]|(?-i:AKIA[A-Z0-9]{12}|[0-9a-f]{32}|\bey[A-Za-z0-9_-]{6}|-----BEGIN |[A-Za-z0-9+/_-]{40})"
_SSH_MAGIC = b"openssh-key-v1\0"
_SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def _b64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_sequence(raw: bytes) -> bool:
    """One DER SEQUENCE that fills the bytes, whose elements (nested ones too) fit exactly and hold an INTEGER or OID."""
    if len(raw) < 16 or raw[0] != 0x30:
        return False
    known, open_ = False, [(0, len(raw))]
    while open_:
        at, end = open_.pop()
        while at < end:
            if at + 2 > end:
                return False
            tag, n, at = raw[at], raw[at + 1], at + 2
            if n >= 0x80:
                width = n & 0x7F
                if not 1 <= width <= 4 or at + width > end:
                    return False
                n, at = int.from_bytes(raw[at : at + width], "big"), at + width
                if n < 0x80:
                    return False
            if at + n > end:
                return False
            if tag & 0x20:
                open_.append((at, at + n))
            elif tag in (0x02, 0x06) and n:
                known = True
            elif tag & 0xDF == 0 or tag & 0x1F == 0x1F:
                return False
            at += n
    # the outermost element alone fills the bytes
    first = raw[1] if raw[1] < 0x80 else int.from_bytes(raw[2 : 2 + (raw[1] & 0x7F)], "big")
    head = 2 if raw[1] < 0x80 else 2 + (raw[1] & 0x7F)
    return known and head + first == len(raw)


def _fields(raw: bytes, at: int, n: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from ``at``: n of them, or as many as fill the bytes."""
    out: list[bytes] = []
    while len(out) < n if n is not None else at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return None
        out.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def _public_key(raw: bytes) -> bool:
    found = _fields(raw, 0)
    return found is not None and len(found[0]) >= 2 and found[0][0] in _SSH_NAMES


def ssh_key(raw: bytes) -> bool:
    """A public key's length-prefixed fields, or the container of private keys with all its parts.

    The container: cipher, key derivation and its options, the count of keys, that many public keys, and
    one block of private keys, which fills the rest and a whole number of cipher blocks.
    """
    if not raw.startswith(_SSH_MAGIC):
        return _public_key(raw)
    head = _fields(raw, len(_SSH_MAGIC), 3)
    if head is None:
        return False
    (cipher, derivation, options), at = head
    count = int.from_bytes(raw[at : at + 4], "big")
    if not cipher or not cipher.isascii() or derivation not in (b"none", b"bcrypt") or (derivation == b"none") != (not options) or not 1 <= count <= len(raw) // 4:
        return False
    body = _fields(raw, at + 4, count + 1)
    if body is None or not all(map(_public_key, body[0][:-1])):
        return False
    block, rest = body[0][-1], len(raw) - body[1]
    # an unencrypted block starts with the same check number twice; authenticated ciphers append a tag
    return len(block) >= 8 and len(block) % 8 == 0 and rest in (0, 16) and (cipher != b"none" or block[:4] == block[4:8])


def signed_token(header: str, payload: str) -> bool:
    """A JOSE header (a JSON object with a registered algorithm) and a payload that is a JSON object."""
    found = []
    for part in (header, payload):
        raw = _b64(part, url=True)
        try:
            found.append(json.loads(raw) if raw is not None else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in found) and isinstance(found[0].get("alg"), str) and found[0]["alg"] in _ALGORITHMS


def key_kind(raw: bytes | None) -> int | None:
    """The kind's number of bytes that parse as a key encoding."""
    return None if not raw else 5 if der_sequence(raw) else 6 if ssh_key(raw) else None


def _key_run(text: str, m: re.Match, url: bool, alone: bool) -> tuple[int | None, int, int]:
    """Kind's number (if any) and end of a run that decodes to a key, alone or with the lines of its width that
    follow it, and where these lines end.

    A wrapped key begins with its block of lines of one width: runs within a block are tried ``alone``,
    which keeps the scan linear.
    """
    run = m[0]
    if not url and len(run) % 2 == 0 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        kind = key_kind(bytes.fromhex(run))
        if kind:
            return kind, m.end(), m.end()
    lines, ends = [run], [m.end()]
    while not alone and len(lines[-1]) == len(run):
        more = _LINE[url].match(text, ends[-1])
        if more is None or len(more[1]) > len(run):
            break
        lines.append(more[1])
        ends.append(more.end())
    # the last short line may be a word of the text that follows
    for n in sorted({len(lines), len(lines) - 1, 1} - {0}, reverse=True):
        kind = key_kind(_b64("".join(lines[:n]), url))
        if kind:
            return kind, ends[n - 1], ends[-1]
    return None, m.end(), ends[-1]


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "ey" in text:
        out += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            raw = _b64("".join(m[3].split()))
            # a block with headers of its own (Proc-Type, DEK-Info) holds ciphertext: whole blocks of a cipher
            if raw and (key_kind(raw) or "DEK-Info:" in m[2] and len(raw) >= 16 and len(raw) % 8 == 0):
                out.append((m.start(), 4, m.end()))
    for pattern, url in ((_B64, False), (_URL64, True)):
        done = block = 0
        for m in pattern.finditer(text):
            if m.start() >= done:
                kind, end, last = _key_run(text, m, url, m.start() < block)
                block = max(block, last)
                if kind:
                    done = end
                    out.append((m.start(), kind, end))
    return sorted(out)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every row (code points, end exclusive)."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            keys, texts = batch.columns
            close = pc.match_substring_regex(texts, _PREFILTER).to_pylist()
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t.as_py())] if c else [] for t, c in zip(texts, close)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(spans, kind)], names=["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as one string."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, spans in zip(*(c.to_pylist() for c in batch.columns)):
                base = [s for s in spans if s["kind"] in KINDS[:3]]
                say = [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in x) for x in (base, spans)]
                counts = [sum(s["kind"] == k for s in base) for k in KINDS[:3]]
                for column, value in zip(out, (key, *counts, hashlib.sha256(say[0].encode()).hexdigest(), say[1])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(c, pa.string()) for c in out[4:]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.select("doc_id", "spans").mapInArrow(run, schema)
