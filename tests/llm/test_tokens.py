"""Operators 1, 3 and 10 against the plain library on whole texts."""

import base64
import functools
import hashlib
import json
import struct
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, segments, token_files, toxicity
from tessera.llm.segments import SegmentEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain():
    return Tokenizer.from_file(PATH)


def want_ids(rows, end):
    t = plain()
    return {(k, text): t.encode(text or "", add_special_tokens=False).ids + [end] for k, text in rows}


@functools.cache
def encoders():
    return SegmentEncoder(PATH), plain()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z1.'s\n\t  \x1cé东́-<|>endoftx")), max_size=60))
def test_segments_equal_whole_text(text):
    enc, ref = encoders()
    for text in (text, text + " word.\nNext### a*b²c it's.\n\nTwo Ⅷx,\n12 _x_ " + text):
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ref.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é.,\n")), max_size=20), max_size=12))
def test_many_texts_at_once(texts):
    enc, ref = encoders()
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [ref.encode(t, add_special_tokens=False).ids for t in texts]


class Counting:
    """A tokenizer that counts the characters it is given to encode."""

    def __init__(self, inner):
        self.inner, self.chars, self.model = inner, 0, self

    def encode(self, text, **how):
        self.chars += len(text)
        return self.inner.encode(text, **how)

    def tokenize(self, text):
        self.chars += len(text)
        return self.inner.model.tokenize(text)


def test_words_with_marks_leave_room_for_words(monkeypatch):
    """Repeated words are encoded once, whatever marks follow them, as long as the words alone fit the cache."""
    monkeypatch.setattr(segments, "CACHE_SEGMENTS", 1000)
    enc, ref = SegmentEncoder(PATH), plain()
    enc.tokenizer = count = Counting(ref)
    letters = "abcdefghijklmnopqrst"
    halves = [[f"w{x}{a}{b}" for a in letters for b in letters] for x in "kq"]
    for words in halves * 3:
        for mark in ",.!?;":
            text = "A " + " ".join(w + mark for w in words)
            assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ref.encode(text, add_special_tokens=False).ids
    assert count.chars < 1.2 * sum(len(w) + 1 for words in halves for w in words)


def test_words_are_known_whatever_stands_beside_them():
    """A word is encoded once after a space and once without, in brackets and quotes, beside line ends and with numbers alike."""
    enc, ref = SegmentEncoder(PATH), plain()
    enc.tokenizer = count = Counting(ref)
    letters = "abcdefghijklmnopqrst"
    words = [f"wk{a}{b}" for a in letters for b in letters]
    for form in ("{}", "({})", '"{}",', "{}.\n{}", "{}/{}", "[{}]:", "{}\n{}", "é.{}", "{}'s", "<{}>;", "{}={}"):
        text = "A " + " ".join(form.format(w, w) for w in words)
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ref.encode(text, add_special_tokens=False).ids
    assert count.chars < 2.5 * sum(len(w) + 1 for w in words)


def test_cuts_beside_two_byte_characters():
    """Punctuation and line ends beside each character of two bytes, letter or not, give the library's ids."""
    enc, ref = encoders()
    texts = [f"a{c},b {c}. x{c}\nY{c}'s,{c} ({c}{c})!{c}\n\n{c}'{c}  {c}," for c in map(chr, range(0x80, 0x800))]
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, enc.dtype).tolist() == ref.encode(text, add_special_tokens=False).ids


def test_words_apart():
    """Words are given to the model together only where no token can lie across two."""
    assert encoders()[0]._apart
    tokens = list(plain().get_vocab())
    assert not segments._words_apart([*tokens, "oĠw"]) and not segments._words_apart([*tokens, "ĠaĠ"]) and not segments._words_apart([t for t in tokens if t != "a"])


def test_a_worker_holds_one_operators_cache():
    """Workers are used again by other stages: the encoder's cache goes when another operator begins."""
    held = weakref.ref(segments.encoder(PATH))
    assert held() is not None and segments.encoder(PATH) is held()
    toxicity.trigram_counts(["text"])
    assert held() is None


@pytest.mark.parametrize("which", ["docs", "awkward", "nothing"])
def test_token_files(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = want_ids(rows, 2)
    got = token_files.token_file_digest(token_files.write_token_files(df, PATH, 2)).collect()
    assert len(got) == len(rows)
    at = 0
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hash_of(want[x])))
    for r, (key, text) in zip(sorted(got, key=lambda r: r.start), ordered):
        ids = want[key, text]
        assert (r._id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def hash_of(ids):
    h = xxhash.xxh64_intdigest(np.array(ids, "<u2").tobytes())
    return h - (h >> 63 << 64)


def test_one_id_over_shards(spark):
    """Rows that share an id are split over shards all the same."""
    df = spark.createDataFrame([(5 if i % 2 else None, f"text {i} " * 20) for i in range(4000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(df, PATH, 2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 3 and max(m.docs for m in manifest) < 2000 and sum(m.docs for m in manifest) == 4000


def seekable_frames(raw):
    """The frames of a file in the public seekable format, told from its last bytes alone."""
    import zstandard

    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    n, flags = struct.unpack("<IB", raw[-9:-4])
    assert flags == 0x80
    size = 12 * n + 9
    assert struct.unpack("<II", raw[-size - 8 : -size]) == (0x184D2A5E, size)
    at, out = 0, []
    for packed, plain_, check in struct.iter_unpack("<III", raw[-size:-9]):
        part = zstandard.ZstdDecompressor().decompress(raw[at : at + packed], max_output_size=max(plain_, 1))
        assert len(part) == plain_ and xxhash.xxh64_intdigest(part) & 0xFFFFFFFF == check
        out.append(part)
        at += packed
    return out


def test_seek_table_is_last(tmp_path, awkward):
    manifest = token_files.write_token_files(awkward, PATH, 2, folder=f"file://{tmp_path}/t").collect()
    want = sorted(np.array(v, "<u2").tobytes() for v in (plain().encode(r.text or "", add_special_tokens=False).ids + [2] for r in awkward.collect()))
    got = sorted(f for m in manifest for f in seekable_frames(open(m.path.removeprefix("file://"), "rb").read()))
    assert got == want
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "t").iterdir()) == sorted(["manifest"] + ["shard"] * len(manifest))


def test_other_files_are_encoded_whole(tmp_path):
    """A file with another pre-tokenizer gives the library's ids all the same."""
    said = json.load(open(PATH))
    said["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    enc, ref = SegmentEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not enc.splits and encoders()[0].splits
    for text in ("word next", " lead", "", "a  b <|endoftext|>c"):
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ref.encode(text, add_special_tokens=False).ids


def test_random_access_and_damage(tmp_path, awkward):
    manifest = token_files.write_token_files(awkward, PATH, 2, folder=f"file://{tmp_path}/t").collect()
    want = {}
    for (k, _), v in want_ids([(r.doc_id, r.text) for r in awkward.collect()], 2).items():
        want.setdefault(k, []).append(v)
    for shard in manifest:
        reader = token_files.ShardReader(shard.path)
        for k, entry in enumerate(reader.index):
            assert reader.ids(k).tolist() in want[None if entry["null"] else int(entry["doc"])]
            assert entry["null"] or k in reader.rows_of(int(entry["doc"]))
    path = manifest[0].path.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    import zstandard

    # a plain decoder reads the same stream, skippable frames and all
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()
    assert len(whole) == 2 * manifest[0].tokens
    raw[6] ^= 0xFF
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        token_files.ShardReader(manifest[0].path).ids(0)


@pytest.mark.parametrize("which", ["docs", "awkward", "nothing"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = want_ids(rows, 1)
    tokens = packing.token_table(df, PATH, 1)
    pieces = packing.packed_pieces(tokens, 256).collect()
    stream = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for s, o, n in stream:  # gapless, and every sequence but the last is full
        assert s * 256 + o == at and 0 < n <= 256 - o
        at += n
    assert at == sum(len(want[x]) for x in rows)
    by_place = {(p.sequence_id, p.offset): p for p in pieces}
    done = 0
    while done < at:
        p = by_place[divmod(done, 256)]
        ids = next(v for (k, t), v in want.items() if k == p.doc_id and p.doc_tokens == len(v) and p.ids_crc32 == zlib.crc32(np.array(v[: p.length], "<u4").tobytes()))
        taken = 0
        while taken < len(ids):
            p = by_place[divmod(done, 256)]
            assert p.start == taken and p.ids_crc32 == zlib.crc32(np.array(ids[taken : taken + p.length], "<u4").tobytes())
            taken, done = taken + p.length, done + p.length
    whole = packing.packed_sequences(tokens, 256).collect()
    assert all(len(r.ids) == 256 for r in whole) and sum(r.n_tokens for r in whole) == at


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("sizes", [(32_768, 2_048), (50, 12)])
@pytest.mark.parametrize("which", ["docs", "awkward", "nothing"])
def test_byte_bpe(request, which, sizes, monkeypatch):
    df = request.getfixturevalue(which)
    if sizes[0] == 50:
        if which == "awkward":
            df = df.where("length(text) < 1000 or text is null")
        else:
            df = df.where("length(text) < 3000")
    monkeypatch.setattr(bpe, "CHUNK", sizes[0])
    monkeypatch.setattr(bpe, "OVERLAP", sizes[1])
    k = reference()
    if sizes[0] == 50:  # workers import the module anew: run the parts here
        for r in df.collect():
            assert stitched(k, r.text or "", *sizes) == k.encode_ordinary(r.text or "")
        return
    got = bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()
    rows = df.select("doc_id", "text").collect()
    def digest(key, text):
        ids = k.encode_ordinary(text or "")
        return key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted((digest(r.doc_id, r.text) for r in rows), key=str)


def stitched(k, text, size, overlap):
    """The operator's stitching, in plain Python, at a small chunk size."""
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    count = -(-len(text) // size)
    if count <= 1:
        return k.encode_ordinary(text)
    ends = []
    for c in range(count):
        chunk = text[c * size : (c + 1) * size + overlap]
        ends.append([c * size + e for e in bpe.certain_boundaries(pattern, chunk, c == count - 1)])
    cuts = [0]
    for c in range(count - 1):
        tail = {e for e in ends[c] if e >= (c + 1) * size}
        head = [e for e in ends[c + 1] if e < (c + 1) * size + overlap and e in tail]
        if not head:
            return k.encode_ordinary(text)
        cuts.append(min(head))
    cuts.append(len(text))
    return [i for a, b in zip(cuts, cuts[1:]) for i in k.encode_ordinary(text[a:b])]


def test_encode_and_decode(awkward):
    encoded = bpe.encode_documents(awkward, RANKS, public_tokenizers.PATTERN)
    back = {(r.doc_id, bytes(r.bytes)) for r in bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {(r.doc_id, (r.text or "").encode()) for r in awkward.collect()}
