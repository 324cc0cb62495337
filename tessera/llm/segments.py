"""Whole-text encoding with the ``tokenizers`` library, memoised by space-delimited segment.

The pre-tokenizer of a byte-level BPE file never lets a token cross a place where a single U+0020
stands between two characters that aren't white space: words, numbers and punctuation runs hold no
space but an optional leading one.  A text may therefore be cut before each such space, the pieces
encoded one by one with the library and the ids concatenated, and repeated pieces encoded once.
Nor does a token cross the places between a letter or digit and punctuation (but for what follows an
apostrophe, as in "it's"), or those around a line end that stands alone between other characters: the
segments between spaces are cut there as well, so that words are known whatever marks stand beside them.

This holds for files whose only pre-tokenizer is the byte-level one with its pattern and without a
leading space, without a normaliser, and for texts without the string of an added token (the library
takes these out before it splits).  Other files, and other texts, are encoded whole by the library.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import worker_cache

#: Entries of a generation of the cache; two generations are held, which bounds a worker's memory.
CACHE_SEGMENTS = 400_000
#: Longer segments are encoded anew each time.
CACHE_LENGTH = 48
#: Characters encoded in one call.
CALL_CHARS = 100_000
#: Characters after which texts are encoded together: more find more repeated words, and take more memory.
STEP_CHARS = 4_000_000
#: Words of letters that the model gets in one call.
CALL_WORDS = 100
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: What an ASCII byte is, as far as cuts go (bytes from 0x80 on: none of these).
_ALNUM, _MARK, _QUOTE, _LINE = 1, 2, 4, 8
_KIND = np.array([_ALNUM if (c := chr(b)).isalnum() else _QUOTE if c == "'" else _LINE if c == "\n" else _MARK * c.isprintable() * (c != " ") for b in range(128)] + [0] * 128, np.uint8)
#: Whether the two bytes of a character, five and six bits of them, make a letter.
_LETTER = np.array([k >= 0x80 and chr(k).isalpha() for k in range(0x800)])


def _byte_characters() -> dict[int, str]:
    """The printable stand-ins of the byte-level alphabet: visible bytes for themselves, others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_CHARS = _byte_characters()
_BYTE_CODES = np.array([ord(_BYTE_CHARS[b]) for b in range(256)], "<u2")
_SPACE = _BYTE_CHARS[0x20]


def _splits_at_spaces(path: str) -> bool:
    """Whether the file says what the cuts of this module rest on."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    return (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and said.get("normalizer") is None
        and said.get("truncation") is None
        and said.get("padding") is None
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )


def _stand_ins(text: str) -> str:
    """A text in the byte-level alphabet."""
    return text.encode().decode("latin-1").translate(_BYTE_CHARS)


def _words_apart(tokens: list[str]) -> bool:
    """Whether no token can lie across the end of a word of letters and the space after it.

    Then the model merges within each of several words in a row what it merges in each alone.
    """
    own = {c: bytes([b]) for b, c in _BYTE_CHARS.items()}
    if not own.keys() <= set(tokens):
        return False
    for token in tokens:
        before, *words = token.split(_SPACE)
        whole = [b"".join(own.get(c, b"") for c in w).decode("utf-8", "replace") for w in words[:-1]]
        if words and before or any(w.isalpha() for w in whole):
            return False
    return True


class SegmentEncoder:
    """Ids of whole texts as little-endian bytes, two or four to an id depending on the vocabulary."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splits = _splits_at_spaces(path) and not any(re.search(r"\s", a) for a in self.added)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # a byte-level token has one character to a byte
        self._bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self._apart = _words_apart(list(self.tokenizer.get_vocab()))
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._bare: dict[str, bytes] = {}

    def one(self, token_id: int) -> bytes:
        return np.array([token_id], self.dtype).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _cut(self, words: list[str], ids: np.ndarray, data: np.ndarray, known: dict[str, bytes]) -> None:
        """Give each word its share of the ids of them all, ``data`` being their bytes, each after a space."""
        ends = np.append(np.flatnonzero(data[1:] == 0x20) + 1, len(data))
        cuts = ((np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1) * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        known.update(zip(words, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))

    def _together(self, words: list[str], known: dict[str, bytes]) -> None:
        """Encode words, each after a space, in a few calls, and cut the ids where the words end."""
        at, held = 0, 0
        for k, w in enumerate(words):
            held += len(w) + 1
            if held >= CALL_CHARS or k == len(words) - 1:
                some, at, held = words[at : k + 1], k + 1, 0
                text = " " + " ".join(some)
                self._cut(some, self._ids(text), np.frombuffer(text.encode(), np.uint8), known)

    def _letters(self, words: list[str], known: dict[str, bytes]) -> None:
        """Encode words of letters, each after a space and so a pre-token: the model alone is asked, for many at once if it can."""
        tokenize, step = self.tokenizer.model.tokenize, CALL_WORDS if self._apart else 1
        for at in range(0, len(words), step):
            some = words[at : at + step]
            data = np.frombuffer((" " + " ".join(some)).encode(), np.uint8)
            ids = np.array([t.id for t in tokenize(_BYTE_CODES[data].tobytes().decode("utf-16-le"))], self.dtype)
            self._cut(some, ids, data, known)

    def _learn(self, segments: list[str]) -> dict[str, bytes]:
        """Encode segments that follow a space; returns those that aren't kept: long ones."""
        known, old = self._known, self._old
        fresh, mixed, long_ = [], [], []
        for s in segments:
            held = old.get(s)
            if held is not None:
                known[s] = held
            elif len(s) > CACHE_LENGTH:
                long_.append(s)
            elif s.isalpha():
                fresh.append(s)
            else:
                mixed.append(s)
        self._letters(fresh, known)
        self._together(mixed, known)
        once: dict[str, bytes] = {}
        self._together(long_, once)
        return once

    def _learn_bare(self, pieces: list[str]) -> dict[str, bytes]:
        """Encode pieces that no space stands before; returns those that aren't kept: long ones."""
        bare, once = self._bare, {}
        if len(bare) > CACHE_SEGMENTS:
            bare.clear()
        for p in pieces:
            (bare if len(p) <= CACHE_LENGTH else once)[p] = self._first(p)
        return once

    def _first(self, piece: str) -> bytes:
        """A piece that no space stands before; letters are one pre-token, for which the model alone is asked."""
        if not piece.isalpha():
            return self._ids(piece).tobytes()
        return np.array([t.id for t in self.tokenizer.model.tokenize(piece if piece.isascii() else _stand_ins(piece))], self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return [self._ids(t).tobytes() for t in texts]
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        if whole:
            rest = iter(self._in_pieces([t for i, t in enumerate(texts) if i not in whole]))
            return [self._ids(t).tobytes() if i in whole else next(rest) for i, t in enumerate(texts)]
        return self._in_pieces(texts)

    def _in_pieces(self, texts: list[str]) -> list[bytes]:
        """Pieces are told apart and ids put together in arrays; only distinct pieces are looked up."""
        if not texts:
            return []
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        pieces, first = _cut_at_marks(parts.values)
        bounds = first[parts.offsets.to_numpy()]
        spaced = np.zeros(len(pieces), bool)
        spaced[first[:-1]] = True
        spaced[bounds[:-1]] = False
        entry, found, odd, shift = np.empty(len(pieces), np.int32), [], [], 0
        for mask, learn, known in ((spaced, self._learn, self._known), (~spaced, self._learn_bare, self._bare)):
            coded = pieces.filter(pa.array(mask)).dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            entry[mask] = coded.indices.to_numpy() + shift
            ids = list(map(known.get, distinct))
            missing = []
            for i, x in enumerate(ids):
                if x is None:
                    w = distinct[i]
                    if w and w.strip() == w or w == "\n" and known is self._bare:
                        missing.append(i)
                    else:
                        ids[i] = b""
                        odd.append(shift + i)
            once = learn([distinct[i] for i in missing])
            for i in missing:
                word = distinct[i]
                ids[i] = once[word] if word in once else known[word]
            found += ids
            shift += len(distinct)
        runs = set()  # texts with white space besides single spaces, and line ends, between words
        if odd:
            strange = np.zeros(len(found), bool)
            strange[odd] = True
            runs.update(np.unique(np.searchsorted(bounds, np.flatnonzero(strange[entry]), "right") - 1).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        flat, begin, n = np.frombuffer(b"".join(found), self.dtype), np.cumsum(size) - size, size[entry]
        ends = np.cumsum(n)
        total = int(ends[-1])
        kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        raw = flat[np.repeat((begin[entry] - ends + n).astype(kind), n) + np.arange(total, dtype=kind)].tobytes()
        cuts = (np.concatenate([[0], ends])[bounds] * self.dtype.itemsize).tolist()
        out = [self._with_runs(t) if k in runs else raw[a:b] for k, (t, a, b) in enumerate(zip(texts, cuts, cuts[1:]))]
        if len(self._known) > CACHE_SEGMENTS:
            self._old, self._known = self._known, {}
        return out

    def _with_runs(self, text: str) -> bytes:
        """A text with runs of white space: only single spaces between words, and marks after words there, are cut at."""
        out, known, bare = [], self._known, self._bare
        if not text:
            return b""
        for piece in _CUT.split(text):
            word = piece[1:] if piece[:1] == " " else ""
            found = known.get(word) if word else None
            if found is None and word[-2:-1].isalpha() and word[-1:] in bare and not word[-1].isalnum():
                before = known.get(word[:-1])
                found = None if before is None else before + bare[word[-1]]
            out.append(self._ids(piece).tobytes() if found is None else found)
        return b"".join(out)


def _cut_at_marks(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cut words further where a pre-token ends for certain; returns the pieces and the number of each word's first, and of all.

    These places are between a letter or digit and ASCII punctuation, but after an apostrophe, and on both sides of a
    line end between two characters that surely aren't white space.  Letters are those of one or two bytes: what others
    are isn't asked, so nothing is cut beside them.
    """
    _, offsets, held = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    last = int(ends[-1])
    data = np.frombuffer(held, np.uint8)[:last] if held else np.empty(0, np.uint8)
    kinds = _KIND[data]
    cut = np.zeros(last + 2, bool)

    def letter(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a & 0xE0 == 0xC0) & _LETTER[(a & 31).astype(np.int16) << 6 | b & 63]

    at = np.flatnonzero(kinds > _ALNUM)
    kind, left, right = kinds[at], np.maximum(at - 1, 0), np.minimum(at + 1, last - 1)
    # a piece that begins or ends a word has no neighbour there: those places are taken out below
    word_left = (kinds[left] == _ALNUM) | (data[left] & 0xC0 == 0x80) & letter(data[np.maximum(left - 1, 0)], data[left])
    word_right = (kinds[right] == _ALNUM) | letter(data[right], data[np.minimum(right + 1, last - 1)])
    starts = np.zeros(last + 2, bool)
    starts[ends] = True
    sign = kind != _LINE
    cut[at[sign & word_left]] = True
    cut[at[(kind == _MARK) & word_right] + 1] = True
    seen = _MARK | _QUOTE
    alone = ~sign & (word_left | (kinds[left] & seen > 0)) & (word_right | (kinds[right] & seen > 0)) & ~starts[at] & ~starts[at + 1]
    cut[at[alone]] = cut[at[alone] + 1] = True
    places = np.flatnonzero(cut & ~starts)
    owner = np.searchsorted(ends, places, "right") - 1
    first = np.arange(len(ends)) + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
    moved = np.empty(len(ends) + len(places), np.int64)
    moved[first] = ends
    moved[owner + 1 + np.arange(len(places))] = places
    return pa.LargeStringArray.from_buffers(len(moved) - 1, pa.py_buffer(moved), held), first


def encoder(path: str) -> SegmentEncoder:
    """One encoder to a worker process, until another operator runs there."""
    held = worker_cache("segments")
    if path not in held:
        gc.set_threshold(200_000, 20, 100)  # the caches hold no cycles: look for these seldom
        held[path] = SegmentEncoder(path)
    return held[path]


def encoded_batches(batches, path: str, end_id: int, id_name: str = "_id", text_name: str = "_text", most: int = STEP_CHARS):
    """(ids of rows, encoder, encoded texts with the end id) for rows of Arrow batches, some ``most`` characters at a time."""
    enc = encoder(path)
    end = enc.one(end_id)
    for batch in batches:
        keys, texts = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (id_name, text_name))
        at = held = 0
        for k, text in enumerate(texts, 1):
            held += len(text)
            if held >= most or k == len(texts):
                yield keys[at:k], enc, [x + end for x in enc.encode(texts[at:k])]
                at, held = k, 0
