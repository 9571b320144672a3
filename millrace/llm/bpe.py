"""Byte-level BPE by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds all tokens in a pre-token in one pass. The encoder takes the longest
token at each place that is compatible with the token before it and backs up where none is; places that led nowhere are
remembered, so each is left once. Two tokens are compatible if merging their joined bytes gives just the two: no merge
across the border may come due while both of its sides stand there. The result is exactly that of the merge list.

Vocabulary files are read on the executors from the path given; they are never trained, changed or copied.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import map_texts

#: The pre-token pattern of byte-level BPE, with white space as Unicode's White_Space property has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same pattern for texts of ASCII and Latin letters alone, for the faster engine.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
NOT_LATIN = rf"[^\x00-\x7f{_LETTER}]"
LATIN = rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^\t-\r 0-9{_LETTER}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Pre-tokens whose ids a worker remembers, pairs whose compatibility it remembers, characters that are split at once.
REMEMBERED, PAIRS, PIECE = 250_000, 1 << 18, 1 << 20
_NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: Latin-1's own printable characters for
    themselves, and for the other bytes, in order, the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Codec:
    """Encoder and decoder of one vocabulary file (a tokenizers JSON with a BPE model and ByteLevel pre-tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        raw = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        added = {t["id"]: t["content"] for t in spec.get("added_tokens", ())}
        self.added = {t: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.pattern, self.latin, self.not_latin = regex.compile(PATTERN), re.compile(LATIN), re.compile(NOT_LATIN)
        # offset table: the bytes of token i are blob[offsets[i]:offsets[i + 1]]
        every = {**{i: b for i, b in raw.items()}, **{i: t.encode() for i, t in added.items()}}
        size = max(every) + 1
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(every.get(i, b"")) for i in range(size)], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(every.get(i, b"") for i in range(size)), np.uint8)
        self.ids = {b: i for i, b in raw.items() if i not in added}
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            if a in vocab and b in vocab and a + b in vocab:
                self.rank[vocab[a], vocab[b]] = r
                if vocab[a + b] not in self.halves and len(raw.get(vocab[a + b], b"")) > 1:
                    self.halves[vocab[a + b]] = vocab[a], vocab[b]
                    self.born[vocab[a + b]] = r
        self.compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.sizes = np.diff(self.offsets).tolist()
        # the longest token that is a proper prefix of each token, or -1
        self.shorter = [-1] * size
        usable = {b: i for b, i in self.ids.items() if len(b) == 1 or i in self.halves}
        for b, i in usable.items():
            if len(b) > 1:
                self.automaton.add_word(b.decode("latin-1"), (len(b) - 1, i))
            self.shorter[i] = next((usable[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in usable), -1)
        self.single = [usable.get(bytes([b]), -1) for b in range(256)]
        self._sides: dict[tuple[int, bool], list] = {}
        self.automaton.make_automaton()
        self.known = _Remembered(self)

    def _side(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(token, until) of the tokens that stand at one border of ``token`` in turn while it is put together."""
        got = self._sides.get((token, right))
        if got is None:
            got, until, part = [], _NEVER, token
            while True:
                got.append((part, until))
                if part not in self.halves:
                    break
                part, until = self.halves[part][right], self.born[part]
            got = self._sides[token, right] = got[::-1]
        return got

    def pair_fits(self, a: int, b: int) -> bool:
        got = self.compatible.get((a, b))
        if got is None:
            got = True
            left, right, i, j = self._side(a, True), self._side(b, False), 0, 0
            while True:
                (x, x_until), (y, y_until) = left[i], right[j]
                r = self.rank.get((x, y))
                # at one rank merges go from left to right: within a before the border, the border before those in b
                if r is not None and r < x_until and r <= y_until:
                    got = False
                    break
                if i == len(left) - 1 and j == len(right) - 1:
                    break
                if x_until <= y_until:
                    i += 1
                if y_until <= x_until:
                    j += 1
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            self.compatible[a, b] = got
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if piece in self.ids:
            return [self.ids[piece]] if len(piece) == 1 or self.ids[piece] in self.halves else self._search(piece)
        return self._search(piece)

    def _search(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [*map(self.single.__getitem__, piece), -1]
        for end, (ahead, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - ahead] = token  # ends ascend, so the longest stays
        sizes, shorter, known, fits = self.sizes, self.shorter, self.compatible, self.pair_fits
        dead, pos, out, token = set(), 0, [], longest[0]
        while pos < n:
            while token >= 0:
                if pos + sizes[token] not in dead:
                    if not out:
                        break
                    fit = known.get((out[-1], token))
                    if fits(out[-1], token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += sizes[token]
                token = longest[pos]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                dead.add(pos)
                token = out.pop()
                pos -= sizes[token]
                token = shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; strings of added tokens are those tokens."""
        parts = self.split_added.split(text) if self.split_added else [text]
        return b"".join(self.added[p] if k % 2 else self._encode_plain(p) for k, p in enumerate(parts))

    def _encode_plain(self, text: str) -> bytes:
        look = self.known.__getitem__
        pattern = self.pattern if self.not_latin.search(text) else self.latin
        if len(text) <= PIECE:
            return b"".join(map(look, pattern.findall(text)))
        matches, out = (m[0] for m in pattern.finditer(text)), []
        while part := list(islice(matches, 1 << 16)):
            out.append(b"".join(map(look, part)))
        return b"".join(out)

    def forget(self) -> None:
        """Drop what was remembered of pre-tokens and pairs."""
        self.known.clear()
        self.compatible.clear()
        self._sides.clear()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, each a slice of the table; memory is bounded by a block of ids."""
        x = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for k in range(0, len(x), 1 << 16):
            start = self.offsets[x[k : k + (1 << 16)]]
            size = self.offsets[x[k : k + (1 << 16)] + 1] - start
            before = np.cumsum(size) - size
            out.append(self.blob[np.repeat(start - before, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


class _Remembered(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        got = np.array(self.codec.encode_piece(piece.encode()), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = got
        return got


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a file, loaded once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _forget() -> None:
    """At a task's end: workers live on; what a task has remembered does not."""
    for c in _codecs.values():
        c.forget()


def _text_of(value) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as array<int> in column ``ids``, in place of a column of that name.

    Null and empty texts have no ids. Repeated rows are encoded alike; an empty table gives an empty one; the other columns
    may have any names."""

    def make(column):
        c = codec(path)
        got = [np.frombuffer(c.encode(_text_of(t)), "<i4") for t in column]
        ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.empty(0, np.int32)))]

    return map_texts(docs, text, make, {ids: "array<int>"}, binary=True, done=_forget)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's ids in column ``text``, in place of a column of that name. Null ids are none;
    bytes that are no UTF-8 become U+FFFD; ids that the file lacks fail. Repeated rows and empty tables stay what they are."""

    def make(column):
        c = codec(path)
        return [pa.array([c.decode(np.array(i.as_py() or [], "<u4").tobytes()).decode("utf-8", "replace") for i in column], pa.string())]

    return map_texts(docs, ids, make, {text: "string"})


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded in one pass. Null texts are
    empty ones; repeated rows and null keys give rows of their own; an empty table gives an empty one; other columns are
    not read."""

    def make(column):
        c = codec(path)
        out: list[list] = [[], [], []]
        for t in column:
            ids = c.encode(_text_of(t))
            back = c.decode(ids).decode("utf-8", "replace").encode()
            for o, v in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()), strict=True):
                o.append(v)
        return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]

    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = map_texts(narrow, "t", make, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, drop=("t",), binary=True, done=_forget)
    return found.withColumnRenamed("k", key)
