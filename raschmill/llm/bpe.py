"""Byte-level BPE encoding by backtracking, and decoding through an offset table.

Encoding: an Aho-Corasick automaton over the vocabulary gives the longest token at every position
of a piece. The encoder takes the longest token whose pair with the token before it is compatible
(their joint text would not have been merged across the border earlier), else the next shorter
prefix token, else steps back and marks the position as a dead end. Each position is left dead at
most once, so the work is linear in the piece, and the tokens are exactly those of the merges.

Decoding: the bytes of all tokens lie in one array; ids are expanded by one vectorised gather
through the array of offsets.

Pieces repeat, so each worker keeps encodings of white-space chunks in a table of at most CACHE_ENTRIES entries
and CACHE_BYTES bytes that is emptied when full; chunks over CHUNK characters are not kept. The table of
compatible pairs is bounded by CACHE_ENTRIES as well.

Defined results: a null text encodes as the empty text (no tokens; decoded text empty); strings of
added tokens inside a text become those tokens, as in the library; repeated rows are encoded each; a very
long text is encoded whole, as a slice of its own; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

CACHE_ENTRIES, CACHE_BYTES, CHUNK = 300_000, 12 << 20, 200
_SLICE_ROWS_BYTES = 1 << 20

# The published piece pattern of the byte-level tokenizer, and Unicode white space.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte: Latin-1 printables stand for themselves, the rest follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class OffsetTable:
    """Byte strings in one array; expand() joins those of a sequence of ids."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.blob = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def expand(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(joined bytes, byte bounds) of ids cut at ``bounds``."""
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        where = np.repeat(self.at[ids] - ends[:-1], size)
        where += np.arange(ends[-1])
        return self.blob[where].tobytes(), ends[bounds]


class BacktrackingBpe(dict):
    """A byte-level BPE model from a tokenizer file. As a dict: chunk of text -> its ids as bytes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

        # Tokens are numbered in the order in which merging makes them: bytes, then each merge.
        self._bytes: list[bytes] = [bytes([b]) for b in range(256)]
        of_char = {b: c for c, b in to_byte.items()}
        self._id: list[int] = [vocab.get(of_char[b], -1) for b in range(256)]
        number = {of_char[b]: b for b in range(256)}
        self._parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self._joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = number[left], number[right]
            k = number.setdefault(left + right, len(self._bytes))
            if k == len(self._bytes):
                self._bytes.append(self._bytes[a] + self._bytes[b])
                self._id.append(vocab[left + right])
                self._parts.append((a, b))
            self._joined.setdefault((a, b), k)
        self._len = [len(b) for b in self._bytes]
        self._longest = ahocorasick.Automaton()
        of_bytes = {b: k for k, b in enumerate(self._bytes)}
        for b, k in of_bytes.items():
            self._longest.add_word(b.decode("latin-1"), k)
        self._longest.make_automaton()
        self._shorter: list[int] = [next((of_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in of_bytes), -1) for b in self._bytes]
        self._fits: dict[int, bool] = {}
        self._held = 0

        size = max([*vocab.values(), *self.added.values()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        strings = [b""] * size
        for s, i in vocab.items():
            strings[i] = raw(s)
        for s, i in self.added.items():
            strings[i] = s.encode()
        self.texts = OffsetTable(strings)
        self.decimals = OffsetTable([b"%d," % i for i in range(size)])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging would leave a | b as neighbours: no merge across the border comes before those inside."""
        known = self._fits.get(key := a << 32 | b)
        if known is None:
            if len(self._fits) >= CACHE_ENTRIES:
                self._fits.clear()
            known = self._fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        latest = len(self._bytes)
        while True:
            k = self._joined.get((a, b))
            if k is not None and k < latest:
                return False
            # Undo the later of both merges; what it made existed only from then on.
            if a > b:
                latest, whole = a, a
                a = self._parts[a][1]
                if a == whole:
                    return True
            else:
                latest, whole = b + 1, b
                b = self._parts[b][0]
                if b == whole:  # both are bytes, or a is the earlier one
                    latest, whole = a, a
                    a = self._parts[a][1]
                    if a == whole:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        for end, k in self._longest.iter(piece.decode("latin-1")):
            s = end - self._len[k] + 1
            if longest[s] < 0 or self._len[k] > self._len[longest[s]]:
                longest[s] = k
        out: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, k = 0, longest[0] if n else -1
        while at < n:
            before = out[-1] if out else -1
            while k >= 0 and not (alive[at + self._len[k]] and (before < 0 or self.compatible(before, k))):
                k = self._shorter[k]
            if k >= 0:
                out.append(k)
                at += self._len[k]
                k = longest[at] if at < n else -1
            else:
                alive[at] = 0
                k = out.pop()
                at -= self._len[k]
        return [self._id[k] for k in out]

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= CHUNK:
            self._held += len(text) + len(ids)
            if len(self) >= CACHE_ENTRIES or self._held > CACHE_BYTES:
                self.clear()
                self._held = 0
            self[text] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        pieces = _PIECE.findall(chunk)
        for p in pieces:
            if len(pieces) > 1:
                ids.extend(np.frombuffer(self.piece(p), self.dtype).tolist())
            else:
                ids.extend(self.encode_piece(p.encode()))
        return self._keep(chunk, np.array(ids, dtype=self.dtype).tobytes())

    def piece(self, p: str) -> bytes:
        """The ids of one piece, shared with chunks that are that piece alone."""
        known = self.get(p)
        if known is None:
            known = self._keep(p, np.array(self.encode_piece(p.encode()), dtype=self.dtype).tobytes())
        return known

    def encode_bytes(self, text: str) -> bytes:
        if self._added is not None and self._added.search(text):
            out, at = [], 0
            for m in self._added.finditer(text):
                out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], self.dtype).tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), self.dtype).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        return self.texts.expand(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")


_models: dict[str, BacktrackingBpe] = {}


def model(path: str) -> BacktrackingBpe:
    """The worker's model for a file; kept while the worker lives."""
    if path not in _models:
        _models[path] = BacktrackingBpe(path)
    return _models[path]


def _text_slices(col: pa.Array) -> Iterator[list[str]]:
    col = pc.fill_null(col.cast(pa.large_string()), "")
    some: list[str] = []
    size = 0
    for s in col:
        some.append(s.as_py())
        size += len(some[-1])
        if size >= _SLICE_ROWS_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _encoded(bpe: BacktrackingBpe, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [bpe.encode_bytes(t) for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(p) // bpe.dtype.itemsize for p in parts])))
    return np.frombuffer(b"".join(parts), bpe.dtype), bounds


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids (array<int>) for every document."""
    two = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            at = 0
            for texts in _text_slices(b.column("text")):
                ids, bounds = _encoded(bpe, texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(texts)), lists], ["id", "ids"])
                at += len(texts)

    return two.mapInArrow(run, f"id {two.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """id, text from id, ids; null ids decode as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            texts = [bpe.decode(x.as_py() or []) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: id, n_tokens, ids_sha256, decoded_sha256 (and ids, if wanted)."""
    two = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = two.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            at = 0
            for texts in _text_slices(b.column("text")):
                ids, bounds = _encoded(bpe, texts)
                wide = ids.astype(np.int64)
                digits, cut = bpe.decimals.expand(wide, bounds)
                listed = [hashlib.sha256(digits[i : max(i, j - 1)]).hexdigest() for i, j in zip(cut[:-1], cut[1:])]
                raw, cut = bpe.texts.expand(wide, bounds)
                decoded = [hashlib.sha256(raw[i:j].decode("utf-8", "replace").encode()).hexdigest() for i, j in zip(cut[:-1], cut[1:])]
                out = [b.column("id").slice(at, len(texts)), pa.array(np.diff(bounds), pa.int64()), pa.array(listed), pa.array(decoded)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)
                at += len(texts)
        release()

    return two.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
