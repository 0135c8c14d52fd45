"""Token ids in fixed-width bit-packed blocks, in ascending document order.

Format: a Parquet folder, one row per block: the part (range partition) and the number of the
block, how many ids of the part precede it, the width in bits, its document ids, the end of each
document inside the block, and the payload, in which id i takes the bits [i * width, (i + 1) *
width), least significant first. The width is the least that holds every id of the vocabulary.
Spark's own writer commits the files, so a lost executor's task is simply run again. Any document
is found through the block's first and last id (row-group statistics) and its offset alone;
unpacking is one vectorised numpy step.

Only the number of ids of each part comes to the driver, one number per range partition.

Texts are encoded with the tokenizers library. Its normaliser and splitter never cross a space or a
line feed, so a worker finds the distinct runs between them in the bytes of a slice of texts, asks the library for those it
does not know, and puts the ids of all runs together in numpy. Runs are grouped by a hash and then
compared byte by byte; what it keeps is bounded by CACHE_ENTRIES runs and CACHE_IDS ids.

Defined results: a null text is empty and has the end id alone; null ids come first, then
ascending; rows with the same id are ordered by their text; an empty table gives no block; a very long text is a
slice and a block of its own; other columns do not matter.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, byte_view, mix, sliced

CACHE_ENTRIES, CACHE_IDS = 600_000, 6_000_000
SLICE = 4 << 20
#: Runs of up to EIGHTS eight-byte words are grouped in numpy.
EIGHTS = 4
BLOCK_IDS = 1 << 18
BLOCK = "part int, block int, before long, width int, n_ids long, doc_ids array<{0}>, ends array<long>, first_id {0}, last_id {0}, payload binary"


def width_of(vocabulary: int) -> int:
    """Bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, end: int) -> np.ndarray:
    """Ids [start, end) of a block; only their bytes are touched."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{width // 8}")[start:end].astype(np.uint32)
    first, last = start * width // 8, -(-end * width // 8)
    bits = np.unpackbits(np.frombuffer(payload[first:last], dtype=np.uint8), bitorder="little")
    skip = start * width - first * 8
    bits = bits[skip : skip + (end - start) * width].reshape(-1, width).astype(np.uint32)
    return (bits << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


_U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


# Letters, apostrophe and other punctuation of ASCII.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127], _KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[39] = 2, 0, 1, 1, 3


class _Runs:
    """Pieces between spaces and line feeds of some texts that encode by themselves, and their keys.

    In a run of ASCII and Latin-1, letters A-Z become a-z, which changes neither lower case nor composition of
    what is around them, and the run is cut between letters and punctuation, where the splitter cuts as well (not after an
    apostrophe, which may begin a contraction). Runs with other characters, or with the "<" of a special token, stay as they are.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        kind = _KIND[data]
        high = np.flatnonzero(data[:-1] == 0xC3)
        high = high[(data[high + 1] != 0x97) & (data[high + 1] != 0xB7)]
        kind[high] = kind[high + 1] = 1
        inside = (data != 32) & (data != 10)
        low = _LOWER[data]
        odd = np.flatnonzero((data >= 0xC4) | (data == 60))
        if len(odd):
            begin, end = self._edges(inside, offs, np.zeros(n + 1, dtype=bool))
            raw = np.unique(np.searchsorted(begin, odd, side="right") - 1)
            step = np.zeros(n + 1, dtype=np.int8)
            step[begin[raw]] += 1
            step[end[raw]] -= 1
            raw = np.cumsum(step[:-1], dtype=np.int8) > 0
            low, kind = np.where(raw, data, low), np.where(raw, 0, kind)
        cut = np.zeros(n + 1, dtype=bool)
        letter = kind == 1
        cut[1:n] = (letter[:-1] & (kind[1:] >= 2)) | ((kind[:-1] == 2) & letter[1:])
        self.start, self.end = self._edges(inside, offs, cut)
        self.low = np.concatenate((low, np.zeros(8 * EIGHTS + 8, dtype=np.uint8)))
        self.letter = letter
        self.length = self.end - self.start

    @staticmethod
    def _edges(inside: np.ndarray, offs: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(inside)
        cut = cut.copy()
        cut[offs] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:n]
        ends[:-1] &= ~inside[1:] | cut[1:n]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def __len__(self) -> int:
        return len(self.start)

    def eight(self, j: int, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Bytes 8 j to 8 j + 7 of the runs as one number; bytes beyond a run's end are 0."""
        words = np.ndarray((len(self.low) - 7,), "<u8", buffer=self.low, strides=(1,))
        return words[self.start[which] + 8 * j] & _MASK[np.clip(self.length[which] - 8 * j, 0, 8)]

    def text(self, i: int) -> str:
        return self.low[self.start[i] : self.end[i]].tobytes().decode()


class RunEncoder:
    """Ids of texts, by asking the library for distinct runs.

    Known runs are kept as bytes (EIGHTS words) and ids; when there are more than the bound, those that the slice before did not
    use are dropped.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.slice = 0
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.eights = np.zeros((0, EIGHTS), dtype=np.uint64)
        self.length = np.zeros(0, dtype=np.int64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), 20_000):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
        return out

    def _asked(self, r: _Runs, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each run, all ids).

        Runs of Latin letters are one word each, so many go to the library together, and the ids that end a word tell them apart.
        """
        length = r.length[at]
        plain = np.logical_and.reduceat(r.letter[_spread(r.start[at], length)], np.cumsum(length) - length)
        words, other = at[plain], at[~plain]
        size = r.length[words] + 1
        put = np.cumsum(size) - size
        line = np.full(size.sum(), 32, dtype=np.uint8)
        line[_spread(put, size - 1)] = r.low[_spread(r.start[words], size - 1)]
        cuts = [*put[::256].tolist(), len(line)]
        ids = self._flat([line[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])])[1]
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):  # a vocabulary without word ends
            own, ids = self._flat([r.text(i) for i in words.tolist()])
            ends = np.cumsum(own)
        own, rest = self._flat([r.text(i) for i in other.tolist()])
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        lens, begin = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        lens[order] = np.concatenate((np.diff(ends, prepend=0), own))
        begin[order] = np.cumsum(lens[order]) - lens[order]
        return lens, np.concatenate((ids, rest))[_spread(begin, lens)]

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        own = self._ids(texts)
        return np.array([len(e) for e in own], dtype=np.int64), np.array([x for e in own for x in e], dtype=np.uint32)

    def _add(self, eights: np.ndarray, length: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> np.ndarray:
        first = len(self.begin)
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(lens) - lens))
        self.count = np.concatenate((self.count, lens))
        self.ids = np.concatenate((self.ids, ids))
        self.eights = np.concatenate((self.eights, eights))
        self.length = np.concatenate((self.length, length))
        self.used = np.concatenate((self.used, np.full(len(lens), self.slice)))
        return first + np.arange(len(lens))

    def _trim(self) -> None:
        if len(self.begin) <= CACHE_ENTRIES and len(self.ids) <= CACHE_IDS:
            return
        keep = self.used == self.slice
        if keep.sum() > CACHE_ENTRIES // 2 or self.count[keep].sum() > CACHE_IDS // 2:
            return self._empty()
        place = np.cumsum(keep) - 1
        stays = keep[self.at]
        self.keys, self.at = self.keys[stays], place[self.at[stays]]
        self.ids = self.ids[_spread(self.begin[keep], self.count[keep])]
        self.count = self.count[keep]
        self.begin = np.cumsum(self.count) - self.count
        self.eights, self.length, self.used = self.eights[keep], self.length[keep], self.used[keep]

    def _entries(self, r: _Runs) -> np.ndarray:
        """The entry of each run."""
        deep = [np.flatnonzero(r.length > 8 * j) for j in range(1, EIGHTS)]
        words = [r.eight(0), *(r.eight(j, d) for j, d in enumerate(deep, 1))]
        key = mix(words[0] + r.length.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        for w, d in zip(words[1:], deep):
            key[d] = mix(key[d] * _U(0x9E3779B97F4A7C15) + w)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        entry = np.full(len(distinct), -1)
        if len(self.keys):
            near = np.minimum(place, len(self.keys) - 1)
            entry = np.where(self.keys[near] == distinct, self.at[near], -1)
        new = np.flatnonzero((entry < 0) & (r.length[first] <= 8 * EIGHTS))
        if len(new):
            at = first[new]
            entry[new] = self._add(np.stack([r.eight(j, at) for j in range(EIGHTS)], axis=1), r.length[at], *self._asked(r, at))
            self.keys, self.at = np.insert(self.keys, place[new], distinct[new]), np.insert(self.at, place[new], entry[new])
        found = entry[back]
        # Byte by byte: what a hash has put together by chance, and what is longer, goes to the library by itself.
        wrong = (found < 0) | (self.length[found] != r.length) | (self.eights[found, 0] != words[0])
        for j, (w, d) in enumerate(zip(words[1:], deep), 1):
            wrong[d] |= self.eights[found[d], j] != w
        wrong |= r.length > 8 * EIGHTS
        bad = np.flatnonzero(wrong)
        if len(bad):
            texts = [r.text(i) for i in bad.tolist()]
            names = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            own = self._add(np.zeros((len(names), EIGHTS), np.uint64), np.full(len(names), -1), *self._flat(list(names)))
            found[bad] = own[[names[t] for t in texts]]
        self.used[found] = self.slice
        return found

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts with the end id after each, bounds)."""
        self._trim()
        self.slice += 1
        r = _Runs(data, offs)
        doc = np.searchsorted(offs, r.start, side="right") - 1
        found = self._entries(r) if len(r) else np.zeros(0, np.int64)
        lens = self.count[found]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=lens, minlength=len(offs) - 1).astype(np.int64) + 1)))
        out = np.empty(bounds[-1], dtype=np.uint32)
        put = np.cumsum(lens) - lens + doc  # an end id after each text before
        out[_spread(put, lens)] = self.ids[_spread(self.begin[found], lens)]
        out[bounds[1:] - 1] = end_id
        return out, bounds

    def encode_all(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(*byte_view(pa.array(texts, pa.string())), end_id)


def _spread(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (lens[0] of them), begin[1], ..."""
    ends = np.cumsum(lens)
    return np.repeat(begin - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


_encoders: dict[str, RunEncoder] = {}


def _encoder(path: str) -> RunEncoder:
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the packed blocks to ``path`` in ascending order of the document ids."""
    spark = docs.sparkSession
    two = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = two.repartitionByRange(parts, F.asc_nulls_first("id"), F.asc_nulls_first(F.xxhash64("text"))).sortWithinPartitions(F.asc_nulls_first("id"), F.asc_nulls_first("text"))
    kind = two.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        width = width_of(max(enc.vocabulary, end_id + 1))
        part, number, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            for at, upto, data, offs in sliced(b.column("text"), SLICE):
                ids, bounds = enc.encode(data, offs, end_id)
                lo, n_texts = 0, upto - at
                while lo < n_texts:  # blocks of about BLOCK_IDS ids, whole documents each
                    hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK_IDS, side="right")) - 1)
                    own = b.column("id").slice(at + lo, hi - lo)
                    n = int(bounds[hi] - bounds[lo])
                    kept = own.drop_null()
                    edge = [kept[0].as_py(), kept[-1].as_py()] if len(kept) else [None, None]
                    row = [part, number, before, width, n, own.to_pylist(), (bounds[lo + 1 : hi + 1] - bounds[lo]).tolist(), *edge, pack(ids[bounds[lo] : bounds[hi]], width)]
                    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(own.type), pa.list_(pa.int64()), own.type, own.type, pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)
                    number, before, lo = number + 1, before + n, hi

    names = ["part", "block", "before", "width", "n_ids", "doc_ids", "ends", "first_id", "last_id", "payload"]
    ordered.mapInArrow(run, BLOCK.format(kind)).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids of every document."""
    blocks = spark.read.parquet(path)
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, width, ends, doc_ids, payload in zip(*(b.column(c) for c in ("part", "before", "width", "ends", "doc_ids", "payload"))):
                cut = np.concatenate(([0], np.asarray(ends.values, dtype=np.int64)))
                ids = unpack(payload.as_py(), width.as_py(), 0, int(cut[-1]))
                out = [
                    doc_ids.values,
                    pa.array(cut[:-1] + (starts[part.as_py()] + before.as_py())),
                    pa.array(np.diff(cut)),
                    pa.array([zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(cut[:-1], cut[1:])], pa.int64()),
                ]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return blocks.select("part", "before", "width", "ends", "doc_ids", "payload").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: object) -> list[list[int]]:
    """Random access: the ids of each row with this document id; only blocks that may hold it are read."""
    found = []
    for r in spark.read.parquet(path).where((F.col("first_id") <= F.lit(doc_id)) & (F.col("last_id") >= F.lit(doc_id))).orderBy("part", "block").toLocalIterator():
        cut = [0, *r["ends"]]
        found += [unpack(r["payload"], r["width"], cut[i], cut[i + 1]).tolist() for i, d in enumerate(r["doc_ids"]) if d == doc_id]
    return found
