"""What several operators of this subpackage share: byte views of Arrow text columns,
vectorised word splitting and rolling hashes, stable splits, and shared storage.

Texts are handled as the UTF-8 bytes that Arrow already holds, so no Python string is made
for a document. Work is cut into slices of about SLICE_BYTES so that a worker's memory does
not depend on the batch; a single document longer than that is a slice of its own.
"""

from __future__ import annotations

import ctypes
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_U = np.uint64


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(col).cast("string")) % F.lit(mod)


def crc_mod_py(value: object, mod: int) -> int:
    return zlib.crc32(str(value).encode()) % mod


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset (tests), one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and any executor can read it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*keep) if keep else out


class Scratch:
    """Intermediate tables of one call in the shared folder, deleted together once the result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_folder(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a task no longer uses back to the system; a worker outlives its tasks, and allocators keep what is freed."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc only
except (AttributeError, OSError):
    _trim = None


# ---------------------------------------------------------------- bytes of a text column


def byte_view(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, offs


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) whose texts hold about ``limit`` bytes together."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def sliced(col: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """(lo, hi, bytes, offsets from 0) for each slice of a text column."""
    data, offs = byte_view(col)
    for lo, hi in slices(offs, limit):
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


# ---------------------------------------------------------------- rolling hashes

_rng = np.random.default_rng(20240229)
#: A random value for each byte, so that the low bits of a polynomial hash are random as well.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    got = _powers.get(which)
    if got is None or len(got[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        base = _BASES[which]
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        got = (out[0], out[1])
        if size <= SLICE_BYTES + 4096:  # a longer text's tables are not kept
            _powers[which] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit of a 64-bit value over all bits."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Prefix:
    """Polynomial prefix hashes of a byte array: the hash of any [start, end) in O(1)."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.pow, self.inv = _power_tables(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * self.pow[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))


# ---------------------------------------------------------------- words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, a-z once lower-cased, and every byte of a non-ASCII character.
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


class Words:
    """The words of the texts in a byte array: A-Z lower-cased, runs of digits, letters and non-ASCII."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.low = _LOWER[data]
        is_word = _IS_WORD[self.low]
        n = len(data)
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = is_word
        before[offs] = False
        after = np.zeros(n + 1, dtype=bool)
        after[:n] = is_word
        after[offs] = False
        self.start = np.flatnonzero(is_word & ~before[:n])
        self.end = np.flatnonzero(is_word & ~after[1:]) + 1
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        self.n_docs = len(offs) - 1

    def hashes(self) -> np.ndarray:
        return Prefix(self.low).of(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n]))


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every n consecutive words of one document."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        h *= _U(0x9E3779B97F4A7C15)
        h += hashes[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, mix(h[at])
