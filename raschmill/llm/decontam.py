"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. Every window of
``n`` consecutive words of a benchmark item (or the whole item, if it has fewer words) goes into a
hash set. Documents are scanned once: the hash of every word window is looked up, each hit is
verified on the words themselves, and verified hits mark the words they cover.

The set holds sorted arrays: a hash and a place for each window, and the benchmark's words once, about six
bytes for each byte of ordinary text and 17 at worst (words of one letter). It is broadcast for MAX_BLOCK_BYTES of
benchmark text at a time. A larger benchmark is split by item into blocks of about that size; the spans and
items that a block finds travel with the document's row to the next block's pass (written to the shared folder between
passes), so each row is judged by itself at every size, and no item is left out.

Defined results: a null or empty text has no words, no hits and is clean; an empty benchmark
hits nothing; a null item id is written "null"; repeated rows, and rows with the same or no id, each get their own
result; very long texts are scanned whole, as a slice of their own (an item longer than the bound is a block of its own);
other columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_view, ngrams, release, sliced, written

WINDOW = 13
MAX_BLOCK_BYTES = 8 << 20
_BITS = 20
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_FOUND = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))]
_KINDS = ["long", "long", "array<string>", "array<struct<first:long,last:long>>"]


class NGramSet:
    """Windows of benchmark items: for each word count, their sorted hashes and first words."""

    def __init__(self, rows: list[tuple[object, str | None]], n: int = WINDOW):
        self.names = ["null" if item is None else str(item) for item, _ in rows]
        w = Words(*byte_view(pa.array([t for _, t in rows], pa.string())))
        size = w.end - w.start
        self.end = np.cumsum(size + 1, dtype=np.int64) - 1
        self.start = self.end - size
        self.item = w.doc.astype(np.int32)
        blob = np.full(int(self.end[-1]) + 1 if len(size) else 0, 32, dtype=np.uint8)
        if len(size):
            blob[np.repeat(self.start - (np.cumsum(size) - size), size) + np.arange(size.sum())] = w.low[np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.blob = blob.tobytes()
        hashes, counts = w.hashes(), w.counts()
        self.keys: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        self.bitmap: dict[int, np.ndarray] = {}
        for k in np.unique(np.minimum(counts, n)).tolist():
            if k:
                at, h = ngrams(hashes, w.doc, k)
                own = np.minimum(counts, n)[w.doc[at]] == k
                at, h = at[own], h[own]
                order = np.argsort(h, kind="stable")
                self.keys[k], self.place[k] = h[order], at[order].astype(np.int32)
                self.bitmap[k] = np.zeros(1 << _BITS, dtype=bool)
                self.bitmap[k][(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def hits(self, w: Words) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, number of words, items) of every verified occurrence of a window."""
        hashes = w.hashes() if self.keys else None
        for k, keys in self.keys.items():
            at, h = ngrams(hashes, w.doc, k)
            maybe = np.flatnonzero(self.bitmap[k][(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            for x in np.flatnonzero(hi > lo).tolist():
                text, items = w.text(int(at[x]), k), set()
                for p in self.place[k][lo[x] : hi[x]].tolist():
                    if (i := int(self.item[p])) not in items and self.blob[self.start[p] : self.end[p + k - 1]] == text:
                        items.add(i)
                if items:
                    yield int(at[x]), k, items


def _scan(grams: NGramSet, text: pa.Array, before: list[tuple[list[str], list[dict]]] | None):
    """For each row: words, covered words, item names, and the covered spans as (first, last) word, with what earlier blocks found."""
    for lo, _, data, offs in sliced(text):
        w = Words(data, offs)
        change = np.zeros(len(w.start) + 1, dtype=np.int64)
        counts = w.counts()
        base = np.concatenate(([0], np.cumsum(counts)))
        items: dict[int, set[str]] = {}
        for i, k, found in grams.hits(w):
            change[i] += 1
            change[i + k] -= 1
            items.setdefault(int(w.doc[i]), set()).update(grams.names[x] for x in found)
        if before:
            for d, (names, spans) in enumerate(before[lo : lo + w.n_docs]):
                if names:
                    items.setdefault(d, set()).update(names)
                    for s in spans:
                        change[base[d] + s["first"]] += 1
                        change[base[d] + s["last"] + 1] -= 1
        covered = np.cumsum(change[:-1]) > 0
        n_hit = np.bincount(w.doc[covered], minlength=w.n_docs)
        for d in range(w.n_docs):
            spans: list[dict] = []
            if n_hit[d]:
                c = np.concatenate(([False], covered[base[d] : base[d + 1]], [False]))
                edge = np.flatnonzero(c[1:] != c[:-1])
                spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]
            yield int(counts[d]), int(n_hit[d]), sorted(items.get(d, ())), spans


def _benchmark_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-total // MAX_BLOCK_BYTES) or 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r[0], r[1]) for r in part.collect()]


def _found(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, n: int) -> tuple[DataFrame, list[str]]:
    """The documents with four more columns (words, hits, items, spans), and their names."""
    plain = docs.columns
    free = [x for x in (f"found_{i}" for i in range(len(plain) + len(_FOUND))) if x not in plain][: len(_FOUND)]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", {x} {k}" for x, k in zip(free, _KINDS))
    out = docs

    def scanned(df: DataFrame, grams: NGramSet, again: bool) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(grams)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [b.column(i) for i in range(len(plain))]
                before = list(zip(b.column(len(plain) + 2).to_pylist(), b.column(len(plain) + 3).to_pylist())) if again else None
                rows = list(_scan(shared.value, own[plain.index(text)].cast(pa.string()), before))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FOUND))], [*plain, *free])
            release()

        return df.mapInArrow(run, kind)

    for i, rows in enumerate(_benchmark_blocks(benchmark, item_id, item_text)):
        out = scanned(written(out) if i else out, NGramSet(rows, n), i > 0)
    return out, free


def scan_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, items (sorted), spans (covered words as first/last position) per document; no shuffle."""
    two = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    out, free = _found(two, benchmark, "text", item_id, item_text, n)
    return out.select("id", *[F.col(x).alias(name) for x, (name, _) in zip(free, _FOUND)])


def is_contaminated(n_hit, n_words):
    """The rule: a twentieth of the words, and at least one, lie in benchmark windows."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """The documents that the rule does not reject, with all their columns; no shuffle."""
    out, free = _found(docs, benchmark, text, item_id, item_text, n)
    return out.where(~is_contaminated(F.col(free[1]), F.col(free[0]))).select(*[f"`{c}`" for c in docs.columns])
