"""Exact removal of byte strings that occur more than once, by prefix-free parsing.

Parsing. A rolling hash of TRIGGER bytes runs over every text. The trigger of a window (a string of
``width`` bytes) is the leftmost least hash among the first ``reach`` positions of the window, so
equal windows have their trigger at the same place. The phrase of a trigger is the text from
reach - 1 bytes before it to ``width`` bytes after it, cut at the document's ends; each window lies
wholly inside the phrase of its trigger. Phrases overlap, so a document's parse needs no
neighbouring symbol to decide a window: the order of a parse suffix is settled by its first phrase.

Dictionary. The distinct phrases with their frequencies, keyed by the short core text that follows
the trigger. A phrase that occurs twice repeats in all its windows, so all its bytes go. A core
that only one phrase has cannot hold a repeated window. What is left are phrases that occur once
but share their core with other phrases: the edges of repeated passages.

Suffixes of the dictionary. The windows of those phrases, and of one copy of each frequent phrase
that they share a core with, are suffixes of dictionary phrases. They are dealt out by a fingerprint
of their first ``width`` bytes and sorted by it, not lexicographically; equal fingerprints are
repeated windows. Together both give, for every byte, whether a window that covers it occurs again.
No suffix array is made of the dictionary, the parse or the corpus.

Scale. Documents are dealt by a hash into units of a few megabytes. A unit sends each distinct
phrase or window once, however many copies it holds, so a group of copies or a common passage
weighs no more than one entry for each unit, and fingerprints spread evenly. Phrases are compared
by 128 bits (core and phrase), windows by 128 bits (two fingerprints), in the buckets as in the units that are told.

Defined results: a null text has no bytes; texts shorter than the window lose nothing; matches
never cross documents but may overlap inside one; repeated rows are repeated text; a very long text is
parsed whole, as a slice of its own; an empty table
gives an empty result; other columns, whatever their names, are carried in a struct of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, byte_view, mix, release, slices, written

WIDTH = 200
TRIGGER = 12
UNIT_BYTES = 4 << 20
_U = np.uint64


class Parse:
    """Triggers and phrases of the texts in a byte array."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, width: int):
        self.data, self.offs, self.width = data, offs, width
        reach = 1
        while 2 * reach + TRIGGER <= max(width * 3 // 4, TRIGGER + 2):
            reach *= 2
        self.reach, self.core = reach, width - reach + 1
        self.hash = Prefix(data)
        size = np.diff(offs)
        n_starts = np.maximum(size - width + 1, 0)
        total = int(n_starts.sum())
        begin = np.concatenate(([0], np.cumsum(n_starts)))
        starts = np.repeat(offs[:-1] - begin[:-1], n_starts) + np.arange(total)
        if not total:
            self.p = self.lo = self.hi = self.doc = np.zeros(0, np.int64)
            return
        m = len(data) - TRIGGER + 1
        s = self.hash.sums
        key = mix((s[TRIGGER:] - s[:m]) * self.hash.inv[:m])
        key &= _U(0xFFFFFFFF00000000)
        key |= np.arange(m, dtype=np.uint64)
        step = 1
        while step < reach:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        p = (key[starts] & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        self.p = p[first]
        self.lo = starts[first]
        self.hi = starts[np.concatenate((first[1:] - 1, [total - 1]))]
        self.doc = np.searchsorted(offs, self.p, side="right") - 1

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(self.offs[self.doc], self.p - self.reach + 1), np.minimum(self.offs[self.doc + 1], self.p + self.width)

    def cores(self) -> np.ndarray:
        return self.hash.of(self.p, self.p + self.core)

    def phrases(self) -> np.ndarray:
        a, b = self.spans()
        return mix(self.hash.of(a, b) ^ (self.p - a).astype(np.uint64))

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of the windows whose trigger is among the chosen ones."""
        lo, n = self.lo[chosen], self.hi[chosen] - self.lo[chosen] + 1
        begin = np.cumsum(n) - n
        return np.repeat(lo - begin, n) + np.arange(int(n.sum()))


def _parses(text: pa.ChunkedArray, width: int) -> Iterator[tuple[int, Parse]]:
    """(first row, parse) of slices of a unit's texts."""
    data, offs = byte_view(text)
    release()
    for lo, hi in slices(offs):
        yield lo, Parse(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], width)


_ENTRY = np.dtype([("key", "<u8"), ("more", "<u8"), ("flag", "u1")])
_FREQUENT, _ASKS = 1, 2


def _dealt(entries: np.ndarray, unit: int, buckets: int) -> pa.Table:
    """Entries as one row for each bucket that has any."""
    to = (entries["key"] % _U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    entries, to = entries[order], to[order]
    cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, np.int64)
    ends = np.concatenate((cut[1:], [len(to)])) if len(to) else cut
    return pa.table({"bucket": pa.array(to[cut], pa.int64()), "unit": pa.array(np.full(len(cut), unit), pa.int64()), "payload": pa.array([entries[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})


def _unique(key: np.ndarray, more: np.ndarray, asks: np.ndarray | None) -> np.ndarray:
    """One entry for each distinct (key, more): whether it occurs twice here, and whether any asks."""
    order = np.lexsort((more, key))
    key, more = key[order], more[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])))) if len(key) else np.zeros(0, np.int64)
    out = np.zeros(len(first), _ENTRY)
    out["key"], out["more"] = key[first], more[first]
    count = np.diff(np.concatenate((first, [len(key)])))
    out["flag"] = np.where(count > 1, _FREQUENT, 0)
    if asks is not None and len(first):
        out["flag"] |= np.where(np.maximum.reduceat(asks[order].astype(np.uint8), first) > 0, _ASKS, 0).astype(np.uint8)
    return out


def _gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(entries, unit of each) of a bucket, sorted by key and more."""
    blobs = t.column("payload").to_pylist()
    parts = [np.frombuffer(b, _ENTRY) for b in blobs]
    entries = np.concatenate(parts)
    unit = np.repeat(t.column("unit").to_numpy(), [len(p) for p in parts])
    order = np.lexsort((unit, entries["more"], entries["key"]))
    return entries[order], unit[order]


_PAIR = np.dtype([("key", "<u8"), ("more", "<u8")])


def _replies(unit: np.ndarray, kind: np.ndarray, key: np.ndarray, more: np.ndarray) -> pa.Table:
    """One row for each unit and kind, with the pairs (key, more) for it."""
    value = np.zeros(len(key), _PAIR)
    value["key"], value["more"] = key, more
    order = np.lexsort((kind, unit))
    unit, kind, value = unit[order], kind[order], value[order]
    cut = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (kind[1:] != kind[:-1])))) if len(unit) else np.zeros(0, np.int64)
    ends = np.concatenate((cut[1:], [len(unit)])) if len(unit) else cut
    return pa.table({"unit": pa.array(unit[cut], pa.int64()), "kind": pa.array(kind[cut], pa.int32()), "payload": pa.array([value[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})


SETTLED, SUPPORTS, ASKING, REPEATED = range(4)
_DEALT, _REPLY = "bucket long, unit long, payload binary", "unit long, kind int, payload binary"


def _settle_phrases(t: pa.Table) -> pa.Table:
    """The dictionary of a bucket of cores: what each unit is told about its phrases."""
    e, unit = _gathered(t)
    n = len(e)
    new_core = np.concatenate(([True], e["key"][1:] != e["key"][:-1]))
    new_phrase = new_core | np.concatenate(([True], e["more"][1:] != e["more"][:-1]))
    core, phrase = np.cumsum(new_core) - 1, np.cumsum(new_phrase) - 1
    often = np.bincount(phrase, weights=1 + (e["flag"] & _FREQUENT)) > 1
    core_of = core[new_phrase]
    shared = np.bincount(core_of) > 1
    has_rare = np.bincount(core_of, weights=~often) > 0
    settled = often[phrase]
    supports = settled & new_phrase & shared[core] & has_rare[core]
    asking = ~settled & shared[core]
    pick = np.concatenate((np.flatnonzero(settled), np.flatnonzero(supports), np.flatnonzero(asking)))
    kind = np.repeat([SETTLED, SUPPORTS, ASKING], [settled.sum(), supports.sum(), asking.sum()])
    assert len(phrase) == n
    return _replies(unit[pick], kind, e["more"][pick], e["key"][pick])


def _settle_windows(t: pa.Table) -> pa.Table:
    """The sorted suffixes of a bucket: which windows each asking unit finds repeated."""
    e, unit = _gathered(t)
    new = np.concatenate(([True], (e["key"][1:] != e["key"][:-1]) | (e["more"][1:] != e["more"][:-1])))
    which = np.cumsum(new) - 1
    often = np.bincount(which, weights=1 + (e["flag"] & _FREQUENT)) > 1
    told = np.flatnonzero(often[which] & ((e["flag"] & _ASKS) > 0))
    return _replies(unit[told], np.full(len(told), REPEATED), e["key"][told], e["more"][told])


class _Pairs:
    """A set of pairs of 64 bits."""

    def __init__(self, blobs: list[bytes]):
        v = np.frombuffer(b"".join(blobs), _PAIR)
        order = np.lexsort((v["more"], v["key"]))
        self.key, self.more = v["key"][order], v["more"][order]

    def __len__(self) -> int:
        return len(self.key)

    def has_key(self, key: np.ndarray) -> np.ndarray:
        if not len(self) or not len(key):
            return np.zeros(len(key), dtype=bool)
        return self.key[np.minimum(np.searchsorted(self.key, key), len(self) - 1)] == key

    def has(self, key: np.ndarray, more: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), dtype=bool)
        rest = np.flatnonzero(self.has_key(key))
        at = np.searchsorted(self.key, key[rest]) if len(rest) else rest
        while len(rest):  # more than once only where pairs share their first half
            out[rest] = self.more[at] == more[rest]
            go = ~out[rest] & (at + 1 < len(self))
            rest, at = rest[go], at[go] + 1
            go = self.key[at] == key[rest]
            rest, at = rest[go], at[go]
        return out


def _told(replies: pa.Table) -> dict[int, _Pairs]:
    """What a unit is told, by kind."""
    by: dict[int, list[bytes]] = {k: [] for k in range(4)}
    for k, p in zip(replies.column("kind").to_pylist(), replies.column("payload").to_pylist()):
        by[k].append(p)
    return {k: _Pairs(v) for k, v in by.items()}


def _unit_of(t: pa.Table) -> int:
    return t.column("unit")[0].as_py()


def find_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """row (struct of the other columns), text, spans (array of struct<start, end>: byte runs to remove).

    Two jobs: the dictionary of phrases is written to the shared folder first, so that the lineage
    of what follows ends there.
    """
    if width < TRIGGER + 4:
        raise ValueError(f"width must be at least {TRIGGER + 4}")
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // UNIT_BYTES))
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    d = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")]), F.lit(units)).alias("unit"))

    def send_phrases(t: pa.Table) -> pa.Table:
        core, phrase = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, parse in _parses(t.column("text"), width):
            core.append(parse.cores())
            phrase.append(parse.phrases())
        return _dealt(_unique(np.concatenate(core), np.concatenate(phrase), None), _unit_of(t), units)

    first = written(d.select("unit", "text").groupBy("unit").applyInArrow(send_phrases, _DEALT).groupBy("bucket").applyInArrow(_settle_phrases, _REPLY))

    def send_windows(t: pa.Table, replies: pa.Table) -> pa.Table:
        told = _told(replies)
        one, two, asks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        if t.num_rows and (len(told[ASKING]) or len(told[SUPPORTS])):
            for _, parse in _parses(t.column("text"), width):
                core, phrase = parse.cores(), parse.phrases()
                for asking, values in ((True, told[ASKING]), (False, told[SUPPORTS])):
                    at = parse.windows(np.flatnonzero(values.has(phrase, core)))
                    one.append(parse.hash.of(at, at + width))
                    two.append(Prefix(parse.data, 1).of(at, at + width) if len(at) else at.astype(np.uint64))
                    asks.append(np.full(len(at), asking))
        key, more, asks_ = np.concatenate(one), np.concatenate(two), np.concatenate(asks)
        return _dealt(_unique(key, more, asks_), _unit_of(t) if t.num_rows else 0, units)

    by_unit = d.groupBy("unit")  # the same in both passes below, so that the texts are shuffled once for both
    second = by_unit.cogroup(first.where(F.col("kind").isin(SUPPORTS, ASKING)).groupBy("unit")).applyInArrow(send_windows, _DEALT).groupBy("bucket").applyInArrow(_settle_windows, _REPLY)

    span_type = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def mark(t: pa.Table, replies: pa.Table) -> pa.Table:
        told = _told(replies)
        found: list[list[dict]] = []
        for _, parse in _parses(t.column("text"), width):
            change = np.zeros(len(parse.data) + 1, dtype=np.int32)
            core, phrase = (parse.cores(), parse.phrases()) if len(parse.p) else (np.zeros(0, np.uint64),) * 2
            a, b = parse.spans()
            gone = told[SETTLED].has(phrase, core)
            np.add.at(change, a[gone], 1)
            np.add.at(change, b[gone], -1)
            if len(told[REPEATED]):
                at = parse.windows(np.flatnonzero(told[ASKING].has(phrase, core)))
                one = parse.hash.of(at, at + width)
                known = told[REPEATED].has_key(one)
                at, one = at[known], one[known]
                if len(at):
                    at = at[told[REPEATED].has(one, Prefix(parse.data, 1).of(at, at + width))]
                np.add.at(change, at, 1)
                np.add.at(change, at + width, -1)
            covered = np.zeros(len(parse.data) + 1, dtype=bool)
            covered[:-1] = np.cumsum(change[:-1]) > 0
            edge = covered.copy()
            edge[1:] ^= covered[:-1]
            edge[parse.offs] |= covered[parse.offs]  # a run ends where its document does
            begins = np.flatnonzero(edge & covered)
            is_end = np.zeros(len(covered), dtype=bool)
            is_end[parse.offs] = True
            stop = np.flatnonzero(covered[:-1] & (~covered[1:] | is_end[1:])) + 1
            doc = np.searchsorted(parse.offs, begins, side="right") - 1
            lists: list[list[dict]] = [[] for _ in range(len(parse.offs) - 1)]
            for k, s, e in zip(doc.tolist(), begins.tolist(), stop.tolist()):
                o = int(parse.offs[k])
                lists[k].append({"start": s - o, "end": e - o})
            found += lists
        return pa.table({"row": t.column("row"), "text": t.column("text"), "spans": pa.array(found, pa.list_(span_type))})

    schema = f"row {d.schema['row'].dataType.simpleString()}, text string, spans array<struct<start:bigint,end:bigint>>"
    replies = first.where(F.col("kind").isin(SETTLED, ASKING)).unionByName(second)
    return by_unit.cogroup(replies.groupBy("unit")).applyInArrow(mark, schema)


def _kept(text: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, digest: bool = False) -> DataFrame:
    """row, and either the kept text (characters cut by a removed run are dropped) or its digest columns
    n_bytes, n_removed, n_spans, kept_sha256 over the kept bytes."""
    found = find_repeats(docs, text, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = byte_view(b.column("text"))
            spans = b.column("spans").to_pylist()
            kept = (_kept(data[i:j].tobytes(), s) for i, j, s in zip(offs[:-1], offs[1:], spans))
            if digest:
                out = [
                    pa.array(np.diff(offs)),
                    pa.array([sum(s["end"] - s["start"] for s in x) for x in spans], pa.int64()),
                    pa.array([len(x) for x in spans], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([b.column("row"), *out], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                texts = [k.decode("utf-8", "ignore") if s else t.as_py() for k, s, t in zip(kept, spans, b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    kind = found.schema["row"].dataType.simpleString()
    return found.mapInArrow(run, f"row {kind}, " + ("n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "text string"))
