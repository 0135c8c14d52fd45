"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (lower-cased A-Z; a shorter text is one shingle). A shingle
weighs its number of occurrences times the mean idf of its words, idf = 1 + log10(N / df), where df
is counted over all documents. Words in less than a COMMON-th of the documents share the largest
idf, so the table of common words, which is broadcast, has at most (mean distinct words of a
document) / COMMON entries however large the corpus. With word idf an edited shingle weighs
about as much as the ones beside it; idf of shingles would weigh each edit more the more copies
a text has, and lose near copies in large groups.

For each of BANDS x ROWS samples, the sampler draws for every shingle r ~ Gamma(2, 1),
c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash, t = floor(ln S / r + b), y = exp(r (t - b)), and keeps
the shingle and t with the least c / (y e^r): two texts agree with the probability of their weighted
Jaccard similarity. ROWS samples make a band; texts that share a band are candidates and are
verified by their exact weighted Jaccard similarity.

Groups. Texts with the same words are one text, named by a 128-bit hash of its words. In ROUNDS rounds every
text that shares a band is compared with one other text: of the leads of its buckets, the one whose
own buckets hold most texts (near copies of one text share their bands with it more than with each
other, so this is mostly the text that was copied). Links to leads grow with the members of a group, not with their pairs,
and join most of it into classes. What is left are pairs of different classes in one bucket. They are
taken in blocks of BLOCK texts and BLOCK_BYTES bytes, each pair in the first band that it shares: first on the samples
alone, which only marks the texts that agree with another class in MAYBE of them; then the marked
texts are verified, one text against all of its block in one vectorised step. A block
keeps its own union of classes, skips what is joined already and returns at most one link for each
text, so no table of candidate pairs is made, and none is left out. (Pairs that agree in fewer than MAYBE of the
samples are over four standard deviations from the threshold.) Joins on buckets and classes are
plain equi-joins of written tables, which adaptive execution splits where a bucket or class is large (it would not
where one side comes straight from an aggregation by the same key). Intermediate tables are deleted at the end.

Defined results: a null id takes no part and has a null class; a text without words is its own
class; rows are told apart by id and text, so an id with two texts may lie in two classes; an empty table gives an empty
result; very long texts are whole, a block of their own; other columns
do not matter. A class is named by its least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, byte_view, mix, release, sliced, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
ROUNDS = 2
BLOCK, BLOCK_BYTES = 512, 4 << 20
MAYBE = 0.6
COMMON = 1000
_U = np.uint64
_SLOTS = 1 << 16


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    g = np.random.default_rng(1010)
    return g.gamma(2, 1, _SLOTS).astype(np.float32), np.log(g.gamma(2, 1, _SLOTS)).astype(np.float32), g.random(_SLOTS, dtype=np.float32), g.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


_R, _LN_C, _B, _SEED = _draws()


class Idf:
    """idf of common words; all others have the largest."""

    def __init__(self, words: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(words)
        self.words = words[order]
        self.idf = (1 + np.log10(n / df[order])).astype(np.float32) if n else df.astype(np.float32)
        self.rare = np.float32(1 + np.log10(COMMON))

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), self.rare, np.float32)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.idf[at], self.rare)


def weighted_shingles(data: np.ndarray, offs: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, weight) of distinct shingles, sorted by both; then number of words and 128-bit hash of all words by document."""
    w = Words(data, offs)
    h, counts = w.hashes(), w.counts()
    n, m = len(h), w.n_docs
    base = np.concatenate(([0], np.cumsum(counts)))
    k = np.minimum(counts, SHINGLE)
    own = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(own)))
    at = np.repeat(base[:-1] - begin[:-1], own) + np.arange(begin[-1])
    doc = np.repeat(np.arange(m), own)
    sh = np.zeros(len(at), dtype=np.uint64)
    for j in range(SHINGLE):
        inside = j < k[doc]
        sh = np.where(inside, sh * _U(0x9E3779B97F4A7C15) + h[np.minimum(at + j, max(n - 1, 0))] if n else sh, sh)
    sh = mix(sh)
    total = np.concatenate(([0.0], np.cumsum(idf.of(h), dtype=np.float64)))
    mean = (total[at + k[doc]] - total[at]) / np.maximum(k[doc], 1)
    order = np.lexsort((sh, doc))
    doc, sh, mean = doc[order], sh[order], mean[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])))) if len(doc) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate((first, [len(doc)])))
    place = np.arange(n) - base[w.doc]
    whole = np.zeros((m, 2), dtype=np.uint64)
    filled = np.flatnonzero(counts)
    if n:
        for j, odd in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
            whole[filled, j] = np.add.reduceat(mix((h ^ _U(j)) + place.astype(np.uint64) * _U(odd)), base[:-1][filled])
    return doc[first], sh[first], np.round(mean[first], 6) * tf, counts, whole


def signatures(doc: np.ndarray, sh: np.ndarray, weight: np.ndarray, n_docs: int, samples: int) -> np.ndarray:
    """One 32-bit sample hash for each document and sample; 0 rows for documents without shingles."""
    out = np.zeros((n_docs, samples), dtype=np.uint32)
    if not len(doc):
        return out
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    log_s = np.log(weight).astype(np.float32)
    for k in range(samples):
        own = (sh ^ _SEED[k]) * _SEED[255 - k]
        slot = (own >> _U(48)).astype(np.int64)
        r = _R[slot]
        t = np.floor(log_s / r + _B[slot])
        ln_a = _LN_C[slot] - r * (t - _B[slot]) - r
        bits = ln_a.view(np.int32)
        rank = bits.view(np.uint32) ^ ((bits >> 31).view(np.uint32) | np.uint32(0x80000000))
        name = mix(own + t.astype(np.int64).view(np.uint64)) & _U(0xFFFFFFFF)
        out[doc[starts], k] = (np.minimum.reduceat((rank.astype(np.uint64) << _U(32)) | name, starts) & _U(0xFFFFFFFF)).astype(np.uint32)
    return out


def word_idf(docs: DataFrame) -> Idf:
    """idf table of the words in at least a COMMON-th of all documents (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [np.zeros(0, np.uint64)]
            for _, _, data, offs in sliced(b.column(0)):
                w = Words(data, offs)
                h = w.hashes()
                order = np.lexsort((h, w.doc))
                d, h = w.doc[order], h[order]
                words.append(h[np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))] if len(h) else h)
            h, df = np.unique(np.concatenate(words), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(df)], ["word", "df"])
        release()

    n = docs.count()
    common = docs.select("text").mapInArrow(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).where(F.col("df") * COMMON >= n).toPandas()
    return Idf(common["word"].to_numpy(np.int64).view(np.uint64), common["df"].to_numpy(np.int64), n)


def _signed(docs: DataFrame, idf: Idf, kind: str) -> DataFrame:
    """id, h, n_words, rep (hash of all words), bands, samples."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in sliced(b.column("text")):
                doc, sh, weight, counts, whole = weighted_shingles(data, offs, shared.value)
                samples = signatures(doc, sh, weight, hi - lo, BANDS * ROWS)
                sig = samples.astype(np.uint64).reshape(hi - lo, BANDS, ROWS)
                band = np.zeros((hi - lo, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    band = mix(band * _U(0x9E3779B97F4A7C15) + sig[:, :, r] + _U(1))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), pa.array(band.ravel().view(np.int64)))
                own = [pa.array(counts, pa.int64()), pa.array([x.tobytes() for x in whole], pa.binary()), bands, pa.array([x.tobytes() for x in samples], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), b.column("h").slice(lo, hi - lo), *own], ["id", "h", "n_words", "rep", "bands", "samples"])
        release()

    return docs.mapInArrow(run, f"id {kind}, h long, n_words long, rep binary, bands array<long>, samples binary")


def _shingle_set(text: str | None, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    _, sh, weight, _, _ = weighted_shingles(*byte_view(pa.array([text], pa.string())), idf)
    return sh, weight


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater; 0 for two empty sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, idf: Idf) -> DataFrame:
    """rep, lead, similarity of pairs (rep, lead)."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    left = texts.select("rep", F.col("text").alias("x"))
    right = texts.select(F.col("rep").alias("lead"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kept = None, None
        for t in batches:
            found = []
            for b, x, y in zip(t.column("lead"), t.column("x"), t.column("y")):
                if kept is None or b != name:
                    name, kept = b, _shingle_set(y.as_py(), shared.value)
                found.append(weighted_jaccard(_shingle_set(x.as_py(), shared.value), kept))
            yield pa.RecordBatch.from_arrays([t.column("rep"), t.column("lead"), pa.array(found, pa.float64())], ["rep", "lead", "similarity"])
        release()

    joined = pairs.join(left, "rep").join(right, "lead").select("rep", "lead", "x", "y")
    return joined.mapInArrow(run, "rep binary, lead binary, similarity double")


def connected(edges: DataFrame, tables: Scratch) -> DataFrame:
    """id, label for every end of an edge (a, b): the least id of its component.

    Labels and edges stay distributed; each round passes least labels to neighbours and jumps to the
    label of the label, and is written to the shared folder.
    """
    both = tables.written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = tables.written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        step = labels.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("higher"))
        new = tables.written(step.join(up, "label", "left").select("id", "old", F.least("label", "higher").alias("label")))
        if new.where("label < old").limit(1).count() == 0:
            return new.select("id", "label")
        labels = new.select("id", "label")


def _samples(col: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint32) for x in col.to_pylist()]) if len(col) else np.zeros((0, BANDS * ROWS), np.uint32)


def _in_blocks(rows: DataFrame, tables: Scratch) -> DataFrame:
    """Rows of buckets (band, key, rep, size, ...) dealt to pairs (i, j) of their bucket's blocks; ``own`` is a row's block."""
    n = rows.groupBy("band", "key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("n"))
    d = rows.join(tables.written(n), ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    d = d.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "other", "size")
    return d.repartition("band", "key", "i", "j")  # else the join's dealing by bucket would do, all its blocks in one task


def _open_pairs(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows that may be similar) of a block: of other labels, and this is the first band they share."""
    sig = _samples(t.column("samples"))
    label = np.unique(t.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    own, band = t.column("own").to_numpy(), t.column("band")[0].as_py()
    between = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    for x in range(len(sig) - 1):
        later = x + 1 + np.flatnonzero((label[x + 1 :] != label[x]) & ((own[x + 1 :] != own[x]) if between else True))
        same = sig[later] == sig[x]
        close = same.mean(axis=1) >= MAYBE
        if close.any():
            first = same[close].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            later = later[close][first == band]
            if len(later):
                yield x, later


def _marked(rows: DataFrame, tables: Scratch) -> DataFrame:
    """band, key, rep of the rows (band, key, rep, label, samples, size) that may be similar to one of another label."""

    def run(t: pa.Table) -> pa.Table:
        mark = np.zeros(t.num_rows, dtype=bool)
        for x, later in _open_pairs(t):
            mark[x] = True
            mark[later] = True
        return t.select(["band", "key", "rep"]).filter(pa.array(mark))

    found = _in_blocks(rows, tables).groupBy("band", "key", "i", "j").applyInArrow(run, "band int, key long, rep binary")
    return found.distinct()


def _links(rows: DataFrame, idf: Idf, threshold: float, tables: Scratch) -> DataFrame:
    """a, b: links that join the labels of the rows (band, key, rep, label, samples, text, size) within their blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        doc, sh, weight, _, _ = weighted_shingles(*byte_view(t.column("text")), shared.value)
        codes = np.unique(sh, return_inverse=True)[1]
        begin = np.searchsorted(doc, np.arange(t.num_rows + 1))  # every text of a bucket has words
        total = np.add.reduceat(weight, begin[:-1]) if len(doc) else weight
        dense = np.zeros(len(codes) and int(codes.max()) + 1)
        up = np.unique(t.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1].tolist()
        parent = list(range(len(up)))

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        at, to = [], []
        for x, later in _open_pairs(t):
            later = [y for y in later.tolist() if top(up[y]) != top(up[x])]
            if not later:
                continue
            lo, hi = begin[x], begin[x + 1]
            dense[codes[lo:hi]] = weight[lo:hi]
            for y in later:
                a, b = begin[y], begin[y + 1]
                both = np.minimum(dense[codes[a:b]], weight[a:b]).sum()
                if top(up[y]) != top(up[x]) and both >= threshold * (total[x] + total[y] - both):
                    at.append(x)
                    to.append(y)
                    parent[top(up[y])] = top(up[x])
            dense[codes[lo:hi]] = 0
        rep = t.column("rep")
        return pa.table({"a": rep.take(pa.array(at, pa.int64())), "b": rep.take(pa.array(to, pa.int64()))})

    return _in_blocks(rows, tables).groupBy("band", "key", "i", "j").applyInArrow(run, "a binary, b binary")


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """id, h (hash of the text), n_words, label (the same for all rows of a class) of every row, written."""
    tables = Scratch(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    kind = d.schema["id"].dataType.simpleString()
    idf = word_idf(d)
    signed = tables.written(_signed(d, idf, kind))
    known = signed.where("id is not null and n_words > 0")
    reps = tables.written(known.groupBy("rep").agg(F.min(F.struct("id", "h", "bands", "samples")).alias("f")).select("rep", "f.*"))
    members = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    crowded = tables.written(members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = tables.written(members.join(crowded, ["band", "key"]))
    central = tables.written(shared.groupBy("rep").agg(F.sum("n").alias("central")))
    texts = tables.written(d.join(central.join(reps, "rep").select("rep", "id", "h", "samples"), ["id", "h"]).dropDuplicates(["rep"]).select("rep", "samples", "text", F.octet_length("text").alias("size")))

    active = shared.join(central, "rep").select("rep", "band", "key", "central")
    edges: list[DataFrame] = []
    for _ in range(ROUNDS):
        leads = active.groupBy("band", "key").agg(F.min(F.struct((-F.col("central")).alias("less"), F.col("rep").alias("lead"))).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
        own = active.select("rep", "band", "key").join(tables.written(leads.select("band", "key", "best")), ["band", "key"]).where("rep <> best.lead")
        one = own.groupBy("rep").agg(F.min("best").alias("best")).select("rep", "best.lead")
        checked = tables.written(_verified(one, texts, idf))
        edges.append(checked.where(F.col("similarity") >= threshold).select(F.col("rep").alias("a"), F.col("lead").alias("b")))
        done = edges[-1].select(F.col("a").alias("rep")).unionByName(checked.select(F.col("lead").alias("rep"))).distinct()
        active = tables.written(active.join(done, "rep", "left_anti"))

    label = connected(_union(edges), tables)
    names = tables.written(central.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")))
    rows = tables.written(shared.select("band", "key", "rep").join(names, "rep"))
    several = rows.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band", "key")
    left = tables.written(rows.join(tables.written(several), ["band", "key"]).select("band", "key", "rep", "label"))
    marked = tables.written(_marked(tables.written(left.join(texts.select("rep", "samples"), "rep").withColumn("size", F.lit(0))), tables))
    late = tables.written(_links(tables.written(left.join(marked, ["band", "key", "rep"]).join(texts, "rep")), idf, threshold, tables))
    if late.limit(1).count():
        label = connected(_union([*edges, late]), tables)
    out = written(signed.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("id", "h", "n_words", F.when(F.col("id").isNotNull() & (F.col("n_words") > 0), F.coalesce("label", "rep")).alias("label")))
    tables.delete()
    return out


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id (the least id of the class), n_words for every document."""
    rows = _classes(docs, doc_id, text, threshold)
    least = written(rows.where("label is not null").groupBy("label").agg(F.min("id").alias("class_id")))
    return rows.join(least, "label", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "n_words")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class (the one with the least id) with all its columns; rows without an id stay, rows with the same id and text are one."""
    rows = _classes(docs, doc_id, text, threshold).where("id is not null")
    first = written(rows.where("label is not null").groupBy("label").agg(F.min(F.struct("id", "h")).alias("first")))
    gone = rows.join(first, "label").where("id <> first.id or h <> first.h").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    h = F.xxhash64(F.col(text).cast("string"))
    kept = docs.join(gone, (docs[doc_id] == F.col("__id")) & (h == F.col("__h")), "left_anti")
    if rows.groupBy("id", "h").count().where("count > 1").limit(1).count():
        hashed = kept.withColumn("__h", h)
        kept = hashed.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, "__h"]).unionByName(hashed.where(F.col(doc_id).isNull())).select(*docs.columns)
    return kept
