"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a document are hashed runs of three character classes (letters by case, digits, white
space, each mark of punctuation by itself), repetitions of the word one to eight places before,
repetitions of whole lines, and its share of distinct words. Document frequencies are counted over
all documents. A bounded sample of labelled documents (labelled.py) gives the term matrix whose
leading singular vectors span the space; their own vectors and labels are broadcast, a fixed size.

Each block of documents is projected, its exact cosines with all labelled vectors are one matrix
product, and the NEIGHBOURS nearest vote with weights that grow with the similarity; all that are as near as the last
of them vote too.

Defined results: a null or empty text has no terms; like any text with a zero vector, it gets the
share of good rows in the sample (0.5 without labelled rows); repeated rows are scored each; a very long text is
counted whole, as a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, Words, byte_view, sliced, slices
from .labelled import labelled_sample

TERMS = 1024
EXTRA = 24
RANK = 32
NEIGHBOURS = 25
SHARPNESS = 16
_ALL = TERMS + EXTRA


def _classes() -> np.ndarray:
    c = np.zeros(256, dtype=np.uint32)
    c[97:123], c[65:91], c[48:58], c[128:] = 1, 2, 3, 4
    c[[32, 9]], c[[10, 13]] = 5, 6
    for b in range(33, 127):
        if not c[b]:
            c[b] = b
    return c


_CLASS = _classes()


def term_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of terms, one row for each text."""
    n = len(offs) - 1
    out = np.zeros((n, _ALL), dtype=np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(offs))
    c = _CLASS[data]
    if len(c) >= 3:
        tri = ((c[:-2] * np.uint32(128) + c[1:-1]) * np.uint32(128) + c[2:]) * np.uint32(2654435761) >> np.uint32(32 - 10)
        same = doc[:-2] == doc[2:]
        out[:, :TERMS] = np.bincount((doc[:-2] * TERMS + tri)[same], minlength=n * TERMS).reshape(n, TERMS)
    w = Words(data, offs)
    h = w.hashes()
    for k in range(1, 9):
        if len(h) > k:
            hit = (h[k:] == h[:-k]) & (w.doc[k:] == w.doc[:-k])
            out[:, TERMS + k - 1] = np.bincount(w.doc[k:][hit], minlength=n)
    counts = w.counts()
    distinct = np.bincount(w.doc[np.unique(np.stack((w.doc.astype(np.uint64), h)), axis=1, return_index=True)[1]] if len(h) else np.zeros(0, np.int64), minlength=n)
    share = np.floor(8 * distinct / np.maximum(counts, 1)).astype(np.int64)
    out[np.arange(n), TERMS + 8 + np.minimum(share, 7)] = np.sqrt(counts)
    # Lines that repeat one before them in the same text.
    ends = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate((offs[:-1], ends + 1)))
    cut = cut[cut < len(data)]
    stop = np.minimum(np.concatenate((cut[1:], [len(data)])), offs[np.searchsorted(offs, cut, side="right")])
    line, ldoc = Prefix(data).of(cut, stop), np.searchsorted(offs, cut, side="right") - 1
    lines = np.bincount(ldoc, minlength=n)
    once = np.bincount(ldoc[np.unique(np.stack((ldoc.astype(np.uint64), line)), axis=1, return_index=True)[1]], minlength=n)
    out[:, TERMS + 16] = lines - once
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weights(cos: np.ndarray) -> np.ndarray:
    return np.maximum(cos, 0).astype(np.float64) ** SHARPNESS + 1e-12


@dataclass
class QualityModel:
    prior: float = 0.5
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None
    vectors: np.ndarray | None = None
    labels: np.ndarray | None = None

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = _weighted(counts, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if self.vectors is None:
            return out
        z = self.project(counts)
        live = np.flatnonzero(np.abs(z).sum(axis=1) > 0)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(live), 256):
            cos = z[live[i : i + 256]] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(cos, near, axis=1)
            w = _weights(best)
            vote = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
            level = cos >= best.min(axis=1, keepdims=True)
            for j in np.flatnonzero(level.sum(axis=1) > k).tolist():
                w = _weights(cos[j, level[j]])
                vote[j] = (w * self.labels[level[j]]).sum() / w.sum()
            out[live[i : i + 256]] = vote
        return np.clip(out, 0, 1)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(documents with each term, documents), counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(_ALL + 1, dtype=np.int64), 0
        for b in batches:
            for _, _, data, offs in sliced(b.column(0)):
                df[:_ALL] += (term_counts(data, offs) > 0).sum(axis=0)
                n += len(offs) - 1
        df[_ALL] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_ALL + 1), pa.int64()), pa.array(df)], ["term", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(_ALL + 1, dtype=np.int64)
    for r in found:
        df[r["term"]] = r["n"]
    return df[:_ALL], int(df[_ALL])


def fit(rows: list[tuple[str, int]], df: np.ndarray, n_docs: int) -> QualityModel:
    if not rows:
        return QualityModel()
    data, offs = byte_view(pa.array([r[0] for r in rows], pa.string()))
    counts = np.concatenate([term_counts(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in slices(offs)])
    y = np.array([r[1] for r in rows], dtype=np.float64)
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)
    x = _weighted(counts, idf)
    q = np.random.default_rng(7).standard_normal((x.shape[1], RANK + 8)).astype(np.float32)
    for _ in range(6):  # subspace iteration towards the leading right singular vectors
        q, _r = np.linalg.qr(x.T @ (x @ q))
    _u, _s, vt = np.linalg.svd(x @ q, full_matrices=False)
    model = QualityModel(float(y.mean()), idf, (q @ vt.T[:, :RANK]).astype(np.float32))
    model.vectors, model.labels = model.project(counts), y
    return model


def fit_from(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 4, held_out: int = 2, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    rows = labelled_sample(docs, labels, label, mod, held_out, doc_id, text)
    return fit(rows, *document_frequencies(docs, text))


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score for every document; one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    two = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.score(term_counts(data, offs)) for _, _, data, offs in sliced(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.concatenate([np.zeros(0), *s]))], ["id", "score"])

    return two.mapInArrow(run, f"id {two.schema['id'].dataType.simpleString()}, score double")
