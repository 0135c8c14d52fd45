"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are the words of the lower-cased text, with two labels (clean, toxic). A token's features are
hashes of the word and of its first and last bytes; the chain adds transition weights. Documents
carry labels, tokens do not, so token labels are derived first: in a toxic training document the
tokens are toxic whose word or beginning is significantly more frequent in toxic than in clean
training documents (likelihood ratio over documents). The field is fitted to those tokens by its
exact gradient. Forward-backward gives each token's marginal; a logistic model of the expected
number of toxic tokens and of the largest marginals, fitted on the same documents, gives the score.

With two labels the forward and backward messages are ratios that change by a Moebius map from token
to token. Maps compose, so a slice of many texts is cut into equal columns, whose composed maps link
them: exact messages in few vectorised steps, whatever the length of a text.

Fitting uses the bounded sample of labelled.py, whose words are numbered slice by slice; gradients are summed over
chunks of whole documents of about CHUNK tokens, so the driver's memory does not hold the messages of the whole
sample; scoring is one pass without a shuffle over whole
texts, and the model that is broadcast has a fixed size (2 ** BITS weights).

Defined results: a null or empty text scores as one without tokens; without labelled rows of both
classes every score is the share of toxic rows (0.5 without any) and the filter drops nothing; repeated rows are scored each; a very long text is
scored whole, as a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, Words, mix, release, sliced, slices
from .labelled import labelled_sample

BITS = 18
ROUNDS = 60
CHUNK = 1 << 18
#: Least likelihood-ratio statistic for a feature to mark tokens of toxic documents.
SIGNIFICANT = 20.0
_U = np.uint64
_HEADS, _TAILS = (4, 5, 6), (4,)


def token_features(w: Words, at: np.ndarray) -> np.ndarray:
    """Hashed features of the words at ``at``: one row each (word, beginnings, ends)."""
    h, s, e = Prefix(w.low), w.start[at], w.end[at]
    cols = [h.of(s, e)]
    cols += [mix(h.of(s, np.minimum(s + k, e)) + _U(k)) for k in _HEADS]
    cols += [mix(h.of(np.maximum(e - k, s), e) + _U(64 + k)) for k in _TAILS]
    return np.stack([(c & _U((1 << BITS) - 1)).astype(np.int64) for c in cols], axis=1)


def ratios(p: np.ndarray, q: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """r[i] = (p[i] r[i-1] + q[i]) / (s[i] r[i-1] + t[i]); the first map must be constant (p = s = 0)."""
    n = len(p)
    if not n:
        return np.zeros(0)
    rows = max(1, int(n**0.5 / 4))
    cols = -(-n // rows)
    pad = rows * cols - n

    def laid(x: np.ndarray, fill: float) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate((x, np.full(pad, fill))).reshape(cols, rows).T)

    p, q, s, t = laid(p, 1.0), laid(q, 0.0), laid(s, 0.0), laid(t, 1.0)
    a, b, c, d = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for i in range(rows):  # composed maps of whole columns
        a, b, c, d = p[i] * a + q[i] * c, p[i] * b + q[i] * d, s[i] * a + t[i] * c, s[i] * b + t[i] * d
        scale = 1 / (np.abs(c) + np.abs(d))
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    into, r = np.empty(cols), 1.0
    for k, (x, y, z, v) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        into[k] = r
        r = (x * r + y) / (z * r + v)
    out = np.empty((rows, cols))
    r = into
    for i in range(rows):
        r = (p[i] * r + q[i]) / (s[i] * r + t[i])
        out[i] = r
    return out.T.ravel()[:n]


class Chain:
    """Messages of the field over concatenated texts."""

    def __init__(self, emission: np.ndarray, doc: np.ndarray, trans: np.ndarray, start: float):
        n = len(emission)
        self.first = np.concatenate(([True], doc[1:] != doc[:-1])) if n else np.zeros(0, bool)
        self.last = np.concatenate((doc[1:] != doc[:-1], [True])) if n else np.zeros(0, bool)
        self.e = np.exp(np.clip(emission, -30, 30))
        self.a = np.exp(trans)
        (a00, a01), (a10, a11) = self.a
        f = ~self.first
        self.forward = ratios(f * self.e * a11, np.where(f, self.e * a01, self.e * np.exp(start)), f * a10, np.where(f, a00, 1.0))
        nxt = np.concatenate((self.e[1:], [1.0]))[::-1] if n else self.e
        g = ~self.last[::-1]
        self.backward = ratios(g * a11 * nxt, np.where(g, a10, 1.0), g * a01 * nxt, np.where(g, a00, 1.0))[::-1]

    def marginals(self) -> np.ndarray:
        odds = self.forward * self.backward
        return odds / (1 + odds)

    def pairs(self) -> np.ndarray:
        """Expected number of each transition."""
        inner = np.flatnonzero(~self.last)
        r, nb = self.forward[inner], self.e[inner + 1] * self.backward[inner + 1]
        w = np.stack([np.full(len(inner), self.a[0, 0]), self.a[0, 1] * nb, self.a[1, 0] * r, self.a[1, 1] * r * nb])
        return (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class ToxicityModel:
    prior: float = 0.5
    weights: np.ndarray | None = None
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    doc: np.ndarray | None = None

    def emissions(self, w: Words) -> np.ndarray:
        """Score of the toxic label for each word; features are made once for each distinct word."""
        _, at, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        return (self.bias + self.weights[token_features(w, at)].sum(axis=1))[back]

    def score(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(score of each text, marginal of each word)."""
        if self.doc is None:
            return np.full(w.n_docs, self.prior), np.zeros(len(w.start))
        m = Chain(self.emissions(w), w.doc, self.trans, self.start).marginals()
        return 1 / (1 + np.exp(-(self._summary(m, w.doc, w.n_docs) @ self.doc))), m

    @staticmethod
    def _summary(m: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        expected = np.bincount(doc, weights=m, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, doc, m)
        none = np.bincount(doc, weights=np.log1p(-np.minimum(m, 1 - 1e-9)), minlength=n)
        return np.stack([np.ones(n), np.log1p(expected), most, 1 - np.exp(none), expected >= 1.5], axis=1)


@dataclass
class _Tokens:
    """The words of a sample: each one's document, distinct word and toxicity; features of distinct words."""

    doc: np.ndarray
    word: np.ndarray
    feats: np.ndarray
    toxic: np.ndarray
    #: Hash of the neighbours of each toxic token.
    around: np.ndarray
    #: Number of tokens before each document.
    begin: np.ndarray


def _tokens(texts: list[str], y: np.ndarray) -> _Tokens:
    doc, word, names, feats, around = [], [], [], [], []
    for lo, hi, data, offs in sliced(pa.array(texts, pa.string())):
        w = Words(data, offs)
        h = w.hashes()
        name, at, back = np.unique(h, return_index=True, return_inverse=True)
        beside = np.zeros(len(h), dtype=np.uint64)
        near = w.doc[1:] == w.doc[:-1]
        beside[1:][near] = h[:-1][near]
        beside[:-1][near] += mix(h[1:][near])
        doc.append((w.doc + lo).astype(np.int32))
        word.append(back.astype(np.int32))
        names.append(name)
        feats.append(token_features(w, at).astype(np.int32))
        around.append(beside[y[doc[-1]] > 0] & _U((1 << 40) - 1))
    _, first, back = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    base = np.cumsum([0, *map(len, names)])
    word = np.concatenate([back[base[i] + w] for i, w in enumerate(word)]).astype(np.int32)
    doc = np.concatenate(doc)
    begin = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))
    return _Tokens(doc, word, np.concatenate(feats)[first], y[doc] > 0, np.concatenate(around), begin)


def _marked(t: _Tokens, y: np.ndarray) -> np.ndarray:
    """Whether each distinct word marks toxic tokens.

    Counts documents of each class that have a feature, over the word and its beginnings. Toxic ones count no
    more than the feature has different neighbours there, so that copies of a text are no evidence.
    """
    mark = np.zeros(len(t.feats), dtype=bool)
    n1, n0 = y.sum(), (1 - y).sum()
    for k in range(1 + len(_HEADS)):
        pair = np.unique(t.doc.astype(np.int64) * (1 << BITS) + t.feats[t.word, k])
        has, d = pair & ((1 << BITS) - 1), pair >> BITS
        a = np.bincount(has, weights=y[d], minlength=1 << BITS)
        b = np.bincount(has, weights=1 - y[d], minlength=1 << BITS)
        contexts = np.unique((t.feats[t.word[t.toxic], k].astype(np.uint64) << _U(40)) | t.around) >> _U(40)
        a = np.minimum(a, np.bincount(contexts.astype(np.int64), minlength=1 << BITS))
        share = (a + b) / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = lambda o, e: np.where(o > 0, o * np.log(o / e), 0.0)
            g2 = 2 * (ll(a, n1 * share) + ll(b, n0 * share) + ll(n1 - a, n1 * (1 - share)) + ll(n0 - b, n0 * (1 - share)))
        mark |= ((g2 > SIGNIFICANT) & (a / n1 > 4 * (b + 0.5) / n0))[t.feats[:, k]]
    return mark


def fit(rows: list[tuple[str, int]], rounds: int = ROUNDS) -> ToxicityModel:
    y = np.array([r[1] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(prior=float(y.mean()) if len(y) else 0.5)
    t = _tokens([r[0] for r in rows], y)
    label = _marked(t, y)[t.word] & t.toxic
    chunks = [(lo, hi, t.begin[lo], t.begin[hi]) for lo, hi in slices(t.begin, CHUNK)]

    n, size = len(t.word), 1 << BITS
    theta = np.zeros(size + 6)
    theta[size] = np.log((label.sum() + 1) / (n + 2))
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    same = t.doc[1:] == t.doc[:-1]
    seen = np.bincount((label[:-1] * 2 + label[1:])[same], minlength=4).reshape(2, 2)
    scale = max(1.0, float(label.sum()))
    for k in range(rounds):  # Adam on the exact gradient
        emission = theta[size] + theta[:size][t.feats].sum(axis=1)
        by_word, pairs, begins = np.zeros(len(t.feats)), -seen.astype(float), 0.0
        for _, _, a, b in chunks:
            c = Chain(emission[t.word[a:b]], t.doc[a:b], theta[size + 1 : size + 5].reshape(2, 2), theta[size + 5])
            miss = c.marginals() - label[a:b]
            by_word += np.bincount(t.word[a:b], weights=miss, minlength=len(by_word))
            pairs += c.pairs()
            begins += miss[c.first].sum()
        g = np.zeros_like(theta)
        g[:size] = np.bincount(t.feats.ravel(), weights=np.repeat(by_word, t.feats.shape[1]), minlength=size)
        g[size] = by_word.sum()
        g[size + 1 : size + 5] = pairs.ravel()
        g[size + 5] = begins
        g = g / scale + 1e-4 * theta
        mean = 0.9 * mean + 0.1 * g
        var = 0.99 * var + 0.01 * g * g
        theta -= 0.3 * (mean / (1 - 0.9 ** (k + 1))) / (np.sqrt(var / (1 - 0.99 ** (k + 1))) + 1e-6)
    model = ToxicityModel(float(y.mean()), theta[:size].astype(np.float32), float(theta[size]), theta[size + 1 : size + 5].reshape(2, 2), float(theta[size + 5]))
    emission = model.bias + model.weights[t.feats].sum(axis=1)
    x = np.concatenate([model._summary(Chain(emission[t.word[a:b]], t.doc[a:b], model.trans, model.start).marginals(), t.doc[a:b] - lo, hi - lo) for lo, hi, a, b in chunks])
    beta = np.zeros(5)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1, 0.1, 0.1])
        beta = beta - np.clip(np.linalg.solve(h, x.T @ (p - y) + np.array([1e-6, 0.1, 0.1, 0.1, 0.1]) * beta), -5, 5)
    model.doc = beta
    return model


def fit_from(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, held_out: int = 0, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows outside the held-out remainder."""
    return fit(labelled_sample(docs, labels, label, mod, held_out, doc_id, text))


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, score, spans (byte offsets of runs of words whose marginal reaches the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    two = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, spans = [np.zeros(0)], []
            for lo, hi, data, offs in sliced(b.column("text")):
                w = Words(data, offs)
                s, m = shared.value.score(w)
                own: list[list[dict]] = [[] for _ in range(hi - lo)]
                last = -2
                for i in np.flatnonzero(m >= threshold).tolist():
                    d = int(w.doc[i])
                    o = int(offs[d])
                    if own[d] and last == i - 1:
                        own[d][-1]["end"] = int(w.end[i]) - o
                        own[d][-1]["marginal"] = max(own[d][-1]["marginal"], float(m[i]))
                    else:
                        own[d].append({"start": int(w.start[i]) - o, "end": int(w.end[i]) - o, "marginal": float(m[i])})
                    last = i
                scores.append(s)
                spans += own
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.concatenate(scores)), pa.array(spans, kind)], ["id", "score", "spans"])

    return two.mapInArrow(run, f"id {two.schema['id'].dataType.simpleString()}, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns; no shuffle. A model that has not seen both classes drops none."""
    if model.doc is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index(text)).cast(pa.string())
            scores = [shared.value.score(Words(data, offs))[0] for _, _, data, offs in sliced(col)]
            yield b.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
