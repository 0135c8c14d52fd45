import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from raschmill.llm import common, quality, toxicity
from raschmill.llm.common import Words, byte_view
from raschmill.llm.labelled import labelled_sample
from raschmill.llm.queries import op3_quality, op10_toxicity

SF = "/root/testdata/sf0.01"


def auc(y, s):
    y, s = np.array(y), np.array(s)
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None]).mean() + 0.5 * (p[:, None] == n[None]).mean())


def held_out(spark, found, label):
    y = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in found.collect() if r["held_out"] and r["doc_id"] in y]
    return [y[r["doc_id"]] for r in rows], [r["score"] for r in rows], [r["predicted"] for r in rows]


def test_toxicity_query(spark):
    f = op10_toxicity(spark, SF)
    y, s, p = held_out(spark, f, "toxic")
    assert auc(y, s) > 0.8 and np.mean(np.array(y) == p) > np.mean(np.array(y) == 0)
    for r in f.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_toxicity_on_more_rows(spark):
    """About 120 held-out toxic documents: nearly all are found, few clean ones are taken for them."""
    sf = "/root/testdata/sf0.1"
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op10_toxicity(spark, sf).select("doc_id", "held_out", "score", "predicted").collect() if r["held_out"] and y.get(r["doc_id"]) is not None]
    truth, said = np.array([y[r["doc_id"]] for r in rows]), np.array([r["predicted"] for r in rows])
    assert auc(truth, [r["score"] for r in rows]) > 0.93
    assert (truth == said).mean() > 0.5 * (1 + (truth == 0).mean())


def test_votes_against_brute_force(spark):
    """Every score is the vote of the nearest labelled vectors, counted here one document at a time."""
    rows = toy(150, seed=3)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(999, "odd, other WORDS 77")], "doc_id long, text string")
    m = quality.fit(rows, *quality.document_frequencies(docs))
    got = {r["id"]: r["score"] for r in quality.score(docs, m).collect()}
    for r in docs.collect():
        z = m.project(quality.term_counts(*byte_view(pa.array([r["text"]]))))[0].astype(np.float64)
        cos = sorted(((float(z @ v), y) for v, y in zip(m.vectors.astype(np.float64), m.labels)), reverse=True)
        edge = cos[quality.NEIGHBOURS - 1][0]
        near = [x for x in cos if x[0] >= edge - 1e-7]
        w = [max(c, 0) ** quality.SHARPNESS + 1e-12 for c, _ in near]
        assert abs(got[r["doc_id"]] - sum(a * y for a, (_, y) in zip(w, near)) / sum(w)) < 1e-3


def test_all_of_equal_neighbours_vote():
    rows = [("Plain words here, in order. ", 1)] * 30 + [("Plain words here, in order. ", 0)] * 30 + [("BUY!! NOW!! ", 0)] * 10
    m = quality.fit(rows, np.full(quality._ALL, 10), 70)
    assert m.score(quality.term_counts(*byte_view(pa.array(["Plain words here, in order. "])))).tolist() == pytest.approx([0.5])


def test_quality_query(spark):
    f = op3_quality(spark, SF)
    y, s, p = held_out(spark, f, "quality")
    assert auc(y, s) > 0.85 and np.mean(np.array(y) == p) > 0.9
    for r in f.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


@pytest.mark.parametrize("seed", range(4))
def test_chain_marginals_by_enumeration(seed):
    g = np.random.default_rng(seed)
    doc = np.repeat([0, 2, 3, 4], [1, 5, 7, 3])
    e, trans, start = g.normal(0, 2, len(doc)), g.normal(0, 1, (2, 2)), float(g.normal())
    c = toxicity.Chain(e, doc, trans, start)
    want, pairs = np.zeros(len(doc)), np.zeros((2, 2))
    for d in np.unique(doc):
        at = np.flatnonzero(doc == d)
        total, own, two = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for labels in itertools.product([0, 1], repeat=len(at)):
            s = start * labels[0] + sum(e[i] for i, x in zip(at, labels) if x) + sum(trans[a, b] for a, b in zip(labels, labels[1:]))
            w = np.exp(s)
            total += w
            own += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                two[a, b] += w
        want[at], pairs = own / total, pairs + two / total
    assert np.allclose(c.marginals(), want)
    assert np.allclose(c.pairs(), pairs)


def toy(n=300, seed=1):
    r = random.Random(seed)
    plain = ["sun", "moon", "tree", "river", "stone", "bird", "cloud", "grass"]
    rows = []
    for i in range(n):
        w = [r.choice(plain) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vilewort", "vilestone", "grubble"]))
        rows.append((" ".join(w), int(bad)))
    return rows


def test_spans_and_long_texts(spark):
    m = toxicity.fit(toy())
    long = "river " * 60_000 + "vilefire grubble"
    docs = spark.createDataFrame([(1, "the sun vilemost tree", 0.1), (2, "sun and moon", 0.2), (3, long, 0.3), (4, None, 0.4), (5, "", 0.5), (5, "", 0.5), (None, "grubble é grubble vilewort", 0.0)], "doc_id long, text string, score double")
    got = {r["id"]: r for r in toxicity.score(docs, m).collect()}
    assert [("the sun vilemost tree").encode()[s["start"] : s["end"]] for s in got[1]["spans"]] == [b"vilemost"]
    assert [long[s["start"] : s["end"]] for s in got[3]["spans"]] == ["vilefire grubble"]
    assert got[2]["spans"] == [] and got[2]["score"] < 0.5 and got[4]["score"] < 0.5 and got[None]["score"] > 0.5
    kept = toxicity.drop_toxic(docs, m)
    assert kept.columns == docs.columns and None not in {r["doc_id"] for r in kept.collect()}
    assert toxicity.score(docs.limit(0), m).count() == 0


def test_fit_does_not_depend_on_chunks_and_slices(monkeypatch):
    rows = [*toy(120), ("", 0), ("vilewort " * 3, 1)]
    whole = toxicity.fit(rows)
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    monkeypatch.setattr(toxicity, "sliced", lambda col: common.sliced(col, 500))
    parts = toxicity.fit(rows)
    assert np.allclose(whole.weights, parts.weights, atol=1e-5) and np.allclose(whole.doc, parts.doc, atol=1e-5)


def test_without_labels(spark):
    assert toxicity.fit([]).score(Words(*byte_view(pa.array(["a b", None]))))[0].tolist() == [0.5, 0.5]
    assert toxicity.fit([("a", 1), ("b", 1)]).score(Words(*byte_view(pa.array(["a"]))))[0].tolist() == [1.0]
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [("a", 1), ("b", 1)]):
        assert toxicity.drop_toxic(docs, toxicity.fit(rows)).count() == 2
    m = quality.fit([], np.zeros(quality._ALL), 0)
    assert m.score(quality.term_counts(*byte_view(pa.array(["x", None])))).tolist() == [0.5, 0.5]


def test_quality_edges(spark):
    rows = [("Plain words here, in order. " * (1 + i % 5), 1) for i in range(40)] + [("BUY!! NOW!! " * (1 + i % 5), 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "q") for i, (t, _) in enumerate(rows)] + [(None, None, "q"), (900, "", "q")], "doc_id long, text string, score string")
    m = quality.fit(rows, *quality.document_frequencies(docs))
    got = {r["id"]: r["score"] for r in quality.score(docs, m).collect()}
    assert all((got[i] > 0.7) == (y == 1) for i, (_, y) in enumerate(rows))
    assert got[None] == got[900] == 0.5
    assert quality.score(docs.limit(0), m).count() == 0


def test_term_counts_do_not_depend_on_neighbours():
    texts = ["a b b c\nline\nline\n", "", "A!! A!!", "é" * 9, "x"]
    both = quality.term_counts(*byte_view(pa.array(texts)))
    for i, t in enumerate(texts):
        assert (both[i] == quality.term_counts(*byte_view(pa.array([t])))[0]).all()


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(None, 1)], "doc_id long, y int")
    got = labelled_sample(docs, labels, "y", 5, 0, max_rows=300)
    assert 200 < len(got) < 400
    assert all(zlib.crc32(t[1:].encode()) % 5 != 0 and int(t[1:]) % 2 == y for t, y in got)
    assert sum(len(t) for t, _ in labelled_sample(docs, labels, "y", 5, 0, max_bytes=100)) <= 100


def test_a_long_text_does_not_end_the_sample(spark):
    docs = spark.createDataFrame([(i, "x" * 1000 if i < 60 else f"t{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60) if i % 2 else 1) for i in range(300)], "doc_id long, y int")
    everything = labelled_sample(docs, labels, "y", 5, 0)
    short = sorted(r for r in everything if len(r[0]) < 10)
    assert len(short) > 150
    assert sorted(labelled_sample(docs, labels, "y", 5, 0, max_bytes=999)) == short
    assert sum(len(t) for t, _ in labelled_sample(docs, labels, "y", 5, 0, max_bytes=2500)) <= 2500
