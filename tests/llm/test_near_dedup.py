import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from raschmill.llm import near_dedup as nd
from raschmill.llm.common import byte_view

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows):
    """id -> set of ids of its class, by all pairs and exact weighted Jaccard."""
    w = {i: words(t) for i, t in rows if i is not None}
    n = len(rows)
    df = Counter(x for i, t in rows for x in set(words(t)))
    idf = {x: 1 + math.log10(n / c) if c * nd.COMMON >= n else 1 + math.log10(nd.COMMON) for x, c in df.items()}
    sets = {}
    for i, ws in w.items():
        k = min(5, len(ws))
        c = Counter(tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)) if k else Counter()
        sets[i] = {g: f * sum(idf[x] for x in g) / k for g, f in c.items()}
    up = {i: i for i in w}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(w)
    sims = {}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = sum(min(v, sets[b][g]) for g, v in sets[a].items() if g in sets[b])
                sims[a, b] = both / (sum(sets[a].values()) + sum(sets[b].values()) - both)
                if sims[a, b] >= 0.8:
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: root(i) for i in ids}, sims


def corpus(seed, n=40):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 30, 60, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 8])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i * 3 % 101, " ".join(w)))
    return rows + [(500, None), (501, ""), (502, "?!"), (503, "one"), (504, "One."), (None, "one")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_against_brute_force(spark, seed):
    rows = corpus(seed)
    want, _ = brute(rows)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, class_id int")
    got = {r["id"]: r["class_id"] for r in nd.near_duplicate_classes(docs).collect()}
    assert got.pop(None) is None
    assert got == want
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, set(want.values())), "None"])


def test_samples_agree_as_often_as_weights(spark):
    r = random.Random(3)
    a = [f"u{r.randrange(300)}" for _ in range(200)]
    b = a[:150] + [f"v{i}" for i in range(50)]
    idf = nd.Idf(np.zeros(0, np.uint64), np.zeros(0), 0)
    x = nd._shingle_set(" ".join(a), idf)
    y = nd._shingle_set(" ".join(b), idf)
    doc, sh, weight, _, _ = nd.weighted_shingles(*byte_view(pa.array([" ".join(a), " ".join(b)])), idf)
    s = nd.signatures(doc, sh, weight, 2, 120)
    assert abs((s[0] == s[1]).mean() - nd.weighted_jaccard(x, y)) < 0.13


@pytest.mark.parametrize("block, size", [(512, 4 << 20), (7, 4 << 20), (512, 3000)])
def test_chains_and_large_groups(spark, monkeypatch, block, size):
    """Near copies of near copies, and a group in which most pairs of members are not similar to each other; also with small blocks."""
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "BLOCK_BYTES", size)
    r = random.Random(8)
    base = [f"a{i}" for i in range(300)]
    rows, w = [], list(base)
    for i in range(12):  # a chain: neighbours similar, ends not
        rows.append((i, " ".join(w)))
        w[i * 20 : i * 20 + 8] = [f"c{i}x{j}" for j in range(8)]
    star = [f"s{i}" for i in range(300)]
    for i in range(60):
        v = list(star)
        for j in r.sample(range(300), 5):
            v[j] = f"e{i}x{j}"
        rows.append((100 + i, " ".join(v)))
    rows += [(1000 + i, " ".join(f"z{i}q{j}" for j in range(50))) for i in range(30)]
    rows += [(2000 + i, rows[0][1]) for i in range(50)]
    want, _ = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["id"]: x["class_id"] for x in nd.near_duplicate_classes(docs).collect()} == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5), (1, "a b c d e f", 5), (2, "a b c d e f", 6)], "doc_id long, text string, id int")
    assert {(x["id"], x["class_id"]) for x in nd.near_duplicate_classes(docs).collect()} == {(1, 1), (2, 1)}
    assert [x["doc_id"] for x in nd.drop_near_duplicates(docs).collect()] == [1]
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "one two three four five six"), (2, "a b c d e f"), (0, "One, two three four five six"), (None, "a b c d e f"), (3, ""), (3, "")], "doc_id long, text string")
    kept = sorted(((x["doc_id"], x["text"]) for x in nd.drop_near_duplicates(twice).collect()), key=str)
    assert kept == [(0, "One, two three four five six"), (1, "a b c d e f"), (3, ""), (None, "a b c d e f")]
    assert nd.near_duplicate_classes(docs.limit(0)).count() == 0
    assert nd.drop_near_duplicates(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, "x y z"), (2, "quite other words")], "doc_id long, text string")
    assert nd.drop_near_duplicates(alone).count() == 2


def test_very_long_texts(spark):
    w = [f"l{i}" for i in range(120_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:60_000], "x", *w[60_000:]])), (3, " ".join(f"m{i}" for i in range(120_000))), (4, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["id"]: x["class_id"] for x in nd.near_duplicate_classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_query_against_brute_force(spark, tmp_path):
    from raschmill.llm.queries import op7_near_dedup

    spark.createDataFrame([(*r, "en") for r in corpus(7)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_near_dedup(spark, str(tmp_path)).collect()
    want, _ = brute(corpus(7))
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
