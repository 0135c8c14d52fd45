import hashlib
import random
from collections import Counter

import pytest

from raschmill.llm.queries import op1_suffix_dedup
from raschmill.llm.suffix_dedup import find_repeats, remove_repeats


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans, at = [], None
        for i, g in enumerate([*gone, 0]):
            if g and at is None:
                at = i
            elif not g and at is not None:
                spans.append((at, i))
                at = None
        out.append(spans)
    return out


def texts_with_repeats(seed, n=60, alphabet="abcdeé "):
    r = random.Random(seed)
    make = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    passages = [make(r.choice([30, 39, 40, 41, 60, 150, 400])) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            parts += [make(r.randint(0, 60)), r.choice([p, p[a:b]])]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("width", [40, 64])
def test_against_brute_force(spark, seed, width):
    texts = texts_with_repeats(seed) + ["a" * 300, "ab" * 200, None, "", "x"]
    texts += texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in find_repeats(docs, width=width).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, width)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, spans in zip(rows, brute([r["text"] for r in rows], 200)):
        d = (r["text"] or "").encode()
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + d[at:a], b
        kept += d[at:]
        want[r["doc_id"]] = (len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in op1_suffix_dedup(spark, sf).collect()}
    assert got == want


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == 0
    same = "long " * 100
    odd = spark.createDataFrame([(1, same, 5, "x"), (1, same, 5, "x"), (None, None, None, None)], "doc_id long, text string, unit int, spans string")
    got = sorted((str(r["row"]["doc_id"]), r["text"], r["row"]["unit"], r["row"]["spans"]) for r in remove_repeats(odd).collect())
    assert got == [("1", "", 5, "x"), ("1", "", 5, "x"), ("None", "", None, None)] or got == [("1", "", 5, "x"), ("1", "", 5, "x"), ("None", None, None, None)]
    cut = spark.createDataFrame([(1, "é" * 150 + "q"), (2, "z" + "é" * 150)], "doc_id long, text string")
    assert [r["text"] for r in remove_repeats(cut, width=201).orderBy("row.doc_id").collect()] == ["q", "z"]


def test_pairs_that_share_half():
    import numpy as np

    from raschmill.llm.suffix_dedup import _PAIR, _Pairs

    r = random.Random(3)
    have = [(r.randrange(6), r.randrange(40)) for _ in range(60)]
    pairs = _Pairs([np.array(have[:30], _PAIR).tobytes(), np.array(have[30:], _PAIR).tobytes()])
    ask = [(k, m) for k in range(8) for m in range(45)]
    key, more = (np.array([x[j] for x in ask], np.uint64) for j in (0, 1))
    assert pairs.has(key, more).tolist() == [x in have for x in ask]
    assert not _Pairs([]).has(key, more).any()
