import hashlib
import random
import re

import pytest

from raschmill.llm import decontam
from raschmill.llm.decontam import drop_contaminated, scan_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[a : a + n]), set()).add("null" if i is None else str(i))
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    found |= grams[tuple(w[a : a + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def made(seed):
    r = random.Random(seed)
    vocab = ["a", "B1", "é", "ÀÉ", "x2", "日本", "the", "of"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 12, 13, 14, 30]))) for i in range(12)] + [(None, text(20)), (99, None), (3, text(15))]
    docs = []
    for d in range(60):
        parts = [text(r.randint(0, 40))]
        if r.random() < 0.6:
            w = words(r.choice(items)[1])
            parts.insert(r.randint(0, 1), " ".join(w[: r.randint(0, len(w))]).upper())
        docs.append((d, "; ".join(parts)))
    return docs + [(100, None), (101, "")], items


def test_against_brute_force(spark):
    docs, items = made(4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in scan_contamination(d, b).collect()}
    assert got == brute(docs, items)
    kept = {r["doc_id"] for r in drop_contaminated(d, b).collect()}
    assert kept == {i for i, (n, h, _) in got.items() if not (h and 20 * h >= n)}


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    docs, items = made(9)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "MAX_BLOCK_BYTES", 600)
    found = scan_contamination(d, b).collect()
    assert {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found} == brute(docs, items)
    for r in found:
        assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_hit"]
    kept = {r["doc_id"] for r in drop_contaminated(d, b).collect()}
    assert kept == {r["id"] for r in found if not (r["n_hit"] and 20 * r["n_hit"] >= r["n_words"])}


@pytest.mark.parametrize("size", [8 << 20, 100])
def test_rows_are_judged_by_themselves(spark, monkeypatch, size):
    monkeypatch.setattr(decontam, "MAX_BLOCK_BYTES", size)
    bad, fine = " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    docs = [(1, bad, "x"), (1, fine, "y"), (None, bad, "z"), (None, fine, "z"), (2, fine + " " + bad, "w")]
    items = [(1, bad), (2, "unlike " * 20), (3, " ".join(bad.split()[5:25]))]
    d = spark.createDataFrame(docs, "doc_id long, text string, found_0 string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["id"]), r["n_words"], r["n_hit"], r["items"]) for r in scan_contamination(d, b).collect())
    assert got == [("1", 30, 0, []), ("1", 30, 30, ["1", "3"]), ("2", 60, 30, ["1", "3"]), ("None", 30, 0, []), ("None", 30, 30, ["1", "3"])]
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((str(r[0]), r[1]) for r in kept.collect()) == [("1", fine), ("None", fine)]


def test_size_of_the_set():
    r = random.Random(1)
    rows = [(i, " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 10))) for _ in range(400))) for i in range(400)]
    grams = decontam.NGramSet(rows)
    arrays = [grams.start, grams.end, grams.item, *grams.keys.values(), *grams.place.values()]
    assert sum(x.nbytes for x in arrays) + len(grams.blob) < 8 * sum(len(t) for _, t in rows)


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    d = spark.createDataFrame([(1, long)], "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(299_990, 300_010))), (6, "w7 w8"), (7, long)], "item_id long, text string")
    (r,) = scan_contamination(d, b).collect()
    assert (r["n_words"], r["n_hit"], r["items"], r["spans"][0]["first"]) == (300_000, 300_000, ["6", "7"], 0)


def test_query_against_brute_force(spark, tmp_path):
    from raschmill.llm.queries import op5_decontamination

    docs, items = made(6)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in op5_decontamination(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert got == {d: (n, h, sha(x), bool(h and 20 * h >= n)) for d, (n, h, x) in brute(docs, items).items()}


def test_edges(spark):
    d = spark.createDataFrame([(1, "a b", "n", 1), (1, "a b", "n", 1), (None, None, None, None)], "doc_id long, text string, items string, spans int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in scan_contamination(d, none).collect()] == [0, 0, 0]
    assert scan_contamination(d.limit(0), none).count() == 0
    one = spark.createDataFrame([(7, "A, b")], "item_id long, text string")
    assert sorted(r["items"] for r in scan_contamination(d, one).collect()) == [[], ["7"], ["7"]]
    assert [r["doc_id"] for r in drop_contaminated(d, one).collect()] == [None]
    assert drop_contaminated(d, one).columns == d.columns
