"""The pipeline against brute force, stage by stage, on a small fixture with planted cases."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests_llm_brute import byte_repeats, near_classes, ngram_hits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    vocab = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        t = text(r.choice([5, 40, 120]))
        bad = i % 6 == 0
        if bad:
            w = t.split()
            for _ in range(4):
                w.insert(r.randrange(len(w) + 1), r.choice(["grumblax", "vexhole", "snarkwad"]))
            t = " ".join(w)
        rows.append([i, t])
        if i < 200:
            labels.append((i, 1, int(bad)))
    items = [(k, text(30)) for k in range(5)]
    passage = text(70)
    for i in range(240, 250):
        rows.append([i, text(40) + " " + passage + " " + text(30)])
    for i in range(250, 256):
        rows.append([i, rows[241][1]])
    w = rows[248][1].split()
    w[20] = "changed"
    rows.append([256, " ".join(w)])
    rows.append([257, text(20) + " " + items[2][1] + " " + text(20)])
    rows.append([258, text(3000) + " " + items[3][1]])
    rows += [[259, ""], [260, None]]
    path = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {i: t or "" for i, t in rows}, items


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "tokens"]


def test_pipeline_against_brute_force(spark, folder):
    path, docs, items = folder
    docs = {i: t for i, t in docs.items() if not set(t.split()) & {"grumblax", "vexhole", "snarkwad"}}
    cls = near_classes(docs)
    docs = {i: t for i, t in docs.items() if cls[i] == i}
    assert 241 in docs and not {*range(250, 257)} & set(docs)
    ids = sorted(docs)
    cut = byte_repeats([docs[i] for i in ids], 200)
    shorter = {}
    for i, spans in zip(ids, cut):
        d, out, at = docs[i].encode(), b"", 0
        for a, b in spans:
            out, at = out + d[at:a], b
        shorter[i] = (out + d[at:]).decode("utf-8", "ignore")
    assert sum(len(shorter[i]) < len(docs[i]) for i in ids) >= 8
    docs = {}
    for i, t in shorter.items():
        n, h = ngram_hits(t, items)
        if not (h and 20 * h >= n):
            docs[i] = t
    assert 257 not in docs and 258 in docs
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        assert got[i]["ids"] == lib.encode(t, add_special_tokens=False).ids
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_columns_between_stages(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, folder[0])
        assert out.columns == docs.columns and [x.dataType for x in out.schema] == [x.dataType for x in docs.schema]


def test_empty_documents_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, folder[0]).count() == 0
