import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from raschmill.llm import packed_ids
from raschmill.llm.queries import op9_packed_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("width", [1, 3, 7, 8, 11, 15, 16, 17, 20, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    blob = packed_ids.pack(ids, width)
    assert len(blob) == -(-1001 * width // 8)
    assert (packed_ids.unpack(blob, width, 0, 1001) == ids).all()
    assert (packed_ids.unpack(blob, width, 333, 777) == ids[333:777]).all()


@pytest.mark.parametrize("entries", [600_000, 50])
def test_runs_equal_library(monkeypatch, entries):
    monkeypatch.setattr(packed_ids, "CACHE_ENTRIES", entries)
    t, r = Tokenizer.from_file(PATH), random.Random(2)
    enc = packed_ids.RunEncoder(PATH)
    pool = "abc ABC é́ \n\t\x85\xa0　'sst1 23 <|endoftext|> ΑΣ σ İ 日本😀.,W̊É,ß.\x00µ×."
    texts = ["", None, " ", "<|startoftext|>a <|endoftext|>", "x" * 33 + " " + "x" * 34, "ab" * 500 + ",", "a\x00 a a\x00\x00"]
    texts += ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [" ".join("".join(r.choice("abAB.,") for _ in range(r.randint(1, 30))) for _ in range(20)) for _ in range(300)]
    texts += ["".join(r.choice("aÉ'é.,(st«ªµ1×÷C ") for _ in range(25)) for _ in range(2000)]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        ids, bounds = enc.encode_all(some, 2)
        for j, x in enumerate(some):
            assert ids[bounds[j] : bounds[j + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2], repr(x)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(packed_ids, "mix", lambda h: h & np.uint64(3))
    t, enc = Tokenizer.from_file(PATH), packed_ids.RunEncoder(PATH)
    texts = [f"word{i} longer{i}than{i}eight{i}bytes a{i % 7}." for i in range(200)]
    for _ in range(2):
        ids, bounds = enc.encode_all(texts, 2)
        assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(200)] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def expected(rows):
    t, at, out = Tokenizer.from_file(PATH), 0, []
    t.no_truncation()
    t.no_padding()
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_against_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op9_packed_ids(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == expected(rows)


def test_edges_and_random_access(spark, tmp_path):
    rows = [(5, "five five"), (1, None), (5, "five five"), (None, "nobody"), (-3, ""), (9, "word " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    packed_ids.write_ids(docs, f"{tmp_path}/a", PATH, 2)
    got = packed_ids.read_ids(spark, f"{tmp_path}/a").collect()
    assert sorted((str(r["id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(a), *b) for a, *b in expected(rows))
    assert packed_ids.read_document(spark, f"{tmp_path}/a", 1) == [[2]]
    assert len(packed_ids.read_document(spark, f"{tmp_path}/a", 5)) == 2
    assert packed_ids.read_document(spark, f"{tmp_path}/a", 77) == []
    packed_ids.write_ids(docs.limit(0), f"{tmp_path}/b", PATH, 2)
    assert packed_ids.read_ids(spark, f"{tmp_path}/b").count() == 0
