import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from raschmill.llm import bpe
from raschmill.llm.queries import op4_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def strange_texts():
    r = random.Random(5)
    pools = ["abcdefghij ", "aA1 .,!?\n\t'", "éüñçß ", " \x1c\x1d\x85\xa0 　x\n", "日本語テキスト😀👩‍👩‍👧 ", "'stremlld ve", "   \n\n  ab", "<|endoftext|>"]
    out = ["", " ", "   ", "\n", "a   b", "a  \n b", "it's we'll 'S x's", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "  <|endoftext|>", "\x00\x7f", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "é"]
    for _ in range(1500):
        pool = r.choice(pools) if r.random() < 0.7 else "".join(pools)
        out.append("".join(r.choice(pool) for _ in range(r.randint(0, 60))))
    return out


def test_encoder_equals_library(library):
    m = bpe.BacktrackingBpe(PATH)
    for t in strange_texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert m.encode(t) == ids, repr(t)
        assert m.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_is_its_own_encoding():
    m = bpe.BacktrackingBpe(PATH)
    for k in range(256, len(m._bytes), 7):
        assert m.encode_piece(m._bytes[k]) == [m._id[k]]


def test_decode_of_any_ids(library):
    m, r = bpe.BacktrackingBpe(PATH), random.Random(3)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert m.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query_against_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        hexes = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want[d] = (len(ids), *hexes)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op4_bpe(spark, sf).collect()} == want


def test_encode_decode_frames_and_edges(spark):
    rows = [(1, "hello  world", "x"), (1, "hello  world", "x"), (None, None, None), (3, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    e = bpe.encode(docs, PATH)
    assert sorted(str(r["id"]) + "|" + r["text"] for r in bpe.decode(e, PATH).collect()) == ["1|hello  world", "1|hello  world", "3|", "None|"]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_small_table_still_exact(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    m = bpe.BacktrackingBpe(PATH)
    t = "one two, three four; one two five " * 3
    assert m.encode(t) == library.encode(t, add_special_tokens=False).ids
