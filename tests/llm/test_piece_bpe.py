"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from gapmend.llm import piece_bpe as B
from gapmend.llm.queries import QUERIES

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [None, "", " ", "  a", "hi  there ", "\n\n", "<s> x <unk> </s>", "a▁b", "▁", "▁▁ ▁", "\x00a", " " * 50 + "x", " " * 100, "a" * 28, "中文字符测试 日本語 \U0001f600", "naïve   nbsp x",
       "<0x41> <0x0A>", "word " * 30_000, "=" * 500 + "-" * 300, "\t\t\t  \t", "é​", "ab" * 50_000, "..." * 1000 + " " + "0123456789" * 50]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return B.MergeModel(MODEL)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_random_texts(library, model):
    rng = random.Random(4)
    letters = "abcdefghijklmnop ▁  \n\té中<>0x=/._-"
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(1500)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for t in texts:
        assert ids(model.encode(t)) == library.encode(t), t


def test_without_cuts_and_memory(library, model):
    """The search itself, over whole texts at once."""
    for t in ODD[1:]:
        if len(t) < 2000:
            marked = ("▁" + t.replace(" ", "▁")) if t else ""
            assert ids(b"".join(map(model._piece_ids, model.pieces(marked)))) == library.encode(t)


def test_failed_positions_are_taken_back(library, model):
    """Texts whose longest first piece leads nowhere."""
    rng, back = random.Random(2), 0
    for _ in range(3000):
        t = "".join(rng.choice("aeinorst") for _ in range(12))
        got = model.pieces("▁" + t)
        back += len(got[0]) < max(k for k in range(1, 14) if ("▁" + t)[:k] in model.ids)
        assert [library.piece_to_id(p) for p in got] == library.encode(t)
    assert back > 0


def test_random_ids_decode_alike(library):
    model, rng = B.Surfaces(MODEL), random.Random(3)
    for _ in range(3000):
        some = [rng.choice([rng.randrange(32000), rng.randrange(260), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(some) == library.decode(some), some


def test_odd_texts_in_a_table(spark, library):
    rows = [(i if i else None, t, 1, "x") for i, t in enumerate(ODD)] + [(5, "again", 1, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, key string")
    for bos, eos in ((True, True), (False, False)):
        enc = B.encode(docs, MODEL, bos, eos)
        got = [tuple(r) for r in B.decode(enc, MODEL).select("doc_id", "ids", "n_tokens", "text").collect()]
        want = [library.encode(r[1] or "", add_bos=bos, add_eos=eos) for r in rows]
        assert [(g[0], ids(g[1]), g[2], g[3]) for g in got] == [(r[0], w, len(w), library.decode(w)) for r, w in zip(rows, want)]
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert B.decode(B.encode(none, MODEL), MODEL).count() == 0


def test_whole_table(spark, sf, library):
    def digest(b):
        return hashlib.sha256(b).hexdigest()

    want = {}
    for key, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = library.encode(text or "", add_bos=True, add_eos=True)
        want[key] = (len(w), digest(np.array(w, "<u4").tobytes()), digest(library.decode(w).encode()))
    got = QUERIES["op12_sentencepiece"](spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)
