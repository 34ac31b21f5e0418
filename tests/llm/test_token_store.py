import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gapmend.llm import token_store as T
from gapmend.session import scratch_path

VOCAB = str(public_tokenizers.path("byte_bpe_50k.json"))


def expected(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCAB)
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def stored(spark, rows, schema="doc_id bigint, text string"):
    docs, path = spark.createDataFrame(rows, schema), scratch_path(spark, "tokens")
    T.write_store(docs, path, VOCAB)
    out = T.stored_documents(spark, path, docs.select("doc_id")).select("doc_id", "start", "n_tokens", "ids_crc32", "slot")
    return [tuple(r) for r in out.orderBy("start").collect()], path


def test_whole_table_equals_direct_encoding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    from gapmend.llm.queries import QUERIES
    got = [tuple(r) for r in QUERIES["op2_token_store"](spark, sf).orderBy("start").collect()]
    assert [r[:4] for r in got] == expected(rows)
    assert sorted(r[4] for r in got) == list(range(len(rows)))  # minimal and perfect


ODD = ["", None, " ", "  two  blanks ", "a\n b", "tab\t\tend \n", "trailing ", " lead", "it's we'll  ok", "naïve   nbsp  x",
       "<|endoftext|> end", "hello <|endoftext|> end", "a <|endoftext|>", "x<|endoftext|>y <|endoftext|><|endoftext|> z", "<|endoftext|>", " <|endoftext|>", "q <|endoftext|>, r\n<|endoftext|>\n s", "<|endof text|>", "中文 \U0001f600 x", "a\x1c b", "word " * 30_000, "1 2  3 !! ?? ' s",
       "end.\nStart, x\n\ny it's, a,b,,c É!!\nz ²x. a_, x² word!?\r\nnext", "a. b, c! d# e. a, b. c, d\ne\nf.\ng", "x\n", "\nx y\n z", "e\u0301, a\u0301. \u200b, b"]


def test_odd_texts(spark):
    rows = [(i * 3 - 5, t) for i, t in enumerate(ODD)]
    assert [r[:4] for r in stored(spark, rows)[0]] == expected(rows)


def test_repeated_and_null_ids(spark):
    rows = [(5, "same text")] * 40 + [(None, "no id"), (None, None), (7, "other")]
    got = stored(spark, rows)[0]
    assert len(got) == len(rows) and sum(r[2] for r in got) == sum(r[2] for r in expected(rows))
    assert [r[0] for r in got] == [None, None] + [5] * 40 + [7]
    starts = [r[1] for r in got]
    assert starts == [sum(r[2] for r in got[:i]) for i in range(len(got))]


def test_empty_table_and_unknown_keys(spark):
    assert stored(spark, [])[0] == []
    _, path = stored(spark, [(i, f"text {i}") for i in range(5000)])
    asked = spark.range(10_000).select(F.col("id").alias("doc_id"))
    got = T.look_up(spark, path, F.col("doc_id"), asked)
    assert got.where("found").count() == 5000 and got.where("found and key >= 5000").count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "a b", 9, "x"), (2, "c", 8, "y")]
    assert len(stored(spark, rows, "doc_id bigint, text string, shard int, ids string")[0]) == 2


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_hash_is_minimal_and_perfect(n):
    h = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    sizes, bits = T.build_levels(h)
    assert sorted(T.slots(h, sizes, bits).tolist()) == list(range(n))
