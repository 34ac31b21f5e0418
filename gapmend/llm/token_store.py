"""Token ids in binary shards with a minimal perfect hash index.

A store is a folder with two Parquet tables. ``payload`` holds blocks: (shard, block, first, n_ids,
doc_ids, lens, ids); ``ids`` are the raw little-endian ids of whole consecutive documents, 16
bits wide if the vocabulary allows it, else 32; ``first`` counts the ids before the block in its shard. ``index`` holds one row per bucket
of keys: the bit levels of the hash function and, by slot, a fingerprint and the place of the
key's first document. Shards are ranges of ids in ascending order. Both are written by Spark's
own committer, so a lost task leaves no trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from gapmend.llm.common import worker_cache

BLOCK_BYTES = 1 << 20
BUCKET_KEYS = 2000
#: Bits per key still to be placed, on each level.
GAMMA = 2
#: Chunks remembered by a worker; later ones are encoded anew.
MEMO_CHUNKS = 1_200_000
#: Documents encoded together.
TOGETHER = 200

PAYLOAD = "shard int, block int, first bigint, n_ids bigint, wide boolean, doc_ids array<bigint>, lens array<bigint>, ids binary"
INDEX = ("bucket bigint, n_keys int, sizes array<int>, bits binary, prints binary, shards array<int>, blocks array<int>, "
         "places array<bigint>, copies array<bigint>")


def text_encoder(path: str):
    """list of texts -> list of ids as little-endian bytes, and whether they are 32 bits wide.

    The byte-level vocabulary splits text before every single blank between two visible characters,
    so chunks cut there are encoded once and remembered; a text with other white space next to
    a blank is encoded whole. New chunks are encoded together in one string and cut apart again by
    the bytes that each id stands for. The string of a special token becomes its id, as the library has it; it
    holds no blank, so no cut falls into it.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    cache = worker_cache(f"tokens:{path}")
    if "tok" not in cache:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # without the search for special tokens where none occurs
        exact, tok = Tokenizer.from_file(path), Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        n = tok.get_vocab_size()
        # a byte-level token's string has one character for each byte
        plain = Tokenizer(tok.model)
        plain.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        cache |= {"tok": tok, "exact": exact, "special": special, "plain": plain, "chunks": {}, "wide": n > 1 << 16, "bytes": np.array([len(tok.id_to_token(i) or "") for i in range(n)])}
    plain, chunks, wide, n_bytes = cache["plain"], cache["chunks"], cache["wide"], cache["bytes"]
    kind, width = ("<u4", 4) if wide else ("<u2", 2)

    def reader(text: str):
        return cache["exact" if any(s in text for s in cache["special"]) else "tok"]

    def whole(text: str) -> bytes:
        return np.array(reader(text).encode_batch_fast([text], add_special_tokens=False)[0].ids, kind).tobytes()

    def cut(encoder, text: str, ends: np.ndarray) -> list[bytes]:
        """The ids of ``text``, cut after the given numbers of bytes."""
        ids = np.array(encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        cuts = [0, *(width * (np.searchsorted(np.cumsum(n_bytes[ids]), ends) + 1)).tolist()]
        got = ids.astype(kind).tobytes()
        return [got[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode_chunks(new: set[str]) -> dict[str, bytes | None]:
        """None for a chunk with white space at an end, whose context matters. Plain words need no search for
        boundaries; in the byte alphabet a blank is written as U+0120."""
        safe = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        out = dict.fromkeys(new) if len(safe) < len(new) else {}
        easy = [w for w in safe if w.isascii() and w.isalpha()]
        if easy:
            out.update(zip(easy, cut(plain, "\n".join(["\u0120" + w for w in easy]), np.cumsum([1 + len(w) for w in easy]))))
        hard = [w for w in safe if w not in out]
        if hard:
            joint = " " + " ".join(hard)
            out.update(zip(hard, cut(reader(joint), joint, np.cumsum([1 + len(w.encode("utf-8", "surrogatepass")) for w in hard]))))
        return out

    def encode(texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        got = [list(map(chunks.get, s[1:])) for s in split]
        found = encode_chunks({w for s, g in zip(split, got) if None in g for w, v in zip(s[1:], g) if v is None})
        if len(chunks) < MEMO_CHUNKS:
            chunks.update(x for x in found.items() if x[1] is not None)
        out = []
        for t, s, g in zip(texts, split, got):
            if None in g:
                g = [found[w] if v is None else v for w, v in zip(s[1:], g)]
            out.append(whole(t) if None in g or s[0][-1:].isspace() else b"".join([whole(s[0]), *g]))
        return out

    return encode, wide


def _writer(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, wide = text_encoder(path)
        end = b"" if end_id is None else np.array([end_id], "<u4" if wide else "<u2").tobytes()
        width, shard = (4 if wide else 2), TaskContext.get().partitionId()
        block = first = size = 0
        ids, docs, lens = [], [], []

        def flush():
            nonlocal block, first, size, ids, docs, lens
            n = sum(lens)
            out = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([wide]),
                pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([b"".join(ids)], pa.binary())],
                names=["shard", "block", "first", "n_ids", "wide", "doc_ids", "lens", "ids"])
            block, first, size, ids, docs, lens = block + 1, first + n, 0, [], [], []
            return out

        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                part = b.slice(i, TOGETHER)
                for key, got in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    got += end
                    ids.append(got)
                    docs.append(key)
                    lens.append(len(got) // width)
                    size += len(got)
                    if size >= BLOCK_BYTES:
                        yield flush()
        if docs:
            yield flush()
    return run


def _key_hashes(key: Column) -> list[Column]:
    known = key.isNull().cast("int")
    return [F.xxhash64(known, key).alias("h1"), F.xxhash64(F.lit(7), known, key).alias("h2")]


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A new 64-bit hash for each level (two rounds of multiply and shift)."""
    x = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_levels(h: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Bit levels of a minimal perfect hash of distinct 64-bit numbers: on each level a key that meets no
    other one sets its bit, the rest goes on to the next level."""
    sizes, bits = [], []
    while len(h):
        m = max(8, GAMMA * len(h))
        at = (_mix(h, len(sizes)) % np.uint64(m)).astype(np.int64)
        n = np.bincount(at, minlength=m)
        sizes.append(m)
        bits.append(n == 1)
        h = h[n[at] != 1]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(h: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key: the rank of its bit; -1 for a key that sets none."""
    rank = np.cumsum(bits) - 1
    out, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for level, m in enumerate(sizes):
        at = base + (_mix(h[todo], level) % np.uint64(m)).astype(np.int64)
        hit = bits[at]
        out[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + m
    return out


def _build(pdf):
    import pandas as pd

    h = pdf.h2.to_numpy().view(np.uint64)
    sizes, bits = build_levels(h)
    p = pdf.iloc[np.argsort(slots(h, sizes, bits))]
    prints = (p.h1.to_numpy().view(np.uint64) >> np.uint64(32)).astype("<u4").tobytes()
    return pd.DataFrame([{"bucket": p.bucket.iloc[0], "n_keys": len(p), "sizes": sizes, "bits": np.packbits(bits).tobytes(), "prints": prints,
                          "shards": p.shard.tolist(), "blocks": p.block.tolist(), "places": p.place.tolist(), "copies": p.copies.tolist()}])


def _look_up(keys, index):
    import pandas as pd

    names = ["key", "found", "slot", "shard", "block", "place", "copies"]
    if not len(keys):
        return pd.DataFrame(columns=names)
    n = len(keys)
    out = pd.DataFrame({"key": keys.key, "found": np.zeros(n, bool), **{c: np.full(n, -1, np.int64) for c in names[2:]}})
    if len(index):
        r = index.iloc[0]
        sizes = list(r["sizes"])
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: sum(sizes)].astype(bool)
        s = slots(keys.h2.to_numpy().view(np.uint64), sizes, bits)
        prints = np.frombuffer(r["prints"], "<u4")
        ok = (s >= 0) & (prints[np.maximum(s, 0)] == (keys.h1.to_numpy().view(np.uint64) >> np.uint64(32)))
        out["found"] = ok
        for c, values in (("slot", s + r["base"]), ("shard", np.asarray(r["shards"])[np.maximum(s, 0)]), ("block", np.asarray(r["blocks"])[np.maximum(s, 0)]),
                          ("place", np.asarray(r["places"])[np.maximum(s, 0)]), ("copies", np.asarray(r["copies"])[np.maximum(s, 0)])):
            out[c] = np.where(ok, values, -1)
    return out[names]


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = 0,
                id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write payload and index below ``path``.

    Documents are dealt by ranges of (id, text hash), so one id in a third of the rows is split, and
    sorted by id inside a shard; a null id comes first, a null text is empty. Rows with the same id stay next
    to each other; the index leads to the first one and counts them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(_writer(tokenizer_file, end_id), PAYLOAD).write.option("compression", "none").parquet(f"{path}/payload")
    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    each = payload.select("shard", "block", F.posexplode("doc_ids").alias("place", "key"))
    first = each.groupBy("key").agg(F.min(F.struct("shard", "block", "place")).alias("at"), F.count(F.lit(1)).alias("copies"))
    n = payload.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()[0]
    hashed = first.select(*_key_hashes(F.col("key")), "at.*", "copies").withColumn("place", F.col("place").cast("bigint"))
    hashed = hashed.withColumn("bucket", F.pmod("h1", F.lit(max(1, -(-n // BUCKET_KEYS)))).cast("bigint"))
    hashed.groupBy("bucket").applyInPandas(_build, INDEX).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``base``, the keys in earlier buckets, from sums over groups of 1024 buckets."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index").withColumn("part", F.floor(F.col("bucket") / 1024))
    parts = index.groupBy("part").agg(F.sum("n_keys").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_keys").over(Window.partitionBy("part").orderBy("bucket")) - F.col("n_keys")
    return index.withColumn("inside", inside).join(before, "part").withColumn("base", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def look_up(spark: SparkSession, path: str, keys: Column, frame: DataFrame) -> DataFrame:
    """(key, found, slot, shard, block, place, copies) of each distinct key of ``frame``.

    One hash and one fingerprint comparison per key; a key that was never stored is found with
    probability 2^-32. Slots are 0 .. number of keys - 1, each used once.
    """
    index = read_index(spark, path)
    n = index.agg(F.coalesce(F.max("bucket"), F.lit(0))).first()[0] + 1
    total = spark.read.schema(PAYLOAD).parquet(f"{path}/payload").agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()[0]
    n = max(n, 1, -(-total // BUCKET_KEYS))
    asked = frame.select(keys.cast("bigint").alias("key")).distinct().select("key", *_key_hashes(F.col("key")))
    asked = asked.withColumn("bucket", F.pmod("h1", F.lit(n)).cast("bigint"))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        _look_up, "key bigint, found boolean, slot bigint, shard bigint, block bigint, place bigint, copies bigint")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for b in batches:
        for row in b.to_pylist():
            ids = np.frombuffer(row["ids"], "<u4" if row["wide"] else "<u2").astype("<u4")
            lens = np.array(row["lens"], np.int64)
            ends = np.cumsum(lens)
            n = len(lens)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), row["lens"])]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["shard"], np.int64)), pa.array(np.full(n, row["block"], np.int64)),
                pa.array(np.arange(n)), pa.array(row["first"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "block", "place", "start_in_shard", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, block, place, start, n_tokens, ids_crc32) of every stored document, from the payload."""
    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    sizes = payload.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per shard
    starts = sizes.select(F.col("shard").cast("bigint").alias("shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    docs = payload.select("shard", "block", "first", "wide", "doc_ids", "lens", "ids").mapInArrow(
        _reader, "doc_id bigint, shard bigint, block bigint, place bigint, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts, "shard").select("doc_id", "shard", "block", "place", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def stored_documents(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """read_store() for the ids in column doc_id of ``ids``, found through the index: a document is
    returned only at or after the place that the index names for its id. Adds ``slot``."""
    at = look_up(spark, path, F.col("doc_id"), ids).where("found").select(
        "key", "slot", F.struct("shard", "block", "place").alias("from_place"))
    rows = read_store(spark, path)
    return rows.join(at, F.col("doc_id").eqNullSafe(F.col("key")) & (F.struct("shard", "block", "place") >= F.col("from_place"))).select(*rows.columns, "slot")
