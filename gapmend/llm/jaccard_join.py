"""Exact Jaccard similarity join of documents in metric space, by pivots and distance windows.

Documents with equal shingle sets form a class, and all work is done on classes. The first
shingles of a set, in an order common to all, are its region keys: two sets with similarity 0.8 or more share
several, so every link lies inside a region. In each region the members' distances to its pivot are
computed; what lies within 0.2 of the pivot is linked to it. Regions whose members are not
all in one component yet go on: by the triangle inequality two members can only be linked if
their distances to a common pivot differ by at most 0.2, so only such windows are joined, directly if few
pairs remain, else around further pivots. Profiles, distances to fixed pivots, rule out most other pairs
before whole sets are compared.

The result is the connected components only: links inside a component are tested no further than
connectivity needs, so neither all linked pairs nor numbers of links per document can be taken from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from gapmend.llm.common import arrow_rows, drop_worker_caches, staged
from gapmend.llm.components import connected

SHINGLE = 5
SIMILAR, OUT_OF = 80, 100
#: Bytes of text hashed together.
CHUNK_BYTES = 1 << 19
#: Texts whose shingles a task holds at a time, and keys of classes that it remembers.
TEXTS = 1000
SEEN = 50_000
#: Region keys that two linked sets have in common at least: one for FEW shingles up to COMMON, then one for MANY.
COMMON, FEW, MANY = 8, 4, 10
#: Shingles per task of the search for region keys that two classes share.
KEYS_PER_BUCKET = 500_000
#: Documents looked at to find frequent shingles, which come last in the order; it has no influence on the result.
ORDER_SAMPLE = 10_000
FREQUENT_IN_SAMPLE = 3
MAX_FREQUENT = 500_000
#: Buckets over which the keys of frequent shingles are spread.
SPREAD = 64
#: Parts of the shingle universe in a profile.
PARTS = 256
#: New pivots of each kind in a region in the second round; each further one doubles them.
PIVOTS = 32
#: Regions are joined directly when at most so many pairs per class remain.
DIRECT_PAIRS = 20
#: Profiles (280 bytes each) of at most so many classes are broadcast after they have been counted.
SMALL_PROFILES = 100_000
#: A side of at most so many rows is broadcast after it has been counted.
SMALL_ROWS = 1_000_000

NO_ID = (1 << 63) - 1
POSTING = "token bigint, k bigint, n int"


@lru_cache(maxsize=1)
def _tables(size: int):
    """Byte values (A-Z like a-z), blanks, and powers of an odd number and of its inverse modulo 2^64."""
    rng = np.random.default_rng(20_240_607)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    p = 0x9E3779B97F4A7C15
    power, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (p, pow(p, -1, 1 << 64)))
    return value, blank, power, inverse


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _chunk_sets(raws: list[bytes]) -> list[np.ndarray]:
    buf = np.frombuffer(b" ".join([b"", *raws, b""]), np.uint8)
    size = CHUNK_BYTES
    while size < len(buf):
        size *= 2
    value, blank, power, inverse = _tables(size)
    # sums of byte value times power; a word's hash is a difference of two, moved to power 0
    sums = np.cumsum(value[buf] * power[:len(buf)])
    gap = blank[buf]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    w = _mixed((sums[ends] - sums[starts - 1]) * inverse[starts] + (ends - starts).astype(np.uint64))
    h = w[:max(0, len(w) - SHINGLE + 1)].copy()
    for i in range(1, SHINGLE):
        h = _mixed(h) + w[i:len(w) - SHINGLE + 1 + i]
    h = _mixed(h)
    first = np.searchsorted(starts, np.r_[0, np.cumsum([len(r) + 1 for r in raws])] + 1)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a:b - SHINGLE + 1]))
        elif b > a:
            x = w[a:a + 1] + np.uint64(b - a)
            for i in range(a + 1, b):
                x = _mixed(x) + w[i:i + 1]
            out.append(_mixed(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's five-word shingles; A-Z is lower-cased. A
    shorter text is one shingle, one without words none."""
    out, raws, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if raws and size + len(raw) > CHUNK_BYTES - 2 * len(raws) - 4:
            out += _chunk_sets(raws)
            raws, size = [], 0
        raws.append(raw)
        size += len(raw)
    return out + (_chunk_sets(raws) if raws else [])


def class_key(s: np.ndarray) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(s.tobytes(), seed=len(s))
    return x - (1 << 64) if x >> 63 else x


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_worker_caches()
    for b in batches:
        each = [(class_key(s), len(s)) for s in _in_parts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array([x[i] for x in each], pa.int64()) for i in (0, 1)]], names=["doc_id", "t", "k", "n"])


def _sample_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_worker_caches()
    for b in _slices(batches):
        sets = shingle_sets(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)),
            pa.array(np.repeat(np.array([class_key(s) for s in sets], np.int64), [len(s) for s in sets]))], names=["token", "k"])


def common(n: int) -> int:
    """How many region keys a set of n shingles gives to share. It grows with n, so that a few shingles met by chance do
    not make a long text a candidate, and is small for short ones, whose frequent shingles stay out of their keys."""
    return max(1, min(COMMON, n // FEW), n // MANY)


def prefix(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The region keys of a set: its first n - ceil(0.8 n) + common(n) shingles, rare ones first; and
    which of them are frequent. Two sets with similarity 0.8 share common(m) of them, m being the smaller size: the c-th
    shingle they share is followed by all but c of 0.8 n shared ones at least."""
    size = len(s) - -(-SIMILAR * len(s) // OUT_OF) + common(len(s)) if len(s) else 0
    if not len(frequent):
        return s[:size], np.zeros(size, bool)
    hot = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    order = np.argsort(hot, kind="stable")[:size]
    return s[order], hot[order]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            yield b.slice(i, TEXTS)


def _in_parts(texts) -> Iterator[np.ndarray]:
    for i in range(0, len(texts), 500):
        yield from shingle_sets(texts.slice(i, 500).to_pylist())


def _keys(frequent, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_list = frequent.value
        drop_worker_caches()
        seen = set()
        for b in _slices(batches):
            tokens, hots, keys, sizes = [], [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for s in _in_parts(b.column(0)):
                k = class_key(s)
                if len(s) and k not in seen:
                    seen.add(k)
                    p, hot = prefix(s, hot_list)
                    tokens.append(p)
                    hots.append(hot)
                    keys.append(np.full(len(p), k, np.int64))
                    sizes.append(np.full(len(p), len(s), np.int32))
            if not tokens:
                continue
            t, h, k, n = map(np.concatenate, (tokens, hots, keys, sizes))
            bucket = np.where(h, buckets + (k.view(np.uint64) % np.uint64(SPREAD)).astype(np.int64), (t % np.uint64(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            at, first = np.unique(bucket[order], return_index=True)
            parts = np.split(order, first[1:])
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (t, k, n)]],
                                             names=["bucket", "tokens", "ks", "ns"])
    return run


def _shared(buckets: int):
    def run(pdf):
        import pandas as pd

        t = np.frombuffer(b"".join(pdf.tokens), np.uint64)
        k, n = np.frombuffer(b"".join(pdf.ks), np.int64), np.frombuffer(b"".join(pdf.ns), np.int32)
        order = np.lexsort((k, n, t))
        t, k, n = t[order], k[order], n[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])]
        t, k, n = t[new], k[new], n[new]
        if pdf.bucket.iloc[0] < buckets and len(t):
            # sorted by size inside a region: a member stays if a neighbour's size allows a link
            ok = (t[1:] == t[:-1]) & (OUT_OF * n[:-1].astype(np.int64) >= SIMILAR * n[1:].astype(np.int64))
            keep = np.r_[ok, False] | np.r_[False, ok]
            t, k, n = t[keep], k[keep], n[keep]
        return pd.DataFrame({"token": t.view(np.int64), "k": k, "n": n})
    return run


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def profile(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of PARTS parts of the universe, 127 at most: the set's distances
    to PARTS fixed pivots, up to a constant. The sum of differences of two profiles is at most
    the size of the sets' symmetric difference."""
    return np.minimum(np.bincount((s >> np.uint64(7)).astype(np.int64) % PARTS, minlength=PARTS), 127).astype(np.int8)


def reach(s: np.ndarray, frequent: np.ndarray) -> int:
    """The place of a set's last region key in the common order, as a number."""
    p, hot = prefix(s, frequent)
    return ((int(hot[-1]) << 63) | int(p[-1]) >> 1) - (1 << 63) if len(p) else 0


def _sets(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_list = frequent.value
        for b in _slices(batches):
            sets = shingle_sets(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f(s) for s in sets], pa.int64()) for f in (class_key, lambda s: reach(s, hot_list))], _lists(sets),
                                              pa.array([profile(s) for s in sets], pa.list_(pa.int8()))], names=["first_id", "k", "last", "s", "q"])
    return run


def _small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _asked(n: Column) -> Column:
    """How many region keys a set of n shingles has in common with any partner: ``common`` of the least
    size that a partner can have."""
    least = F.floor((n * SIMILAR + OUT_OF - 1) / OUT_OF)
    return F.greatest(F.lit(1), F.least(F.lit(COMMON), F.floor(least / FEW)), F.floor(least / MANY))


def _key_count(n: Column) -> Column:
    """The number of region keys of a set of n shingles, as in ``prefix``."""
    return F.floor(n * (OUT_OF - SIMILAR) / OUT_OF) + F.greatest(F.lit(1), F.least(F.lit(COMMON), F.floor(n / FEW)), F.floor(n / MANY))


def _fits(a: str, b: str):
    """Whether two classes can have similarity 0.8 by their sizes and keys.

    A pair needs nx + ny <= 2.25 * intersection. Of the one whose keys end first in the common order, every
    shared shingle up to there is a key of the other one too, so its keys without a partner (``alone``) are outside the intersection.
    """
    n = {c: F.col("n" + c) for c in (a, b)}
    def room(c):
        return F.col("room" + c)
    sizes = OUT_OF * F.least(*n.values()) >= SIMILAR * F.greatest(*n.values())
    return sizes & (n[a] + n[b] <= F.when(F.col("last" + a) < F.col("last" + b), room(a)).when(F.col("last" + b) < F.col("last" + a), room(b)).otherwise(F.least(room(a), room(b))))


def _partnered(full: DataFrame) -> DataFrame:
    """The members (token, k, n, last, room, ...) that may have a partner in their region, with ``able`` and ``least``.

    A member goes if even the least one is too large for its own room and none whose keys end before its own has room.
    """
    least = full.groupBy("token").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", "least")
    full = full.drop("least", "able").join(least, "token")
    able = full.where("n + least <= room").groupBy("token").agg(F.min("last").alias("able"))
    return full.join(able, "token").where("n + least <= room OR able < last")


def _roomed(region: DataFrame, ends: DataFrame) -> DataFrame:
    """(token, k, n, last, room) of the members (token, k) that may have a partner in their region.

    ``room`` bounds the sizes of a linked pair together: 2.25 times the size without the keys that no region holds any
    more. A class goes if it is left in fewer regions than a link asks for. What goes leaves others alone, hence the rounds.
    """
    share = (OUT_OF + SIMILAR) / SIMILAR
    for _ in range(2):
        kept = region.groupBy("k").agg(F.count(F.lit(1)).alias("c")).join(_small(ends), "k").where(F.col("c") >= _asked(F.col("n")))
        kept = staged(kept.select("k", "n", "last", F.floor((F.col("n") - _key_count(F.col("n")) + F.col("c")) * share).alias("room")), "kept")
        full = staged(region.select("token", "k").join(_small(kept), "k"), "roomed")
        region = staged(_partnered(full).select("token", "k", "n", "last", "room"), "regions")
    return region


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, d, linked) of pairs (x, y): the integer test of the contract, and the exact Jaccard distance.

    Profiles go first: they are small, and a pair whose profiles differ by more than a ninth of both
    sizes together cannot reach 0.8; its d stays null. Whole sets meet for the other pairs only.
    """
    def side(c, *cols):
        return sets.select(F.col("k").alias(c), *[F.col(v).alias(v + c) for v in cols])
    apart = F.aggregate(F.zip_with("qx", "qy", lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda t, v: t + v)
    tried = pairs.join(_small(side("x", "n", "q"), SMALL_PROFILES), "x").join(_small(side("y", "n", "q"), SMALL_PROFILES), "y").select(
        "x", "y", ((OUT_OF + SIMILAR) * apart <= (OUT_OF - SIMILAR) * (F.col("nx") + F.col("ny"))).alias("near"))
    tried = staged(tried, "tried")
    got = tried.where("near").select("x", "y").join(side("x", "n", "s"), "x").join(side("y", "n", "s"), "y").select(
        "x", "y", "nx", "ny", F.size(F.array_intersect("sx", "sy")).alias("o"))
    union = F.col("nx") + F.col("ny") - F.col("o")
    exact = got.select("x", "y", (1 - F.col("o") / union).alias("d"), (OUT_OF * F.col("o") >= SIMILAR * union).alias("linked"))
    return exact.unionAll(tried.where("NOT near").select("x", "y", F.lit(None).cast("double").alias("d"), F.lit(False).alias("linked")))


def _windowed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` without those that the triangle inequality rules out: distances of x and y to a
    common pivot that differ by more than 0.2. One pivot of each, the one with the least number, is tried."""
    ends = known.select(F.col("x").alias("k"), F.col("y").alias("p"), "d").unionAll(known.select(F.col("y").alias("k"), F.col("x").alias("p"), "d"))
    one = staged(ends.where("d IS NOT NULL").groupBy("k").agg(F.min(F.struct("p", "d")).alias("w")).select("k", "w.p", "w.d"), "windows")
    x = one.select(F.col("k").alias("x"), F.col("p").alias("px"), F.col("d").alias("dx"))
    y = one.select(F.col("k").alias("y"), F.col("p").alias("py"), F.col("d").alias("dy"))
    both = pairs.join(x, "x", "left").join(y, "y", "left")
    far = (F.col("px") == F.col("py")) & (F.abs(F.col("dx") - F.col("dy")) > 0.2 + 1e-9)
    return both.where(~F.coalesce(far, F.lit(False))).select("x", "y")


def linked_classes(docs: DataFrame, heads: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(node, root): the components of linked classes; classes without links are absent."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    n_docs, n_shingles = heads.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = min(1.0, ORDER_SAMPLE / max(1, n_docs))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    tokens = sample.mapInArrow(_sample_tokens, "token bigint, k bigint").distinct().groupBy("token").count().where(F.col("count") >= FREQUENT_IN_SAMPLE)
    frequent = np.array([r[0] for r in tokens.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).select("token").collect()], np.int64)
    frequent = spark.sparkContext.broadcast(np.sort(frequent.view(np.uint64)))
    buckets = int(max(16, n_shingles * 0.2 // KEYS_PER_BUCKET))
    keyed = texts.mapInArrow(_keys(frequent, buckets), "bucket bigint, tokens binary, ks binary, ns binary")
    region = staged(keyed.groupBy("bucket").applyInPandas(_shared(buckets), POSTING), "regions")

    def enough(r):
        """Classes with as many shared keys as a link asks for."""
        return r.groupBy("k", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= _asked(F.col("n"))).select("k")

    for _ in range(2):
        region = region.join(_small(staged(enough(region), "enough")), "k", "left_semi")
        both = region.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
        region = staged(region.join(both, "token", "left_semi"), "regions")

    members = staged(region.select("k").distinct(), "members")
    chosen = heads.join(_small(members), "k", "left_semi").groupBy("k").agg(F.min("doc_id").alias("first_id"))
    chosen = staged(chosen.select("k", "first_id"), "chosen")
    # the first document of each member class; equal ids with other texts are sorted out by the class key
    ids = chosen.select(F.coalesce("first_id", F.lit(NO_ID)).alias("first_id"), "k")
    some = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("first_id"), F.col(text_col).alias("text"))
    some = some.join(_small(ids.select("first_id").distinct()), "first_id", "left_semi")
    sets = some.mapInArrow(_sets(frequent), "first_id bigint, k bigint, last bigint, s array<bigint>, q array<tinyint>").join(_small(ids), ["first_id", "k"], "left_semi")
    sets = sets.select("k", F.size("s").alias("n"), "last", "s", "q")
    if not heads.groupBy("doc_id", "k").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["k"])  # repeated rows
    sets = staged(sets, "sets")

    going = _roomed(region, sets.select("k", "n", "last"))
    known = component = None
    held = ["k", "n", "last", "room"]

    def side(c, *more):
        return ["token", F.col("k").alias(c), *[F.col(v).alias(v + c) for v in (*held[1:], *more)]]
    # the first pivot of a region is the member with the largest share of partnered keys, so that the regions of one group agree
    rank = F.struct(-F.col("room") / F.col("n"), "k")
    pivots = going.groupBy("token").agg(F.min(F.struct(rank.alias("r"), *held)).alias("p")).select("token", "p.*").select(*side("p"))
    rounds, more = 0, []
    while True:
        pivots = staged(pivots, "pivots")
        around = going.select(*side("k", *more)).join(pivots, "token").where((F.col("k") != F.col("p")) & _fits("k", "p"))
        if known is not None:
            around = around.where("ck <> cp")
        pairs = around.select(F.least("k", "p").alias("x"), F.greatest("k", "p").alias("y")).distinct()
        fresh = pairs if known is None else pairs.join(known.select("x", "y"), ["x", "y"], "left_anti")
        dist = staged(_distances(fresh, sets), "distances")
        known = dist if known is None else known.unionAll(dist)
        component = staged(connected(known.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))), "component")

        # a pivot has met all of its region and leaves it; a region with members of several components
        # goes on, its largest component is the main one
        rest = going.join(pivots.select("token", F.col("p").alias("k")), ["token", "k"], "left_anti")
        named = rest.select("token", *held).join(component.select(F.col("node").alias("k"), "root"), "k", "left").select("token", *held, F.coalesce("root", "k").alias("c"))
        parts = named.groupBy("token", "c").agg(F.count(F.lit(1)).alias("m"))
        mixed = parts.groupBy("token").agg(F.max(F.struct("m", "c")).alias("main"), F.sum("m").alias("m")).where("main.m < m")
        mixed = staged(mixed.select("token", F.col("main.c").alias("main")), "mixed")
        going = staged(named.join(mixed, "token").select("token", *held, "c", (F.col("c") != F.col("main")).alias("other")), "going")
        going = staged(_partnered(going), "partnered")
        sizes = going.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.count_if("other").alias("others"))
        todo = sizes.agg(F.coalesce(F.sum(F.col("m") * F.col("others")), F.lit(0))).first()[0]
        if not todo:
            return component
        if todo <= DIRECT_PAIRS * n_docs:
            break
        # the next pivots: members outside the main component; and those with room whose keys end first, as others have no room for more
        more = ["c"]
        place = F.row_number().over(Window.partitionBy("token").orderBy(rank))
        early = F.row_number().over(Window.partitionBy("token").orderBy("last", "k"))
        pivots = going.where("other").withColumn("place", place).unionByName(going.where("n + least <= room").withColumn("place", early))
        pivots = pivots.where(F.col("place") <= PIVOTS << rounds).select(*side("p", "c")).distinct()
        rounds += 1
    # a pair that no pivot has met shares all its keys here; each region counts it once
    a = going.where("other").select(*side("x", "c"))
    b = going.select(*side("y", "c"), F.col("other").alias("oy"))
    met = a.join(b, "token").where((F.col("cx") != F.col("cy")) & (~F.col("oy") | (F.col("x") < F.col("y"))) & _fits("x", "y"))
    pairs = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("c"), F.min(F.least("nx", "ny")).alias("n"))
    pairs = pairs.where(F.col("c") >= _asked(F.col("n"))).select("x", "y")
    pairs = staged(pairs.join(known.select("x", "y"), ["x", "y"], "left_anti"), "pairs")
    more = staged(_distances(_windowed(pairs, known), sets), "distances")
    return connected(component.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(
        more.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))))


def classed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, k, n, root) of documents with shingles, and those without (root null); t is a hash of the text."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"))
    with arrow_rows(docs.sparkSession, TEXTS):
        heads = staged(rows.mapInArrow(_heads, "doc_id bigint, t bigint, k bigint, n bigint"), "heads")
        linked = staged(linked_classes(docs, heads.where("n > 0"), text_col, id_col), "linked")
    full = heads.where("n > 0").join(linked.select(F.col("node").alias("k"), "root"), "k", "left")
    full = staged(full.select("doc_id", "t", "k", "n", F.coalesce("root", "k").alias("root")), "classed")
    return full, heads.where("n = 0")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k, n_shingles, component_id) of every row of ``docs``.

    Links, and the ids of components, are as the query op6 states them; ``k`` is the class of equal
    shingle sets, a 64-bit hash (as are shingles). Null and empty texts have no shingles and are linked with
    nothing. Rows with the same id are separate rows; null ids are never the least one
    unless alone. An empty table gives no rows.
    """
    full, empty = classed(docs, id_col, text_col)
    least = staged(full.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    out = full.join(least, "root").select("doc_id", "k", F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(empty.select("doc_id", "k", "n", "doc_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of linked documents the one with the least id (a null id
    is the last choice), then the least text hash; of rows equal in both, one. Rows without
    words all stay, as they are linked with nothing."""
    full, _ = classed(docs, id_col, text_col)
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("key")
    texts = staged(full.groupBy("root", key, "t").agg(F.count(F.lit(1)).alias("c")), "texts")
    first = staged(texts.groupBy("root").agg(F.min(F.struct("key", "t", "c")).alias("f")).select("root", "f.*"), "first")
    gone = texts.select("key", "t").exceptAll(first.select("key", "t"))
    twice = first.where("c > 1").select("key", "t")
    packed = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1)).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    stay = packed.join(_small(staged(gone, "gone")), ["key", "t"], "left_anti")
    if twice.isEmpty():
        return stay.select("doc.*")
    again = stay.join(_small(twice), ["key", "t"], "left_semi").dropDuplicates(["key", "t"])
    return stay.join(_small(twice), ["key", "t"], "left_anti").unionAll(again).select("doc.*")
