"""Runs against a search over every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmend.llm import runs as R
from gapmend.llm.queries import QUERIES


def every_run(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        k, n = 0, len(w) - q
        while k < n:
            j = k
            while j < n and w[j] == w[j + q]:
                j += 1
            if j > k and j - k + q >= max(6, 4 * q):
                best.setdefault((k, j - k + q), q)
            k = max(j, k + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2], r[1]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("seed", range(5))
def test_random_words(seed):
    rng = random.Random(seed)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            k, w = rng.choice([1, 2, 2, 3, 5]), []
            for _ in range(rng.randint(0, 4)):
                p = [rng.randrange(k + 1) for _ in range(rng.randint(1, 7))]
                w += (p * rng.randint(1, 9))[:rng.randint(1, 60)]
            docs.append(w)
        flat = np.array([x for d in docs for x in d], np.int64)
        assert R.find_runs(flat, np.array([len(d) for d in docs], np.int64)) == [every_run(d) for d in docs]


def test_many_occurrences_in_one_interval():
    rng = random.Random(9)
    w = [x for _ in range(4000) for x in (90, 91, 92, 93, 94, 95, 96, rng.randrange(3))]
    assert R.find_runs(np.array(w, np.int64), np.array([len(w)])) == [every_run(w)]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert R.find_runs(np.array(b * 5, np.int64), np.array([len(b) * 5])) == [every_run(b * 5)]


EDGE = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "a"), (5, "a " * 6), (6, "a " * 5), (7, "x y z\u0085 " * 4), (None, "b c " * 9), (8, "ab " * 70_000), (9, "p q r " * 4 + "t " + "q r p " * 4),
        (5, "a " * 6), (10, " ".join(f"w{i}" for i in range(20_000)) * 5)]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in EDGE], "doc_id bigint, text string, runs string, key int")
    got = R.periodic_runs(docs).withColumn("top", R.longest(F.col("runs"))).collect()
    assert len(got) == len(EDGE)
    for r, (key, text) in zip(got, EDGE):
        w = words_of(text)
        found = [tuple(x) for x in r.runs]
        assert (r.doc_id, r.n_words, r.collapsed) == (key, len(w), collapsed(w, found))
        if len(w) < 2000:
            assert found == every_run(w)
        assert (tuple(r.top) if r.top else None) == min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    by = {r.doc_id: [tuple(x) for x in r.runs] for r in got}
    assert by[8] == [(0, 70_000, 1)] and by[None] == [(0, 18, 2)] and by[10] == [(1, 99_994, 19_999)] and by[6] == []
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.periodic_runs(none).count() == 0


def test_whole_table(spark, sf):
    want = {}
    for key, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = words_of(text)
        n, h = len(w), zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        found = every_run(w)
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want[key] = (len(found), *top, top[0] is not None and 1000 * top[1] // top[2] or None,
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest())
    got = QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want) and any(v[0] for v in want.values())
