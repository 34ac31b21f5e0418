"""The Jaccard join on one large group of near copies that all hold a common passage."""

import random

from gapmend.llm import jaccard_join


def _shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def _components(texts):
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for j in range(len(sets)):
        for i in range(j):
            o = len(sets[i] & sets[j])
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(300):  # from links to all down to links to none
        w = list(base)
        for p in rng.sample(range(150), i % 9):
            w[p] = f"e{i}x{p}"
        texts.append(" ".join(w))
    texts += [" ".join([*base[:9], *[f"o{i}x{j}" for j in range(i % 40)]]) for i in range(100)]
    tried = []

    def counted(pairs, sets, run=jaccard_join._distances):
        tried.append(pairs.count())
        return run(pairs, sets)
    monkeypatch.setattr(jaccard_join, "_distances", counted)
    monkeypatch.setattr(jaccard_join, "DIRECT_PAIRS", 1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _components(texts)
    print("pairs", tried)
    assert sum(tried) < 10 * len(texts)  # 400 texts make 79,800 pairs


def test_common_keys_of_linked_sets(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    frequent = np.sort(rng.integers(0, 1 << 62, 200).astype(np.uint64))
    for n in [1, 2, 3, 4, 5, 7, 9, 12, 19, 20, 31, 40, 79, 80, 123, 400]:
        for _ in range(30):
            a = np.unique(np.r_[rng.integers(0, 1 << 62, n).astype(np.uint64)[:n - min(n, 60) // 2], rng.choice(frequent, min(n, 60) // 2)])
            drop = rng.integers(0, max(1, len(a) // 5 + 1))
            b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 62, 3).astype(np.uint64)[:rng.integers(0, 3)]])
            o = len(np.intersect1d(a, b))
            if not len(b) or 100 * o < 80 * (len(a) + len(b) - o):
                continue
            shared = np.intersect1d(jaccard_join.prefix(a, frequent)[0], jaccard_join.prefix(b, frequent)[0])
            assert len(shared) >= jaccard_join.common(min(len(a), len(b)))
            ends = sorted([(jaccard_join.reach(a, frequent), a, b), (jaccard_join.reach(b, frequent), b, a)], key=lambda x: x[0])
            _, first, other = ends[0]
            alone = len(np.setdiff1d(jaccard_join.prefix(first, frequent)[0], jaccard_join.prefix(other, frequent)[0]))
            assert len(a) + len(b) <= 2.25 * (len(first) - alone)


def test_keys_are_made_for_few_texts_at_a_time():
    """A long Arrow batch leaves as several, each class once; tables of other operators are forgotten."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from gapmend.llm import jaccard_join as J
    from gapmend.llm.common import worker_cache

    worker_cache("another")["table"] = 1
    texts = [" ".join(f"w{i % 2500}_{j}" for j in range(40)) for i in range(5000)]
    out = list(J._keys(SimpleNamespace(value=np.zeros(0, np.uint64)), 16)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    classes = [set(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in b.column(2)]).tolist()) for b in out]
    assert len(classes) > 1 and max(map(len, classes)) <= 1000
    assert sum(map(len, classes)) == len(set().union(*classes)) == 2500
    assert worker_cache("another") == {}


def test_texts_travel_in_small_arrow_batches(spark, monkeypatch):
    from gapmend.llm import jaccard_join as J

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([b.num_rows] * b.num_rows, pa.int64()), pa.array([0] * b.num_rows, pa.int64())], names=["doc_id", "t", "k", "n"])
    monkeypatch.setattr(J, "_heads", sizes)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 5000, 1, 1).selectExpr("id AS doc_id", "'a b' AS text")
    _, empty = J.classed(docs, "doc_id", "text")
    assert empty.agg({"k": "max"}).first()[0] <= J.TEXTS and empty.count() == 5000
    assert spark.conf.get(key) == before
