"""The trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gapmend.llm import prefix_trie as T
from gapmend.llm.queries import _rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def key(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def sequences(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    own = {c: [(r, t) for _, _, _, r, t in sorted(v)] for c, v in own.items()}
    if not rebuild:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[:h[c]] + own[c][h[c]:] for c in own}


def trie(seqs):
    nodes = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            nodes[tuple(seqs[c][:d])].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        kids = {q for q in below if len(q) == len(p) + 1}
        leaves = sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * len((q[-1][1]).split()) for q in below if q)
        ends = ",".join(str(c) for c in members if len(seqs[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, rebuild=True):
    frame = spark.createDataFrame(rows, SCHEMA)
    turns = _rebuilt(frame) if rebuild else T.ordered_turns(frame)
    return sorted([tuple(r) for r in T.prefix_trie(turns).collect()], key=repr)


def random_rows(seed, n=60, span=90):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(span), n):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "d  e\tf", ""])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = random_rows(seed)
    assert found(spark, rows) == trie(sequences(rows))


def test_many_shards_agree_with_one(spark, monkeypatch):
    """Shards of a few conversations, made by the function that the tasks run."""
    rows = random_rows(7, 80)
    seqs = sequences(rows, rebuild=False)
    one = T._Shard(sorted(seqs), [[(key(*t).encode(), len(t[1].split())) for t in seqs[c]] for c in sorted(seqs)]).nodes()
    for node in one:
        assert node[2] == max([n[0] for n in one if n[0] >= node[0] and (n[0] == node[0] or _under(one, n, node))])
    assert len(one) == len(trie(seqs))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(spark, rows, rebuild=False) == trie(seqs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _under(nodes, node, top):
    while node[1] >= 0:
        node = nodes[node[1]]
        if node[0] == top[0]:
            return True
    return False


def test_edge_cases(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (2, 0, None, ""), (2, None, "", None), (None, 0, "user", "lost"), (40, 0, "user", "x " * 50_000), (40, 1, "a", "1:b"),
            (47, 0, "user", "x " * 50_000), (300, 5, "user", "only"), (307, 0, "u", "t"), (60, 3, "user", "x"), (60, 3, "tool", "x"), (-3, 0, "user", "n"), (-3, 1, "user", "m")]
    assert found(spark, rows, rebuild=False) == trie(sequences(rows, rebuild=False))
    positive = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(spark, positive) == trie(sequences(positive))
    assert found(spark, []) == [] and found(spark, [(None, 0, "a", "b")]) == []


def test_only_turnless_conversations(spark):
    """h >= number of own turns and no base: members of the root alone."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert found(spark, [(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_one_conversation_in_a_third_of_all_conversations_and_a_long_one(spark):
    same = [(1000 + c, t, "user", f"same {t}") for c in range(3000) for t in range(3)]
    long = [(5, t, "user", f"turn {t}") for t in range(3000)]
    got = found(spark, same + long, rebuild=False)
    deep = {r[1]: r for r in got if r[0] == 1000}
    assert len(got) == 3001 + 3 and deep[3][3] == 3000 and deep[3][7] == hashlib.sha256(",".join(str(1000 + c) for c in range(3000)).encode()).hexdigest()
    root = next(r for r in got if r[1] == 0)
    assert root[:6] == (5, 0, None, 3001, 2, 2) and root[6] == 2999 * 2 * 3


def test_extra_columns(spark):
    rows = random_rows(1, 10)
    from pyspark.sql import functions as F
    frame = T.ordered_turns(spark.createDataFrame(rows, SCHEMA)).withColumns({"shard": F.lit("x"), "key": F.lit(1), "n": F.lit(2), "ends": F.lit(0)})
    assert sorted([tuple(r) for r in T.prefix_trie(frame).collect()], key=repr) == trie(sequences(rows, rebuild=False))
