"""The trie of conversation prefixes, from vertical bitmaps.

Conversations are cut into shards of consecutive ids. In a shard every (position, turn) has a bitset
of the conversations that have this turn there. Depth first, the bitset of a prefix is intersected
with the postings of the next position: each intersection that is not empty is a child, its popcount the
number of members, and the members without a next turn are the end list of the node. Nodes of different shards
that stand for the same prefix have the same 128-bit key (a hash of the parent's key and the turn) and are
brought together by it. Sums over subtrees are taken within the shards, where every node that several
shards share counts in the shard of its smallest member only, and added up by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gapmend.llm.common import staged, words

#: A shard ends at a conversation border after so many conversations or turns.
SHARD_CONVERSATIONS, SHARD_TURNS = 2048, 100_000

ROOT = b"\0" * 16
LOCAL = ("shard bigint, no bigint, parent_no bigint, last_no bigint, key binary, depth bigint, conv_id bigint, n bigint, n_words bigint, ends array<bigint>")
SUMS = ("key binary, first bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends array<bigint>")
NODES = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")


def turn_key(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, n_words) of conversations (conv_id, turn, role, text): pos counts from 0 in the order of turn.

    A null turn comes first, ties are ordered by their turn_key, and repeated rows are turns like others. Rows
    with a null conv_id belong to no conversation and are left out. Texts are not shuffled, only their hashes.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn_key(F.col("role"), F.col("text")).alias("turn_key"),
        F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")) - 1
    return rows.withColumn("pos", pos.cast("bigint")).select("conv_id", "pos", "turn_key", "n_words")


class _Shard:
    """The vertical bitmaps of a few conversations."""

    def __init__(self, ids: list[int], turns: list[list[tuple[bytes, int]]]):
        self.ids, self.turns = ids, turns
        self.postings = {}
        for bit, row in enumerate(turns):
            for pos, (turn, _) in enumerate(row):
                self.postings[pos, turn] = self.postings.get((pos, turn), 0) | 1 << bit
        # conversations that end at each depth
        self.ending = {}
        for bit, row in enumerate(turns):
            self.ending[len(row)] = self.ending.get(len(row), 0) | 1 << bit

    def nodes(self):
        """(no, parent_no, last_no, key, depth, conv_id, n, n_words, ends) of every node; no counts depth first."""
        out, open_nodes = [], [((1 << len(self.ids)) - 1, ROOT, 0, 0, -1)]
        ids, turns, postings = self.ids, self.turns, self.postings
        while open_nodes:
            members, key, depth, n_words, parent = open_nodes.pop()
            no = len(out)
            first = (members & -members).bit_length() - 1
            ended = members & self.ending.get(depth, 0)
            out.append([no, parent, no, key, depth, ids[first], members.bit_count(), n_words, _bits(ended, ids)])
            rest, children = members & ~ended, []
            while rest:
                turn, size = turns[(rest & -rest).bit_length() - 1][depth]
                child = rest & postings[depth, turn]
                rest &= ~child
                children.append((child, hashlib.blake2b(key + turn, digest_size=16).digest(), depth + 1, size, no))
            open_nodes += reversed(children)
        for node in reversed(out):  # a child comes after its parent
            if node[1] >= 0 and out[node[1]][2] < node[2]:
                out[node[1]][2] = node[2]
        return out


def _bits(members: int, ids: list[int]) -> list[int]:
    out = []
    while members:
        low = members & -members
        out.append(ids[low.bit_length() - 1])
        members ^= low
    return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conv_id and pos; a row with a null pos only says that the conversation exists."""
    from pyspark import TaskContext

    ids, turns, size, cut = [], [], 0, 0
    task = TaskContext.get().partitionId() << 32

    def flush():
        nonlocal ids, turns, size, cut
        rows = _Shard(ids, turns).nodes()
        shard, cut = task + cut, cut + 1
        ids, turns, size = [], [], 0
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                          names=["shard", "no", "parent_no", "last_no", "key", "depth", "conv_id", "n", "n_words", "ends"])

    for b in batches:
        for c, pos, turn, n in zip(*[b.column(k).to_pylist() for k in range(4)]):
            if not ids or ids[-1] != c:
                if len(ids) >= SHARD_CONVERSATIONS or size >= SHARD_TURNS:
                    yield flush()
                ids.append(c)
                turns.append([])
            if pos is not None:
                turns[-1].append((turn, n))
                size += 1
    if ids:
        yield flush()


def _subtrees(pdf):
    """Sums over the subtrees of one shard; a node counts at home only, in the shard of its smallest member."""
    import pandas as pd

    pdf = pdf.sort_values("no")
    home = (pdf.conv_id == pdf.top_conv).to_numpy()
    n, last = len(pdf), pdf.last_no.to_numpy()
    parent = pdf.parent_no.to_numpy()

    def below(values):
        run = np.r_[0, np.cumsum(values)]
        return run[last + 1] - run[:-1]

    children = np.bincount(parent[1:][home[1:]], minlength=n) if n > 1 else np.zeros(n, np.int64)
    top = pdf.top_conv.to_numpy()
    return pd.DataFrame({
        "key": pdf.key, "first": pdf.conv_id, "conv_id": top, "depth": pdf.depth, "parent_conv_id": pd.Series(np.where(parent < 0, 0, top[parent])).where(parent >= 0).astype("Int64").to_numpy(),
        "n_convs": pdf.total, "n_children": children, "n_leaves": below((home & (pdf.total == pdf.ended).to_numpy()).astype(np.int64)),
        "saved_tokens": below(np.where(home, (pdf.total - 1) * pdf.n_words, 0)), "ends": pdf.ends})


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key and smallest member; one row is kept per key, whose end lists are hashed as they pass."""
    state, done = None, []

    def flush():
        cols = list(zip(*[[*s[1], s[2].hexdigest()] for s in done]))
        out = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:7]], pa.array(cols[7], pa.string())], names=[f.split()[0] for f in NODES.split(", ")])
        done.clear()
        return out

    for b in batches:
        cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
        for key, _, conv, depth, parent, n, children, leaves, saved, ends in zip(*cols):
            if state is None or state[0] != key:
                if state is not None:
                    done.append(state)
                    if len(done) >= 5000:
                        yield flush()
                state = [key, [conv, depth, parent, n, 0, 0, 0], hashlib.sha256(), False]
            for k, v in ((4, children), (5, leaves), (6, saved)):
                state[1][k] += v
            if ends:
                state[2].update(("," if state[3] else "").encode() + ",".join(map(str, ends)).encode())
                state[3] = True
    if state is not None:
        done.append(state)
        yield flush()


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of the turn sequences of ``turns`` (conv_id, pos, turn_key, n_words).

    A row with a null pos only says that the conversation exists, so that one without turns is a member of the root;
    other columns are not read. Per node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless
    nodes below and including it), saved_tokens (words of its last turn times the members but one, summed over its subtree)
    and ends_sha256 (of the ascending, comma-joined ids of the members that end here). No conversations give no
    nodes, not even a root.

    Rows are dealt by ranges of conv_id. A task holds the turn keys of one shard, and of a single conversation however
    long, but no texts. A node that many shards share, as the root, has one row per shard; these are added up as they
    pass by in order, so that no list of members is ever held whole.
    """
    rows = staged(turns.select("conv_id", "pos", "turn_key", "n_words"), "turns")
    local = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_build, LOCAL)
    # one plan reads the nodes once; totals come with a window over the few rows of a key
    of_key = Window.partitionBy("key")
    known = local.withColumns({"total": F.sum("n").over(of_key), "ended": F.sum(F.size("ends").cast("bigint")).over(of_key), "top_conv": F.min("conv_id").over(of_key)})
    sums = known.groupBy("shard").applyInPandas(_subtrees, SUMS)
    return sums.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_combine, NODES)
