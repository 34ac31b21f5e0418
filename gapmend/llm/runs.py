"""Periodic runs of words, from maximal pairs of a suffix array.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Two
occurrences of a stretch of words, at i and i + d, are a maximal pair of length l if the words before them
differ and the words behind them differ. With l >= 3 * d the two overlap so far that the words from i to
i + d + l repeat with period d, and being maximal means that nothing extends them: such pairs are exactly the runs of
length l + d >= 4 * d, once for each multiple of the smallest period. Nothing has to be extended or compared again.

Maximal pairs come from the LCP-interval tree of the suffix array, bottom up: an interval keeps its occurrences in
order of position, those with the same word on their left form a class, and pairs are read off between
occurrences from different children and different classes at most l / 3 apart. Among occurrences that near only the
first of a chain can belong to another class than the rest, so class borders are found without a look at
the other members, and the work stays near the number of runs.

Only stretches that can hold a run are sorted: a run of length n consists, but for its last four words, of
starts of five-word windows that occur twice within n / 4 words.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Least length of a run, also in periods, and the words of a window that its suffixes share at least.
LEAST, TIMES, WINDOW = 6, 4, 5
#: Words of documents looked at together; a longer document is looked at alone.
TOGETHER = 200_000

FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def suffix_levels(x: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... items until all differ; equal ranks share these items.
    The last item must be unique."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.r_[True, x[order][1:] != x[order][:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, h = [rank], 1
    todo = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(todo):
        key = rank[todo] * (n + 1) + rank[todo + h]
        order = np.argsort(key, kind="stable")
        todo, key = todo[order], key[order]
        at = np.arange(len(todo))
        group = np.maximum.accumulate(np.where(np.r_[True, rank[todo][1:] != rank[todo][:-1]], at, 0))
        same = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        nxt = rank.copy()
        nxt[todo] = rank[todo] + same - group
        rank = nxt
        levels.append(rank)
        size = np.bincount(same, minlength=len(todo))[same]
        todo, h = todo[size > 1], 2 * h
    return levels


def common_prefixes(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and the length that each suffix shares with the one before it (0 for the first)."""
    sa = np.empty(len(levels[-1]), np.int64)
    sa[levels[-1]] = np.arange(len(sa))
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(i), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        same = (levels[t][i] == levels[t][j]) << t
        lcp, i, j = lcp + same, i + same, j + same
    return sa, np.r_[0, lcp]


def _close(length: int, children: list[list[int]], left: list[int], found: list) -> list[int]:
    """Maximal pairs between the children of an interval; returns its occurrences in order of position."""
    near = length // (TIMES - 1)
    if len(children) == 2 and len(children[0]) == len(children[1]) == 1:
        a, b = sorted((children[0][0], children[1][0]))
        if b - a <= near and left[a] != left[b]:
            found.append((a, b - a, length))
        return [a, b]
    big = max(range(len(children)), key=lambda k: len(children[k]))
    child = {p: k for k, c in enumerate(children) if k != big for p in c}
    new = sorted(child)
    every = children[big]
    if len(new) < 16:
        for p in new:
            insort(every, p)
    else:
        every = sorted(every + new)
    n = len(every)
    for p in new:
        mine, word = child[p], left[p]
        k = bisect_left(every, p - near)
        q = every[k]
        if q < p and left[q] != word and child.get(q, big) != mine:
            found.append((q, p - q, length))
        k = bisect_left(every, p, k) + 1
        if k < n and every[k] <= p + near and left[every[k]] != word:  # p is the first of a chain
            while k < n and every[k] <= p + near:
                q = every[k]
                if child.get(q, big) != mine:
                    found.append((p, q - p, length))
                k += 1
    return every


def maximal_pairs(sa: list[int], lcp: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(start, distance, length) of the maximal pairs with distance at most a third of length, from a stretch of
    the suffix array in which neighbours share a prefix; some may be listed twice."""
    found, stack, done = [], [], [sa[0]]
    for k in range(1, len(sa)):
        l = lcp[k]
        while stack and stack[-1][0] > l:
            length, children = stack.pop()
            children.append(done)
            done = _close(length, children, left, found)
        if stack and stack[-1][0] == l:
            stack[-1][1].append(done)
        else:
            stack.append((l, [done]))
        done = [sa[k]]
    while stack:
        length, children = stack.pop()
        children.append(done)
        done = _close(length, children, left, found)
    return found


def _stretches(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of window starts of the stretches that can hold a run."""
    n = len(codes)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.arange(n - WINDOW + 1)
    start = start[start + WINDOW <= ends[doc[: len(start)]]]
    h = doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        h = (h ^ codes[start + k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    gap = np.where(h[order][1:] == h[order][:-1], np.diff(start[order]), n)
    near = np.empty(len(start), np.int64)
    near[order] = np.minimum(np.r_[gap, n], np.r_[n, gap])
    twice = np.flatnonzero(near < n)
    if not len(twice):
        return twice, twice
    at, near = start[twice], near[twice]
    head = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    size = np.diff(np.r_[head, len(at)])
    can = np.minimum.reduceat(near, head) <= (size + WINDOW - 1) // TIMES
    return at[head][can], size[can]


def find_runs(codes: np.ndarray, lens: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period), by start and period, of documents whose numbered words follow each other."""
    out = [[] for _ in lens]
    ends = np.cumsum(lens)
    doc = np.repeat(np.arange(len(lens)), lens)
    first, size = _stretches(codes, doc, ends)
    if not len(first):
        return out
    # stretches one after the other, each with an end of its own; the same word in two stretches is two words
    length = size + WINDOW
    base = np.cumsum(length) - length
    part = np.repeat(np.arange(len(first)), length)
    place = np.arange(length.sum()) - base[part]
    last = place == length[part] - 1
    word = first[part] + place
    x = np.where(last, -1, codes[np.minimum(word, len(codes) - 1)]) + part * (int(codes.max()) + 2)
    levels = suffix_levels(x)
    sa, lcp = common_prefixes(levels)
    left = np.r_[-2, x[:-1]].tolist()
    deep = np.flatnonzero(lcp >= WINDOW)
    if not len(deep):
        return out
    for group in np.split(deep, np.flatnonzero(np.diff(deep) != 1) + 1):
        a, b = group[0] - 1, group[-1] + 1
        for i, d, l in maximal_pairs(sa[a:b].tolist(), lcp[a:b].tolist(), left):
            w = int(word[i])
            k = int(doc[w])
            out[k].append((w - int(ends[k] - lens[k]), l + d, d))
    for k, runs in enumerate(out):
        if runs:
            least = {}
            for s, n, d in runs:  # multiples of the smallest period give the same stretch
                if d < least.get((s, n), d + 1):
                    least[s, n] = d
            out[k] = sorted(((s, n, d) for (s, n), d in least.items()), key=lambda r: (r[0], r[2], r[1]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    return b" ".join([words[i] for i in keep.tolist()])


def _share(texts: list) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    # bytes.split() cuts at blank and \\x09-\\x0D, and at nothing else
    words = [(t or "").encode("utf-8").split() for t in texts]
    flat = list(chain.from_iterable(words))
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    return words, find_runs(codes, np.array([len(w) for w in words], np.int64))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("start", "length", "period")
    for b in batches:
        size = np.cumsum(np.r_[0, [len(t or "") // 6 for t in b.column(1).to_pylist()]])
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + TOGETHER, "right")) - 1)
            part = b.slice(i, j - i)
            words, runs = _share(part.column(1).to_pylist())
            flat = [r for rs in runs for r in rs]
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            rows = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, rows),
                pa.array([_collapsed(w, r).decode("utf-8") for w, r in zip(words, runs)], pa.string())], names=["key", "n_words", "runs", "collapsed"])
            i = j


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    ``runs`` lists (start, length, period), in words ``[^\\x20\\x09-\\x0D]+`` numbered from 0, of all runs
    of length >= max(6, 4 * period), by start and period; ``collapsed`` is the text of the words that no run
    contains after its first period, joined by one blank. A null or empty text has no words and
    no runs; long texts are searched whole, in one task; repeated rows and null ids are rows like others; other columns are not read;
    an empty table gives no rows. No shuffle.
    """
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_search, f"key {kind}, {FOUND}").withColumnRenamed("key", id_col)


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null without runs."""
    order = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(F.size(runs) > 0, F.struct((-order["s"]).alias("start"), order["n"].alias("length"), (-order["p"]).alias("period")))
