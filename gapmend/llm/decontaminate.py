"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gapmend.llm.common import let, staged, word_windows, words

SHINGLE = 5
#: Hamming radius; RADIUS + 1 blocks of bits guarantee that two fingerprints within it share a block.
RADIUS = 20
#: A benchmark table of at most so many rows is broadcast; a larger one is joined by shuffles.
SMALL_ROWS = 2_000_000

KEY = ["k1", "k2"]
WINDOW = [*KEY, "size", "start"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, doc): the key of a row is its id and a hash of its text, so rows that share both
    are judged alike. ``doc`` holds the whole row."""
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def shingles(text: Column) -> Column:
    """Hashes of the runs of five lower-cased words, in order; empty for fewer words."""
    hashed = F.transform(words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.xxhash64(w))
    return let(hashed, lambda h: word_windows(h, SHINGLE))


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def least_overlap(a: Column, b: Column) -> Column:
    """The least common count o of two multisets of a and b shingles with o / (a + b - o) >= 0.8."""
    return F.ceil(4 * (a + b) / 9).cast("int")


def fingerprint(shingle: Column, weight: Column) -> Column:
    """Aggregate: bit b is set if the shingles with that bit outweigh the others."""
    bits = [F.shiftleft((F.sum(F.when(F.shiftright(shingle, b).bitwiseAND(F.lit(1)) == 1, weight).otherwise(-weight)) > 0).cast("bigint"), b)
            for b in range(64)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def blocks(print_col: str) -> Column:
    """(number, bits) of the RADIUS + 1 blocks of a fingerprint."""
    edges = [round(64 * i / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(print_col), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(k1, k2, item_id, start, n_words, similarity): the best window of every document for every
    benchmark item that it holds, by similarity, then start (counted in words).

    A window has as many words as the item (all of a shorter document). Similarity compares the
    weighted five-word shingles of window and item, weights being their counts: sum of least counts /
    sum of greatest counts, at least 0.8. Steps:

    1. Positions of item shingles in the documents. A window can only reach 0.8 if it holds at least
       ``least_overlap`` of them, so only such starts go on; no match is lost here.
    2. A 64-bit SimHash of every such window and of every item. Fingerprints within RADIUS bits
       agree in one of RADIUS + 1 blocks, so a join on (item size, block, bits) finds all of them.
    3. The exact similarity of each pair that is left.

    Pairs whose fingerprints differ in more than RADIUS bits although they reach 0.8 are the
    method's only loss; at 0.8 the expected difference is about 10 bits. Items with fewer than five words have no shingle and
    are skipped, as are null texts. Each text of an item is searched by itself; an id with several
    texts has one row per document, for the best of them, and a null id is an id like others. Rows alike in
    id and text give one row. A shingle common to many documents only makes more rows of step 1.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), shingles(F.col(item_text_col)).alias("sh")).where(F.size("sh") > 0)
    # a number of its own for each text of an item: ids may be null, and texts may share one
    items = staged(items.dropDuplicates(["item_id", "sh"]).withColumn("item", F.monotonically_increasing_id()), "items")
    item_sh = items.select("item", F.size("sh").alias("s_item"), F.explode("sh").alias("s")).groupBy("item", "s_item", "s").agg(F.count(F.lit(1)).alias("c_item"))
    item_sh = staged(item_sh, "item-shingles")

    read = keyed(docs, id_col, text_col).select(*KEY, shingles(F.col("doc")[text_col]).alias("sh"))
    at = read.where(F.size("sh") > 0).select(*KEY, F.size("sh").alias("s_doc"), F.posexplode("sh").alias("p", "s"))
    hits = at.join(small(item_sh.select("s", "item", "s_item")), "s")
    found = hits.groupBy(*KEY, "item", "s_item").agg(F.array_sort(F.collect_set("p")).alias("h"), F.max("s_doc").alias("s_doc"))
    found = found.withColumn("s_win", F.least("s_item", "s_doc")).withColumn("m", least_overlap(F.col("s_item"), F.col("s_win")))
    found = found.where(F.size("h") >= F.col("m"))
    # a start between h[k + m - 1] - s_win + 1 and h[k] has h[k] .. h[k + m - 1] in its window
    spans = F.transform(F.sequence(F.lit(0), F.size("h") - F.col("m")), lambda k: F.struct(
        F.greatest(F.get("h", k + F.col("m") - 1) - F.col("s_win") + 1, F.lit(0)).alias("a"),
        F.least(F.get("h", k), F.col("s_doc") - F.col("s_win")).alias("b")))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda x: x["a"] <= x["b"]), lambda x: F.sequence(x["a"], x["b"]))))
    windows = staged(found.select(*KEY, F.col("s_item").alias("size"), F.col("s_win"), F.explode(starts).alias("start")).distinct(), "windows")

    mine = windows.select(*KEY).distinct()
    held = read.join(small(mine), KEY, "left_semi").dropDuplicates(KEY)
    w_sh = held.join(windows, KEY).select(*WINDOW, "s_win", F.explode(F.slice("sh", F.col("start") + 1, F.col("s_win"))).alias("s"))
    w_sh = staged(w_sh.groupBy(*WINDOW, "s_win", "s").agg(F.count(F.lit(1)).alias("c")), "window-shingles")

    w_fp = w_sh.groupBy(*WINDOW).agg(fingerprint(F.col("s"), F.col("c")).alias("fp"))
    i_fp = item_sh.groupBy("item", F.col("s_item").alias("size")).agg(fingerprint(F.col("s"), F.col("c_item")).alias("item_fp"))
    left = w_fp.select(*WINDOW, "fp", F.inline(blocks("fp")))
    right = i_fp.select("item", "size", "item_fp", F.inline(blocks("item_fp")))
    near = left.join(small(right), ["size", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select(*WINDOW, "item").distinct()

    both = near.join(w_sh, WINDOW).join(small(item_sh), ["item", "s"])
    scored = both.groupBy(*WINDOW, "s_win", "item").agg(F.sum(F.least("c", "c_item")).alias("o"))
    scored = scored.where(9 * F.col("o") >= 4 * (F.col("s_win") + F.col("size")))
    similarity = F.col("o") / (F.col("s_win") + F.col("size") - F.col("o"))
    scored = scored.join(small(items.select("item", "item_id")), "item")
    best = scored.groupBy(*KEY, "item_id").agg(F.max(F.struct(similarity.alias("similarity"), (-F.col("start")).alias("neg"), "s_win")).alias("b"))
    return best.select(*KEY, "item_id", (-F.col("b.neg")).cast("bigint").alias("start"), (F.col("b.s_win") + SHINGLE - 1).cast("bigint").alias("n_words"),
                       F.col("b.similarity").alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with its columns."""
    bad = staged(leaks(docs, benchmark, id_col, text_col, **options).select(*KEY).distinct(), "leaks")
    return keyed(docs, id_col, text_col).join(small(bad), KEY, "left_anti").select("doc.*")
