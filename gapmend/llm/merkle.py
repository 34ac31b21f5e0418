"""Fixity audit of WARC replicas by Merkle trees (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from gapmend.llm.common import staged

FANOUT = 16
#: Slots of a shard; a power of FANOUT.
SHARD = FANOUT ** 3


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The record's text; its bytes are UTF-8. Null url and html are empty, a null id is written as such."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(level 0) one row per id: page_id, shard, node, n_records, n_bytes, digest.

    A shard is a range of SHARD ids and a leaf's place in it is fixed by the id, so a lost
    record shifts no other one. Records with the same id share a leaf: its digest covers their number
    and the sums of their hashes' parts, which need no order and combine before the shuffle, however
    many there are. Records without an id share the leaf 0 of shard NO_ID.
    """
    record = warc_record(F.col(id_col), F.col(url_col), F.col(html_col))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.octet_length(record).cast("bigint").alias("b"), F.sha2(record, 256).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(5)]
    slot = F.coalesce(F.pmod(F.col("page_id"), F.lit(SHARD)).cast("bigint"), F.lit(SHARD).cast("bigint"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("b").alias("n_bytes"), *parts).select(
        "page_id", F.coalesce(F.floor((F.col("page_id") - slot) / SHARD), F.lit(0)).cast("bigint").alias("shard"), slot.alias("node"),
        "n_records", "n_bytes", F.sha2(F.concat_ws(":", "n_records", *[f"s{k}" for k in range(5)]), 256).alias("digest"))


def above(shard: Column, level: int, base: int) -> Column:
    """The number, on the next level, of the node that gathers a shard-level node."""
    return F.floor((shard - (base if level == 3 else 0)) / FANOUT).cast("bigint")


def parents(nodes: DataFrame, level: int, base: int) -> DataFrame:
    """The next level: a node's digest hashes its at most FANOUT children in order.

    Up to three levels lie inside a shard; above them shards are gathered by number, counted from ``base``.
    """
    place = "node" if level < 3 else "shard"
    shard = F.col("shard") if level < 3 else above(F.col("at"), level, base).alias("shard")
    node = F.floor(F.col("at") / FANOUT).cast("bigint") if level < 3 else F.lit(0).cast("bigint")
    kids = F.array_sort(F.collect_list(F.struct("at", "digest")))
    return nodes.withColumnRenamed(place, "at").select("at", "digest", shard, node.alias("node")).groupBy("shard", "node").agg(kids.alias("kids")).select(
        "shard", "node", F.sha2(F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["at"], k["digest"])), "|"), 256).alias("digest"))


def audit(reference: DataFrame, replica: DataFrame, **columns) -> DataFrame:
    """One row per id of either replica: (page_id, shard, record_offset, n_bytes, n_records, digest, status).

    Offsets are bytes before the id's records inside its shard of the reference. Both trees are built
    level by level, each level written once; then the roots are compared and only the
    children of differing nodes are looked at, down to the leaves. ``status`` is 'ok', 'changed',
    'missing' (only in the reference) or 'extra' (only in the replica, described by its own values and
    a null offset). Equal roots end the search at once. Empty tables give no rows.
    """
    levels = [[staged(leaves(x, **columns), "leaves")] for x in (reference, replica)]
    lo, hi = levels[0][0].unionByName(levels[1][0]).agg(F.min("shard"), F.max("shard")).first()
    level, base = 0, lo
    while lo is not None and (level < 3 or lo != hi):
        for side in levels:
            side.append(staged(parents(side[-1], level, base), f"level{level + 1}"))
        if level >= 3:
            lo, hi = 0, (hi - (base if level == 3 else 0)) // FANOUT
        level += 1

    def differing(a, b):
        both = a.select("shard", "node", F.col("digest").alias("a")).join(b.select("shard", "node", F.col("digest").alias("b")), ["shard", "node"], "full")
        return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("shard", "node")

    bad = differing(levels[0][level], levels[1][level])
    for k in range(level - 1, -1, -1):
        up = ([F.col("shard").alias("up_shard"), F.floor(F.col("node") / FANOUT).cast("bigint").alias("up_node")] if k < 3 else
              [above(F.col("shard"), k, base).alias("up_shard"), F.lit(0).cast("bigint").alias("up_node")])
        marked = staged(bad.select(F.col("shard").alias("up_shard"), F.col("node").alias("up_node")), f"bad{k + 1}")
        below = [s[k].select("shard", "node", "digest", *up).join(marked, ["up_shard", "up_node"], "left_semi") for s in levels]
        bad = differing(*below)
    a, b = levels[0][0], levels[1][0]
    order = Window.partitionBy("shard").orderBy("node")
    placed = a.withColumn("record_offset", F.sum("n_bytes").over(order) - F.col("n_bytes"))
    have = b.select("shard", "node", F.lit(True).alias("there"))
    bad = staged(bad.withColumn("bad", F.lit(True)), "bad")
    known = placed.join(bad, ["shard", "node"], "left").join(have, ["shard", "node"], "left")
    status = F.when(F.col("bad").isNull(), "ok").when(F.col("there").isNull(), "missing").otherwise("changed")
    cols = ["page_id", "shard", "record_offset", "n_bytes", "n_records", "digest", "status"]
    extra = b.join(bad, ["shard", "node"]).join(a.select("shard", "node"), ["shard", "node"], "left_anti")
    return known.withColumn("status", status).select(cols).unionByName(
        extra.select("page_id", "shard", F.lit(None).cast("bigint").alias("record_offset"), "n_bytes", "n_records", "digest", F.lit("extra").alias("status")))
