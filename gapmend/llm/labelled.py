"""Bounded samples of labelled documents for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3 (false for a null id)."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text"):
    """Texts to learn from, as a list of (doc_id, text, label, weight) on the driver.

    At most ``per_class`` labels of each class 0 and 1, those with the least md5 of their id among all
    rows that are not held out; ``weight`` is how many labels of the class each stands for. The
    bound keeps the sample small whatever the size of the tables. Repeated labels of an id count
    once, with the highest label; rows with a null id or label are not learned from; of documents that share
    an id at most 2 * per_class rows are taken in all. Null texts are empty.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    order = F.md5(F.col("key").cast("string"))
    chosen = known.where("label = 0").orderBy(order, "key").limit(per_class).unionAll(known.where("label = 1").orderBy(order, "key").limit(per_class))
    totals = dict(known.groupBy("label").count().collect())  # at most two rows
    # chosen has at most 2 * per_class rows
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    got = [tuple(r) for r in rows.orderBy(order, "key", F.md5("text")).limit(2 * per_class).collect()]
    n = {c: max(1, sum(1 for r in got if r[2] == c)) for c in (0, 1)}
    return [(*r, totals.get(r[2], 0) / n[r[2]]) for r in got]
