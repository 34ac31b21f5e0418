"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A larger mean is split into that many independent parts, so that exp(-mean) stays a normal number.
PART_MEAN = 500.0


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of seed and parts; the same on every engine and retry."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. mean + 12 sqrt(mean) + 30; what lies beyond is below 1e-15."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    grown = F.aggregate(F.sequence(F.lit(1), top), first, lambda a, k: F.struct(
        (a["p"] * mean / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c")))
    return grown["c"]


def target_rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """(mix_source, chars, rate, parts, cdf): how often a document of each source is to be repeated on average.

    A source's weight is taken from ``weights`` (0 if it is not listed) or is chars ** temperature.
    Rates keep the expected total of characters: rate = weight / sum(weights) * total / chars. A
    source without characters gets rate 1.
    """
    chars = F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint"))
    sizes = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source")).agg(chars.alias("chars"))
    if weights is None:
        w = F.pow(F.col("chars").cast("double"), F.lit(float(temperature)))
    else:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("mix_source")), F.lit(0.0))
    sizes = sizes.withColumn("w", w)
    all_w, all_chars = sizes.agg(F.sum("w"), F.sum("chars").cast("double")).first()
    rate = F.when(F.col("chars") > 0, F.col("w") / F.lit(all_w or 1.0) * F.lit(all_chars or 0.0) / F.col("chars")).otherwise(F.lit(1.0))
    rated = sizes.select("mix_source", "chars", rate.alias("rate"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN).cast("int")))
    return rated.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def replicated(docs: DataFrame, seed: str = "mix", weights: dict[str, float] | None = None, temperature: float = 0.5,
               source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, rate, copy, key) in a random global order: each document as often as its draw says.

    A document's count is the inverse of the Poisson distribution with its source's rate
    (:func:`target_rates`) at a uniform number that is a hash of seed and id; copies are numbered
    from 1, and the rows are sorted by ``key``, a hash of seed, id and copy. A document drawn 0
    times is absent: that is the method. Rows with the same id draw the same count. A null source counts
    as '', a null id as 'null', a null text as empty. ``doc`` holds the whole input row, so no
    name can clash. An empty table gives an empty one.
    """
    rates = target_rates(docs, source_col, text_col, weights, temperature)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    packed = packed.withColumn("mix_source", F.coalesce(F.col("doc")[source_col].cast("string"), F.lit("")))
    one = lambda j: F.size(F.filter("cdf", lambda c: c <= uniform(seed, F.col("doc")[id_col], j)))
    drawn = packed.join(rates.select("mix_source", "rate", "parts", "cdf"), "mix_source").withColumn(
        "times", F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), one), F.lit(0), lambda a, x: a + x))
    copies = drawn.where("times > 0").select("doc", "rate", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc")[id_col].cast("string"), F.lit("null")), F.col("copy")))
    return copies.withColumn("key", key).orderBy("key", "copy")
