"""Quality rules with verdicts per host (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapmend.llm.common import let, staged, word_windows, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"


def _repeat_words(hashed: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the array, first ones included."""
    def covered(starts):
        end = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                          lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")))
        return end["n"]

    def repeated(s):
        keep = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        # a missing neighbour is null; false or null is not kept, true or null is
        return F.array_sort(F.transform(keep, lambda x: x["p"]))

    def heavy(w):
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return covered(let(pairs, repeated))

    return let(word_windows(hashed, WINDOW), lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), heavy(w)).otherwise(F.lit(0))).cast("bigint")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rule counts of every document: columns ``doc`` (the whole input row as a struct, so no
    name can clash) and ``m`` (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words).

    A null text has no words and counts 0 everywhere. Windows are compared by 64-bit hashes.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    step = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), words(t).alias("w"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
    return step.select("doc", F.struct(
        F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        "n_symbols", "n_dup_lines",
        let(F.transform("w", lambda x: F.xxhash64(x)), _repeat_words).alias("n_repeat_words")).alias("m"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def host_rates(rows: DataFrame, host: Column, failed: Column) -> DataFrame:
    """(host, n, k, rate): failures of each host, shrunk by an empirical beta prior.

    The prior's mean is the failure share m of all documents and its strength follows from the
    between-host variance v of the shares, weighted by documents: a + b = m (1 - m) / v - 1, between
    1 and 1e6. ``rate`` is the posterior mean (k + a) / (n + a + b). With one host, or equal
    shares, the strength is 1e6.
    """
    hosts = rows.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("bigint")).alias("k"))
    n, k, q = hosts.agg(F.sum("n"), F.sum("k"), F.sum(F.col("k") * F.col("k") / F.col("n"))).first()
    m = k / n if n else 0.0
    v = q / n - m * m if n else 0.0
    strength = max(1.0, min(1e6, m * (1 - m) / v - 1)) if v > 1e-12 else 1e6
    return hosts.select("host", "n", "k", ((F.col("k") + m * strength) / (F.col("n") + strength)).alias("rate"))


def judged(docs: DataFrame, host_col: str = "source", max_host_rate: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as (doc, m, base_failed, host_rate, kept).

    Rule failures are aggregated per host, shrunk by :func:`host_rates`, and the verdict is joined
    back: a document stays if it passes the base rules and its host's rate is at most
    ``max_host_rate``. A null host counts as the host ''. ``keep`` names the columns of ``docs``
    that the result carries (default all). Repeated rows are judged each on its own; an empty
    table gives an empty one. The counts are written once and read twice.
    """
    rows = measured(docs)
    if keep is not None:
        rows = rows.select(F.struct(*[F.col("doc")[c].alias(c) for c in dict.fromkeys([*keep, host_col])]).alias("doc"), "m")
    rows = staged(rows, "rules")
    host = F.coalesce(F.col("doc")[host_col].cast("string"), F.lit(""))
    rates = host_rates(rows, host, base_failed(F.col("m")))
    out = rows.withColumn("host", host).join(rates.select("host", "rate"), "host")
    failed = base_failed(F.col("m"))
    return out.select("doc", "m", failed.alias("base_failed"), F.col("rate").alias("host_rate"),
                      (~failed & (F.col("rate") <= max_host_rate)).alias("kept"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    return judged(docs, **options).where("kept").select("doc.*")
