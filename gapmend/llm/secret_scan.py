"""Secrets with corpus-wide ownership (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapmend.llm.common import let, running_sums, staged

#: Fixed patterns: name, expression, group of the secret, least length of that group.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: What the ownership step looks up outside the base spans: long strings of letters and digits.
BARE = r"[A-Za-z0-9+/_=-]+"
BARE_CHARS = 16
#: The same matches as BARE with enough characters; the look-behind keeps the search out of the middle of a run.
LONG_BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
KEYWORDS = ("password", "passwd", "secret", "token", "api")

SPAN = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"


def _spans(text: Column, kind: int, pattern: str, group: int, least: int, gate: Column) -> Column:
    """Leftmost non-overlapping matches with positions in code points: the pieces between the
    matches and the matches themselves, in turn, add up to every start. ``gate`` is a cheap test that every text with a match passes."""
    pat = F.lit(pattern)

    def cut(found):
        full, pieces = found["full"], found["pieces"]
        lens = F.flatten(F.transform(full, lambda m, i: F.array(F.length(F.get(pieces, i)).cast("bigint"), F.length(m).cast("bigint"))))
        return let(running_sums(lens), lambda ends: F.transform(full, lambda m, i: F.struct(
            F.get(ends, 2 * i).alias("start"), F.lit(kind).alias("kind"), F.get(ends, 2 * i + 1).alias("stop"),
            F.get(found["value"], i).alias("value"))))

    found = F.struct(F.regexp_extract_all(text, pat, 0).alias("full"), F.regexp_extract_all(text, pat, group).alias("value"),
                     F.split(text, pattern, -1).alias("pieces"))
    spans = F.filter(let(found, cut), lambda s: F.length(s["value"]) >= least)
    return F.when(gate, spans).otherwise(F.array()).cast(SPAN)


def _gates(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    words = [low.contains(w) for w in KEYWORDS]
    return {"assign": words[0] | words[1] | words[2] | words[3] | words[4], "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{24}"),
            "bare": text.rlike("[0-9]") & text.rlike(LONG_BARE)}


def base_spans(text: Column) -> Column:
    """All base matches of a text (null: none) by start, then kind as listed."""
    t = F.coalesce(text, F.lit(""))
    gates = _gates(t)
    return F.array_sort(F.concat(*[_spans(t, i, pat, group, least, gates[name]) for i, (name, pat, group, least) in enumerate(KINDS)]))


def bare_spans(text: Column, base: Column) -> Column:
    """Long strings with letters and digits that touch no base span; kind number 3."""
    t = F.coalesce(text, F.lit(""))
    found = _spans(t, len(KINDS), LONG_BARE, 0, BARE_CHARS, _gates(t)["bare"])
    return let(base, lambda bs: F.filter(found, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & ~F.exists(
        bs, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order of the array."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("bare"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def ownership(values: DataFrame) -> DataFrame:
    """(value_hash, in_base, n_owners, n_repos) from rows (value_hash, kind, owner, repo).

    Owners and repositories are counted exactly, by two levels of sums that combine before every
    shuffle, so a value found in a third of all documents is no hot key.
    """
    by_repo = values.groupBy("value_hash", "owner", "repo").agg(F.max((F.col("kind") < len(KINDS)).cast("int")).alias("in_base"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.max("in_base").alias("in_base"), F.count(F.lit(1)).alias("n_repos"))
    return by_owner.groupBy("value_hash").agg(F.max("in_base").alias("in_base"), F.count(F.lit(1)).alias("n_owners"),
                                              F.sum("n_repos").alias("n_repos"))


def scan(docs: DataFrame, owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"),
         example_owners: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, base, extra, n_live, n_example), spans as arrays.

    A candidate's value is hashed and its distinct owners and repositories are counted over the
    whole corpus. A value of ``example_owners`` owners or more is a widely copied example, any other
    one is live-looking. ``extra`` holds bare strings, outside every base span, that equal a
    live-looking value which some base span of the corpus holds. Base spans always stay.
    Null texts have no spans; null owners and repositories count as one of their own. Repeated
    rows and repeated ids give one row each. Other columns of ``docs`` are not read.
    """
    t, blank = F.col(text_col), F.lit("")
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), blank).alias("owner"),
                        F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), blank) for c in repo_cols]).alias("repo"),
                        t.alias("text"), base_spans(t).alias("base"))
    found = staged(found.select("doc_id", "owner", "repo", "base", bare_spans(F.col("text"), F.col("base")).alias("bare")), "secrets")
    # the id is taken from the written table, so it is the same whenever it is read
    rows = staged(found.withColumn("row", F.monotonically_increasing_id()), "secret-rows")
    each = rows.select("row", "owner", "repo", F.explode(F.concat("base", "bare")).alias("s")).select(
        "row", "owner", "repo", "s", F.col("s.kind").alias("kind"), F.sha2(F.col("s.value"), 256).alias("value_hash"))
    known = ownership(each).where("in_base = 1")
    verdicts = each.join(known, "value_hash").groupBy("row").agg(
        F.count(F.when((F.col("kind") < len(KINDS)) & (F.col("n_owners") < example_owners), 1)).alias("n_live"),
        F.count(F.when((F.col("kind") < len(KINDS)) & (F.col("n_owners") >= example_owners), 1)).alias("n_example"),
        F.collect_list(F.when((F.col("kind") == len(KINDS)) & (F.col("n_owners") < example_owners), F.col("s"))).alias("extra"))
    return rows.join(verdicts, "row", "left").select(
        "doc_id", "base", F.coalesce(F.array_sort("extra"), F.array().cast(SPAN)).alias("extra"),
        F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("bigint").alias("n_example"))
