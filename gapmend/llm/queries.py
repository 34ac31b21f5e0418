"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapmend.llm import (compression, decontaminate, host_rules, jaccard_join, merkle, mixing, piece_bpe, prefix_trie, runs, secret_scan,
                         suffix_dedup, token_store, toxicity)
from gapmend.llm.common import staged, table, words
from gapmend.session import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


#: words of t as a DuckDB list
SQL_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, host, t, """ + SQL_WORDS.format(t="t") + r""" AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(0, len(w) - 7)) AS p, w FROM w WHERE len(w) >= 8),
h AS (SELECT rid, p, list_aggregate(w[p + 1 : p + 8], 'string_agg', ' ') AS s FROM g),
r AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, s) AS c FROM h),
s AS (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM r WHERE c > 1),
n AS (SELECT rid, sum(least(8, coalesce(p - q, 8))) AS n_repeat_words FROM s GROUP BY rid),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN n USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
k AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM f GROUP BY host),
a AS (SELECT sum(k) / sum(n) AS pm, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS v FROM k),
b AS (SELECT pm, CASE WHEN v > 1e-12 THEN greatest(1.0::DOUBLE, least(1e6::DOUBLE, pm * (1 - pm) / v - 1)) ELSE 1e6::DOUBLE END AS z FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (k.k + pm * z) / (k.n + z) <= 0.5 AS kept
FROM f JOIN k USING (host), b
"""


@query("op5_host_rules", OP5_SQL)
def op5(spark, d):
    out = host_rules.judged(table(spark, d, "documents"), keep=["doc_id"])
    return out.select("doc.doc_id", "m.*", "base_failed", "kept")


def _op10_kind(name: str, pattern: str, group: int, least: int, i: int) -> str:
    pat = pattern.replace("'", "''")
    return (f"SELECT rid, {i} AS ord, '{name}' AS kind, list_sum(lens[: 2 * k - 1]) AS a, list_sum(lens[: 2 * k]) AS b, v[k] AS value FROM "
            f"(SELECT rid, v, unnest(range(1, len(f) + 1)) AS k, flatten(list_transform(list_zip(p[: len(f)], f), lambda x: [length(x[1]), length(x[2])])) AS lens FROM "
            f"(SELECT rid, regexp_extract_all(t, '{pat}', 0) AS f, regexp_extract_all(t, '{pat}', {group}) AS v, regexp_split_to_array(t, '{pat}') AS p "
            f"FROM d)) WHERE length(v[k]) >= {least}")


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_op10_kind(*k, i) for i, k in enumerate(secret_scan.KINDS))}),
raw AS ({_op10_kind("bare", secret_scan.BARE, 0, secret_scan.BARE_CHARS, 3)}),
bare AS (SELECT * FROM raw WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
         AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = raw.rid AND base.a < raw.b AND raw.a < base.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
own AS (SELECT value, count(DISTINCT owner) AS n_owners FROM every JOIN d USING (rid) GROUP BY value HAVING bool_or(ord < 3)),
j AS (SELECT every.*, n_owners FROM every LEFT JOIN own USING (value) WHERE ord < 3 OR n_owners < 3)
SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (WHERE ord < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord), '') AS spans,
  count(*) FILTER (WHERE ord < 3 AND n_owners < 3) AS n_live, count(*) FILTER (WHERE ord < 3 AND n_owners >= 3) AS n_example
FROM d LEFT JOIN j USING (rid) GROUP BY d.rid, doc_id
"""


@query("op10_secret_ownership", OP10_SQL)
def op10(spark, d):
    s = secret_scan
    out = s.scan(table(spark, d, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    count = {f"n_{k[0]}": (F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint") for i, k in enumerate(s.KINDS)}
    return out.withColumns(count).select(
        "doc_id", *count, F.sha2(s.joined(F.col("base")), 256).alias("base_sha256"),
        s.joined(F.array_sort(F.concat("base", "extra"))).alias("spans"), "n_live", "n_example")


OP8_SQL = r"""
WITH s AS (SELECT coalesce(source, '') AS source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY 1),
r AS (SELECT source, sqrt(chars) / sum(sqrt(chars)) OVER () * sum(chars) OVER () / chars AS rate FROM s),
c AS (SELECT source, rate, list_transform(range(0, 200), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(rate) - rate - lgamma(j + 1))))) AS cdf FROM r),
n AS (SELECT doc_id, c.source, rate, len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('mix:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0)) AS times
      FROM documents d JOIN c ON c.source = coalesce(d.source, ''))
SELECT doc_id, source, round(rate, 6) AS rate, unnest(range(1, times + 1))::INTEGER AS copy FROM n
"""


@query("op8_poisson_mix", OP8_SQL)
def op8(spark, d):
    out = mixing.replicated(table(spark, d, "documents"))
    return out.select("doc.doc_id", F.coalesce("doc.source", F.lit("")).alias("source"), F.round("rate", 6).alias("rate"), "copy")


@query("op2_token_store")
def op2(spark, d):
    import public_tokenizers

    docs, path = table(spark, d, "documents"), scratch_path(spark, "tokens")
    token_store.write_store(docs, path, str(public_tokenizers.path("byte_bpe_50k.json")))
    return token_store.stored_documents(spark, path, docs.select("doc_id")).select("doc_id", "start", "n_tokens", "ids_crc32", "slot")


_RECORD = ("'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) "
           "|| 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) "
           "|| chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)")
OP9_SQL = f"""
WITH r AS (SELECT page_id, {_RECORD} AS rec FROM pages), h AS (SELECT page_id, strlen(rec) AS b, sha256(rec) AS d FROM r),
g AS (SELECT page_id, count(*) AS n_records, sum(b)::BIGINT AS n_bytes, {", ".join(f"sum(('0x' || substr(d, {1 + 15 * k}, 15))::BIGINT)::HUGEINT AS s{k}" for k in range(5))} FROM h GROUP BY page_id)
SELECT page_id, page_id // 4096 AS shard, (sum(n_bytes) OVER (PARTITION BY page_id // 4096 ORDER BY page_id) - n_bytes)::BIGINT AS record_offset, n_bytes, n_records,
  sha256(n_records || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3 || ':' || s4) AS digest,
  CASE substr(md5(page_id::VARCHAR), 1, 2) WHEN '00' THEN 'changed' WHEN '01' THEN 'missing' ELSE 'ok' END AS status
FROM g
"""


@query("op9_merkle_audit", OP9_SQL)
def op9(spark, d):
    """The replica is the same table with two kinds of planted damage, chosen by a hash of the id."""
    pages = table(spark, d, "pages")
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    replica = pages.where(mark != "01").withColumn("html", F.when(mark == "00", F.concat("html", F.lit("\x00"))).otherwise(F.col("html")))
    return merkle.audit(pages, replica)


@query("op3_compression_quality")
def op3(spark, d):
    out = compression.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "difference")


@query("op1_ordinal_toxicity")
def op1(spark, d):
    return toxicity.severity(table(spark, d, "documents"), table(spark, d, "labels"))


OP4_SQL = r"""
WITH b AS (SELECT item_id, """ + SQL_WORDS.format(t="lower(coalesce(text, ''))") + r""" AS w FROM benchmark),
i AS (SELECT item_id, len(w) - 4 AS si, unnest(list_transform(range(0, len(w) - 4), lambda p: array_to_string(w[p + 1 : p + 5], ' '))) AS s FROM b WHERE len(w) >= 5),
ic AS (SELECT item_id, si, s, count(*) AS ci FROM i GROUP BY ALL),
d AS (SELECT doc_id, """ + SQL_WORDS.format(t="lower(coalesce(text, ''))") + r""" AS w FROM documents),
dw AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5),
ds AS (SELECT doc_id, len(w) - 4 AS sd, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM dw),
h AS (SELECT doc_id, item_id, s, p, ci, si, sd, least(si, sd) AS sw FROM ds JOIN ic USING (s)),
few AS (SELECT doc_id, item_id, si, sd, sw FROM h GROUP BY ALL HAVING count(*) * 9 >= 4 * (si + sw)),
st AS (SELECT DISTINCT doc_id, item_id, si, sw, unnest(range(greatest(p - sw + 1, 0), least(p, sd - sw) + 1)) AS a FROM h SEMI JOIN few USING (doc_id, item_id)),
o AS (SELECT st.doc_id, st.item_id, st.si, st.sw, a, h.s, least(count(*), any_value(ci)) AS o FROM st JOIN h ON h.doc_id = st.doc_id AND h.item_id = st.item_id AND h.p BETWEEN a AND a + st.sw - 1 GROUP BY ALL),
t AS (SELECT doc_id, item_id, si, sw, a, sum(o) AS o FROM (SELECT doc_id, item_id, si, sw, a, s, o FROM o) GROUP BY ALL HAVING 9 * sum(o) >= 4 * (si + sw))
SELECT doc_id, item_id, a::BIGINT AS start, (sw + 4)::BIGINT AS n_words, round(o / (si + sw - o), 6) AS similarity
FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY o / (si + sw - o) DESC, a) = 1
"""


@query("op4_simhash_leaks", OP4_SQL)
def op4(spark, d):
    out = decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.select(F.col("k1").alias("doc_id"), "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(0, len(w) - 4), lambda p: array_to_string(w[p + 1 : p + 5], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


@query("op6_jaccard_join", OP6_SQL)
def op6(spark, d):
    return jaccard_join.components(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_suffix_dedup")
def op7(spark, d):
    return suffix_dedup.removals(table(spark, d, "documents"))


#: crc32 of the decimal text of c in DuckDB, bit by bit: a byte is xored in, -1 shifts by one bit
SQL_CRC32 = ("xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split({c}::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]), "
             "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)")

OP11_SQL = r"""
WITH o AS (SELECT row_number() OVER () AS rid, doc_id, """ + SQL_WORDS.format(t="coalesce(text, '')") + " AS w, " + SQL_CRC32.format(c="coalesce(doc_id, 1)") + r""" AS h FROM documents),
g AS (SELECT rid, doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a,
        CASE WHEN len(w) > 0 THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p FROM o),
d AS (SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 AND doc_id IS NOT NULL
        THEN list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) ELSE w END AS w FROM g),
f AS (SELECT rid, unnest(range(0, len(w) - 4)) AS i, w FROM d WHERE len(w) >= 6),
s AS (SELECT rid, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5]) AS s, len(w) AS n FROM f),
e AS (SELECT x.rid, y.i - x.i AS q, x.i FROM s x JOIN s y ON x.rid = y.rid AND x.s = y.s AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
k AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e),
m AS (SELECT rid, q, min(i) AS start, count(*) + 4 + q AS length FROM k GROUP BY rid, q, island),
r AS (SELECT rid, start, length, min(q) AS q FROM m WHERE length >= greatest(6, 4 * q) GROUP BY rid, start, length),
b AS (SELECT rid, count(*) AS n_runs, max({'n': length, 's': -start, 'q': -q}) AS top, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed,
        list({'a': start + q, 'b': start + length}) AS cuts FROM r GROUP BY rid),
x AS (SELECT DISTINCT rid, unnest(range(c.a, c.b)) AS i FROM (SELECT rid, unnest(cuts) AS c FROM b)),
y AS (SELECT rid, list(i) AS gone FROM x GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-top.s)::BIGINT AS start, top.n::BIGINT AS length, (-top.q)::BIGINT AS period, (1000 * top.n // -top.q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(0, len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]), ' ') END, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (rid) LEFT JOIN y USING (rid)
"""


def _with_periodic_tails(docs):
    """Input of op11: in documents with crc32(doc_id) % 10 = 0 the words from g % n on repeat with a period that the id fixes."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("w")
    w = docs.where(F.col("doc_id").isNotNull() & (h % 10 == 0)).select("doc_id", words(F.col("text")).alias("w"))
    w = w.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))).otherwise(x))
    rest = docs.where(F.col("doc_id").isNull() | (h % 10 != 0)).select("doc_id", F.col("text"))
    return rest.unionAll(w.select("doc_id", F.array_join(tail, " ").alias("text")))


@query("op11_periodic_runs", OP11_SQL)
def op11(spark, d):
    out = runs.periodic_runs(_with_periodic_tails(table(spark, d, "documents"))).withColumn("top", runs.longest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.*", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_sentencepiece")
def op12(spark, d):
    import public_tokenizers

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    out = piece_bpe.decode(piece_bpe.encode(table(spark, d, "documents"), model), model)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(""" + SQL_WORDS.format(t="coalesce(text, '')") + r""") AS n FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, """ + SQL_CRC32.format(c="c") + r""" % 4 AS h FROM (SELECT DISTINCT c FROM t)),
o AS (SELECT v.c, 0 AS own, pos, k, n FROM v JOIN t ON t.c = v.c - v.c % 20 AND t.pos < v.h UNION ALL SELECT v.c, 1, pos, k, n FROM v JOIN t ON t.c = v.c AND t.pos >= v.h),
p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, k, n FROM o),
x AS (SELECT c, d, n, md5(string_agg(k, ',') OVER (PARTITION BY c ORDER BY d)) AS key FROM p UNION ALL SELECT c, 0, 0, 'root' FROM v),
l AS (SELECT c, max(d) AS last FROM x GROUP BY c),
u AS (SELECT x.*, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), '') AS up, d = last AS ends FROM x JOIN l USING (c)),
g AS (SELECT key, up, d, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, string_agg(c, ',' ORDER BY c) FILTER (WHERE ends) AS ended FROM u GROUP BY key, up, d),
q AS (SELECT up AS key, count(*) AS n_children FROM g GROUP BY up),
y AS (SELECT g.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * n AS saved FROM g LEFT JOIN q USING (key)),
-- each node adds to its ancestors, which lie on the path of its smallest member
s AS (SELECT u.key, sum((y.n_children = 0)::BIGINT) AS n_leaves, sum(y.saved) AS saved_tokens FROM y JOIN u ON u.c = y.conv_id AND u.d <= y.d GROUP BY u.key)
SELECT y.conv_id, y.d::BIGINT AS depth, pg.conv_id AS parent_conv_id, y.n_convs::BIGINT AS n_convs, y.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(y.ended, '')) AS ends_sha256
FROM y JOIN s USING (key) LEFT JOIN g pg ON pg.key = y.up
"""


def _rebuilt(conversations):
    """Input of op13: conversation c gets the first crc32(c) % 4 turns of c - c % 20 in place of its own."""
    own = staged(prefix_trie.ordered_turns(conversations), "own_turns")
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    turn = F.struct("pos", "turn_key", "n_words")
    heads = own.where("pos < 3").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))  # at most three turns
    plan = own.where("pos = 0").select("conv_id", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base")).join(heads, "base", "left")
    plan = plan.select("conv_id", "h", F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,turn_key:binary,n_words:bigint>>")), 1, F.greatest("h", F.lit(1))))
                       .otherwise(F.array().cast("array<struct<pos:bigint,turn_key:binary,n_words:bigint>>")).alias("head"))
    # a conversation whose base lacks turns moves up
    short = plan.select("conv_id", (F.col("h") - F.size("head")).cast("bigint").alias("up"))
    kept = own.where(F.col("pos") >= h).join(short, "conv_id").select("conv_id", (F.col("pos") - F.col("up")).alias("pos"), "turn_key", "n_words")
    first = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    there = plan.select("conv_id", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("bigint").alias("n_words"))
    return kept.unionAll(first).unionAll(there)


@query("op13_prefix_trie", OP13_SQL)
def op13(spark, d):
    return prefix_trie.prefix_trie(_rebuilt(table(spark, d, "conversations")))
