"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, mixing, quality_model, quality_rules, repeats, token_counts, url_filter, warc
from .common import partitions_for, split_of, table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
WEIGHTS = [5, 2, 1]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, by majority attribution."""
    return token_counts.count_sections(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(split_of(F.col("doc_id")) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang"))
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root = warc.archive(table(spark, sf_dir, "pages").select("page_id", "html"))
    back = warc.read_records(index.repartition(partitions_for(spark), "path"), root)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url", RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds part of a benchmark item, with the item."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    held = F.coalesce(split_of(F.col("doc_id")) == 2, F.lit(False))
    train = docs.where(~held & F.col("doc_id").isNotNull()).join(labels.where(~held), "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "label")
    model = quality_model.fit(train)
    scored = quality_model.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
p AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS k FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND k > 1 THEN first END AS refers_to
FROM f
"""

OP4_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, max_by(struct_pack(rule := h || p, v := v), length(h) * 100000 + length(p)) AS best
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM u LEFT JOIN m USING (page_id)
"""

#: tokens as in the operator: ASCII separators, other punctuation beyond ASCII, characters of unspaced scripts; ASCII punctuation that does not part tokens is moved out of the way
OP5_SQL = r"""
WITH s AS (SELECT 0 AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
n AS (SELECT kind, id, row_number() OVER () AS k, regexp_replace(regexp_replace(translate(lower(t), '#%&''*-/@\_{}' || chr(8208) || chr(8209) || chr(8216) || chr(8217),
        chr(57344) || chr(57345) || chr(57346) || chr(57347) || chr(57348) || chr(57349) || chr(57350) || chr(57351) || chr(57352) || chr(57353) || chr(57354) || chr(57355) || chr(57356) || chr(57357) || chr(57358) || chr(57359)),
        '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])', ' \1 ', 'g'), '[\p{P}\p{Z}\x{85}\x{200B}\x09-\x0D]+', ' ', 'g') AS t FROM s),
w AS (SELECT kind, id, k, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM n),
x AS (SELECT kind, id, k, len(w) AS n, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos FROM w),
-- of 13 aligned tokens with two substitutions four in a row agree; shorter items agree as a whole
g AS (SELECT *, hash(tok, lead(tok, 1) OVER o, lead(tok, 2) OVER o, lead(tok, 3) OVER o) AS four, pos + 3 < n AS ok FROM x WINDOW o AS (PARTITION BY kind, k ORDER BY pos)),
a AS (SELECT DISTINCT d.k AS dk, d.id AS doc_id, d.n AS dn, b.k AS bk, b.id AS item_id, b.n AS bn, d.pos - b.pos AS shift FROM g d JOIN g b ON d.four = b.four AND d.ok AND b.ok AND d.kind = 0 AND b.kind = 1
      UNION SELECT d.k, d.id, d.n, b.k, b.id, b.n, d.pos FROM x d JOIN x b ON d.tok = b.tok AND d.kind = 0 AND b.kind = 1 AND b.pos = 0 AND b.n < 13 AND (b.n > 1 OR d.n = 1)),
e AS (SELECT a.*, b.pos, (d.tok = b.tok)::INT AS same FROM a JOIN x b ON b.kind = 1 AND b.k = a.bk JOIN x d ON d.kind = 0 AND d.k = a.dk AND d.pos = b.pos + a.shift),
v AS (SELECT *, least(bn, 13) AS width, sum(same) OVER q AS hits, count(*) OVER q AS seen FROM e WINDOW q AS (PARTITION BY dk, bk, shift ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
y AS (SELECT *, pos + shift AS p FROM v WHERE seen = width AND (bn >= 13 OR pos = 0) AND hits >= width - CASE WHEN bn < 13 THEN 0 ELSE 2 END)
SELECT doc_id, item_id, min(p)::INT AS first_token, max(p + width - 1)::INT AS last_token, count(DISTINCT p) AS windows, max(hits)::INT AS best
FROM y GROUP BY doc_id, item_id
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
      UNION SELECT k, hash(array_to_string(w, ' '), len(w)) FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
f AS (SELECT k, n, doc_id, bit_xor(h) AS fx, sum(h::HUGEINT % 1000000007) AS fs FROM g JOIN n USING (k) JOIN d USING (k) GROUP BY ALL),
c AS (SELECT k, n, min(k) OVER (PARTITION BY n, fx, fs) AS c FROM f),
r AS (SELECT g.k, g.h, c.n FROM g JOIN c USING (k) WHERE c.k = c.c),
l AS (SELECT a.k AS x, b.k AS y FROM r a JOIN r b ON a.h = b.h AND a.k < b.k AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
      GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
z(k, m) AS (SELECT k, k FROM c WHERE k = c UNION SELECT e.y, z.m FROM z JOIN e ON e.x = z.k),
o AS (SELECT k, min(m) AS m FROM z GROUP BY k),
q AS (SELECT c.k, o.m FROM c JOIN o ON o.k = c.c),
b AS (SELECT q.m, min(doc_id) AS least FROM q JOIN d USING (k) GROUP BY q.m)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(b.least, doc_id) AS component_id
FROM d LEFT JOIN n USING (k) LEFT JOIN q USING (k) LEFT JOIN b USING (m)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w),
c AS (SELECT *, cap * rest <= weight * (total - before) AS capped FROM o),
f AS (SELECT *, coalesce(sum(cap) FILTER (capped) OVER (), 0) AS used, coalesce(sum(weight) FILTER (NOT capped) OVER (), 1) AS open FROM c),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * (total - used))::DOUBLE / open::DOUBLE END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
p AS (
  SELECT doc_id, size, source_size, target, whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN target - whole * source_size > 0 AND (2 * before + size)::DOUBLE <= 2 * (target - (whole * source_size)::DOUBLE) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

#: hexadecimal digits stand for bytes; windows are read from pieces of 1000 starts
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT k, j * 1000 AS base, substr(x, j * 2000 + 1, 2398) AS x FROM (SELECT k, x, unnest(range(0, (length(x) // 2 + 999) // 1000)) AS j FROM d)),
s AS (SELECT k, base + i AS pos, hash(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT k, base, x, unnest(range(0, greatest(0, least(1000, length(x) // 2 - 199)))) AS i FROM p)),
t AS (SELECT k, pos FROM (SELECT k, pos, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
r AS (SELECT k, pos, sum(fresh) OVER (PARTITION BY k ORDER BY pos) AS run FROM (SELECT k, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY k ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS fresh FROM t)),
u AS (SELECT k, run, min(pos) AS a, max(pos) + 200 AS e FROM r GROUP BY k, run),
g AS (SELECT u.k, a, e, lag(e, 1, 0) OVER (PARTITION BY u.k ORDER BY a) AS before FROM u),
m AS (SELECT g.k, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(d.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(e) AS last FROM g JOIN d USING (k) GROUP BY g.k)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN m USING (k)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
n AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS c FROM g),
x AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM n WHERE c > 1),
r AS (SELECT k, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words FROM x GROUP BY k),
q AS (
  SELECT l.k, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM l LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q),
h AS (SELECT source, count(*)::DOUBLE AS nd, sum(base_failed::INT)::DOUBLE AS nf FROM b GROUP BY source),
s AS (SELECT count(*)::DOUBLE AS hk, sum(nd) AS hn, sum(nf) AS hf, sum(nf * nf / nd) AS ff FROM h),
m AS (SELECT *, hf / hn AS m FROM s),
z AS (SELECT m, least(greatest(m * (1 - m) / greatest(ff / hn - m * m - m * (1 - m) * hk / hn, 1e-9) - 1, 1.0), 1e6) AS pw FROM m),
v AS (SELECT source, (nf + m * pw) / (nd + pw) AS rate FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_warc, op4_url_filter, op5_decontamination, op6_jaccard_join, op7_quality_classifier, op8_mixing, op9_suffix_dedup, op10_quality_rules)}
ORACLES = {"op3_warc": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op8_mixing": OP8_SQL, "op9_suffix_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL}
