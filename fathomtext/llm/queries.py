"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomtext.llm import decontaminate, fertility, language_id, mixing, near_dups, pii, sharding, substrings, token_counts, warc
from fathomtext.llm._spark import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    profiles = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fertility.quality(_table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "n_pieces", "fallback_share", "token_entropy", "script", "broken_bands")


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.feistel_shards(_table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op7_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # an empty cache for each run, so that a run's result and cost don't hang on the runs before it
    cache = f"{shared_dir(spark)}/token_cache-{uuid.uuid4().hex}"
    counts = token_counts.count_through(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = near_dups.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)
    return n.select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict:
    return {f.__name__: f for f in (op1_rank_order_profiles, op2_fertility_rules, op3_feistel_shards, op4_content_addressed_warc, op5_pareto_mix, op6_weak_supervision, op7_prefix_suffix_trees, op8_suffix_automaton, op9_digest_cache, op10_circulant_minhash)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
k AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
  xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, tab),
n AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), size, text_crc32)), doc_id, size, text_crc32) - 1 AS x, count(*) OVER () AS n FROM k),
g AS (SELECT *, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM n),
f AS (
  SELECT doc_id, size, text_crc32, n, a, b, x // b AS l, x % b AS r, 1 AS i FROM g
  UNION ALL
  SELECT doc_id, size, text_crc32, n, a, b,
    CASE WHEN i > 6 THEN (l * b + r) // b WHEN i % 2 = 1 THEN (l + ('0x' || substr(md5(concat_ws(':', '20240229', i, r)), 1, 12))::BIGINT) % a ELSE l END,
    CASE WHEN i > 6 THEN (l * b + r) % b WHEN i % 2 = 1 THEN r ELSE (r + ('0x' || substr(md5(concat_ws(':', '20240229', i, l)), 1, 12))::BIGINT) % b END,
    CASE WHEN i > 6 THEN 1 ELSE i + 1 END
  FROM f WHERE i <= 6 OR l * b + r >= n),
p AS (SELECT *, l * b + r AS p FROM f WHERE i = 7 AND l * b + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 8)::INTEGER AS shard, p // 8 AS slot, NULL::INTEGER AS grown_shard FROM p
"""

OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest
"""

OP5 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, (('0x' || substr(md5(concat_ws('|', '7', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS ratio FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM s3 WHERE level <= ratio), (SELECT max(ratio) FROM s3)) * weight) AS target FROM s3),
c0 AS (SELECT source, length(bin(size)) AS bits, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL),
c1 AS (SELECT c0.*, target, 2.0::DOUBLE / bits AS ratio, (target - coalesce(sum(words * 2.0::DOUBLE) OVER w, 0)) / sum(words * bits::DOUBLE) OVER v AS level FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source
  WINDOW w AS (PARTITION BY c0.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY c0.source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c2 AS (SELECT source, coalesce(arg_max(level, bits) FILTER (level <= ratio), max(ratio)) AS level FROM c1 GROUP BY source),
c3 AS (SELECT c0.*, least(2.0::DOUBLE, level * bits) AS copies FROM c0 JOIN c2 ON c0.source IS NOT DISTINCT FROM c2.source),
n AS (SELECT c3.source, any_value(target) - sum(floor(copies) * words) AS need FROM c3 JOIN s ON c3.source IS NOT DISTINCT FROM s.source GROUP BY c3.source),
q AS (SELECT d.*, floor(copies) AS whole, copies - floor(copies) AS part, need FROM d JOIN c3 ON d.source IS NOT DISTINCT FROM c3.source AND length(bin(size)) = bits JOIN n ON d.source IS NOT DISTINCT FROM n.source WHERE size > 0),
k AS (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS o FROM q),
w AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY floor(o / (1 + o) * 281474976710656.0::DOUBLE), doc_id, u ROWS UNBOUNDED PRECEDING) AS upto FROM k WHERE o IS NOT NULL UNION ALL SELECT *, NULL FROM k WHERE o IS NULL),
t AS (SELECT doc_id, source, size, (size * (whole + CASE WHEN upto < need + size / 2.0::DOUBLE THEN 1 ELSE 0 END))::BIGINT AS taken FROM w UNION ALL SELECT doc_id, source, 0, 0 FROM d WHERE size = 0)
SELECT doc_id, size, source_size, target, taken FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source
"""

OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda p: md5(array_to_string(w[p:p + 19], ' ')))) AS s FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM p),
x AS (SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT doc_id, unnest(range(p, p + 20)) AS x FROM g WHERE r > 1) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

OP8 = rf"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS s FROM (SELECT *, least(13, len(w)) AS n FROM i) WHERE n > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
dw AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
h AS (SELECT rid, p, n, item_id FROM dw JOIN iw USING (n, s)),
t AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS x FROM h) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN t USING (rid) LEFT JOIN m USING (rid)
"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS l FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.c = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) ON d = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_content_addressed_warc": OP4, "op7_prefix_suffix_trees": OP7, "op3_feistel_shards": OP3, "op5_pareto_mix": OP5, "op8_suffix_automaton": OP8, "op10_circulant_minhash": OP10}
