"""SQL with the same rows as the registered queries, for an engine with RE2 regular expressions."""

from fathomtext.functions.errors import TOO_LONG
from fathomtext.plans.queries import ANSWERS, SERVED, SETTINGS

_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _strip(x: str) -> str:
    for pattern, new in ((r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"(?i)\b(?:https?|ftp|mailto):[^\s)>\]]+", ""), ("<[^>]+>", ""), ("[ \\t]+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return _trim(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _normal(x: str) -> str:
    return _trim(rf"regexp_replace(lower({x}), '{_SPACE}+', ' ', 'g')")


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE left({x}, list_max(list_filter(range(0, {n + 1}), lambda k: strlen(left({x}, k)) <= {n}))) END"


def _cosine(a: str, b: str) -> str:
    def dot(x: str, y: str) -> str:
        return f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"

    return f"(CASE WHEN len({a}) <> len({b}) OR len({a}) = 0 THEN 0.0 WHEN sqrt({dot(a, a)}) * sqrt({dot(b, b)}) = 0 THEN 0.0 ELSE {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) END)"


_NAMES = "(SELECT unnest([" + ", ".join(map(_q, SERVED)) + "]) AS name)"
_CANON = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^user\.', ''), '^([^:]+):.*$', '\1'), '\.gguf$', ''), '-gguf$', '')"
_ANSWERS = "(VALUES " + ", ".join(f"({s}, {_q(b)})" for s, b in ANSWERS) + ") a(status, body)"
_TOO_LONG = "(status = 413 OR " + " OR ".join(f"contains(lower(body), {_q(x)})" for x in TOO_LONG) + ")"
_PAIRS = f"(SELECT b.vec_id AS query_id, a.vec_id AS doc_index, round({_cosine('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"
_LOG = "(SELECT doc_id AS seq, lang AS model, strlen(text)::BIGINT AS bytes, len(string_split(text, ' '))::BIGINT AS tokens, len(string_split(text, ' ')) >= 500 AS clipped FROM documents)"
_QUERIES = "(SELECT * FROM conversations WHERE role = 'user')"
_KEY = f"('m' || chr(0) || '64' || chr(0) || {_normal('text')})"


def _calibration(window: int) -> str:
    return f"""
WITH l AS (SELECT * FROM {_LOG} WHERE tokens > 0 AND bytes > 0),
t AS (SELECT model, sum(clipped::BIGINT)::BIGINT AS clipped FROM l GROUP BY model),
r AS (SELECT model, list_sort(list(bytes / tokens)) AS v, avg(bytes / tokens) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS n FROM l WHERE NOT clipped) WHERE n <= {window} GROUP BY model)
SELECT model, coalesce(len(v), 0)::BIGINT AS samples, clipped, round(v[1], 6) AS min, round(v[least(len(v) * 10 // 100, len(v) - 1) + 1], 6) AS p10, round(v[least(len(v) * 50 // 100, len(v) - 1) + 1], 6) AS median, round(mean, 6) AS mean FROM t LEFT JOIN r USING (model)"""


def _inside(p: str) -> str:
    return f"unicode(substr(t, {p} + 1, 1)) BETWEEN 128 AND 191"


def _back(p: str) -> str:
    return f"CASE WHEN {p} >= n THEN n WHEN {_inside(p)} THEN CASE WHEN {_inside(f'({p} - 1)')} THEN CASE WHEN {_inside(f'({p} - 2)')} THEN {p} - 3 ELSE {p} - 2 END ELSE {p} - 1 END ELSE {p} END"


def _ended(rel: str, sections: bool) -> str:
    """rel(t, n, s, l, fl, starts) with e, where its window ends."""
    section = "WHEN len(list_filter(starts, lambda x: x > s AND x <= l)) > 0 THEN list_max(list_filter(starts, lambda x: x > s AND x <= l))" if sections else ""
    return f"""
     SELECT *, CASE WHEN l >= n THEN n {section} WHEN pi > 0 AND s + k - pi + 1 > fl THEN s + k - pi + 1 WHEN li > 0 AND s + k - li + 1 > fl THEN s + k - li + 1 WHEN si > 0 AND s + si > fl THEN s + si WHEN wi > 0 AND s + wi > fl THEN s + wi ELSE {_back("l")} END AS e FROM (
      SELECT *, instr(reverse(win), chr(10) || chr(10)) AS pi, instr(reverse(win), chr(10)) AS li, length(regexp_extract(win, '(?s)^(.*[.!?])[ \\t\\n\\r]', 1)) AS si, length(regexp_extract(win, '(?s)^(.+)[ \\t\\n\\r]', 1)) AS wi FROM (
       SELECT *, substr(t, s + 1, l - s) AS win, l - s AS k FROM ({rel})))"""


def _follows(p: str) -> str:
    """Whether byte p of the text whose bytes are h, in hex, goes on with a code point."""
    return f"substr(h, 2 * ({p})::INTEGER + 1, 1) IN ('8', '9', 'A', 'B')"


def _trimmed(a: str, b: str, name: str) -> str:
    """Columns of the first and the last place of t[a:b] without blanks around it; -1 if there is nothing else."""
    sub, ws = f"substr(t, {a} + 1, {b} - {a})", "' ' || chr(9) || chr(10) || chr(13)"
    return f"CASE WHEN trim({sub}, {ws}) = '' THEN -1 ELSE {a} + length({sub}) - length(ltrim({sub}, {ws})) END AS {name}s, CASE WHEN trim({sub}, {ws}) = '' THEN -1 ELSE {a} + length(rtrim({sub}, {ws})) END AS {name}e"


def _split(size: int, overlap: int, source: str = "SELECT doc_id, text, []::BIGINT[] AS starts FROM documents", first: str = "", sections: bool = False) -> str:
    """CTEs up to sp(doc_id, ordinal, c, cs, ce), over a string with one character for each UTF-8 byte, so that places are bytes."""
    window = f"SELECT *, s + ((l - s) * 50) // 100 AS fl FROM (SELECT *, least(s + {size}, n)::INT AS l FROM w WHERE s < n)"
    return f"""
WITH RECURSIVE {first} src AS ({source}),
b AS (SELECT doc_id, starts, hex(encode(text)) AS h, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: chr(('0x' || h)::INTEGER)), '') AS t FROM src WHERE text IS NOT NULL),
w AS (
 SELECT doc_id, starts, t, length(t)::INT AS n, 0 AS s, -1 AS last, -1 AS cs, -1 AS ce FROM b
 UNION ALL
 SELECT doc_id, starts, t, n, CASE WHEN l >= n THEN n WHEN nx <= s OR nx <= last2 THEN e ELSE nx END, last2, cs2, ce2 FROM (
  SELECT *, {_back(f"(e - {overlap})")} AS nx, CASE WHEN cs2 >= 0 THEN cs2 ELSE last END AS last2 FROM (
   SELECT *, cut_s AS cs2, cut_e AS ce2 FROM (SELECT *, {_trimmed("s", "e", "cut_")} FROM ({_ended(window, sections)}))))
),
sp AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY cs) - 1)::INTEGER AS ordinal, count(*) OVER (PARTITION BY doc_id) AS c, cs, ce FROM w WHERE cs >= 0)"""


def _absorbed(size: int, least: int) -> str:
    """CTE fin: sp with a short last chunk merged, or the last two cut anew near their middle."""
    pair = f"SELECT doc_id, min(cs) AS a, max(ce) AS z, max(c) - 2 AS o FROM sp WHERE c >= 2 AND ordinal >= c - 2 GROUP BY doc_id HAVING arg_max(ce, ordinal) - arg_max(cs, ordinal) < {least}"
    window = f"SELECT b.starts, b.t, length(b.t)::INT AS n, p.*, a AS s, least((a + z) // 2, least(z, a + {size}))::INT AS l, greatest(a, z - {size})::INT AS fl FROM ({pair}) p JOIN b USING (doc_id)"
    return f""",
re AS (SELECT *, z - a <= {size} AS whole, e > a AND e < z AND ls >= 0 AND rs >= 0 AND le - ls <= {size} AND re - rs <= {size} AS anew FROM (SELECT *, {_trimmed("a", "e", "l")}, {_trimmed("e", "z", "r")} FROM ({_ended(window, False)}))),
fin AS (
 SELECT sp.doc_id, ordinal, cs, ce FROM sp LEFT JOIN re USING (doc_id) WHERE o IS NULL OR ordinal < o OR NOT (whole OR anew)
 UNION ALL SELECT doc_id, o::INTEGER, a, z FROM re WHERE whole
 UNION ALL SELECT doc_id, o::INTEGER, ls, le FROM re WHERE anew AND NOT whole
 UNION ALL SELECT doc_id, o::INTEGER + 1, rs, re.re FROM re WHERE anew AND NOT whole)"""


def _texts(rel: str, more: str = "") -> str:
    return f'SELECT doc_id, ordinal, cs::INTEGER AS "start", ce::INTEGER AS "end", decode(unhex(substr(h, 2 * cs::INTEGER + 1, 2 * (ce - cs)::INTEGER))) AS text{more} FROM {rel} JOIN b USING (doc_id)'


_OFFSETS = "SELECT doc_id, ordinal::BIGINT AS ordinal, cs, ce FROM sp"

_RENDERED = "SELECT conv_id AS doc_id, '# Conversation ' || conv_id || chr(10) || coalesce(string_agg(chr(10) || '## ' || role || ' ' || turn || chr(10) || chr(10) || text || chr(10), '' ORDER BY turn, text), '') AS text FROM conversations GROUP BY conv_id"

#: hd(doc_id, start, level, title, path): lines are looked at one after the other, with the open fence and whether a paragraph line stands above
_HEADINGS = rf"""
md AS ({_RENDERED}),
ln0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
ln AS (SELECT doc_id, i, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start, left(mark, 1) AS mc, length(mark) AS mn,
  CASE WHEN title = '' THEN 0 ELSE length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})(?:[ \t]|$)', 1)) END AS atx, title, {_trim("line")} AS body, CASE WHEN regexp_matches(line, '^ *=+[ \t]*$') THEN 1 WHEN regexp_matches(line, '^ *-+[ \t]*$') THEN 2 ELSE 0 END AS ul
  FROM (SELECT *, regexp_extract(line, '^ *(`{{3,}}|~{{3,}})', 1) AS mark, {_trim("regexp_replace(" + _trim("regexp_extract(line, '(?s)^ {0,3}#{1,6}(.*)$', 1)") + ", '#+$', '')")} AS title FROM ln0)),
st AS (
 SELECT doc_id, 0::BIGINT AS i, '' AS fc, 0::BIGINT AS fn, false AS above, 0::BIGINT AS hl FROM md
 UNION ALL
 SELECT doc_id, l.i, CASE WHEN fc = '' THEN mc WHEN mc = fc AND mn >= fn THEN '' ELSE fc END, CASE WHEN fc = '' THEN mn WHEN mc = fc AND mn >= fn THEN 0 ELSE fn END,
  fc = '' AND mn = 0 AND atx = 0 AND NOT (above AND ul > 0) AND body <> '', CASE WHEN fc <> '' OR mn > 0 THEN 0 WHEN atx > 0 THEN atx WHEN above AND ul > 0 THEN 10 + ul ELSE 0 END
 FROM st JOIN ln l USING (doc_id) WHERE l.i = st.i + 1),
hd0 AS (SELECT doc_id, o.start, (hl % 10)::INTEGER AS level, CASE WHEN hl > 10 THEN o.body ELSE o.title END AS title FROM st JOIN ln o USING (doc_id) WHERE hl > 0 AND o.i = st.i - CASE WHEN hl > 10 THEN 1 ELSE 0 END),
hd AS (SELECT doc_id, h.start, h.level, h.title, concat_ws(' > ', (SELECT string_agg(g.title, ' > ' ORDER BY g.start) FROM hd0 g WHERE g.doc_id = h.doc_id AND g.start < h.start AND g.level < h.level AND NOT EXISTS (SELECT 1 FROM hd0 k WHERE k.doc_id = g.doc_id AND k.start > g.start AND k.start < h.start AND k.level <= g.level)), h.title) AS path FROM hd0 h)"""


def _vectors(rel: str) -> str:
    """CTEs from ask, which is rel(id, text), to ve(id, place, value), its hashed words."""
    return f"""
ask AS ({rel}),
wd AS (SELECT id, md5(w) AS h FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[^{_SPACE[1:-1]}]+')) AS w FROM ask)),
sm AS (SELECT id, (('0x' || substr(h, 1, 13))::BIGINT % 64)::INTEGER AS place, sum(CASE WHEN substr(h, 14, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM wd GROUP BY ALL),
nm AS (SELECT id, sqrt(sum(v * v)) AS norm FROM sm GROUP BY id),
ve AS (SELECT ask.id, p.place, CASE WHEN norm > 0 THEN coalesce(v, 0) / norm ELSE 0 END::FLOAT AS value FROM ask CROSS JOIN (SELECT unnest(range(64))::INTEGER AS place) p LEFT JOIN sm ON sm.id = ask.id AND sm.place = p.place LEFT JOIN nm ON nm.id = ask.id WHERE text IS NOT NULL)"""


def _limit(field: int) -> str:
    from fathomtext.functions.models import KNOWN_LIMITS

    known = " ".join(f"WHEN {_q(k)} THEN {(v.max_bytes, v.max_tokens)[field]}" for k, v in KNOWN_LIMITS.items())
    return f"coalesce(CASE name {known} END, CASE {_CANON} {known} END, 0)"


ORACLE = {
    "strip_nonsemantic": f"SELECT page_id, {_strip('x')} AS text FROM (SELECT page_id, html || chr(10) || chr(10) || chr(10) || chr(10) || '![pic](http://a.b/c) [home](' || url || ') é' || url || ' end  ' AS x FROM pages)",
    "normalize_query": f"SELECT conv_id, turn, {_normal('x')} AS query FROM (SELECT *, '  ' || text || chr(10) || ' ÉÀ ' || chr(9) || 'X' AS x FROM {_QUERIES})",
    "cache_key": f"SELECT conv_id, turn, sha256('nomic-embed-text' || chr(0) || '64' || chr(0) || {_normal('text')}) AS key FROM {_QUERIES}",
    "truncate_bytes": f"SELECT doc_id, {_cut('text', 1021)} AS text FROM documents",
    "limits_flag": f"SELECT lang, count(*) AS n, count(*) FILTER (strlen(text) > 6000) AS over, sum(strlen({_cut('text', 6000)}))::BIGINT AS bytes FROM documents GROUP BY lang",
    "strict_reject": "SELECT doc_id, CASE WHEN strlen(text) <= 6000 THEN strlen(text) END AS bytes, CASE WHEN strlen(text) > 6000 THEN 'embedding: input ' || doc_id || ' exceeds m MaxBytes (' || strlen(text) || ' > 6000)' END AS message, CASE WHEN strlen(text) > 6000 THEN true END AS permanent FROM documents",
    "limit_documents": f"SELECT doc_id, strlen({_cut('text', 18000)}) AS bytes FROM documents",
    "shrink_once": "SELECT doc_id, CASE WHEN strlen(text) > 256 THEN greatest(strlen(text) * 4 // 5, 256) ELSE strlen(text) END AS keep_bytes, strlen(text) > 256 AS changed FROM documents",
    "format_record": "SELECT doc_id, 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || chr(10) || text AS record FROM documents",
    "format_for_task": "SELECT doc_id, 'search_query:' || chr(10) || source AS nomic_retrieval_query, 'search_document:' || chr(10) || source AS nomic_retrieval_document, source AS nomic_code_retrieval, 'task: search result | query:' || chr(10) || source AS embed_retrieval_query, 'title: none | text:' || chr(10) || source AS embed_retrieval_document, 'task: code retrieval | query:' || chr(10) || source AS embed_code_retrieval FROM documents",
    "format_record_for_task": "SELECT doc_id, 'clustering:' || chr(10) || 'lang: ' || lang || chr(10) || chr(10) || text AS record FROM documents",
    "format_retrieval_doc": "SELECT doc_id, 'title: ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'none' END || ' | text:' || chr(10) || 'lang: ' || lang || chr(10) || chr(10) || source AS gemma, 'search_document:' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'title: ' || source || chr(10) ELSE '' END || 'lang: ' || lang || chr(10) || chr(10) || source AS nomic FROM documents",
    "canonical_model": f"SELECT name, {_CANON} AS canonical FROM {_NAMES}",
    "lookup_limits": f"SELECT name, {_limit(0)} AS max_bytes, {_limit(1)} AS max_tokens FROM {_NAMES}",
    "lookup_model": f"SELECT name, {_CANON} AS canonical, {_limit(0)} AS max_bytes, {_CANON} IN ('nomic-embed-text', 'nomic-embed-text-v2', 'embeddinggemma') AS has_prompts, {_limit(0)} > 0 AS known FROM {_NAMES}",
    "effective_limits": "SELECT model, set_bytes, set_tokens, ratio::DOUBLE AS ratio, CASE WHEN set_bytes > 0 THEN set_bytes WHEN known THEN 6000 ELSE floor(set_tokens * CASE WHEN ratio > 0 THEN ratio ELSE 2 END)::INTEGER END AS max_bytes, CASE WHEN set_tokens > 0 THEN set_tokens ELSE 2000 END AS max_tokens FROM (SELECT *, model = 'nomic-embed-text' AS known FROM (VALUES ('nomic-embed-text', 0, 0, 0.0), ('nomic-embed-text', 100, 0, 0.0), ('x', 0, 1000, 1.75), ('x', 0, 1000, 0.0), ('x', 50, 1000, 1.75)) v(model, set_bytes, set_tokens, ratio))",
    "alias_models": "SELECT name, canonical, CASE WHEN lower(name) = 'bge-reranker-v2-m3:q8' THEN 18000 WHEN canonical IN ('nomic-embed-text', 'nomic-embed-text-v2', 'embeddinggemma') THEN 6000 ELSE 0 END AS max_bytes, CASE WHEN lower(name) = 'bge-reranker-v2-m3:q8' THEN 6000 WHEN canonical IN ('nomic-embed-text', 'nomic-embed-text-v2', 'embeddinggemma') THEN 2000 ELSE 0 END AS max_tokens FROM (SELECT name, CASE lower(name) WHEN ':odd' THEN 'embeddinggemma' WHEN 'nomic-embed-text-v2-moe' THEN 'nomic-embed-text-v2' ELSE " + _CANON + " END AS canonical FROM " + _NAMES + ")",
    "registered_limits": f"SELECT name, CASE k WHEN 'unknown-model' THEN 700 WHEN 'nomic-embed-text-v2' THEN 6000 WHEN 'bge-reranker-v2-m3' THEN 18000 ELSE 0 END AS max_bytes, CASE k WHEN 'nomic-embed-text' THEN 512 WHEN 'nomic-embed-text-v2' THEN 2000 WHEN 'bge-reranker-v2-m3' THEN 6000 ELSE 0 END AS max_tokens FROM (SELECT name, {_CANON} AS k FROM {_NAMES})",
    "strict_model": f"SELECT name, CASE WHEN k NOT IN ('nomic-embed-text', 'nomic-embed-text-v2', 'embeddinggemma', 'bge-reranker-v2-m3') THEN 'embedding: model ''' || name || ''' is not recognised (canonical ''' || k || '''): no prefixes and no budget would apply' END AS error FROM (SELECT name, {_CANON} AS k FROM {_NAMES})",
    "own_prompters": "SELECT doc_id, '[clustering] ' || source AS mine, source AS gone, '<' || coalesce(lang, '') || '> ' || CASE WHEN coalesce(lang, '') = '' THEN source WHEN source = '' THEN 'lang: ' || lang ELSE 'lang: ' || lang || chr(10) || chr(10) || source END AS document FROM documents",
    "settings": "SELECT own_model, model, own_bytes, bytes, own_timeout, timeout, CASE WHEN good THEN coalesce(nullif(own_model, ''), nullif(model, ''), 'nomic-embed-text') END AS found_model, CASE WHEN good THEN coalesce(TRY_CAST(b AS INTEGER), 0) END AS found_bytes, CASE WHEN good THEN CASE WHEN t IS NULL THEN 0 WHEN t = 'none' THEN -1 ELSE coalesce(TRY_CAST(regexp_extract(t, '([0-9]+)h', 1) AS DOUBLE), 0) * 3600 + coalesce(TRY_CAST(regexp_extract(t, '([0-9]+)m', 1) AS DOUBLE), 0) * 60 + coalesce(TRY_CAST(regexp_extract(t, '([0-9]+)s', 1) AS DOUBLE), 0) END::DOUBLE END AS found_timeout, good FROM (SELECT *, coalesce(regexp_matches(b, '^[+]?0*[1-9][0-9]*$'), true) AND coalesce(t = 'none' OR regexp_matches(t, '^([0-9]+[hms])+$'), true) AS good FROM (SELECT *, coalesce(nullif(own_bytes, ''), nullif(bytes, '')) AS b, coalesce(nullif(own_timeout, ''), nullif(timeout, '')) AS t FROM (VALUES " + ", ".join("(" + ", ".join(map(_q, c)) + ")" for c in SETTINGS) + ") v(own_model, model, own_bytes, bytes, own_timeout, timeout)))",
    "fingerprint_compare": "SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN 'embedding: stored vectors are ''m'' of ' || len(embedding) || ', current ones ''m'' of 3' END AS error FROM embeddings",
    "embed_shrinking": f"WITH RECURSIVE s AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, h, CASE WHEN p < n AND {_follows('p')} THEN CASE WHEN {_follows('p - 1')} THEN CASE WHEN {_follows('p - 2')} THEN p - 3 ELSE p - 2 END ELSE p - 1 END ELSE p END FROM (SELECT *, greatest(n * 4 // 5, 256) AS p FROM s WHERE n > 1000)) SELECT doc_id, n::INTEGER AS bytes, NULL::VARCHAR AS error FROM s WHERE n <= 1000 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL",
    "classify_http": f"SELECT status, body, status BETWEEN 400 AND 499 AS permanent, status BETWEEN 400 AND 499 AND {_TOO_LONG} AS too_long FROM {_ANSWERS}",
    "rerank_classify": f"SELECT status, body, status = 429 OR status >= 500 AS unavailable, status <> 429 AND status BETWEEN 400 AND 499 AS permanent, status <> 429 AND status BETWEEN 400 AND 499 AND {_TOO_LONG} AS too_long FROM {_ANSWERS}",
    "context_length": f"SELECT status, body, {_TOO_LONG} AS context_length FROM {_ANSWERS}",
    "cosine_pairs": f"SELECT * FROM {_PAIRS}",
    "cosine_topk": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index)::INTEGER AS rank FROM {_PAIRS}) WHERE rank <= 10",
    "cosine_guards": "SELECT vec_id, 0.0::DOUBLE AS zero, 0.0::DOUBLE AS uneven, 0.0::DOUBLE AS empty FROM embeddings",
    "codec_roundtrip": "SELECT vec_id, len(embedding)::INTEGER * 4 AS bytes, true AS same, 2 AS cut, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings",
    "fingerprint_check": "SELECT DISTINCT 'nomic-embed-text' AS model, len(embedding)::INTEGER AS dim FROM embeddings",
    "usage_rows": f"SELECT seq, model, 1 AS inputs, bytes, tokens, 500 AS max_tokens, tokens >= 500 AS clipped FROM {_LOG}",
    "calibration": _calibration(4096),
    "calibration_window": _calibration(50),
    "sigmoid_scores": f"SELECT query_id, doc_index, round(1 / (1 + exp(-score * 10)), 6) AS score FROM {_PAIRS}",
    "rerank_topn": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index)::INTEGER AS rank FROM {_PAIRS}) WHERE rank <= 3",
    "rerank_ties": f"SELECT query_id, doc_index, round(score, 1) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, doc_index)::INTEGER AS rank FROM {_PAIRS}",
    "rerank_lengths": "SELECT query_id, doc_index, score, true AS available, CASE WHEN score IS NULL THEN 'rerank: no document' END AS error, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_index)::INTEGER AS rank FROM (SELECT coalesce(source, 'none') AS query_id, doc_id AS doc_index, (length(text) % 97)::DOUBLE AS score FROM documents)",
    "rerank_normalized": "SELECT query_id, doc_index, round(1 / (1 + exp(-score)), 9) AS score, true AS available, CASE WHEN score IS NULL THEN 'rerank: no document' END AS error, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_index)::INTEGER AS rank FROM (SELECT coalesce(source, 'none') AS query_id, doc_id AS doc_index, (length(text) % 97)::DOUBLE AS score FROM documents)",
    "cache_split": f"SELECT conv_id, turn, {_KEY} IN (SELECT {_KEY} FROM {_QUERIES} WHERE conv_id % 3 = 0) AS hit FROM {_QUERIES}",
    "cache_evict": f"SELECT * FROM (SELECT sha256({_KEY}) AS key, max(conv_id) AS last_used FROM {_QUERIES} GROUP BY ALL) ORDER BY last_used DESC, key LIMIT 20",
    "token_count": r"SELECT doc_id, len(regexp_extract_all(text, '[^\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'))::INTEGER AS n FROM documents",
    "split_bytes": _split(1024, 0) + _OFFSETS,
    "split_overlap": _split(1024, 128) + _OFFSETS,
    "split_full": _split(1024, 128) + _texts("sp"),
    "split_sql": _split(2000, 0) + _texts("sp"),
    "split_minbytes": _split(1000, 0) + _absorbed(1000, 300) + _texts("fin"),
    "headings": f"WITH RECURSIVE {_HEADINGS} SELECT doc_id, start, level, title, path FROM hd",
    "split_markdown": _split(400, 0, "SELECT doc_id, text, coalesce((SELECT list(start::BIGINT) FROM hd WHERE hd.doc_id = md.doc_id), []) AS starts FROM md", _HEADINGS + ",", True) + _texts("sp", ", CASE WHEN length(t) > 400 THEN (SELECT arg_max(path, start) FROM hd WHERE hd.doc_id = sp.doc_id AND hd.start <= cs) END AS headings"),
    "embed_hash": "WITH" + _vectors("SELECT doc_id AS id, text FROM documents") + "SELECT id AS doc_id, place, round(value::DOUBLE, 6) AS value FROM ve",
    "batch_embed_results": "SELECT doc_id, 64 AS dim, true AS good FROM documents",
    "cached_embedding": "WITH" + _vectors(f"SELECT row_number() OVER () AS id, conv_id || ':' || turn AS row_id, {_KEY} AS key, text FROM {_QUERIES}") + "SELECT row_id, key IN (SELECT key FROM ask WHERE row_id LIKE '1%') AS cached, place, round(value::DOUBLE, 6) AS value FROM ve JOIN ask USING (id)",
    "flagship": _split(1024, 128, f"SELECT page_id AS doc_id, {_strip('html')} AS text, []::BIGINT[] AS starts FROM pages") + f", ch AS ({_texts('sp')})," + _vectors("SELECT doc_id || ':' || ordinal AS id, text FROM ch UNION ALL SELECT '', 'the report of the year'") + f", v AS (SELECT id, list(value ORDER BY place) AS v FROM ve GROUP BY id) SELECT a.id AS row_id, round({_cosine('a.v', 'q.v')}, 6) AS score FROM v a, v q WHERE q.id = '' AND a.id <> '' ORDER BY score DESC, row_id LIMIT 5",
}
