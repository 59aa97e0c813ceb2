"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import byte_bpe, decontaminate, line_dedup, lm_scoring, near_dedup, pii, prefix_trie, quality_rules, resampling, substring_dedup, token_counts, toxicity, warc
from parlance.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), size=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments", "problem")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_spread_lines(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    found = (op1_quality_rules, op2_pii, op3_decontamination, op4_substring_dedup, op5_byte_bpe, op6_minhash, op7_token_counts, op8_lm_scoring, op9_warc, op10_line_dedup, op11_conversation_trie, op12_importance_resampling, op13_toxicity)
    return {q.__name__: q for q in found}


OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.r = w.r),
q AS (SELECT *, (n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words) AS base_failed,
             100 * word_chars // greatest(n_words, 1) AS word_length, {quality_rules.SCALE} * n_symbols // greatest(word_chars, 1) AS symbol_share,
             {quality_rules.SCALE} * n_dup_lines // greatest(n_words, 1) AS dup_line_rate, {quality_rules.SCALE} * n_repeat_words // greatest(n_words, 1) AS repeat_share FROM m),
v AS (SELECT lang, source, unnest([{', '.join(f"{{'ratio': '{k}', 'x': {k}}}" for k in quality_rules.RATIOS)}]) AS u FROM q WHERE NOT base_failed),
b AS (SELECT lang, source, u.ratio AS ratio, u.x - u.x % CAST(pow(2, greatest(length(bin(u.x)) - {quality_rules.SKETCH_BITS}, 0)) AS BIGINT) AS x FROM v),
l AS (SELECT 0 AS level, lang, source, ratio, x FROM b UNION ALL SELECT 1, lang, NULL, ratio, x FROM b UNION ALL SELECT 2, NULL, NULL, ratio, x FROM b),
c AS (SELECT level, lang, source, ratio, x, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY x) AS seen, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total FROM c),
a AS (SELECT *, 100 * seen // total AS upto, 100 * (seen - n) // total AS before, CAST(pow(2, greatest(length(bin(x)) - {quality_rules.SKETCH_BITS}, 0)) AS BIGINT) AS step FROM s),
z AS (SELECT *, min(x) FILTER (upto >= {quality_rules.MIDDLE}) OVER g AS mid, min(x) FILTER (upto >= {quality_rules.UPPER}) OVER g AS up, min(x) FILTER (upto >= {quality_rules.LOWER}) OVER g AS down FROM a WINDOW g AS (PARTITION BY level, lang, source, ratio)),
y AS (SELECT *, CAST(pow(2, greatest(length(bin(mid)) - {quality_rules.SKETCH_BITS}, 0)) AS BIGINT) AS unit, lead(x) OVER g AS nxt, lag(x) OVER g AS lst FROM z WHERE upto > before OR seen = n WINDOW g AS (PARTITION BY level, lang, source, ratio ORDER BY x)),
f AS (SELECT *, (1.0::DOUBLE + greatest(up, mid + unit)) / (1.0::DOUBLE + mid) AS ru, (1.0::DOUBLE + mid) / (1.0::DOUBLE + least(down, greatest(mid - unit, 0))) AS rd FROM y),
h AS (SELECT level, lang, source, ratio, max(total) AS total, arg_min((x + nxt) // 2, x) FILTER (upto >= {quality_rules.UPPER} AND 1.0::DOUBLE + nxt > (1.0::DOUBLE + x) * (ru * ru * ru * ru * ru)) AS high,
             CASE WHEN ratio = 'word_length' THEN arg_max((x + lst) // 2, x) FILTER (before < {quality_rules.LOWER} AND x <= down AND 1.0::DOUBLE + x > (1.0::DOUBLE + lst) * (rd * rd * rd * rd * rd)) END AS low FROM f GROUP BY level, lang, source, ratio),
k AS (SELECT q.r, q.lang, q.source, u.ratio AS ratio, u.x AS x FROM (SELECT r, lang, source, unnest([{', '.join(f"{{'ratio': '{k}', 'x': {k}}}" for k in quality_rules.RATIOS)}]) AS u FROM q) q),
j AS (SELECT k.r, bool_or(coalesce(k.x > CASE WHEN o.total >= {quality_rules.LEAST_GROUP} THEN o.high WHEN p.total >= {quality_rules.LEAST_GROUP} THEN p.high ELSE a.high END, false)
                       OR coalesce(k.x < CASE WHEN o.total >= {quality_rules.LEAST_GROUP} THEN o.low WHEN p.total >= {quality_rules.LEAST_GROUP} THEN p.low ELSE a.low END, false)) AS beyond
      FROM k LEFT JOIN h o ON o.level = 0 AND o.lang IS NOT DISTINCT FROM k.lang AND o.source IS NOT DISTINCT FROM k.source AND o.ratio = k.ratio
             LEFT JOIN h p ON p.level = 1 AND p.lang IS NOT DISTINCT FROM k.lang AND p.ratio = k.ratio
             LEFT JOIN h a ON a.level = 2 AND a.ratio = k.ratio GROUP BY k.r)
SELECT q.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT beyond) AS kept, word_length, symbol_share, dup_line_rate, repeat_share
FROM q JOIN j ON j.r = q.r
"""

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM t),
gone AS (SELECT r, list(p) AS ps, count(*) AS n FROM g GROUP BY r),
k AS (SELECT u.r, string_agg(u.w, ' ' ORDER BY u.p) AS kept FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d) u LEFT JOIN g ON g.r = u.r AND g.p = u.p WHERE g.p IS NULL GROUP BY u.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.r = d.r LEFT JOIN k ON k.r = d.r
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM d),
n AS (SELECT r, doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT r, unnest(sh) AS g FROM s WHERE doc_id IS NOT NULL),
c AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x.doc_id AS u, y.doc_id AS v FROM c JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * c >= 80 * (x.n + y.n - c)),
k AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach AS (SELECT doc_id AS d, doc_id AS m FROM n WHERE doc_id IS NOT NULL UNION SELECT k.v, reach.m FROM reach JOIN k ON k.u = reach.d),
o AS (SELECT d, min(m) AS m FROM reach GROUP BY d)
SELECT n.doc_id, n.n AS n_shingles, coalesce(o.m, n.doc_id) AS component_id, coalesce(n.doc_id = o.m, true) AS kept FROM n LEFT JOIN o ON o.d = n.doc_id
"""

OP9 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {warc.LEAST_REVISIT} GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, CASE WHEN page_id <> first THEN 1 ELSE {{segments}} END AS n_segments, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN f ON f.h = p.h
"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, source, line, i FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
b AS (SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= {line_dedup.SITES}),
k AS (SELECT r, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS kept FROM l LEFT JOIN b ON b.line = l.line GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r
"""


#: unsigned CRC-32 of a text's UTF-8 bytes, by a table made of eight steps a byte
CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || [CAST(k AS BIGINT) FOR k IN range(8)], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, 1 + octet_length(encode({x}))), lambda i: ('0x' || substring(hex(encode({x})), CAST(2 * i - 1 AS BIGINT), 2))::BIGINT), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"

OP11 = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'l': label, 'c': chars}} ORDER BY turn NULLS FIRST, label) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, {CRC.format(x='CAST(conv_id AS VARCHAR)')} % 6 AS h FROM o, crc),
p AS (SELECT h.conv_id, coalesce(f.own[1:h.h], []) || h.own[h.h + 1:] AS path FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % {prefix_trie.FAMILY}),
b AS (SELECT conv_id, len(path) AS size, unnest(range(len(path) + 1)) AS depth, path FROM p),
k AS (SELECT conv_id, size, depth, array_to_string(list_transform(path[1:depth], lambda x: x.l), ' ') AS prefix, array_to_string(list_transform(path[1:depth - 1], lambda x: x.l), ' ') AS above, CASE WHEN depth > 0 THEN path[depth].c ELSE 0 END AS chars FROM b),
n AS (SELECT depth, prefix, CASE WHEN depth > 0 THEN any_value(above) END AS above, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends FROM k GROUP BY depth, prefix),
c AS (SELECT above, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(c.n, 0) AS kids FROM n LEFT JOIN c ON c.above = n.prefix AND c.depth = n.depth),
s AS (SELECT a.depth, a.prefix, count(*) FILTER (d.kids = 0) AS leaves, sum((d.n - 1) * d.chars) AS saved FROM m a JOIN m d ON d.depth >= a.depth AND (a.depth = 0 OR d.prefix = a.prefix OR starts_with(d.prefix, a.prefix || ' ')) GROUP BY ALL)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s ON s.depth = m.depth AND s.prefix = m.prefix LEFT JOIN n u ON u.depth = m.depth - 1 AND u.prefix = m.above
"""

OP12 = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
x AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
f AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
g AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM x) GROUP BY ALL),
v AS (SELECT w, {CRC.format(x='w')} % {resampling.BUCKETS} AS b FROM (SELECT w FROM f UNION SELECT w FROM g) u, crc),
s AS (SELECT b, sum(n) AS n FROM f JOIN v USING (w) GROUP BY b), t AS (SELECT b, sum(n) AS n FROM g JOIN v USING (w) GROUP BY b),
z AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS t),
k AS (SELECT s.b, floor(1000.0::DOUBLE * ln(((coalesce(t.n, 0)::DOUBLE + 1) * (z.s + {resampling.BUCKETS})) / ((s.n::DOUBLE + 1) * (z.t + {resampling.BUCKETS})))) AS gain FROM s LEFT JOIN t ON t.b = s.b, z),
q AS (SELECT r, sum(n) AS n, sum(n * gain) AS gain FROM f JOIN v USING (w) JOIN k USING (b) GROUP BY r),
w AS (SELECT d.r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(gain / n), 0) AS BIGINT) AS weight, CAST('0x' || substring(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN q ON q.r = d.r),
e AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w),
y AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM e WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= floor({resampling.PERCENT} * (SELECT count(*) FROM y) / 100) THEN rank END AS rank FROM e LEFT JOIN y USING (r)
"""


def oracle_sql() -> dict[str, str]:
    head = len(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n")
    # a block: head, per chunk its length in hexadecimal digits and two line breaks, the last chunk
    rest = f"n % {warc.CHUNK}"
    block = f"({head} + n + (n // {warc.CHUNK}) * {len('%x' % warc.CHUNK) + 4} + CASE WHEN {rest} > 0 THEN length(format('{{:x}}', {rest})) + 4 ELSE 0 END + 5)"
    segments = f"CAST(ceil({block} / {warc.SEGMENT}.0) AS INTEGER)"
    return {"op1_quality_rules": OP1, "op4_substring_dedup": OP4, "op6_minhash": OP6, "op9_warc": OP9.replace("{segments}", segments), "op10_line_dedup": OP10, "op11_conversation_trie": OP11, "op12_importance_resampling": OP12}
