"""The registered queries of the operators, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from .attention_lm import score_documents
from .chat import rotate_perspectives
from .common import read
from .decontamination import contamination
from .divergence import divergences
from .licences import scan_licences
from .line_dedup import dedup_lines
from .mixing import mixture
from .pieces import encode_documents
from .posting_lists import nearest
from .quality import quality_verdicts
from .resampling import resampled
from .sharding import shard_documents
from .signature_trees import jaccard_components


def op1_sharding(spark, sf_dir):
    return shard_documents(read(spark, sf_dir, "documents"), 24)


def op2_lm_scoring(spark, sf_dir):
    return score_documents(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    out = quality_verdicts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_chat_formatting(spark, sf_dir):
    return rotate_perspectives(read(spark, sf_dir, "conversations"))


def op5_line_dedup(spark, sf_dir):
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scans(spark, sf_dir):
    return scan_licences(read(spark, sf_dir, "documents"))


def op7_nearest(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_source_mixing(spark, sf_dir):
    return mixture(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"), k=3, percent=90)


def op10_sentencepiece(spark, sf_dir):
    return encode_documents(read(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergences(read(spark, sf_dir, "documents"), least_docs=3, top=200)


def op12_decontamination(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=10)


def op13_importance_resampling(spark, sf_dir):
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, least_words=20, buckets=10_000, longest=1, seed="2024")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_lm_scoring,
        op3_quality_rules,
        op4_chat_formatting,
        op5_line_dedup,
        op6_license_scans,
        op7_nearest,
        op8_source_mixing,
        op9_jaccard_join,
        op10_sentencepiece,
        op11_source_divergence,
        op12_decontamination,
        op13_importance_resampling,
    )
}
# DuckDB has no crc32, so its table is made by the usual rule and folded over the bytes.
_SHARDING = """WITH RECURSIVE c(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
 tab AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
 d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
 h AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d, tab),
 b AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM h),
 s AS (SELECT *, least((before * 2 + size) * 24 // (2 * total), 23)::INT AS shard FROM b)
 SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM s"""

_ROTATION = """WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
 n AS (SELECT *, row_number() OVER w AS pos, (sum(length(text) + 64) OVER w - length(text) - 64) // 200000 AS part FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)),
 v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
 r AS (SELECT n.conv_id, v.perspective, part, pos, n.speaker = v.perspective AS own, replace(text, '<|', '< |') || '<|im_end|>' AS body,
  CASE WHEN n.speaker = 'system' THEN '<|im_start|>system' || chr(10) WHEN n.speaker = v.perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || replace(n.speaker, '<|', '< |') || chr(10) END AS head
  FROM n JOIN v ON n.conv_id IS NOT DISTINCT FROM v.conv_id),
 o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS starts FROM r)
 SELECT conv_id, perspective, part::INT AS part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY pos) AS text, coalesce(list(starts::BIGINT ORDER BY pos) FILTER (own), []) AS mask_starts,
 coalesce(list((starts + length(body))::BIGINT ORDER BY pos) FILTER (own), []) AS mask_ends, coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_learned FROM o GROUP BY ALL"""

_JOIN = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS x FROM w),
 e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
 SELECT doc_id, len(x)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS component_id FROM s"""

_QUALITY = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
 v AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 3),
 g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS c FROM v),
 q AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS place FROM g WHERE c > 1) GROUP BY doc_id),
 b AS (SELECT doc_id, text, words, len(lines) AS n_lines, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN q USING (doc_id)),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines OR 20 * len(list_distinct(words)) < n_words
  OR 2 * len(regexp_extract_all(text, '\p{L}')) < word_chars OR 10 * len(regexp_extract_all(text, '(?m)(\.\.\.|…)$')) > 3 * n_lines OR 10 * len(regexp_extract_all(text, '(?m)^[ \t]*[•*-] ')) > 9 * n_lines) AS kept FROM f"""

# Dense, where the operator is sparse: every kept term of a language against every source.
_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
 t AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
 k AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(*) >= 3),
 c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, sum(total) AS ln FROM k GROUP BY ALL), s AS (SELECT lang, source, sum(n) AS gn FROM c GROUP BY ALL),
 a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.gn, 0) + v.v) AS p, 1 + 1000000000 * (k.total + 1) // (v.ln + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
 f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
 o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM a WHERE n > 0 AND p > q)
 SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o QUALIFY part = 'pair' OR rank <= 200"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, w, least(len(w), 10) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
 x AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM b),
 r AS (SELECT rid, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + l - 1], ' ')}})) AS z FROM d, (SELECT DISTINCT l FROM b)),
 m AS (SELECT rid, z.i AS i, x.l AS l, item_id FROM r JOIN x ON x.l = r.l AND x.g = r.z.g),
 h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM m) GROUP BY rid),
 j AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN j USING (rid)"""

_RESAMPLING = f"""WITH RECURSIVE c(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
 tab AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
 d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
 dw AS (SELECT rid, unnest(w) AS word FROM d), bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
 u AS (SELECT word, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
 k AS (SELECT word, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM u, tab),
 s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (word) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (word) GROUP BY ALL),
 n AS (SELECT (SELECT count(*) FROM dw) + 10000 AS sn, (SELECT count(*) FROM bw) + 10000 AS tn),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * sn::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * tn::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), n),
 w AS (SELECT rid, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY ALL),
 z AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (rid)),
 o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS r FROM z)
 SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM z WHERE n_features >= 20) // 100 THEN r END AS rank FROM o"""

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": _SHARDING, "op3_quality_rules": _QUALITY, "op4_chat_formatting": _ROTATION, "op9_jaccard_join": _JOIN,
    "op11_source_divergence": _DIVERGENCE, "op12_decontamination": _CONTAMINATION, "op13_importance_resampling": _RESAMPLING,
}
