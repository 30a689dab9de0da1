"""The queries that SQL can express, as DuckDB SQL."""

from __future__ import annotations

RULES = (
    ("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow"),
)  # the longest first


def _case(value: str) -> str:
    """What the longest fitting rule says: its name or its verdict."""
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value == 'rule' else v}'" for h, p, v in RULES
    ) + " END"


LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The url after its first ://, the query and the fragment cut off by position.
REST = "CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN split_part(split_part(url[strpos(url, '://') + 3:], '?', 1), '#', 1) ELSE '' END"
HREF = r"""(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''>\s]+)"""

URL_FILTERS = rf"""WITH RECURSIVE parsed AS (
  SELECT page_id, html, {LOWER.format(x="split_part(rest, '/', 1)")} AS host, rest[length(split_part(rest, '/', 1)) + 1:] AS path
  FROM (SELECT *, {REST} AS rest FROM pages)
), judged AS (SELECT *, {_case('rule')} AS rule, {_case('verdict')} AS said FROM parsed
), seeds AS (
  SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust, avg(CASE WHEN said = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust
  FROM judged WHERE host <> '' GROUP BY host
), links AS (
  SELECT host AS src, {LOWER.format(x='dst')} AS dst, count(*) AS n FROM (SELECT host, unnest(regexp_extract_all(html, '{HREF}', 1)) AS dst FROM judged) GROUP BY 1, 2 HAVING src <> {LOWER.format(x='dst')} AND src <> ''
), shares AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links
), edges AS (SELECT *, share / sum(share) OVER (PARTITION BY dst) AS back FROM shares
), ranks AS (
  SELECT 0 AS k, host, trust, distrust FROM seeds
  UNION ALL
  SELECT k, host, sum(t), sum(d) FROM (
    SELECT r.k + 1 AS k, s.host, s.trust AS t, s.distrust AS d FROM seeds s, (SELECT DISTINCT k FROM ranks) r
    UNION ALL SELECT r.k + 1, e.dst, 0.85::DOUBLE * e.share * r.trust, 0 FROM edges e JOIN ranks r ON r.host = e.src
    UNION ALL SELECT r.k + 1, e.src, 0, 0.85::DOUBLE * e.back * r.distrust FROM edges e JOIN ranks r ON r.host = e.dst
  ) WHERE k <= 10 GROUP BY k, host
)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0)::DOUBLE AS trust, coalesce(distrust, 0)::DOUBLE AS distrust
FROM judged j LEFT JOIN (SELECT * FROM ranks WHERE k = 10) r ON r.host = j.host"""

CHAT_FORMATTING = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
), n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<|im_start|>') + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) + 1 + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) + length('<|im_end|>') + 1 AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM n)
SELECT conv_id, any_value(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant')), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""

WARC = """WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM o"""

#: Every term of every group, present or not, without supports or histograms.
SOURCE_DIVERGENCE = r"""WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all({text}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), kept AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(DISTINCT id) >= 10
), groups AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), n AS (SELECT lang, source, term, count(*) AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER t AS lang_n,
    sum(coalesce(n.n, 0)) OVER s AS total, count(*) OVER s AS v
  FROM groups g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)
  WINDOW t AS (PARTITION BY g.lang, k.term), s AS (PARTITION BY g.lang, g.source)
), shares AS (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT)::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (lang_n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT)::BIGINT AS q FROM cells
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), said AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), placed AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM said)
SELECT * FROM placed WHERE part = 'pair' OR rank <= 10""".replace("{text}", LOWER.format(x="coalesce(text, '')"))

#: crc32 of the decimal doc_id, bit by bit.
CRC = """xor(list_reduce([4294967295::UBIGINT] || list_transform(range(8 * length({x})), lambda k: k::UBIGINT), lambda c, k:
    CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(c, ascii({x}[(k // 8 + 1)::INTEGER])::UBIGINT) ELSE c END) % 2 = 1
    THEN xor((CASE WHEN k % 8 = 0 THEN xor(c, ascii({x}[(k // 8 + 1)::INTEGER])::UBIGINT) ELSE c END) >> 1, 3988292384::UBIGINT)
    ELSE (CASE WHEN k % 8 = 0 THEN xor(c, ascii({x}[(k // 8 + 1)::INTEGER])::UBIGINT) ELSE c END) >> 1 END), 4294967295::UBIGINT)"""

#: Two places with the same word q apart are a pair; consecutive pairs of one q are a stretch of period q. A stretch that
#: lies in one of a smaller period has that one.
PERIODIC_RUNS = r"""WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {crc}::BIGINT AS h
  FROM documents
), s AS (
  SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM d
), w AS (
  SELECT id, i, CASE WHEN i < a OR a IS NULL THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM s)
), sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM w
), pairs AS (
  SELECT x.id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.id, y.i - x.i ORDER BY x.i) AS island
  FROM sized x JOIN sized y ON x.id = y.id AND x.word = y.word AND x.i < y.i AND (y.i - x.i) * 4 <= x.n
), stretches AS (
  SELECT id, q AS period, min(i) AS start, count(*) + q AS length FROM pairs GROUP BY id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM stretches r WHERE NOT EXISTS (SELECT 1 FROM stretches o WHERE o.id = r.id AND o.period < r.period AND o.start <= r.start AND o.start + o.length >= r.start + r.length)
), told AS (
  SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY id
), best AS (
  SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.id = r.id AND (o.length * r.period > r.length * o.period
    OR o.length * r.period = r.length * o.period AND (o.start < r.start OR o.start = r.start AND o.period < r.period)))
), kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY i) AS text FROM w
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.id = w.id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM s LEFT JOIN told USING (id) LEFT JOIN best USING (id) LEFT JOIN kept USING (id)""".replace("{crc}", CRC.format(x="(doc_id::VARCHAR)"))

ORACLE_SQL = {
    "op6_url_filters": URL_FILTERS, "op7_chat_formatting": CHAT_FORMATTING, "op10_warc": WARC, "op11_source_divergence": SOURCE_DIVERGENCE,
    "op12_periodic_runs": PERIODIC_RUNS,
}
