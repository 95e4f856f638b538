"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from linkmap.llm import chat
from linkmap.llm.quality import Thresholds

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_T = "coalesce(text, '')"
_AT = Thresholds()

#: All 100-byte windows by content; islands of lost windows; what lies between them. Two hexadecimal digits stand for a byte.
SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, hex({_T}) AS x, octet_length(encode({_T})) AS n FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT *, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
lost AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
marked AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM lost),
isles AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM isles GROUP BY doc_id, g),
gaps AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM spans),
parts AS (SELECT g.doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head, max(b) AS e, sum(b - a) AS removed, count(*) AS c FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)"""

_TURNS = f"""turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, {_T} AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{{odd}}' UNION ALL SELECT -1, 1, 'assistant', '{{odd}}')"""


def _escaped(c: str) -> str:
    return f"regexp_replace({c}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"


def chat_sql(odd: str) -> str:
    fixed = len(chat.START) + len(chat.END) + 2
    role = _escaped("replace(replace(role, '%', '%25'), chr(10), '%0A')")
    return f"""WITH {_TURNS.format(odd=odd)}
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length({role}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


LINE_DEDUP = f"""
WITH s AS (SELECT doc_id, string_split({_T}, chr(10)) AS x FROM documents),
l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM s)),
k AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, first FROM p JOIN f USING (h)),
b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT)) AS v FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM b"""

_MEASURED = f"""
w AS (SELECT doc_id, {_T} AS t, list_filter(regexp_split_to_array({_T}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
tri AS (SELECT doc_id, i, words[i + 1] AS a, words[i + 2] AS b, words[i + 3] AS c FROM (SELECT doc_id, words, unnest(range(len(words) - 2)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split({_T}, chr(10)), lambda x: trim(x, {_SPACE}) <> '') AS lines FROM documents),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(t, {_SPACE}, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_capitals, coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest_word
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))"""
_FAILS = [
    f"n_words < {_AT.min_words}",
    f"100 * n_repeat_words > {_AT.max_repeat_percent} * n_words",
    f"100 * n_symbols > {_AT.max_symbol_percent} * n_words",
    f"100 * n_dup_lines > {_AT.max_dup_line_percent} * n_lines",
    f"word_chars < {_AT.min_mean_word} * n_words OR word_chars > {_AT.max_mean_word} * n_words",
    f"100 * n_capitals > {_AT.max_capital_percent} * word_chars",
    f"longest_word > {_AT.max_word}",
]
QUALITY = f"""WITH {_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_FAILS[0]}) OR ({_FAILS[1]}) AS base_failed, NOT ({' OR '.join(f'({x})' for x in _FAILS[:6])}) AS kept,
  CAST({' + '.join(f'CASE WHEN {x} THEN {1 << i} ELSE 0 END' for i, x in enumerate(_FAILS))} AS BIGINT) AS failed_bits FROM m"""
