"""DuckDB SQL that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from . import chat, quality, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACE, _SYMBOLS, _MARKS = map(_quoted, (quality.SPACE, quality.SYMBOLS, quality.MARKS))
_FAILS = f"""(length(x) - length(regexp_replace(x, {_MARKS}, '', 'g')) > {quality.MOST_MARKS}::double * length(regexp_replace(x, {_SPACE}, '', 'g'))
  OR len(regexp_split_to_array(x, {_quoted(quality.BAR)})) > {quality.BAR_SEPARATORS} OR regexp_matches(x, {_quoted(quality.LABEL)}) OR regexp_matches(x, {_quoted(quality.NOTICE)}))"""

QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
f AS (SELECT *, list_filter(lines, lambda x: {_FAILS}) AS failed FROM w),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
c AS (SELECT f.doc_id, len(words)::bigint AS n_words, length(regexp_replace(t, {_SPACE}, '', 'g'))::bigint AS word_chars, (length(t) - length(regexp_replace(t, {_SYMBOLS}, '', 'g')))::bigint AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(covered.n, 0)::bigint AS n_repeat_words, len(lines)::bigint AS n_lines, len(failed)::bigint AS n_failed_lines,
  coalesce(list_sum([length(regexp_replace(x, {_SPACE}, '', 'g')) FOR x IN failed]), 0)::bigint AS lost_chars FROM f LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND lost_chars <= {quality.MOST_LOST}::double * word_chars AS kept FROM b"""


def _spans(order: int, rule: secrets.Rule) -> str:
    pattern = _quoted(rule.pattern)
    return f"""SELECT doc_id, {order} AS rank, {_quoted(rule.kind)} AS kind, s AS start, s + length(ms[i]) AS stop FROM (
  SELECT *, (list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(m) FOR m IN ms[1:i - 1]]), 0))::bigint AS s FROM (
    SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {pattern}, 0) AS ms, regexp_extract_all(t, {pattern}, {rule.group}) AS gs, regexp_split_to_array(t, {pattern}) AS gaps FROM d)))
  WHERE length(gs[i]) >= {rule.least}"""


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(secrets.RULES))}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for plain, shown in chat.CONTROL:
        out = f"replace({out}, {_quoted(plain)}, {_quoted(shown)})"
    return out


CHATS = f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{chat.LOSS_ROLE}'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
  sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.OPEN) + len(chat.CLOSE) + len(chat.END)})::bigint AS formatted_chars FROM m GROUP BY 1"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {10 * b + 1}, 10))::bigint >> {35 - 5 * j}) & 31)::int + 1, 1)" for b in range(4) for j in range(8))
ARCHIVES = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), m AS (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS keeper FROM p)
SELECT page_id, strlen(t)::bigint AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM m"""

ORACLE_SQL = {"op1_quality_rules": QUALITY, "op2_secret_scan": SECRETS, "op3_chat_formatting": CHATS, "op5_warc": ARCHIVES}
