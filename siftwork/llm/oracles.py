r"""SQL for the operators whose results SQL can express."""

from __future__ import annotations

from siftwork.llm.chat import CLOSE, MIDDLE, OPEN
from siftwork.llm.collocation import LEAST, TOP
from siftwork.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS
from siftwork.llm.secrets import EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, KINDS

_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, text, {_W} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT d.doc_id, (SELECT min(reach) FROM r WHERE r.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links, min(d.doc_id) OVER (PARTITION BY d.text) AS text_id FROM documents d"""

QUALITY = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_W} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (VALUES (0), (1), (2)) t(d) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, len(l) AS lines, len(l) - len(list_distinct(l)) AS dup FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w)),
c AS (SELECT w.doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols, dup AS n_dup_lines, lines, coalesce(r.n, 0) AS n_repeat_words,
length(text) - length(regexp_replace(text, '[!?]+', '', 'g')) AS marks, length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS capitals FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT (n_symbols > 0.25 * n_words OR n_dup_lines > 0.5 * lines OR word_chars > 30 * n_words OR marks > 0.5 * n_words OR capitals > 0.5 * word_chars) AS kept FROM b"""

_ESCAPED = lambda c: f"(length({c}) + length(regexp_replace({c}, '[^\\\\<\\[]+', '', 'g')))"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
CAST(sum({len(OPEN + MIDDLE + CLOSE) + 1} + {_ESCAPED('role')} + {_ESCAPED('text')}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""

_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, source, {i} AS rank, {_QUOTED(k.name)} AS kind, {k.base} AS base, {k.least} AS least, regexp_extract_all(text, {_QUOTED(k.pattern)}) AS found, "
    f"regexp_extract_all(text, {_QUOTED(k.pattern)}, {k.value}) AS secret, string_split_regex(text, {_QUOTED(k.pattern)}) AS gaps FROM t"
    for i, k in enumerate(KINDS)
)
_SPANS = lambda condition: f"coalesce(string_agg(CASE WHEN {condition} THEN kind || ':' || start || ':' || stop END, ',' ORDER BY start, rank), '')"
SECRETS = f"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), m AS ({_MATCHES}),
e AS (SELECT doc_id, source, rank, kind, base, least, secret[i] AS value, length(found[i]) AS n, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS start
FROM (SELECT *, unnest(generate_series(1, len(found))) AS i FROM m)),
s AS (SELECT doc_id, source, rank, kind, base, value, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop FROM e WHERE length(value) >= least),
v AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) >= {EXAMPLE_OWNERS} OR count(DISTINCT doc_id) >= {EXAMPLE_REPOSITORIES} AS example FROM s GROUP BY value),
d AS (SELECT s.*, example FROM s JOIN v USING (value)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256({_SPANS('base')}) AS base_sha256, {_SPANS('base OR NOT example')} AS spans,
count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_examples FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples FROM t LEFT JOIN g USING (doc_id)"""

# CRC-32 of a short ASCII text: each character is mixed in, then eight steps of the polynomial
_CRC = lambda s: f"xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({s}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) ELSE xor(v >> 1, 3988292384::BIGINT * (v & 1)) END), 4294967295::BIGINT)"
# least of the options (cost, audit) of a state, without an insertion and with it
_KEEP = {0: "WHEN 's' THEN b1 WHEN 'u' THEN b2", 1: "WHEN 'u' THEN b2", 2: "WHEN 'a' THEN b3", 3: "WHEN 'u' THEN b2"}
_EDITS = lambda q, to: f"list_min(list_filter([{{'c': b{q}.c + 4, 'a': 'D' || b{q}.a}}, CASE WHEN NOT gone THEN {{'c': b{to}.c + 3 + more, 'a': 'R' || b{to}.a}} END, CASE WHEN NOT gone THEN (CASE left(role, 1) {_KEEP[q].replace('b', 'k')} END) END], lambda x: x IS NOT NULL))"
_INSERTED = lambda *ways: "list_min([" + ", ".join(f"{{'c': o{q}.c + {3 * n}, 'a': '{'I' * n}' || o{q}.a}}" for n, q in enumerate(ways)) + "])"
_BEST = f"{_INSERTED(0, 2, 3)} AS b0, {_INSERTED(1, 2, 3)} AS b1, {_INSERTED(2, 3)} AS b2, {_INSERTED(3, 2)} AS b3"
_START = "{'c': 0::BIGINT, 'a': ''}"
REPAIR = rf"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS again FROM o WHERE f <> 0),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen, lag(role) OVER w AS prior,
NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again)),
r AS (SELECT *, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated, blank OR seen AS gone FROM n),
v AS (SELECT conv_id, max(n) AS i, {_START} AS b0, {{'c': 6::BIGINT, 'a': 'II'}} AS b1, {{'c': 3::BIGINT, 'a': 'I'}} AS b2, {_START} AS b3 FROM r GROUP BY conv_id
UNION ALL SELECT conv_id, i, {_BEST} FROM (SELECT conv_id, i, {', '.join(f"{_EDITS(q, to)} AS o{q}" for q, to in ((0, 2), (1, 2), (2, 3), (3, 2)))} FROM (
SELECT v.conv_id, v.i - 1 AS i, b0, b1, b2, b3, role, gone, CASE WHEN truncated THEN 3 ELSE 0 END AS more, {', '.join(f"{{'c': b{q}.c + CASE WHEN truncated THEN 3 ELSE 0 END, 'a': 'K' || b{q}.a}} AS k{q}" for q in (1, 2, 3))}
FROM v JOIN r ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND v.i = r.i))),
s AS (SELECT conv_id, b0.c AS cost, b0.a AS audit FROM v WHERE i = 0),
e AS (SELECT conv_id, p, edit, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS turn FROM (SELECT conv_id, audit, unnest(generate_series(1, len(audit))) AS p, audit[p] AS edit FROM s) WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
j AS (SELECT e.*, r.role, r.text, max(CASE WHEN e.turn = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS head FROM e LEFT JOIN r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i WHERE edit <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (turn - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS repaired_sha256 FROM j GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND left(prior, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id"""

_TOTAL = "CAST(1000 AS HUGEINT) * a * n // (CAST(l AS HUGEINT) * r)"
PHRASES = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4, 5], lambda k: list_transform(generate_series(1, len(w) - k + 1), lambda i: w[i:i + k - 1])))) AS g FROM w),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= {LEAST}),
x AS (SELECT lang, g, max(f) AS above FROM (SELECT lang, f, unnest([g[:len(g) - 1], g[2:]]) AS g FROM f WHERE len(g) > 2) GROUP BY lang, g),
k AS (SELECT lang, g, f AS a, unnest(generate_series(1, len(g) - 1)) AS k FROM f LEFT JOIN x USING (lang, g) WHERE len(g) > 1 AND (above IS NULL OR above < f)),
c AS (SELECT k.lang, k.g, a, k, l.f AS l, r.f AS r, n, {_TOTAL.replace('l AS', 'l.f AS').replace('* r)', '* r.f)')} AS score FROM k JOIN f l ON l.lang = k.lang AND l.g = k.g[:k] JOIN f r ON r.lang = k.lang AND r.g = k.g[k + 1:] JOIN t ON t.lang = k.lang),
b AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b) WHERE rank <= {TOP}"""
