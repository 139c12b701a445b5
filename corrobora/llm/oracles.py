"""DuckDB twins of op3, op5 and op9, for the sizes at which results are compared."""

from __future__ import annotations

from corrobora.llm.quality import LINE_CHARS_SHARE, LINE_SHARE, NGRAM_SHARE

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(n.doc_id, m.least), n.doc_id) AS component_id, coalesce(k.n_links, 0) AS n_links
FROM n LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) m ON m.a = n.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = n.doc_id
"""


def contamination_sql(width: int = 10) -> str:
    def words(table: str, key: str) -> str:
        return f"SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT {key}, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS ws FROM {table})"

    def gram(k: int) -> str:
        return f"array_to_string(ws[i:i + {k - 1}], ' ')"

    docs = f"d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS ws FROM documents)"
    items = f"b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("text")}, {_ALNUM}) AS ws FROM benchmark WHERE text IS NOT NULL)"
    windows = f"q AS (SELECT DISTINCT item, least(len(ws), {width}) AS k, unnest(list_transform(range(1, greatest(2, len(ws) - {width} + 2)), lambda i: array_to_string(ws[i:i + {width - 1}], ' '))) AS g FROM b WHERE len(ws) > 0)"
    found = " UNION ALL ".join(
        f"SELECT doc_id, item, unnest(range(i, i + {k})) AS place FROM (SELECT doc_id, i, {gram(k)} AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM d)) JOIN (SELECT item, g FROM q WHERE k = {k}) USING (g)" for k in range(1, width + 1)
    )
    # proximity: from each window's rarest word, at every place from which the others may stand one position off
    near = f"""dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d), df AS (SELECT w, count(*) AS df FROM dw GROUP BY w),
v AS (SELECT DISTINCT k, g, string_split(g, ' ') AS ts FROM q), t AS (SELECT k, g, ts, unnest(ts) AS w, generate_subscripts(ts, 1) AS o FROM v),
r AS (SELECT g, any_value(k) AS k, any_value(ts) AS ts, arg_min(w, coalesce(df, 0)) AS w, arg_min(o, coalesce(df, 0)) AS o FROM t LEFT JOIN df USING (w) GROUP BY g),
c AS (SELECT DISTINCT dw.doc_id, r.g, r.k, r.ts, dw.i - r.o + s AS p FROM dw JOIN r USING (w), (SELECT unnest([-1, 0, 1]) AS s)),
m AS (SELECT DISTINCT doc_id, g FROM c JOIN d USING (doc_id) WHERE len(list_filter(range(1, k + 1), lambda x: list_contains(ws[greatest(1, p + x - 1) : greatest(0, p + x + 1)], ts[x]))) = k),
e AS (SELECT doc_id, count(DISTINCT item) AS near_items FROM m JOIN q USING (g) GROUP BY doc_id)"""
    return f"""WITH {docs}, {items}, {windows}, f AS ({found}), {near},
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM f GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, 0) AS near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN e USING (doc_id)"""


def quality_sql() -> str:
    grams, covers = [], []
    for k in (3, *NGRAM_SHARE):
        grams.append(f"CASE WHEN i + {k - 1} <= n THEN string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) END AS g{k}")
    marks = ["g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS m3"] + [f"g{k} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{k} ORDER BY i) > 1 AS m{k}" for k in NGRAM_SHARE]
    for k in (3, *NGRAM_SHARE):
        covers.append(f"max(m{k}::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c{k}")
    chars = ", ".join(f"coalesce(sum(length(w)) FILTER (WHERE c{k} = 1), 0)::BIGINT AS dup_{k}gram_chars" for k in NGRAM_SHARE)
    names = ", ".join(f"coalesce(dup_{k}gram_chars, 0) AS dup_{k}gram_chars" for k in NGRAM_SHARE)
    bad = " OR ".join(f"dup_{k}gram_chars > {v} * word_chars" for k, v in NGRAM_SHARE.items())
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d), g AS (SELECT *, {", ".join(grams)} FROM x), m AS (SELECT *, {", ".join(marks)} FROM g), c AS (SELECT *, {", ".join(covers)} FROM m),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (WHERE c3 = 1) AS n_repeat_words, {chars} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d), l2 AS (SELECT doc_id, line, count(*) AS k FROM l WHERE regexp_matches(line, {_SPACED}) GROUP BY ALL),
ls AS (SELECT doc_id, sum(k)::BIGINT AS n_lines, sum(k - 1)::BIGINT AS n_dup_lines, sum(k * length(line))::BIGINT AS line_chars, sum((k - 1) * length(line))::BIGINT AS dup_line_chars FROM l2 GROUP BY doc_id),
r AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {names},
    coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0) AS line_chars
  FROM d LEFT JOIN a USING (doc_id) LEFT JOIN ls USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, dup_line_chars > {LINE_CHARS_SHARE} * line_chars OR n_dup_lines > {LINE_SHARE} * n_lines OR {bad} AS bad FROM r)
SELECT * EXCLUDE (n_lines, line_chars, bad), NOT base_failed AND NOT bad AS kept FROM v"""


def near_duplicate_sql(words: int = 5, num: int = 85) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) AS ws FROM documents),
s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(ws) >= {words} THEN list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
n AS (SELECT w.r, w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (r) GROUP BY ALL),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {num} * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT e.a, l.b FROM reach e JOIN links l ON l.a = e.b),
least AS (SELECT reach.a, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a)
SELECT doc_id, n AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM n JOIN least ON least.a = n.r
"""


#: CRC-32 of a decimal id: its table by eight shifts an entry, then a step for each digit.
_CRC = """ct(i, v, step) AS (SELECT i, i::UBIGINT, 0 FROM range(256) AS x(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, step + 1 FROM ct WHERE step < 8),
crcs AS (SELECT list(v ORDER BY i) AS entry FROM ct WHERE step = 8)"""


def _crc(decimal: str) -> str:
    digits = f"list_transform(range(1, len({decimal}) + 1), lambda j: ascii(substr({decimal}, j, 1))::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {digits}), lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255)::INTEGER + 1])), 4294967295::UBIGINT)"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


def merkle_sql() -> str:
    def leaf(text: str) -> str:
        return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {_field(text)})"

    def levels(name: str, start: str) -> str:
        return f"{name}(t, lv, i, h, n) AS ({start} UNION ALL SELECT t, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY t, lv, i // 3)"

    def beside(name: str, levels: str) -> str:
        run = "OVER (PARTITION BY t, lv, i // 3 ORDER BY i ROWS BETWEEN"
        return f"{name} AS (SELECT t, lv, i, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {levels} WHERE n > 1)"

    def walk(name: str, start: str, beside: str) -> str:
        return f"{name}(t, k, lv, i, s, f) AS ({start} UNION ALL SELECT w.t, w.k, w.lv + 1, w.i // 3, w.s || b.l || b.r, sha256(b.l || w.f || b.r) FROM {name} w JOIN {beside} b ON b.t = w.t AND b.lv = w.lv AND b.i = w.i)"

    def ended(name: str, beside: str) -> str:
        return f"SELECT w.t, w.k, w.s, w.f FROM {name} w WHERE NOT EXISTS (FROM {beside} b WHERE b.t = w.t AND b.lv = w.lv AND b.i = w.i)"

    return f"""WITH RECURSIVE {_CRC},
d AS (SELECT *, CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents, crcs),
x AS (SELECT doc_id, coalesce('=' || source, '') AS t, {leaf("text")} AS leaf, {leaf("other")} AS tampered FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM x),
{levels("u", "SELECT t, 0, i, leaf, n FROM p")},
q AS (SELECT '' AS t, t AS source, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM u WHERE n = 1),
{levels("v", "SELECT t, 0, i, h, n FROM q")},
{beside("bu", "u")}, {beside("bv", "v")},
{walk("wu", "SELECT t, i, 0, i, '', tampered FROM p", "bu")},
eu AS ({ended("wu", "bu")}),
{walk("wv", "SELECT '', (t, k), 0, i, s, f FROM (SELECT eu.t, eu.k, q.i, eu.s, eu.f FROM eu JOIN q ON q.source = eu.t)", "bv")},
ev AS ({ended("wv", "bv")})
SELECT p.doc_id, p.leaf, q.h AS subroot, v.h AS root, sha256(ev.s) AS proof_sha256, ev.f AS folded_root, ev.f = v.h AS verified
FROM p JOIN q ON q.source = p.t JOIN v ON v.n = 1 JOIN ev ON ev.k = (p.t, p.i)"""


def trie_sql() -> str:
    return f"""WITH RECURSIVE {_CRC},
o AS (SELECT conv_id AS c, list({{'k': strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''), 'b': strlen(coalesce(text, ''))}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, ts, ({_crc("c::VARCHAR")} % 9)::INTEGER AS h FROM o, crcs),
r AS (SELECT h.c, list_concat(CASE WHEN h.h > 0 THEN coalesce(b.ts, []) ELSE [] END[:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5),
m AS (SELECT c, d, len(ts) AS n, sha256(ts[:d]::VARCHAR) AS p, CASE WHEN d > 0 THEN ts[d].b ELSE 0 END AS b FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
v AS (SELECT d, p, min(c) AS c, count(*) AS n, any_value(b) AS b, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM m GROUP BY d, p),
a AS (SELECT v.*, up.c AS parent FROM v LEFT JOIN m ON m.c = v.c AND m.d = v.d - 1 LEFT JOIN v up ON up.d = m.d AND up.p = m.p),
k AS (SELECT d - 1 AS d, parent AS c, count(*) AS n FROM a WHERE d > 0 GROUP BY ALL),
t AS (SELECT m.d, m.p, count(*) FILTER (k.n IS NULL) AS leaves, sum((a.n - 1) * a.b) AS saved FROM a LEFT JOIN k USING (d, c) JOIN m ON m.c = a.c AND m.d <= a.d GROUP BY m.d, m.p)
SELECT a.c AS conv_id, a.d AS depth, a.parent AS parent_conv_id, a.n AS n_convs, coalesce(k.n, 0) AS n_children, t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN t USING (d, p) LEFT JOIN k ON k.d = a.d AND k.c = a.c"""
