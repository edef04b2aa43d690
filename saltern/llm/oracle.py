"""DuckDB equivalents of the training-data queries that SQL can express."""

from __future__ import annotations

from saltern.llm import chat, quality

_WORDS = "[x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> '']"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
keyed AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM wins),
dups AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM keyed) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dups),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
cut AS (SELECT doc_id, n, j, substr(h, CAST(512 * j + 1 AS BIGINT), 610) AS c FROM (SELECT doc_id, n, h, unnest(range(0, (n - 50) // 256 + 1)) AS j FROM d WHERE n >= 50)),
keyed AS (SELECT doc_id, 256 * j + o AS i, md5_number(substr(c, CAST(2 * o + 1 AS BIGINT), 100)) AS k FROM (SELECT *, unnest(range(0, least(256, n - 49 - 256 * j))) AS o FROM cut)),
first AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM keyed JOIN first USING (k) WHERE m < doc_id),
runs AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hits)),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, g),
parts AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e, b FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)), '' ORDER BY s) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS t, count(*) AS n_spans FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - length(coalesce(t, h)) // 2 AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_SAYS = f"{chat.END}{chat.START}{chat.ASSISTANT} ok"
_ESCAPED = lambda c: f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"
OP4 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_SAYS}' UNION ALL SELECT -1, 1, '{chat.ASSISTANT}', '{_SAYS}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = '{chat.ASSISTANT}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{chat.ASSISTANT}'), '')) AS loss_sha256,
    CAST(sum({len(chat.START)} + length(replace({_ESCAPED("role")}, chr(10), '\\n')) + 1 + length({_ESCAPED("text")}) + {len(chat.END + chat.TURN_BREAK)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
wins AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, wins.n, item FROM wins JOIN grams ON wins.g = grams.g AND wins.n = grams.n),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id),
terms AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN terms USING (doc_id)
"""

_COMMON = "CASE lang " + " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"'{w}'" for w in words) + "]" for k, words in quality.COMMON.items()) + " ELSE [] END"
_CLASSES = "[" + ", ".join("len(regexp_extract_all(plain, '" + p.replace("'", "''").replace('\\"', '"') + "'))" for p in quality.CLASSES.values()) + "]"
_JS = lambda p, q: f"sqrt(greatest(list_sum([CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) / 2 ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) / 2 ELSE 0 END FOR z IN [[{p}[i], {q}[i]] FOR i IN range(1, len({p}) + 1)]]), 0))"


def _judged(name: str, source: str, refs: str, chars: float, words: float) -> str:
    far = f"coalesce(cd > {chars}, false) OR coalesce(wd > {words}, false)"
    return f"""{name}_d AS (SELECT f.*, CASE WHEN n_chars >= {quality.GUARD_CHARS} AND cr IS NOT NULL THEN {_JS("cs", "cr")} END AS cd, CASE WHEN n_words >= {quality.GUARD_WORDS} AND f.lang <> 'other' AND wr IS NOT NULL THEN {_JS("ws", "wr")} END AS wd FROM {source} f LEFT JOIN {refs} r ON f.lang = r.lang),
{name} AS (SELECT *, NOT base_failed AND NOT ({far}) AS kept FROM {name}_d)"""


def _refs(name: str, source: str) -> str:
    usable = f"NOT base_failed AND n_chars >= {quality.GUARD_CHARS} AND n_words >= {quality.GUARD_WORDS}"
    mean = lambda c, out: f"(SELECT lang, list(m ORDER BY i) AS {out} FROM (SELECT lang, i, avg({c}[i]) AS m FROM {source}, LATERAL (SELECT unnest(range(1, len({c}) + 1)) AS i) WHERE {usable} GROUP BY lang, i) GROUP BY lang)"
    return f"{name} AS (SELECT a.lang, cr, wr FROM {mean('cs', 'cr')} a JOIN {mean('ws', 'wr')} b ON a.lang = b.lang)"


OP9 = f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in quality.COMMON)}) THEN lang ELSE 'other' END AS lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, w, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars, len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols,
    len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')]) - len(list_distinct([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')])) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat,
    coalesce(array_to_string([x FOR x IN w IF NOT regexp_matches(x, '{quality.NUMERIC}')], ''), '') AS plain, [lower(x) FOR x IN w] AS lw, {_COMMON} AS common FROM d LEFT JOIN repeats USING (doc_id)),
counts AS (SELECT *, length(plain) AS n_chars, {_CLASSES} AS c, [len([y FOR y IN lw IF y = x]) FOR x IN common] AS f, n_words < {quality.MIN_WORDS} OR 100 * n_repeat > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM base),
found AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_chars, base_failed,
    [x / n_chars FOR x IN list_append(c, n_chars - list_sum(c))] AS cs, [x / n_words FOR x IN list_append(f, n_words - coalesce(list_sum(f), 0))] AS ws FROM counts),
{_refs("refs1", "found")}, {_judged("near", "found", "refs1", quality.WIDE_CHARS, quality.WIDE_WORDS)}, near_kept AS (SELECT * FROM near WHERE kept), {_refs("refs2", "near_kept")}, {_judged("final", "found", "refs2", quality.LIMIT_CHARS, quality.LIMIT_WORDS)}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words, base_failed, kept,
    round(cd, 6) + 0.0 AS char_distance, round(wd, 6) + 0.0 AS word_distance FROM final
"""


OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, [x FOR x IN string_split_regex(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+') IF x <> ''] AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.*, h.f AS l, q.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(h.f AS HUGEINT) * q.f) AS BIGINT) AS score FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f q ON q.lang = cuts.lang AND q.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE m IS NULL OR 100 * m < 50 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""


OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE w END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""


OP13 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), sized AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
stats AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sized),
m AS (SELECT doc_id, 25 + (75 * n * nd) // l AS m FROM sized, stats),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM sized) GROUP BY doc_id, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS wt FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), stats),
q AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
scored AS (SELECT item_id, doc_id, CAST(sum(r * wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_minhash": OP11, "op12_phrases": OP12, "op13_search": OP13, "op2_recompression": OP2, "op4_chat": OP4, "op6_decontamination": OP6, "op7_prefix_free": OP7, "op9_quality": OP9}
