"""SQL that gives the rows of those training-data queries that SQL can express."""

from __future__ import annotations

from contactgrid.llm import chat, licenses, quality_rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    notice = r"(?m)^[^\p{L}\p{N}\n]*(?:(?:copyright|©)[^\n]*\d{4}|\(c\)[^\n]*|©[^\n]*|copyright\s*(?:\(c\)|©)[^\n]*|all rights reserved)[^\n]*$"
    t = f"' ' || regexp_replace(regexp_replace(lower({text}), '{notice}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for a, b in licenses.SPELLINGS.items():
        for _ in range(1 + a.endswith(" ")):
            t = f"replace({t}, ' {a}', ' {b}')"
    return f"sha256(trim({t}, ' '))"


OP5 = f"""WITH known AS (SELECT {_canonical('t')} AS digest, min(id) AS license_id FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in licenses.KNOWN.items())}) x(id, t) GROUP BY 1
 UNION ALL SELECT digest, min(id) FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in licenses.DIGESTS.items())}) y(id, digest) GROUP BY 1),
d AS (SELECT doc_id, {_canonical('text')} AS digest FROM documents) SELECT doc_id, d.digest, license_id FROM d LEFT JOIN known k ON k.digest = d.digest"""

OP6 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

OP7 = f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source), w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
 / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE cap / weight >= level),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(o.level * weight, cap)) AS target FROM w LEFT JOIN o ON TRUE),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, size, source_size, target, epochs, CAST(round(target) AS BIGINT) - epochs * source_size AS rest,
 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p"""

_BARE = "trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
OP9 = f"""WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM d), f AS (SELECT doc_id, i, {_BARE} AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE {_BARE} <> ''),
w AS (SELECT doc_id, k, x || chr(10) || lead(x) OVER n || chr(10) || lead(x, 2) OVER n AS key FROM f WINDOW n AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, k) AS seen FROM w WHERE key IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM r WHERE seen > 1), gone AS (SELECT g.doc_id, f.i FROM g JOIN f ON f.doc_id = g.doc_id AND f.k = g.k),
kept AS (SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = l.doc_id AND gone.i = l.i) GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

_ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g')"
OP10 = rf"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT *, row_number() OVER o AS place, len(regexp_extract_all(text, '\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]')) + {chat.MARKS} AS tokens,
 17 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) AS chars FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS upto, min(CASE WHEN role = 'system' THEN place END) OVER (PARTITION BY conv_id) AS system_place FROM t),
q AS (SELECT p.*, s.tokens AS system_tokens, s.chars AS system_chars, CAST(768 - 192 - least(coalesce(s.tokens, 0), 384) AS BIGINT) AS room FROM p LEFT JOIN t s ON s.conv_id = p.conv_id AND s.place = p.system_place),
z AS (SELECT *, CAST(upto - tokens AS BIGINT) // room AS slot, CAST(upto - 1 AS BIGINT) // room <> CAST(upto - tokens AS BIGINT) // room AS across FROM q),
y AS (SELECT *, CASE WHEN lag(slot) OVER o <> slot OR lag(across) OVER o <> across THEN 1 ELSE 0 END AS turned, lag(tokens) OVER o AS t1, lag(tokens, 2) OVER o AS t2, lag(chars) OVER o AS c1, lag(chars, 2) OVER o AS c2 FROM z
 WINDOW o AS (PARTITION BY conv_id ORDER BY place)), x AS (SELECT *, sum(turned) OVER (PARTITION BY conv_id ORDER BY place) AS win FROM y),
c AS (SELECT *, (CASE WHEN system_place < place THEN system_chars ELSE 0 END) + (CASE WHEN t1 <= 192 AND coalesce(system_place, 0) <> place - 1 THEN c1 ELSE 0 END)
 + (CASE WHEN t1 + t2 <= 192 AND coalesce(system_place, 0) <> place - 2 THEN c2 ELSE 0 END) + 3 AS lead_chars FROM x),
a AS (SELECT conv_id, win, sum(chars) + arg_min(lead_chars, place) AS chars FROM c GROUP BY conv_id, win), f AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM a GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d JOIN f ON f.conv_id = d.conv_id"""


def _op3() -> str:
    common = quality_rules.COMMON_WORDS
    k = max(map(len, common.values()))
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(map(_quoted, [*v, *[''] * (k - len(v))]))}]" for lang, v in common.items())
    cut, last, lengths = [], "body", []
    for name, pattern in (("a", r"\p{Ll}+"), ("b", r"\p{Lu}+"), ("c", r"\p{N}+"), ("e", r"[\x20\x09-\x0D]+"), ("f", r"[.,;:!?''""()-]+".replace('""', '"'))):
        cut.append(f"{name} AS (SELECT *, regexp_replace({'body' if last == 'body' else 'x_' + last}, '{pattern}', '', 'g') AS x_{name} FROM {'m' if last == 'body' else last})")
        lengths.append(f"length({'body' if last == 'body' else 'x_' + last}) - length(x_{name})")
        last = name
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END) + (CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))) / 2))"
    share = lambda x: f"list_transform({x}, lambda v: v / greatest(list_sum({x}), 1e-300))"
    total = lambda c, n: "[" + ", ".join(f"CAST(sum({c}[{i + 1}]) AS DOUBLE)" for i in range(n)) + "]"
    return rf"""WITH m AS (SELECT doc_id, lang, coalesce(text, '') AS body, {WORDS} AS w, list_transform({WORDS}, lambda x: lower(x)) AS lw, CASE lang {lists} END AS fixed FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
r AS (SELECT doc_id, key FROM g GROUP BY ALL HAVING count(*) > 1), v AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN r ON r.doc_id = g.doc_id AND r.key = g.key) GROUP BY doc_id),
{', '.join(cut)},
h AS (SELECT f.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(body) - ({lengths[3]}) AS BIGINT) AS word_chars, CAST(length(x_e) - length(regexp_replace(x_e, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
 list_filter(string_split(body, chr(10)), lambda x: {_BARE} <> '') AS ln, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words, length(body) AS n_chars, [{', '.join(f'CAST({x} AS DOUBLE)' for x in lengths)}, CAST(length(x_f) AS DOUBLE)] AS classes,
 list_transform(coalesce(fixed, list_transform(range({k}), lambda x: '')), lambda c: CAST(len(list_filter(lw, lambda x: x = c)) AS DOUBLE)) AS few FROM f LEFT JOIN v ON v.doc_id = f.doc_id),
j AS (SELECT *, list_append(few, n_words - list_sum(few)) AS commons, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h),
ref AS (SELECT lang, {total('classes', 6)} AS rc, {total('commons', k + 1)} AS rw FROM j WHERE NOT base_failed AND lang IN ({', '.join(map(_quoted, common))}) GROUP BY lang),
s AS (SELECT j.*, rc IS NULL AS free, {js(share('classes'), share('rc'))} AS dc, {js(share('commons'), share('rw'))} AS dw FROM j LEFT JOIN ref ON ref.lang = j.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND (free OR ((n_chars < {quality_rules.MIN_CHARS} OR dc <= {quality_rules.MAX_CLASS_DISTANCE}) AND (n_words < {quality_rules.MIN_WORDS} OR dw <= {quality_rules.MAX_WORD_DISTANCE}))) AS kept FROM s"""

OP11 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), i AS MATERIALIZED (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
k AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM k GROUP BY ALL HAVING count(*) >= 30), n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1), h AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
t AS MATERIALIZED (SELECT *, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 :], ' ') AS tail FROM h),
s AS (SELECT t.*, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * t.f // (x.f + y.f) AS BIGINT) AS score FROM t JOIN f x ON x.lang = t.lang AND x.phrase = head JOIN f y ON y.lang = t.lang AND y.phrase = tail),
b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS MATERIALIZED (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND x.k < y.k AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.f >= 80 * x.f),
r AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase))
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(f AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""
OP12 = rf"""WITH t AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, h // 10 AS g FROM (SELECT doc_id, {WORDS} AS w, {_CRC32} AS h FROM documents)),
u AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM t),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: w[1 + (CASE WHEN i < a THEN i ELSE a + (i - a) % p END)]) ELSE w END AS w FROM u),
f AS MATERIALIZED (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 5], ' ') AS five FROM (SELECT doc_id, n, w, unnest(range(n - 4)) AS i FROM d WHERE n > 4)),
s AS (SELECT doc_id, five FROM f GROUP BY ALL HAVING count(*) > 1), c AS MATERIALIZED (SELECT f.* FROM f JOIN s ON s.doc_id = f.doc_id AND s.five = f.five),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.five = y.five AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
e AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m), r AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM e GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM r WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
told AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs), dropped AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, CASE WHEN dropped.gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT unnest(w) AS x, unnest(range(n)) AS i) WHERE NOT list_contains(dropped.gone, i)), '') END AS text FROM d LEFT JOIN dropped ON dropped.doc_id = d.doc_id)
SELECT kept.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
 coalesce(digest, sha256('')) AS runs_sha256, sha256(text) AS collapsed_sha256 FROM kept LEFT JOIN told ON told.doc_id = kept.doc_id LEFT JOIN best ON best.doc_id = kept.doc_id"""

ORACLES = {
    "op3_quality_divergence": _op3(), "op5_license_digests": OP5, "op6_exact_topk": OP6, "op7_source_mixing": OP7, "op9_line_dedup": OP9, "op10_chat_windows": OP10,
    "op11_phrase_collocations": OP11, "op12_periodic_runs": OP12,
}
