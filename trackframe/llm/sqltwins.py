"""DuckDB SQL for the operators that SQL can express: the same rows as the queries."""

MIX = r"""
WITH s AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT k, sum(size)::BIGINT AS source_size FROM s GROUP BY k),
w AS (SELECT *, ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY k) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () AS total FROM t),
l AS (SELECT *, cap / w AS ratio, row_number() OVER (ORDER BY cap / w, k) AS n,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT k, source_size, CASE WHEN ratio <= lv THEN cap ELSE lv * w END AS target
  FROM (SELECT *, coalesce(arg_min(CASE WHEN level <= ratio THEN level END, CASE WHEN level <= ratio THEN n END) OVER (), 1e300) AS lv FROM l)),
d AS (SELECT s.*, g.source_size, g.target, CASE WHEN size > 0 THEN floor(log2(size::DOUBLE) + 1e-9)::INT ELSE -1 END AS c,
    (('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM s JOIN g USING (k)),
ct AS (SELECT k, c, sum(size)::BIGINT AS class_size, any_value(target) AS target FROM d GROUP BY k, c),
cw AS (SELECT *, class_size * pow(2.0::DOUBLE, c * 0.5::DOUBLE) AS w, 2.0::DOUBLE * class_size AS cap FROM ct),
cr AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 0 END AS ratio FROM cw),
cl AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ratio, c) AS n,
    CASE WHEN sum(w) OVER f > 0 THEN (target - coalesce(sum(cap) OVER b, 0)) / sum(w) OVER f ELSE 0 END AS level FROM cr
  WINDOW b AS (PARTITION BY k ORDER BY ratio, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    f AS (PARTITION BY k ORDER BY ratio, c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ca AS (SELECT *, coalesce(arg_min(CASE WHEN level <= ratio THEN level END, CASE WHEN level <= ratio THEN n END) OVER (PARTITION BY k), 1e300) AS lv FROM cl),
ce AS (SELECT k, c, class_size, target, CASE WHEN class_size > 0 THEN least((CASE WHEN ratio <= lv THEN cap ELSE lv * w END) / class_size, 2.0) ELSE 0 END AS expected FROM ca),
cp AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p,
    floor(target + 1e-6)::BIGINT - sum(floor(expected)::BIGINT * class_size) OVER (PARTITION BY k) AS room FROM ce),
r AS (SELECT d.*, whole, room, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) ELSE 1.0 END AS rank FROM d JOIN cp USING (k, c)),
q AS (SELECT *, sum(size) OVER (PARTITION BY k ORDER BY rank, doc_id) AS upto, sum(size) OVER (PARTITION BY k, rank, doc_id) AS own,
    count(*) OVER (PARTITION BY k, rank, doc_id) AS same FROM r)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  (whole * size + CASE WHEN room - (upto - own) > 0 THEN least(size, floor((room - (upto - own)) / same)) ELSE 0 END)::BIGINT AS taken FROM q
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, range(1, len(w) - 1) t(i) WHERE len(w) >= 3),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM m, range(0, 3) s(o) WHERE n > 1 GROUP BY doc_id),
k AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM k),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines) AS failed FROM f GROUP BY source),
a AS (SELECT sum(failed)::DOUBLE / sum(docs) AS mean, sum(failed * failed / docs) - sum(failed)::DOUBLE * sum(failed) / sum(docs) AS apart,
    sum(docs) - sum(docs * docs)::DOUBLE / sum(docs) AS scale, count(*) AS n FROM h),
b AS (SELECT mean, n > 1 AND mean > 0 AND mean < 1 AS known, mean * (1 - mean) AS spread,
    greatest((apart - (n - 1) * mean * (1 - mean)) / CASE WHEN scale > 0 THEN scale END, mean * (1 - mean) / 1000) AS between_hosts FROM a),
c AS (SELECT known, mean, least(greatest(spread / CASE WHEN between_hosts > 0 THEN between_hosts END - 1, 1.0), 1000.0) AS size FROM b),
e AS (SELECT CASE WHEN known THEN mean * size ELSE 0.5 END AS alpha, CASE WHEN known THEN (1 - mean) * size ELSE 0.5 END AS beta FROM c),
v AS (SELECT source, (failed + alpha) / (docs + alpha + beta) < 0.5 AS host_kept FROM h, e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = rf"""
WITH i AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
t AS (SELECT id, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
f AS (SELECT id, doc_id, n, term, count(*) AS tf FROM t SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
s AS (SELECT item_id, id, doc_id, sum(i.c * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM f JOIN i USING (term) JOIN w USING (term), c GROUP BY item_id, id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
c AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 5) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
q AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT y.lang, y.phrase, a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score FROM
  (SELECT *, array_to_string(w[1 : j], ' ') AS lp, array_to_string(w[j + 1 : k], ' ') AS rp FROM q, range(1, 4) t(j) WHERE j < k) y
  JOIN f l ON l.lang = y.lang AND l.phrase = lp JOIN f r ON r.lang = y.lang AND r.phrase = rp),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
u AS (SELECT lang, array_to_string(w[s : s + n - 1], ' ') AS phrase, max(a) AS longer FROM q, range(1, 4) t(s), range(2, 4) v(n) WHERE n < k AND s + n - 1 <= k GROUP BY ALL),
z AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN u USING (lang, phrase) WHERE NOT (100 * coalesce(longer, 0) >= 80 * a))
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM z JOIN c USING (lang) WHERE rank <= 2000
"""


def licenses(phrases: tuple, templates: tuple, rare: int, slack: int, agree: tuple[int, int]) -> str:
    """The license scan over the given phrases and templates."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({k}, {text(label)}, {text(words)})" for k, (label, words, _) in enumerate(templates))
    needs = ", ".join(f"({k}, {text(p)})" for k, (_, _, own) in enumerate(templates) for p in own)
    known = ", ".join(f"({text(p)}, {text(label)})" for p, label in phrases)
    words = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH t AS (SELECT template, label, {words} AS w FROM (VALUES {listed}) v(template, label, text)),
tw AS (SELECT template, label, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM t),
d AS (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents),
dw AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
df AS (SELECT word, count(DISTINCT id) AS df FROM dw SEMI JOIN tw USING (word) GROUP BY word),
o AS (SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY coalesce(df, 0), word) AS k,
    least({rare}, ceil(count(*) OVER (PARTITION BY template) / 2))::INTEGER AS size FROM (SELECT DISTINCT template, word FROM tw) LEFT JOIN df USING (word)),
x AS (SELECT template, label, word, place, k, size FROM tw JOIN o USING (template, word) WHERE k <= size),
v AS (SELECT id, template, label, size, k, floor((pos - place) / {slack}) - e AS win FROM dw JOIN x USING (word), range(0, 2) r(e)),
m AS (SELECT id, template, label, size, max(n) AS matched FROM (SELECT id, template, label, size, win, count(DISTINCT k) AS n FROM v GROUP BY ALL) GROUP BY ALL),
j AS (SELECT id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d),
ok AS (SELECT id, label, matched / size AS share FROM m JOIN j USING (id) WHERE matched >= 2 AND matched * {agree[1]} >= size * {agree[0]}
  AND NOT EXISTS (SELECT 1 FROM (VALUES {needs}) q(template, phrase) WHERE q.template = m.template AND NOT contains(s, ' ' || phrase || ' '))),
b AS (SELECT id, pos, label FROM dw JOIN d USING (id), (VALUES {known}) q(phrase, label)
  WHERE word = split_part(phrase, ' ', 1) AND array_to_string(w[pos + 1 : pos + len(string_split(phrase, ' '))], ' ') = phrase),
bs AS (SELECT id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM b GROUP BY id),
al AS (SELECT id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT id, label FROM b UNION ALL SELECT id, label FROM ok) GROUP BY id),
sh AS (SELECT id, max(share) AS share FROM ok GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN bs USING (id) LEFT JOIN al USING (id) LEFT JOIN sh USING (id)
"""
