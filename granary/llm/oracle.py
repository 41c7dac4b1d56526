"""DuckDB SQL for the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

import re

from granary.llm import license_scan, quality

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), [])"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) g(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM iw) z, unnest(generate_series(1, len(w) - n + 1)) g(s)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(s, s + n - 1)) g(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _templates() -> str:
    rows = [(label, True, 1.0) for label, _ in license_scan.PHRASES] + [(label, False, need) for label, need, _ in license_scan.NOTICES]
    listed = lambda ws: ", ".join(f"'{w}'" for w in ws)
    return ", ".join(f"({i}, '{label}', {str(exact).lower()}, {need}::DOUBLE, [{listed(w)}])" for i, ((label, exact, need), w) in enumerate(zip(rows, license_scan.wordings(), strict=True)))


LICENSE_SCAN = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT *, least({license_scan.GRAM}, len(wording)) AS k FROM (VALUES {_templates()}) v(template, label, exact, need, wording)),
p AS (SELECT template, label, exact, need, k, len(wording) - k + 1 AS total, place, array_to_string(wording[place + 1:place + k], ' ') AS g FROM t, unnest(range(0, len(wording) - k + 1)) u(place)),
g AS (SELECT doc_id, "at", k, array_to_string(w["at" + 1:"at" + k], ' ') AS g FROM d, (SELECT DISTINCT k FROM t) z, unnest(range(0, len(w) - k + 1)) u("at")),
v AS (SELECT doc_id, template, label, exact, need, g.k, total, "at" - place AS diagonal, list(DISTINCT place) AS places FROM g JOIN p ON g.k = p.k AND g.g = p.g GROUP BY ALL),
f AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER o <= {license_scan.SLACK} IS NOT TRUE THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM f),
s AS (SELECT doc_id, template, label, exact, need, span, min(diagonal + list_min(places)) AS first, len(list_distinct(flatten(list(places)))) / max(total)::DOUBLE AS cover FROM n GROUP BY ALL),
ok AS (SELECT * FROM s WHERE CASE WHEN exact THEN cover = 1 ELSE 2 * cover >= need END),
r AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(first) FILTER (WHERE exact) AS first_word, max(first) FILTER (WHERE exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE cover >= need) AS labels, max(cover) AS score FROM ok GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (doc_id)"""


_RATIO_SQL = ", ".join(f"({a} + 0.5::DOUBLE) / ({b} + {quality.PRIOR}) AS {m}" for m, (a, b) in quality.RATIOS.items())
_BUCKET = f"ceil(ln(v) / ln({quality.GAMMA!r}::DOUBLE))::INTEGER"
_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
_LEAST = {m: f"({count} - {quality.SURE} * sqrt({count}))" for m, (count, _) in quality.RATIOS.items()}
_ODD = " OR ".join(f"coalesce({_LEAST[m]} > 0 AND {_BUCKET.replace('(v)', f'(({_LEAST[m]} + 0.5::DOUBLE) / ({of} + {quality.PRIOR}))')} > last_{m}, false)" for m, (_, of) in quality.RATIOS.items())

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS g FROM w, unnest(generate_series(1, len(w) - 4)) u(s)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) x, unnest(generate_series(s, s + 4)) u(p) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
 len(list_filter(w, lambda x: length(x) > 1 AND regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) AS n_upper_words, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
x AS (SELECT *, {_RATIO_SQL} FROM m),
sk AS (SELECT lang, source, metric, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT lang, source, unnest([{", ".join(f"'{k}'" for k in quality.RATIOS)}]) AS metric, unnest([{", ".join(quality.RATIOS)}]) AS v FROM x WHERE NOT ({_FAILED})) e GROUP BY ALL),
wide AS (SELECT lang, metric, bucket, sum(n) AS n FROM sk GROUP BY ALL), whole AS (SELECT metric, bucket, sum(n) AS n FROM sk GROUP BY ALL),
rl AS (SELECT lang, metric, sum(n)::DOUBLE AS r_lang FROM sk GROUP BY ALL), ra AS (SELECT metric, sum(n)::DOUBLE AS r_all FROM sk GROUP BY ALL), g AS (SELECT DISTINCT lang, source, metric FROM sk),
parts AS (SELECT lang, source, metric, bucket, n * r_lang * r_all AS n FROM sk JOIN rl USING (lang, metric) JOIN ra USING (metric)
 UNION ALL SELECT lang, source, metric, bucket, {quality.WEIGHT} * n * r_all FROM g JOIN wide USING (lang, metric) JOIN ra USING (metric)
 UNION ALL SELECT lang, source, metric, bucket, {quality.WEIGHT} * n * r_lang FROM g JOIN whole USING (metric) JOIN rl USING (lang, metric)),
b AS (SELECT lang, source, metric, bucket, sum(n) AS n FROM parts GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, coalesce(sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket RANGE BETWEEN 1 FOLLOWING AND {quality.WIDTH} FOLLOWING), 0) AS after, sum(n) OVER (PARTITION BY lang, source, metric) AS rows FROM b),
lim AS (SELECT lang, source, metric, min(bucket) + {quality.WIDTH} AS last FROM r WHERE 2 * upto >= rows AND {quality.TAIL} * after < rows GROUP BY ALL),
pl AS (SELECT lang, source, {", ".join(f"max(last) FILTER (WHERE metric = '{k}') AS last_{k}" for k in quality.RATIOS)} FROM lim GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_FAILED} AS base_failed, NOT ({_FAILED}) AND NOT ({_ODD}) AS kept FROM x LEFT JOIN pl USING (lang, source)"""

LEXICAL_SEARCH = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, unnest(list_distinct({_WORDS})) AS term FROM benchmark),
n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0), z AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM n),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) x WHERE term IN (SELECT term FROM b) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, z GROUP BY term),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM b JOIN p USING (term) JOIN wt USING (term) JOIN n USING (doc_id), z GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10"""

SUBSTRING_DEDUP = r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 12)) u(s)),
f AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN f USING (g), unnest(generate_series(s, s + 12)) x(p) WHERE first < doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

SQL = {"op12_substring_dedup": SUBSTRING_DEDUP, "op11_lexical_search": LEXICAL_SEARCH, "op3_license_scan": LICENSE_SCAN, "op7_decontamination": DECONTAMINATION, "op10_quality": QUALITY}
