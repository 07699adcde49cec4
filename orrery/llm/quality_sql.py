"""The quality rules once more, as DuckDB SQL, to hold the operator against."""

from __future__ import annotations

from orrery.llm.quality_rules import BINS, CLASSES, SYMBOL, SYMBOLS, UPPER, VOCABULARY, Limits


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _divergence(p: str, q: str) -> str:
    term = "CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END ELSE z[2] END"
    return f"greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {term})) / 2)"


def judged_sql(s: Limits = Limits()) -> str:
    chars = [f"CAST(length(t) - length(regexp_replace(t, '{_quoted(c)}', '', 'g')) AS DOUBLE)" for c in CLASSES.values()]
    chars = ["CAST(length(t) - length(array_to_string(w, '')) AS DOUBLE)", *chars]
    hits = [f"CAST(len(list_filter(w, lambda x: x = '{v}')) AS DOUBLE)" for v in VOCABULARY]
    total = lambda name, n: ", ".join(f"sum(CAST({name}[{i + 1}] AS BIGINT)) FILTER (ok)" for i in range(n))
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
c0 AS (SELECT *, [{', '.join(chars)}] AS rare, [{', '.join(hits)}] AS hits FROM w),
c AS (SELECT * EXCLUDE (rare, hits), list_concat([length(t) - list_sum(rare)], rare) AS chars, list_concat([len(w) - list_sum(hits)], hits) AS hist,
  len(w) >= {s.min_words} AND rare[{SYMBOL}] <= {s.clean_symbols} * length(t) AND rare[{UPPER}] <= {s.clean_upper} * length(t) AS ok FROM c0),
sums AS (SELECT lang, [{total('chars', BINS)}] AS cs, [{total('hist', len(VOCABULARY) + 1)}] AS hs FROM c WHERE lang IS NOT NULL GROUP BY lang),
refs AS (SELECT lang, list_transform(cs, lambda x: CAST(x AS DOUBLE) / list_sum(cs)) AS rc, list_transform(hs, lambda x: CAST(x AS DOUBLE) / list_sum(hs)) AS rh FROM sums WHERE list_sum(cs) > 0 AND list_sum(hs) > 0),
win AS (SELECT id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 3),
twice AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY id),
lines AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
b AS (SELECT c.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM c JOIN lines USING (id) LEFT JOIN covered v ON v.id = c.id),
x AS (SELECT b.id, refs.lang = b.lang AS own, CASE WHEN length(t) >= {s.char_guard} THEN {_divergence('list_transform(chars, lambda x: CASE WHEN length(t) > 0 THEN x / length(t) ELSE 0.0 END)', 'rc')} ELSE 0.0 END AS dc,
  CASE WHEN n_words >= {s.word_guard} THEN greatest(0.0, {_divergence('list_transform(hist, lambda x: CASE WHEN n_words > 0 THEN x / n_words ELSE 0.0 END)', 'rh')} - {s.noise} / n_words) ELSE 0.0 END AS dh FROM b, refs),
y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN coalesce(own, false) AND dc + dh <= {s.max_distance**2!r} THEN 0 ELSE 1 END, dc + dh, dc, dh) AS r FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {s.min_words} OR 100 * n_repeat_words > {s.max_repeat} * n_words AS base_failed,
  NOT (n_words < {s.min_words} OR 100 * n_repeat_words > {s.max_repeat} * n_words) AND coalesce(dc + dh <= {s.max_distance**2!r}, true) AS kept, round(sqrt(coalesce(dc, 0.0)), 6) AS char_distance, round(sqrt(coalesce(dh, 0.0)), 6) AS word_distance
FROM b LEFT JOIN y ON y.id = b.id AND y.r = 1"""
