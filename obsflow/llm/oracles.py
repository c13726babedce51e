"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from obsflow.llm.quality import MEASURES, SHARES, Rules

SPACE = r"[\x20\x09-\x0D]+"


def _bucket(value: str) -> str:
    cases = " ".join(f"WHEN {value} >= {1 << bits} THEN {value} - {value} % {1 << (bits - 4)}" for bits in range(20, 4, -1))
    return f"CASE {cases} ELSE {value} END"


def quality(rules: Rules = Rules()) -> str:
    share = {m: f"CASE WHEN {whole} > 0 THEN CAST(floor({part} * 1000 / {whole}) AS BIGINT) ELSE 0 END" for m, (part, whole) in SHARES.items()}
    shares = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {share[m]} AS v FROM counts" for m in MEASURES)

    def quartiles(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""{name}_c AS (SELECT {by}measure, bucket, n, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {by}measure) AS total
          FROM (SELECT {by}measure, bucket, sum(n) AS n FROM hist GROUP BY ALL)),
        {name} AS (SELECT {by}measure, max(total) AS n, min(bucket) FILTER (run * 100 >= total * 25) AS q1, min(bucket) FILTER (run * 100 >= total * 75) AS q3 FROM {name}_c GROUP BY ALL)"""

    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in MEASURES.items()) + " END"
    within = " AND ".join(f"{share[m]} <= l.{m}" for m in MEASURES)
    limits = ", ".join(f"max(most) FILTER (measure = '{m}') AS {m}" for m in MEASURES)
    pick = lambda c: f"CASE WHEN o.n >= {rules.least_group} THEN o.{c} WHEN g.n >= {rules.least_group} THEN g.{c} ELSE e.{c} END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  w AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '') AS lines FROM d),
  wins AS (SELECT rid, i, array_to_string(w[i:i + {rules.window - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {rules.window - 2})) AS i FROM w)),
  twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
  rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {rules.window})) AS p FROM twice) GROUP BY 1),
  counts AS (SELECT d.doc_id, d.lang, d.source, len(w) AS n_words, length(regexp_replace(w.t, '{SPACE}', '', 'g')) AS word_chars, length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g')) AS n_upper
    FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
  hist AS (SELECT lang, source, measure, {_bucket('v')} AS bucket, count(*) AS n FROM ({shares}) GROUP BY ALL),
  {quartiles('own', 'lang, source')}, {quartiles('language', 'lang')}, {quartiles('whole', '')},
  lim AS (SELECT o.lang, o.source, measure, {pick('q3')} AS q3, {pick('q1')} AS q1 FROM own o JOIN language g USING (lang, measure) JOIN whole e USING (measure)),
  l AS (SELECT lang, source, {limits} FROM (SELECT *, q3 + {rules.reach} * greatest(q3 - q1, {least}) AS most FROM lim) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM (
  SELECT c.*, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeats} * n_words AS base_failed, {within} AS inside FROM counts c JOIN l USING (lang, source))
"""


SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
  q AS (SELECT DISTINCT item_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
  m AS (SELECT rid, doc_id, 10 + (90 * len(w) * docs) // total AS m FROM d, s),
  r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
