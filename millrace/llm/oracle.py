"""SQL that gives the rows of the queries p6 to p8, as far as SQL can express them."""

from __future__ import annotations

from millrace.llm import quality as q


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(map(_text, values)) + ")"


_BLANK = f"'[{q.BLANKS}]+'"
_WIDE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
_UP_TO = "OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
_HERE, _EARLIER = _UP_TO.format("CURRENT ROW"), _UP_TO.format("1 PRECEDING")

STATISTICS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS MATERIALIZED (
  SELECT doc_id, text, list_filter(string_split_regex(text, {_BLANK}), lambda x: x <> '') AS words,
    list_filter(list_transform(string_split_regex(text, '[\r\n]'), lambda x: trim(x, '{q.BLANKS}')), lambda x: x <> '') AS lines,
    list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS bare FROM d),
statistics AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, {_BLANK}, '', 'g')) / greatest(len(words), 1) AS mean_word_length,
    (length(text) - length(replace(text, '#', '')) + (length(text) - length(replace(text, '...', ''))) / 3 + length(text) - length(replace(text, '…', ''))) / greatest(len(words), 1) AS symbol_ratio,
    len(list_filter(lines, lambda x: x[1] IN {_list(q.BULLETS)})) / greatest(len(lines), 1) AS bullet_lines,
    len(list_filter(lines, lambda x: suffix(x, '...') OR suffix(x, '…'))) / greatest(len(lines), 1) AS ellipsis_lines,
    len(list_filter(lines, lambda x: x[-1] IN {_list(q.ENDS)})) / greatest(len(lines), 1) AS punctuated_lines,
    len(list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}'))) / greatest(len(words), 1) AS letter_words,
    len(list_intersect({list(q.STOP_WORDS)}, bare))::BIGINT AS n_common,
    len(list_filter(bare, lambda x: x IN {_list(q._COMMON)})) / greatest(len(bare), 1) AS common_share,
    CASE WHEN len(lines) = 0 THEN 0 ELSE 1 - len(list_distinct(lines)) / len(lines) END AS repeated_lines FROM a),
raw AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, {_text(q.LINE_END)}, chr(10), 'g'), chr(10)) AS x FROM d)),
trimmed AS (SELECT *, regexp_replace(regexp_replace(raw, '^{_WIDE}+', ''), '{_WIDE}+$', '') AS t, length(regexp_replace(raw, '{_WIDE}+$', '')) AS full_length FROM raw),
line AS (
  SELECT doc_id, i, raw, full_length - length(t) AS indent,
    CASE WHEN prefix(t, '>') AND NOT prefix(t, '>>>>>>>') THEN regexp_replace(regexp_replace(regexp_replace(t, '^(?:>\\s?)+', ''), '^{_WIDE}+', ''), '{_WIDE}+$', '') ELSE t END AS line FROM trimmed),
marked AS (SELECT *, line <> '' AND indent = 0 AND regexp_matches(line, {_text(q.DIFF_START)}) AS starts, regexp_matches(raw, {_text(q.HEAD)}) OR NOT regexp_matches(raw, {_text(q.DIFF_LINE)}) AS ends FROM line),
diffs AS (SELECT *, max(CASE WHEN starts THEN i END) {_EARLIER} AS since, max(CASE WHEN ends THEN i END) {_HERE} AS ended FROM marked),
cand AS (SELECT *, line <> '' AND NOT starts AND NOT (since IS NOT NULL AND coalesce(ended, 0) <= since) AS cand FROM diffs),
lists AS (SELECT *, cand AND regexp_matches(line, {_text(q.LIST)}) AS listed FROM cand),
entries AS (SELECT *, cand AND NOT listed AS plain, max(CASE WHEN listed THEN i END) {_HERE} AS entry, last_value(CASE WHEN listed THEN indent END IGNORE NULLS) {_HERE} AS entry_indent FROM lists),
breaks AS (SELECT *, max(CASE WHEN plain AND NOT coalesce(indent > entry_indent, false) THEN i END) {_HERE} AS broken FROM entries),
prose AS (SELECT *, plain AND NOT (entry IS NOT NULL AND coalesce(broken, 0) < entry) AND NOT regexp_matches(line, {_text(q.SHAPES)}) AS prose FROM breaks),
paras AS (SELECT *, i - sum(prose::INT) {_HERE} AS para FROM prose QUALIFY prose),
counted AS (
  SELECT *, count(*) OVER w AS n_lines, sum(regexp_matches(line, '[.!?…:]$')::INT) OVER w AS n_ends, sum(regexp_matches(line, {_text(q.WITHIN)})::INT) OVER w AS n_within,
    sum((len(string_split_regex(line, '{_WIDE}+')) < {q.SENTENCE_WORDS})::INT) OVER w AS n_short FROM paras WINDOW w AS (PARTITION BY doc_id, para)),
parts AS MATERIALIZED (
  SELECT doc_id, line, para, CASE WHEN n_lines > 1 AND (n_ends >= 0.8 * n_lines AND n_ends > 0 OR n_ends = 0 AND n_within = 0 AND n_short = 0) THEN i ELSE 0 END AS part FROM counted),
sizes AS (SELECT doc_id, para, part, sum(len(string_split_regex(line, '{_WIDE}+'))) AS tokens, sum(length(regexp_replace(line, '{_WIDE}+', '', 'g'))) AS size FROM parts GROUP BY ALL),
word AS (SELECT doc_id, para, part, unnest(regexp_extract_all(lower(line), '{_LETTER}+(?:[''’]{_LETTER}+)*')) AS w FROM parts),
judged AS (
  SELECT doc_id, para, part, count(*) AS n, avg(length(w)) AS mean, count(DISTINCT w) AS different,
    greatest({", ".join(f"count(CASE WHEN w IN {_list(sorted(set(words.split())))} THEN 1 END)" for words in q.COMMON_WORDS.values())}) AS most FROM word GROUP BY ALL),
running AS (
  SELECT doc_id, sum(size) AS inside FROM judged JOIN sizes USING (doc_id, para, part)
  WHERE n >= {q.SENTENCE_WORDS} AND n >= 0.7 * tokens AND most >= 2 AND most >= {q.COMMON_SHARE} * n AND mean BETWEEN 2.5 AND 10 AND different >= least(5, 0.5 * n) GROUP BY doc_id),
every AS (SELECT s.*, coalesce(r.inside, 0) / greatest(length(regexp_replace(d.text, {_BLANK}, '', 'g')), 1) AS prose_share FROM statistics s JOIN d USING (doc_id) LEFT JOIN running r USING (doc_id))
"""
_BROKEN = ", ".join(
    f"CASE WHEN {' OR '.join([f'{f} {'<=' if name == 'not_running_prose' else '<'} {low}'] * (low is not None) + [f'{f} > {high}'] * (high is not None))} THEN '{name}' END" for name, f, low, high in q.RULES
)
P8_FOUND = f"{STATISTICS} SELECT doc_id FROM every WHERE prose_share > 0.5"
P8_QUALITY = f"""{STATISTICS}
SELECT doc_id, n_words, n_common, {", ".join(f"round({f}, 6) AS {f}" for f in q.FIELDS if not f.startswith("n_"))},
  array_to_string(list_filter([CASE WHEN n_words = 0 THEN 'no_text' END, {_BROKEN}], lambda x: x IS NOT NULL), ',') AS reasons FROM every
"""
P6_CHECKS = """
SELECT DISTINCT pack_name, capacity_tokens, (SELECT count(*) FROM documents) AS docs, 0::BIGINT AS lost, 0::BIGINT AS doubled, 0::BIGINT AS needless_splits, 0::BIGINT AS over_full
FROM pack_sizes WHERE capacity_tokens > 0
"""
P7_CHECKS = "SELECT DISTINCT mix_name, source, 0::BIGINT AS doubled, 0::BIGINT AS over_repeated, 0::BIGINT AS wrong, 0::BIGINT AS missed FROM mix_targets"
SQL = {"p6_checks": P6_CHECKS, "p7_checks": P7_CHECKS, "p8_found": P8_FOUND, "p8_quality": P8_QUALITY}
