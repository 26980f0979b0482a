"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re

from logtel.llm import centroids, licenses, quality_rules


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    """The sentence and rule tables as SQL."""
    known = ", ".join(f"({_text(t)}, {_text(f'[{name}]')})" for name, texts in licenses.SENTENCES.items() for t in texts)

    lone = _text(r"\[tag-[^\]]*\]")

    def ruled(column: str) -> str:
        return licenses.rewritten(column, lambda text, old, new: f"replace({text}, {_text(old)}, {_text(new)})")

    def sequence(ends: str) -> str:
        return f"""(
            SELECT coalesce(string_agg(k.mark, '' ORDER BY s.place), '')
            FROM (SELECT unnest(parts) AS sentence, unnest(range(len(parts))) AS place FROM (SELECT regexp_split_to_array(d.t, {_text(ends)}) AS parts)) AS s
            JOIN known AS k ON k.sentence = trim(regexp_replace(lower(s.sentence), '[^a-z0-9]+', ' ', 'g'))
        )"""

    return f"""
WITH known(sentence, mark) AS (VALUES {known}),
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
every AS (SELECT d.doc_id, regexp_matches(d.t, {_text(licenses.ANCHOR)}) AS anchored, {sequence(licenses.ENDS[0])} AS all0, {sequence(licenses.ENDS[1])} AS all1 FROM texts AS d),
ids AS (
    SELECT doc_id, CASE WHEN anchored THEN all0 ELSE regexp_replace(all0, {lone}, '', 'g') END AS ids0,
           CASE WHEN anchored THEN all1 ELSE regexp_replace(all1, {lone}, '', 'g') END AS ids1
    FROM every
),
ruled AS (SELECT *, {ruled('ids0')} AS ruled0, {ruled('ids1')} AS ruled1 FROM ids)
SELECT doc_id,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(
           regexp_extract_all(ruled0, '<([^>]*)>', 1), regexp_extract_all(ruled1, '<([^>]*)>', 1)))), ','), '') AS licenses,
       greatest(length(ids0) - length(replace(ids0, '[', '')), length(ids1) - length(replace(ids1, '[', ''))) AS n_known,
       least(length(ruled0) - length(replace(ruled0, '[', '')), length(ruled1) - length(replace(ruled1, '[', ''))) AS n_unmatched
FROM ruled
"""


OP2 = r"""
WITH rows AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keep FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM kept
"""

OP9 = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM texts
"""


def cluster_sql(spec: centroids.Clustering = centroids.Clustering()) -> str:
    """Rounds of assignment and update as a chain of tables."""
    steps = [f"""
vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, [floor({centroids.SCALE} * e::DOUBLE)::BIGINT FOR e IN embedding] AS x
    FROM embeddings WHERE len(embedding) = {spec.dimensions} AND len([e FOR e IN embedding IF isfinite(e)]) = {spec.dimensions}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{spec.seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM vectors
    QUALIFY c < {spec.centroids}
)"""]
    for k in range(spec.rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
    SELECT rid, v.vec_id, v.x, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c{k}.x)])::BIGINT AS d FROM vectors AS v, c{k}
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
)""")
        if k < spec.rounds:
            steps.append(f"""
m{k} AS (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x
    FROM (SELECT c, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(len(x))) AS i FROM a{k}) GROUP BY c, i)
    GROUP BY c
), c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (c))""")
    last = spec.rounds
    return f"""
WITH {','.join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance,
       sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{last}.x, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (c)
"""


def quality_sql() -> str:
    """Measures and threshold table as SQL."""
    q = quality_rules
    listed = ", ".join(_text(w) for w in sorted({w for words in q.STOP_WORDS.values() for w in words}))
    symbols = f"[{re.escape(q.SYMBOLS)}]"
    values = {r.measure: f"m.{r.measure}" for r in q.RULES} | {r.base: f"m.{r.base}" for r in q.RULES} | {"one": "1"}

    def holds(rule: q.Rule) -> str:
        measure, base = values[rule.measure], values[rule.base]
        tests = [f"1000 * {measure} >= {rule.at_least} * {base}"] if rule.at_least is not None else []
        tests += [f"1000 * {measure} <= {rule.at_most} * {base}"] if rule.at_most is not None else []
        return f"({' AND '.join(tests)} OR {base} = 0)"

    broken = ", ".join(f"CASE WHEN NOT {holds(r)} THEN {_text(r.name)} END" for r in q.RULES)
    return f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
    SELECT rid, w, i FROM (
        SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM texts)
    )
),
lines AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM texts) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
windows AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, w, lead1, lead2) AS n FROM (
        SELECT rid, i, w, lead(w, 1) OVER (PARTITION BY rid ORDER BY i) AS lead1, lead(w, 2) OVER (PARTITION BY rid ORDER BY i) AS lead2 FROM words
    ) WHERE lead2 IS NOT NULL
),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY rid),
of_words AS (
    SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, max(length(w)) AS longest_word,
           count(*) FILTER (trim(lower(w), {_text(q._POINTS)}) IN ({listed})) AS n_stop_words,
           count(*) FILTER (regexp_matches(w, '\\p{{L}}')) AS n_lettered,
           count(*) FILTER (length(w) > 1 AND upper(w) = w AND lower(w) <> w) AS n_shouted
    FROM words GROUP BY rid
),
of_lines AS (
    SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines,
           count(*) FILTER (regexp_matches(x, {_text(q._BULLET)})) AS n_bullets, count(*) FILTER (regexp_matches(x, {_text(q._CUT)})) AS n_cut_lines
    FROM lines GROUP BY rid
),
m AS (
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(longest_word, 0) AS longest_word,
           coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lettered, 0) AS n_lettered, coalesce(n_shouted, 0) AS n_shouted,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_bullets, 0) AS n_bullets,
           coalesce(n_cut_lines, 0) AS n_cut_lines, coalesce(repeated.n, 0) AS n_repeat_words,
           length(t) - length(regexp_replace(t, {_text(symbols)}, '', 'g')) AS n_symbols
    FROM texts LEFT JOIN of_words USING (rid) LEFT JOIN of_lines USING (rid) LEFT JOIN repeated USING (rid)
),
judged AS (
    SELECT m.*, n_words < {q.MIN_WORDS} OR 1000 * n_repeat_words > {q.MAX_REPEATED} * n_words AS base_failed, concat_ws(',', {broken}) AS broken FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM judged
"""
