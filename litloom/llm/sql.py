"""The same results in SQL, where SQL can express them."""

from __future__ import annotations


def _id(column: str) -> str:
    t = f"trim({column})"
    return f"CASE WHEN {t} = '' THEN NULL WHEN instr({t}, ':') > 0 THEN lower(split_part({t}, ':', 1)) || substr({t}, instr({t}, ':')) ELSE {t} END"


def _filled(column: str) -> str:
    return f"CASE WHEN lower(trim({column})) IN ('', '-', 'n/a') THEN NULL ELSE trim({column}) END"


_LATEST = "arg_max({0}, coalesce(updated_at, TIMESTAMP '1000-01-01')) FILTER ({0} IS NOT NULL) AS {0}"

P1_FOUND = f"""
WITH loads AS (
  SELECT {_id('record_id')} AS record_id, {_filled('work_id')} AS work_id,
         lower(translate({_filled('source')}, '-', '_')) AS source,
         lower({_filled('fulltext_status')}) AS status,
         CASE WHEN {_filled('arxiv_latest_version')} IS NOT NULL
              THEN coalesce(try_cast(regexp_extract(arxiv_latest_version, '(\\d+)', 1) AS INT), 0) END AS version,
         updated_at
  FROM manifest_dedup),
records AS (
  SELECT record_id, {', '.join(_LATEST.format(c) for c in ('work_id', 'source', 'status', 'version'))}
  FROM loads WHERE record_id IS NOT NULL GROUP BY record_id),
ranked AS (
  SELECT work_id, record_id, count(*) OVER (PARTITION BY work_id) AS n,
         row_number() OVER (PARTITION BY work_id ORDER BY
           CASE WHEN source = 'arxiv' AND status IN ('html', 'ar5iv', 'pdf') THEN 0
                WHEN source = 'acl' AND status IN ('html', 'ar5iv', 'pdf') THEN 1
                WHEN source = 'arxiv' THEN 2 ELSE 3 END,
           CASE WHEN status IN ('html', 'ar5iv') THEN 0 ELSE 1 END,
           -coalesce(version, 0), record_id) AS place
  FROM records WHERE work_id IS NOT NULL)
SELECT work_id, record_id FROM ranked WHERE n > 1 AND place = 1
"""

_FACTS = "arxiv_id openalex_id doi title authors year venue published_version_url source_url fulltext_url license in_scope topic paper_type".split()


def _round(i: int) -> str:
    return f"""
votes{i} AS (SELECT entity, field, value, round(sum(weight * -ln(1 - reliability)), 9) AS vote
  FROM claims JOIN trust{i} USING (provider) GROUP BY ALL),
best{i} AS (SELECT entity, field, value, vote, sum(vote) OVER (PARTITION BY entity, field) AS all_,
  row_number() OVER (PARTITION BY entity, field ORDER BY vote DESC, value) AS place FROM votes{i}),
trust{i + 1} AS (SELECT provider, round(greatest(0.05, least(0.99, (sum(CASE WHEN c.value = b.value THEN weight ELSE 0 END) + 3.2) / (sum(weight) + 4))), 9) AS reliability
  FROM claims c JOIN best{i} b ON c.entity = b.entity AND c.field = b.field AND b.place = 1 GROUP BY provider)"""


P1_ELECTED_FACTS = f"""
WITH records AS (
  SELECT {_id('record_id')} AS record_id, arg_max({_filled('work_id')}, coalesce(updated_at, TIMESTAMP '1000-01-01')) FILTER ({_filled('work_id')} IS NOT NULL) AS work_id
  FROM manifest_dedup GROUP BY 1),
works AS (SELECT record_id, work_id FROM records WHERE record_id IS NOT NULL AND work_id IN (SELECT work_id FROM records WHERE record_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)),
said AS (
  {' UNION '.join(f"SELECT {_id('record_id')} AS record_id, coalesce(lower(translate({_filled('source')}, '-', '_')), '(unknown)') AS provider, '{f}' AS field, {'lower' if f == 'doi' else ''}({_filled(f)}) AS value FROM manifest_dedup" for f in _FACTS)}),
claims AS (SELECT work_id AS entity, field, value, provider, count(*) AS weight FROM said JOIN works USING (record_id) WHERE value IS NOT NULL GROUP BY ALL),
trust0 AS (SELECT DISTINCT provider, CAST(0.8 AS DOUBLE) AS reliability FROM claims),{','.join(map(_round, range(4)))}
SELECT entity AS work_id, field, value, round(vote / all_, 4) AS share FROM best3 WHERE place = 1
"""

_GROUPS = f"""
rows_ AS (
  SELECT {_id('record_a')} AS x, {_id('record_b')} AS y, lower(trim(decision)) AS decision, scored_at, pair_no
  FROM dedup_candidates),
last_ AS (
  SELECT least(x, y) AS a, greatest(x, y) AS b,
         arg_max(decision, (coalesce(scored_at, TIMESTAMP '1000-01-01'), pair_no)) AS decision
  FROM rows_ WHERE x IS NOT NULL AND y IS NOT NULL AND decision NOT IN ('', '-', 'n/a') GROUP BY 1, 2),
ties AS (SELECT a, b FROM last_ WHERE decision = 'merge' AND a <> b),
both_ AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
reach AS (
  SELECT a AS node, a AS other FROM both_
  UNION SELECT r.node, t.b FROM reach r JOIN both_ t ON r.other = t.a),
groups_ AS (SELECT node AS record_id, min(other) AS group_id FROM reach GROUP BY node)
"""

P3_FOUND = f"WITH RECURSIVE {_GROUPS} SELECT record_id, group_id FROM groups_"
P3_GROUP_SIZES = f"WITH RECURSIVE {_GROUPS} SELECT group_id, count(*) AS records FROM groups_ GROUP BY group_id"

P5_FOUND = r"""
SELECT DISTINCT c.chunk_id FROM chunks_toy c JOIN chunk_limits k ON lower(trim(c.kind)) = lower(trim(k.kind))
WHERE len(regexp_extract_all(c.embed_text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) > k.max_tokens
"""

P5_INVARIANTS = r"""
SELECT DISTINCT chunk_id, CAST(n AS BIGINT) AS new_tokens, 0 AS gaps, 0 AS missing, true AS within
FROM (SELECT c.chunk_id, k.max_tokens, len(regexp_extract_all(c.embed_text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS n
      FROM chunks_toy c JOIN chunk_limits k ON lower(trim(c.kind)) = lower(trim(k.kind)))
WHERE n > max_tokens
"""

P6_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
wanted AS (
  SELECT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS passage
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
there AS (
  SELECT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS passage
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM there JOIN wanted USING (n, passage)
"""


P7_LIMITS = r"""
WITH d AS (SELECT doc_id, min(coalesce(nullif(regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g'), ''), '(none)')) AS source FROM documents WHERE length(text) > 0 GROUP BY doc_id),
n AS (SELECT source, count(*) AS k FROM d GROUP BY source),
t AS (SELECT source, sum(target_share) AS s, min(max_repeats) AS r FROM mix_targets GROUP BY source)
SELECT source, coalesce(round(s, 6), 0.0) AS target_share, coalesce(r, 0) AS max_repeats, coalesce(k, 0) AS available_documents, true AS within FROM n FULL JOIN t USING (source)
"""


def oracle_sql() -> dict[str, str]:
    return {name.lower(): text for name, text in globals().items() if name[:1] == "P" and name[1:2].isdigit()}
