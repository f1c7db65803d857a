"""SQL that says the same as an operator, for those that SQL can express."""

from __future__ import annotations

# The mix of sources: sizes, targets by filling the smallest sources first, ranks, and the landing document.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
  FROM d GROUP BY source
),
f AS (
  SELECT *, source_size * 2.0::DOUBLE AS full_size, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM s
),
l AS (
  SELECT *, (total - coalesce(sum(full_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
),
c AS (SELECT arg_min(level, place) AS common FROM l WHERE level * weight < full_size),
t AS (
  SELECT source, source_size, CASE WHEN common IS NULL THEN full_size ELSE least(full_size, common * weight) END AS target
  FROM l, c
),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
),
r AS (
  SELECT d.doc_id, d.source, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
         (('0x' || substr(md5('1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
),
q AS (
  SELECT *, CASE WHEN rest > 0 AND size > 0 THEN (u / (1 - u)) / ((rest / source_size) / (1 - rest / source_size)) END AS rank FROM r
),
i AS (SELECT source, doc_id, rank, sum(size) AS words, min(rest) AS rest FROM q WHERE rank IS NOT NULL GROUP BY ALL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST) AS pos,
         sum(words) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto
  FROM i
),
stop AS (
  SELECT source, min(pos) AS stop_at, arg_min(rest - (upto - words), pos) AS remaining FROM o WHERE upto > rest GROUP BY source
),
land AS (
  SELECT o.source, arg_min(CASE WHEN abs(words - remaining) < remaining THEN pos END, (abs(words - remaining), pos)) AS land_at
  FROM o JOIN stop ON o.source IS NOT DISTINCT FROM stop.source WHERE pos >= stop_at GROUP BY o.source
),
picked AS (
  SELECT o.source, o.doc_id FROM o
  LEFT JOIN stop ON o.source IS NOT DISTINCT FROM stop.source
  LEFT JOIN land ON o.source IS NOT DISTINCT FROM land.source
  WHERE stop_at IS NULL OR pos < stop_at OR pos = land_at
)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, (q.whole + (p.source IS NOT NULL OR p.doc_id IS NOT NULL)::INT)::BIGINT AS copies,
       ((q.whole + (p.source IS NOT NULL OR p.doc_id IS NOT NULL)::INT) * q.size)::BIGINT AS taken
FROM q LEFT JOIN picked p ON q.source IS NOT DISTINCT FROM p.source AND q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.rank IS NOT NULL
"""

# Line dedup: lines of five words or more, equal or one word apart from an earlier one, go. Candidates are
# found by deletion variants as strings, and the rule is then tested on the words.
LINE_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at_line
  FROM documents
),
l AS (
  SELECT doc_id, at_line, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM raw
),
e AS (
  SELECT w, array_to_string(w, ' ') AS body, row_number() OVER (ORDER BY min((doc_id, at_line))) AS place FROM l WHERE len(w) >= 5 GROUP BY w
),
v AS (
  SELECT place, w, unnest(list_concat([body], list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_concat(w[1:i-1], w[i+1:]), ' ')))) AS variant
  FROM e
),
p AS (
  SELECT DISTINCT b.place, a.w AS wa, b.w AS wb FROM v a JOIN v b ON a.variant = b.variant AND a.place < b.place
),
near AS (
  SELECT DISTINCT place FROM p
  WHERE (len(wa) = len(wb) AND len(list_filter(range(1, len(wa) + 1), lambda i: wa[i] <> wb[i])) = 1)
     OR (len(wa) = len(wb) + 1 AND len(list_filter(range(1, len(wa) + 1), lambda i: list_concat(wa[1:i-1], wa[i+1:]) = wb)) > 0)
     OR (len(wb) = len(wa) + 1 AND len(list_filter(range(1, len(wb) + 1), lambda i: list_concat(wb[1:i-1], wb[i+1:]) = wa)) > 0)
),
j AS (
  SELECT l.doc_id, l.at_line, l.line,
         coalesce(len(l.w) >= 5 AND (near.place IS NOT NULL OR row_number() OVER (PARTITION BY l.w ORDER BY l.doc_id, l.at_line) > 1), false) AS gone
  FROM l LEFT JOIN e ON l.w = e.w LEFT JOIN near ON e.place = near.place
)
SELECT d.doc_id, coalesce(count(*) FILTER (NOT gone), 0)::BIGINT AS n_kept, coalesce(count(*) FILTER (gone), 0)::BIGINT AS n_dropped,
       md5(coalesce(string_agg(line, chr(10) ORDER BY at_line) FILTER (NOT gone), '')) AS kept_md5
FROM j JOIN documents d ON j.doc_id = d.doc_id GROUP BY d.doc_id
"""

# Inner products of the integer vectors, in whole tables; the queries are every fiftieth id.
SEARCH_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# Components of documents whose sets of five-word shingles have a Jaccard similarity of 3/4 or more.
COMPONENT_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM t
),
n AS (SELECT t.doc_id, count(s.shingle) AS n_shingles FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT p.u, p.v FROM p JOIN n a ON a.doc_id = p.u JOIN n b ON b.doc_id = p.v
  WHERE 100 * c >= 75 * (a.n_shingles + b.n_shingles - c)
),
both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (
  SELECT doc_id, doc_id AS found FROM n
  UNION
  SELECT both_ways.v, reach.found FROM reach JOIN both_ways ON both_ways.u = reach.doc_id WHERE reach.found < both_ways.v
)
SELECT n.doc_id, n.n_shingles, min(reach.found) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY ALL
"""
