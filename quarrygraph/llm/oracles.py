"""SQL (DuckDB) for the operators whose rows it can express, written from their contracts and not from their methods."""

AUDIT = r"""
WITH letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
flagged AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM doc
),
lab AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
tally AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
  FROM flagged LEFT JOIN lab USING (doc_id) GROUP BY 1, 2
),
placed AS (
  SELECT part, fails, n, g, x, filter_order, least(
    CASE WHEN contains(fails, 'A') THEN instr(filter_order, 'A') ELSE 99 END,
    CASE WHEN contains(fails, 'B') THEN instr(filter_order, 'B') ELSE 99 END,
    CASE WHEN contains(fails, 'C') THEN instr(filter_order, 'C') ELSE 99 END,
    CASE WHEN contains(fails, 'D') THEN instr(filter_order, 'D') ELSE 99 END,
    CASE WHEN contains(fails, 'E') THEN instr(filter_order, 'E') ELSE 99 END
  ) AS gone
  FROM tally, orders
),
out AS (
  SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS own,
    coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone < step AND contains(fails, substr(filter_order, step::INTEGER, 1))), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = substr(filter_order, step::INTEGER, 1)), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (gone = step), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM placed, range(1, 6) s(step) GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM out
"""

DIVERGENCE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
said AS (SELECT k, lang, source, unnest(terms) AS term FROM doc),
groups AS (SELECT DISTINCT lang, source FROM doc),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM said GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
cell AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sized AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN cell USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v.v) AS p, 1 + (1000000000 * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM sized s JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN cell c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 3
),
each AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM each
) WHERE part = 'pair' OR rank <= 50
"""
