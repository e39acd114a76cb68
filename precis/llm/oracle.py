"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from precis.llm.mixing import SEED

OP10 = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio,
             CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights FROM w),
l AS (SELECT *, CAST(total - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(weights - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level < ratio),
t AS (SELECT source, source_size, CASE WHEN v.level IS NULL OR v.level * weight >= cap THEN CAST(cap AS DOUBLE)
             ELSE v.level * weight END AS target FROM l LEFT JOIN v ON true),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
x AS (SELECT g.*, u.target - u.whole * u.source_size AS rest, u.source_size, u.target, u.whole, sum(words) OVER (PARTITION BY g.source ORDER BY h) AS upto
      FROM g JOIN u ON g.source IS NOT DISTINCT FROM u.source),
y AS (SELECT *, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS wanted FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
             CASE WHEN upto > rest AND words > 0 AND words < 2 * wanted THEN abs(wanted - words) END NULLS LAST, h) = 1
             AND upto > rest AND words > 0 AND words < 2 * wanted AS one FROM y)
SELECT doc_id, size, source_size, target,
       CAST(size * least(whole + CASE WHEN upto <= rest OR one THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source AND d.h = z.h"""

OP2 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND list_dot_product(x, x) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, min(r.other) AS component_id,
       v.vec_id = min(r.other) AS kept
FROM v JOIN reach r USING (vec_id) GROUP BY v.vec_id"""

OP4 = """
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, text,
                  coalesce(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT), -1) AS key FROM documents),
o AS (SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total, row_number() OVER w - 1 AS rank
      FROM d WINDOW w AS (ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CAST(least((2 * upto - size) * 40 // (2 * total), 39) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, CAST(NULL AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s"""

OP9 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, q.row, c.vec_id,
             CAST(CASE WHEN len(q.x) = len(c.x) AND len(q.x) > 0 THEN list_dot_product(q.x, c.x) ELSE
               coalesce(list_sum(list_transform(list_zip(q.x, c.x, true), lambda p: p[1] * p[2])), 0) END AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_OP11_ASSIGN = """
d{r} AS MATERIALIZED (SELECT v.row, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM v CROSS JOIN c{r} c),
a{r} AS MATERIALIZED (SELECT row, CAST(arg_min(c, (d, c)) AS INTEGER) AS c, min(d) AS d FROM d{r} GROUP BY row)"""
_OP11_MEANS = """
m{r} AS (SELECT a.c, i.j, sum(v.x[i.j]) AS s, count(*) AS n FROM a{p} a JOIN v USING (row) CROSS JOIN range(1, 65) i(j)
         GROUP BY a.c, i.j),
c{r} AS MATERIALIZED (SELECT o.c, coalesce(list((m.s - ((m.s % m.n) + m.n) % m.n) // m.n ORDER BY m.j) FILTER (WHERE m.n > 0),
        any_value(o.x)) AS x FROM c{p} o LEFT JOIN m{r} m USING (c) GROUP BY o.c)"""
OP11 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (
  SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 16)),""" + ",".join(
    _OP11_ASSIGN.format(r=r) + "," + _OP11_MEANS.format(r=r + 1, p=r) for r in range(3)) + "," + _OP11_ASSIGN.format(r=3) + """
SELECT v.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 a JOIN v USING (row) JOIN c3 ON c3.c = a.c"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL) USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n,
             1 + CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 1) // CAST(g.total + g.v AS HUGEINT) AS p
      FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // CAST(sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang) AS HUGEINT) AS q
      FROM p GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item,
                 coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y USING (lang, term)
                           WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS MATERIALIZED (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT r, count(*) AS n_lines, count(hot.key) AS n_dropped,
             string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL) AS kept
      FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN g USING (r)"""

#: op4's CRC-32 has no function here, so its SQL stays with the tests (``OP4``, all columns but that one).
ORACLE: dict[str, str] = {"op2_itq_hamming_tables": OP2, "op9_norm_bucket_topk": OP9, "op10_water_filling_mix": OP10,
                          "op11_walsh_hadamard_clusters": OP11, "op12_transducer_divergence": OP12,
                          "op13_line_hash_arrays": OP13}
