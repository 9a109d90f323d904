"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quarry.llm import quality

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def components(nodes: str, links: str) -> str:
    """CTEs ``reach`` and ``comp`` (node, component) for tables of nodes (n) and links (a, b)."""
    return f"""
both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach(n, r) AS (SELECT n, n FROM {nodes} UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
comp AS (SELECT n AS node, min(r) AS component FROM reach GROUP BY n)"""


SUBSTRING = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50) x),
first AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps
         FROM (SELECT win.doc_id, unnest(range(win.i, win.i + 50)) AS p FROM win JOIN first ON first.k = win.k AND first.d < win.doc_id) x
         GROUP BY doc_id),
levels AS (SELECT unnest(range(0, 12)) AS e),
longer AS (SELECT doc_id, n, md5(array_to_string(ws[i:i + n - 1], ' ')) AS k
           FROM (SELECT doc_id, ws, CAST(50 * 2 ** e AS INTEGER) AS n, unnest(range(1, len(ws) - CAST(50 * 2 ** e AS INTEGER) + 2)) AS i
                 FROM w JOIN levels ON len(ws) >= 50 * 2 ** e) x),
shared AS (SELECT n, k FROM longer GROUP BY n, k HAVING min(doc_id) < max(doc_id)),
longest AS (SELECT doc_id, max(n) AS n FROM longer JOIN shared USING (n, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256,
       CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_repeat
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
nodes AS (SELECT doc_id AS n FROM documents),{components("nodes", "links")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, component = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.node = d.doc_id
"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
nodes AS (SELECT vec_id AS n FROM v),{components("nodes", "links")},
degree AS (SELECT a AS n, count(*) AS c FROM both_ways GROUP BY a)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, component AS component_id, component = vec_id AS kept
FROM v JOIN comp ON comp.node = vec_id LEFT JOIN degree ON degree.n = vec_id
"""

# The rules of quality.RULES, in the same order: (against, for).
VOTES = [
    ("n_words < 10", "n_words >= 30"),
    ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    ("2 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    ("10 * n_symbols > 3 * n_words", "100 * n_symbols <= 5 * n_words"),
    ("4 * n_marks > n_words", "20 * n_marks <= n_words"),
    ("word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words"),
    ("10 * n_capitals > 4 * word_chars", "10 * n_capitals <= word_chars"),
    ("10 * n_shouts > 3 * n_words", "100 * n_shouts <= 5 * n_words"),
    ("n_words >= 30 AND n_distinct * n_distinct < 4 * n_words", "n_distinct * n_distinct >= 9 * n_words"),
]


def quality_sql() -> str:
    m = len(VOTES)
    (g0, b0), (wg, wb) = quality.START, quality.WEIGHT
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE 2 END" for bad, good in VOTES)

    def odds(p: str) -> str:
        return f"ln({p}.prior / (1 - {p}.prior)) + " + " + ".join(
            f"CASE votes[{j}] WHEN 1 THEN ln({p}.good[{j}] / {p}.bad[{j}]) WHEN 0 THEN ln((1 - {p}.good[{j}]) / (1 - {p}.bad[{j}])) ELSE 0 END" for j in range(1, m + 1))

    def rate(j: int, weight: str, a: float, share: float) -> str:
        up, on = (f"coalesce(sum(CASE WHEN votes[{j}] {test} THEN {weight} END), 0)" for test in ("= 1", "< 2"))
        known = f"{share}::DOUBLE * (sum(c) + 1)"
        return f"({up} + {known} * {a}::DOUBLE) / ({on} + {known})"

    def rates(weight: str, a: float, share: float) -> str:
        return "[" + ", ".join(rate(j, weight, a, share) for j in range(1, m + 1)) + "]"

    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) x),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT win.doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (doc_id, k)) x GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
                len(regexp_extract_all(t, '[#*$%&|<>]+')) AS n_marks, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
                len(regexp_extract_all(t, '[!?]{{2,}}')) AS n_shouts, len(list_distinct(ws)) AS n_distinct
         FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM w) w LEFT JOIN rep ON rep.doc_id = w.doc_id),
voted AS (SELECT *, [{votes}] AS votes FROM base),
pat AS (SELECT votes, CAST(count(*) AS DOUBLE) AS c FROM voted GROUP BY votes),
em(it, prior, good, bad) AS (
  SELECT 0, 0.85::DOUBLE, {[g0] * m}::DOUBLE[], {[b0] * m}::DOUBLE[]
  UNION ALL
  SELECT it + 1, (sum(g) + 1.7::DOUBLE) / (sum(c) + 2), {rates("g", g0, wg)}, {rates("c - g", b0, wb)}
  FROM (SELECT em.it, votes, c, c / (1 + exp(-({odds("em")}))) AS g FROM em, pat WHERE em.it < {quality.ROUNDS}) x GROUP BY it)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 1 / (1 + exp(-({odds("em")}))) >= 0.5 AS kept
FROM voted, em WHERE em.it = {quality.ROUNDS}
"""

CODES = """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT)) AS x FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
parts AS (SELECT vec_id, label, p AS part, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM kept, unnest(range(16)) AS t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
c0 AS (SELECT part, entry, x FROM parts JOIN firsts USING (vec_id)),
a1 AS (SELECT vec_id, label, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.label, p.part, p.x, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM parts p JOIN c0 c USING (part)) q GROUP BY vec_id, label, part, x),
s1 AS (SELECT part, entry, list(m ORDER BY pos) AS x FROM (
  SELECT part, entry, pos, CAST(sum(v) AS BIGINT) // count(*) - CASE WHEN CAST(sum(v) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END AS m
  FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a1) q GROUP BY part, entry, pos) q GROUP BY part, entry),
c1 AS (SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM c0 b LEFT JOIN s1 s USING (part, entry)),
a2 AS (SELECT vec_id, label, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.label, p.part, p.x, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM parts p JOIN c1 c USING (part)) q GROUP BY vec_id, label, part, x),
s2 AS (SELECT part, entry, list(m ORDER BY pos) AS x FROM (
  SELECT part, entry, pos, CAST(sum(v) AS BIGINT) // count(*) - CASE WHEN CAST(sum(v) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END AS m
  FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a2) q GROUP BY part, entry, pos) q GROUP BY part, entry),
c2 AS (SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM c1 b LEFT JOIN s2 s USING (part, entry)),
a3 AS (SELECT vec_id, label, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.label, p.part, p.x, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM parts p JOIN c2 c USING (part)) q GROUP BY vec_id, label, part, x),
rows AS (SELECT vec_id, label, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM rows, books
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS k, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY k, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((('0x' || substr(h, CAST(10 * (i // 8) + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
