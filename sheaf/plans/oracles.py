"""DuckDB SQL for the queries, written on its own: theta joins and gaps and islands where the engine folds arrays."""

from __future__ import annotations

_LINES = """
l AS (SELECT source, doc_id, u.i - 1 AS line_no, u.line
      FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i))
"""

_CLEAN = r"""
CASE WHEN regexp_matches({raw}, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{2,4}}$|^[0-9]{{4}}-[0-9]{{1,2}}|20[0-9]{{2}}[-年/.][0-9]{{1,2}}') THEN NULL ELSE
  regexp_replace(regexp_replace(
    CASE WHEN length(regexp_extract({raw}, '^(.*?)[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{2,4}}', 1)) >= 2
         THEN regexp_extract({raw}, '^(.*?)[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{2,4}}', 1) ELSE {raw} END,
    '([0-9])[MFmf]$', '\1'), '(?i)(SEX|GENDER|AGE|DATE|YEAR|MONTH|MALE|FEMALE|TAG)+$', '') END
"""

_CANDIDATES = (
    _LINES
    + r""", raw AS (
  SELECT source, doc_id, line_no, u.t, u.k
  FROM l, unnest(regexp_extract_all(line, '[a-z一-鿿][A-Z0-9][-A-Z0-9]{2,29}[-A-Z0-9]*|([A-Z0-9][-A-Z0-9]{2,29})[-A-Z0-9]*', 1)) WITH ORDINALITY AS u(t, k)
  WHERE u.t <> ''
), cut AS (SELECT source, doc_id, line_no, k, """
    + _CLEAN.format(raw="t")
    + r""" AS v FROM raw
), c AS (
  SELECT source, doc_id, line_no, arg_min(v, k) AS id FROM cut
  WHERE v IS NOT NULL AND NOT regexp_matches(v, '^[0-9]+-[0-9]+$') AND regexp_matches(v, '[0-9]') AND length(v) >= 3
    AND NOT (regexp_matches(v, '[A-Za-z]') AND length(regexp_replace(v, '[^0-9]', '', 'g')) * 2 < length(v))
  GROUP BY ALL
), s AS (
  SELECT source, doc_id, line_no, upper(id) AS id,
         upper(regexp_extract(id, '^([A-Za-z]*)([0-9]+)$', 1)) || '#' || length(regexp_extract(id, '^([A-Za-z]*)([0-9]+)$', 2)) AS shape, id AS written
  FROM c WHERE regexp_matches(id, '^[A-Za-z]*[0-9]+$')
)
"""
)

_SKELETONS = (
    _LINES
    + r""", k AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '[\s\x{00a0}\x{3000}]+', '', 'g'), '[0-9]+', '#', 'g'),
         '[A-Za-z]+', 'A', 'g'), '[一-鿿]+', '中', 'g') AS s FROM l
), kn AS (SELECT doc_id, s, count(*) AS n FROM k WHERE length(s) >= 4 AND contains(s, '#') GROUP BY ALL),
kd AS (SELECT doc_id, max(n) AS most_repeated, count(*) AS n_skeletons FROM kn GROUP BY ALL)
"""
)

_CELLS = """
c AS (SELECT o_custkey, o_orderkey AS k, (o_orderkey % 3) * 200.0 AS x0, ((o_orderkey // 3) % 40) * 30.0 AS y0,
             CASE WHEN o_orderkey % 2 = 0 THEN 'K' || lpad(o_orderkey::VARCHAR, 7, '0') END AS id FROM orders)
"""

_ROSTER = """
g AS (SELECT c_nationkey AS file, ascii(c_mktsegment) AS page, count(*) AS n, min(c_custkey) AS first,
             list('B' || lpad(c_custkey::VARCHAR, 6, '0') ORDER BY c_custkey) AS roster
      FROM customer WHERE c_custkey < 1000000 GROUP BY ALL HAVING count(*) >= 5),
r AS (SELECT file, roster FROM g QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, page, first) = 1),
s AS (SELECT s_suppkey, s_acctbal, s_nationkey AS file, 'B' || lpad((s_suppkey * 13 % 1500)::VARCHAR, 6, '0') AS id FROM supplier)
"""

_OUTPUTS = """
o AS (SELECT o_orderkey AS out_seq, CASE WHEN o_orderkey % 50 <> 0 THEN
             CASE WHEN o_orderkey % 2 = 0 THEN lpad(o_custkey::VARCHAR, 9, '0') ELSE o_custkey::VARCHAR END END AS id,
             o_orderpriority AS source, o_orderstatus = 'P' AS suspect, o_custkey FROM orders)
"""

_SEGMENTS = """
t AS (SELECT conv_id AS file, turn AS page, length(text) AS n, CASE WHEN length(text) > 400 THEN 'LONG1' ELSE 'SHORT1' END AS id FROM conversations),
b AS (SELECT *, CASE WHEN id IS DISTINCT FROM lag(id) OVER (PARTITION BY file ORDER BY page) THEN 1 ELSE 0 END AS cut FROM t),
i AS (SELECT *, sum(cut) OVER (PARTITION BY file ORDER BY page) - 1 AS seg_no FROM b)
"""

_TITLE = _LINES + r""", n AS (
  SELECT doc_id, line_no, line, trim(line) AS t, 20.0 * line_no AS y0, 8.0 * length(line) AS x1,
         20.0 * count(*) OVER (PARTITION BY doc_id) AS h, max(8.0 * length(line)) OVER (PARTITION BY doc_id) AS w FROM l
), q AS (
  SELECT doc_id, line_no, 16.0 * (1.5 - (y0 + 8) / h) * CASE WHEN y0 <= 20 THEN 1.5 ELSE 1 END * (1 + 0.3 * (1 - x1 / 2 / w)) * 0.45
         * CASE WHEN contains(line, ':') THEN 0.35 ELSE 1 END
         * CASE WHEN regexp_matches(line, '(19|20)[0-9]{2}[-/.]') THEN 0.6 ELSE 1 END * CASE WHEN length(line) > 40 THEN 0.6 ELSE 1 END AS score
  FROM n
  WHERE length(line) >= 2 AND length(t) >= 4 AND NOT contains(t, '#') AND (y0 + 8) / h <= 0.6
    AND NOT regexp_matches(t, '^[Pp][Aa][Gg][Ee]\s+[0-9]+\b') AND length(regexp_replace(t, '[0-9\s.,:;()#/&''"_-]', '', 'g')) >= 2
    AND NOT regexp_matches(t, '^[a-z]') AND NOT (regexp_matches(t, '[a-z]') AND regexp_matches(t, '\.$'))
)
SELECT doc_id, line_no, round(score, 6) AS score FROM q WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) = 1
"""

SQL = {
    "lines_split": f"WITH {_LINES} SELECT doc_id, line_no, length(line) AS n_chars, regexp_matches(line, '[0-9]') AS has_digit FROM l",
    "token_candidates": f"WITH {_CANDIDATES} SELECT doc_id, line_no, id FROM c",
    "shape_clusters": f"WITH {_CANDIDATES} SELECT source, shape, count(DISTINCT written) AS n_ids, count(*) AS n_lines FROM s GROUP BY ALL",
    "skeleton_repeats": f"WITH {_SKELETONS} SELECT * FROM kd",
    "list_page_flag": f"""
WITH {_CANDIDATES}, {_SKELETONS.partition(", k AS")[1].lstrip(", ")}{_SKELETONS.partition(", k AS")[2]},
m AS (SELECT doc_id, max(n) AS cluster FROM (SELECT doc_id, shape, count(DISTINCT id) AS n FROM s GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, cluster, coalesce(most_repeated, 0) AS repeats, cluster >= 5 OR (cluster >= 3 AND coalesce(most_repeated, 0) >= 5) AS list_page
FROM m LEFT JOIN kd USING (doc_id)""",
    "garbage_lines": f"""
WITH {_LINES}, m AS (
  SELECT doc_id, line_no, line, (line_no * 37 % 100) / 100.0 AS conf,
         list_max(list_transform(list_distinct(string_split(line, '')), lambda x: length(line) - length(replace(line, x, '')))) AS most FROM l)
SELECT doc_id, line_no, CASE WHEN conf < 0.55 THEN NOT (regexp_matches(line, '^[A-Za-z0-9][-A-Za-z0-9]{{3,}}$') AND regexp_matches(line, '[0-9]'))
  ELSE (length(line) >= 3 AND NOT regexp_matches(line, '[0-9]') AND most * 2 > length(line))
    OR (length(line) >= 6 AND length(regexp_replace(line, '[^0-9A-Za-z一-鿿]', '', 'g')) < length(line) * 0.7) END AS garbage FROM m""",
    "title_pick": "WITH " + _TITLE,
    "right_cell": f"""
WITH {_CELLS} SELECT a.o_custkey, a.k AS label_key, b.id AS value FROM c a JOIN c b USING (o_custkey)
WHERE a.k <> b.k AND b.id IS NOT NULL AND abs(a.y0 - b.y0) < 16 * 0.8 AND b.x0 > a.x0 + 10
QUALIFY row_number() OVER (PARTITION BY a.o_custkey, a.k ORDER BY b.x0, b.k) = 1""",
    "below_cell": f"""
WITH {_CELLS} SELECT a.o_custkey, a.k AS label_key, b.id AS value FROM c a JOIN c b USING (o_custkey)
WHERE a.k <> b.k AND b.id IS NOT NULL AND b.y0 - a.y0 - 16 BETWEEN -16 * 0.3 AND 48
  AND (b.x0 + 60 BETWEEN a.x0 - 16 AND a.x0 + 136 OR abs(a.x0 - b.x0) < 16)
QUALIFY row_number() OVER (PARTITION BY a.o_custkey, a.k ORDER BY b.y0, b.k) = 1""",
    "roster_build": f"WITH {_ROSTER} SELECT file, len(roster) AS n, array_to_string(roster, ',') AS ids FROM r",
    "roster_fuzzy_unique": f"""
WITH {_ROSTER}, e AS (SELECT s_suppkey, file, id AS bare, CASE WHEN s_suppkey % 2 = 0 THEN id || 'N' ELSE id END AS id FROM s),
x AS (SELECT s_suppkey, file, e.id, e.bare, u.v FROM e JOIN r USING (file), unnest(r.roster) AS u(v))
SELECT s_suppkey, coalesce(max(CASE WHEN v = bare THEN v END), CASE WHEN count(*) FILTER (abs(length(v) - length(id)) <= 2 AND levenshtein(v, id) <= 2) = 1
       THEN max(CASE WHEN abs(length(v) - length(id)) <= 2 AND levenshtein(v, id) <= 2 THEN v END) END) AS match
FROM x GROUP BY s_suppkey""",
    "roster_page_hits": f"""
WITH {_ROSTER}, p AS (SELECT DISTINCT file, floor(s_acctbal / 2000)::BIGINT AS page, id FROM s),
m AS (SELECT r.file, u.v FROM r, unnest(r.roster) AS u(v))
SELECT p.file, p.page, count(m.v) AS n_hits, coalesce(string_agg(m.v, ',' ORDER BY m.v), '') AS hits, count(m.v) >= 3 AS roster_page
FROM p JOIN r USING (file) LEFT JOIN m ON m.file = p.file AND m.v = p.id GROUP BY ALL""",
    "roster_impute": """
WITH t AS (SELECT DISTINCT conv_id AS file, turn AS page FROM conversations),
n AS (SELECT file, page, row_number() OVER (PARTITION BY file ORDER BY page) - 1 AS place FROM t)
SELECT file, page, CASE WHEN page % 3 = 1 AND count(*) FILTER (page % 3 <> 1) OVER (PARTITION BY file) >= 3
       THEN 'T' || lpad(page::VARCHAR, 4, '0') END AS imputed FROM n""",
    "dedupe_names": """
WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey AS out_seq, CASE WHEN k > 1 THEN p_name || '_' || k ELSE p_name END AS final_name FROM n""",
    "name_template": """
SELECT o_orderkey, c_name || CASE WHEN o_orderkey % 3 <> 0 THEN '_' || c_mktsegment ELSE '' END || '_' || o_orderpriority AS name
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "normal_dates": "SELECT o_orderkey, CASE WHEN year(o_orderdate) % 100 < 10 THEN (year(o_orderdate) % 100)::VARCHAR ELSE strftime(o_orderdate, '%y') END || strftime(o_orderdate, '%m%d') AS day FROM orders",
    "suspect_order": """
SELECT doc_id, coalesce(quality = 0, false) AS suspect, row_number() OVER (ORDER BY coalesce(quality = 0, false) DESC, doc_id) AS place FROM labels""",
    "resume_antijoin": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "lru_files": "SELECT user_id AS file FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 6",
    "history_top": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "retry_select": f"WITH {_CANDIDATES} SELECT doc_id FROM documents WHERE n_chars > 300 AND doc_id NOT IN (SELECT doc_id FROM c)",
}
