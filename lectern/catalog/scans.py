"""Queries over raw lines: grep, windows, scores, overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog.base import Tables, query, strip_sql, with_views
from lectern.operators import scan as S
from lectern.plans import jobs

NL = "chr(10)"
# every question is asked of the documents of one source: source number = query number mod 20 names its scope
Q_SQL = """q AS (SELECT item_id AS query_id, 'file_' || doc_id AS file_id, b.text FROM benchmark b JOIN documents d ON d.source = 'src' || (item_id % 20))"""


def _q(t: Tables):
    ask = t.questions.withColumn("source", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return ask.join(t.docs.select("source", "file_id"), "source").select("query_id", "file_id", "text")


def _docs(t: Tables):
    return t.docs.select("file_id", "text")


KEYS = """list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z]{4,80}'), lambda x: lower(x) NOT IN ('the','a','an','and','or','of','to','in','on','for','with','from','this','that','these','those','is','are','was','were','be','been','it','as','at','by','about','into','what','why','how','when','where','which','can','could','should','would'))"""
IDS = "list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{3,80}'), lambda x: regexp_matches(x, '[0-9_-]'))"
TERMS_SQL = f"""tm AS (SELECT item_id AS query_id, {IDS} || {KEYS} AS l FROM benchmark),
td AS (SELECT query_id, list_filter(l, lambda e, i: list_position(l, e) = i)[1:6] AS terms FROM tm),
pt AS (SELECT query_id, unnest(terms) AS pattern, unnest(range(0, len(terms))) AS pattern_no FROM td)"""
MATCH = "CASE WHEN pattern = lower(pattern) THEN contains(lower(line), pattern) ELSE contains(line, pattern) END"


@query("r16_grep_lines", with_views("lines", f"""WITH {Q_SQL}, {TERMS_SQL},
m AS (SELECT q.query_id, q.file_id, pattern_no, pattern, line_no, row_number() OVER (PARTITION BY q.query_id, q.file_id, pattern_no ORDER BY line_no) AS n
  FROM q JOIN pt USING (query_id) JOIN lines l ON l.file_id = q.file_id WHERE {MATCH})
SELECT query_id, file_id, CAST(pattern_no AS INTEGER) AS pattern_no, line_no FROM m WHERE n <= 80"""))
def grep_lines(t: Tables):
    found = S.grep_lines(_docs(t), S.scan_patterns(_q(t)), 80)
    return found.select("query_id", "file_id", "pattern_no", "line_no")


CONTEXT = 2
RANGES_SQL = f"""{Q_SQL}, {TERMS_SQL},
g AS (SELECT q.query_id, q.file_id, pattern_no, line_no, row_number() OVER (PARTITION BY q.query_id, q.file_id, pattern_no ORDER BY line_no) AS n
  FROM q JOIN pt USING (query_id) JOIN lines l ON l.file_id = q.file_id WHERE line <> '' AND {MATCH}),
fl AS (SELECT query_id, file_id, line_no, min(pattern_no) AS p FROM g WHERE n <= 80 GROUP BY ALL),
kl AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY p, line_no) AS k FROM fl),
la AS (SELECT file_id, max(line_no) AS last FROM lines GROUP BY file_id),
rg AS (SELECT DISTINCT query_id, file_id, greatest(1, line_no - {CONTEXT}) AS s, least(last, line_no + {CONTEXT}) AS e FROM kl JOIN la USING (file_id) WHERE k <= 20),
pv AS (SELECT *, max(e) OVER (PARTITION BY query_id, file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM rg),
il AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM pv),
mr AS (SELECT query_id, file_id, CAST(min(s) AS INTEGER) AS line_start, CAST(max(e) AS INTEGER) AS line_end FROM il GROUP BY query_id, file_id, i)"""


@query("w19_raw_windows", with_views("lines", f"WITH {RANGES_SQL} SELECT * FROM mr"))
def raw_windows(t: Tables):
    return S.raw_windows(_q(t), _docs(t), context=CONTEXT)


TEXT_SQL = f"""{RANGES_SQL},
tx AS (SELECT query_id, mr.file_id, line_start, line_end, {strip_sql(f"string_agg(line, {NL} ORDER BY line_no)")} AS text FROM mr JOIN lines l ON l.file_id = mr.file_id AND line_no BETWEEN line_start AND line_end GROUP BY ALL),
ks AS (SELECT query_id, list_filter(k, lambda e, i: list_position(k, e) = i) AS k, list_filter(d, lambda e, i: list_position(d, e) = i) AS d
  FROM (SELECT item_id AS query_id, {KEYS} AS k, {IDS} AS d FROM benchmark)),
sc AS (SELECT tx.*, len(list_filter(k, lambda x: contains(lower(text), lower(x)))) AS kh, len(list_filter(d, lambda x: contains(lower(text), lower(x)))) AS dh,
  len(string_split(text, {NL})) AS nl FROM tx JOIN ks USING (query_id) WHERE text <> '')"""


@query("w20_window_score", with_views("lines", f"WITH {TEXT_SQL} SELECT query_id, file_id, line_start, CAST(kh AS INTEGER) AS keyword_hits, round(dh * 3.0::DOUBLE + kh + (dh * 2 + kh) / nl::DOUBLE, 6) AS score FROM sc"))
def window_score(t: Tables):
    return S.scored_windows(_q(t), _docs(t), context=CONTEXT).select("query_id", "file_id", "line_start", "keyword_hits", "score")


def _selected(t: Tables, cap: int):
    return S.scan_windows(_q(t), _docs(t), context=CONTEXT, overview=False, chosen=cap)


@query("w21_select_windows", with_views("lines", f"""WITH {TEXT_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY round(dh * 3.0::DOUBLE + kh + (dh * 2 + kh) / nl::DOUBLE, 6) DESC, line_start) AS place FROM sc)
SELECT query_id, file_id, line_start, line_end, CAST(place AS INTEGER) AS place FROM rk WHERE place <= 3"""))
def select_windows(t: Tables):
    """The top windows without their neighbours, which the next query lists."""
    return _selected(t, 3).filter("not neighbor").select("query_id", "file_id", "line_start", "line_end", "place")


def _text(start: str, end: str, file: str) -> str:
    return f"(SELECT coalesce({strip_sql(f'string_agg(line, {NL} ORDER BY line_no)')}, '') FROM lines x WHERE x.file_id = {file} AND x.line_no BETWEEN {start} AND {end})"


def _chosen_sql(most: str, span: int) -> str:
    """Ranked windows and their neighbours over sc (scored windows), la (last lines) and wm (query_id, file_id, m: how many)."""
    score = "round(dh * 3.0::DOUBLE + kh + (dh * 2 + kh) / nl::DOUBLE, 6)"
    return f"""wm AS ({most}),
rk AS (SELECT sc.query_id, sc.file_id, line_start, line_end, {score} AS score, m, row_number() OVER (PARTITION BY sc.query_id, sc.file_id ORDER BY {score} DESC, line_start) AS place FROM sc JOIN wm USING (query_id, file_id)),
bs AS (SELECT * FROM rk WHERE place <= m),
fr AS (SELECT query_id, file_id, count(*) AS n, any_value(m) AS m FROM bs GROUP BY ALL),
sd AS (SELECT query_id, file_id, place, 0 AS side, greatest(line_start - {span}, 1) AS s, line_start - 1 AS e FROM bs WHERE line_start > 1
  UNION ALL SELECT query_id, file_id, place, 1, line_end + 1, least(line_end + {span}, last) FROM bs JOIN la USING (file_id) WHERE line_end + 1 <= last),
st AS (SELECT sd.*, {_text('s', 'e', 'sd.file_id')} AS text FROM sd),
o1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id, s, e ORDER BY place, side) AS i FROM st WHERE text <> ''),
o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id, side ORDER BY place) AS j FROM o1 WHERE i = 1),
o3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY place, side) AS t FROM o2 WHERE j = 1),
nb AS (SELECT query_id, file_id, CAST(s AS INTEGER) AS line_start, CAST(e AS INTEGER) AS line_end, CAST(n + t AS INTEGER) AS place FROM o3 JOIN fr USING (query_id, file_id) WHERE n + t <= fr.m)"""


@query("w21_neighbor_windows", with_views("lines", f"""WITH {TEXT_SQL},
{_chosen_sql("SELECT DISTINCT query_id, file_id, 10 AS m FROM sc", 2 * CONTEXT)} SELECT * FROM nb"""))
def neighbor_windows(t: Tables):
    return _selected(t, 10).filter("neighbor").select("query_id", "file_id", "line_start", "line_end", "place")


@query("w22_raw_overview", with_views("lines", f"""WITH {RANGES_SQL}, la2 AS (SELECT file_id, max(line_no) AS last FROM lines GROUP BY file_id)
SELECT q.query_id, q.file_id, CAST(least(60, last) AS INTEGER) AS line_end, 0.1::DOUBLE AS score FROM q ANTI JOIN mr ON mr.query_id = q.query_id AND mr.file_id = q.file_id JOIN la2 ON la2.file_id = q.file_id
WHERE EXISTS (SELECT 1 FROM lines l WHERE l.file_id = q.file_id AND l.line_no <= 60 AND trim(line) <> '')"""))
def raw_overview(t: Tables):
    return S.raw_overview(_q(t), _docs(t), context=CONTEXT).select("query_id", "file_id", "line_end", "score")


@query("w23_cap_window_bytes", with_views("lines", f"""
WITH u AS (SELECT file_id, line_no, line, sum(strlen(line) + 1) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS used FROM lines)
SELECT file_id, {strip_sql(f"coalesce(string_agg(line, {NL} ORDER BY line_no) FILTER (used <= 4096), '') || CASE WHEN max(used) > 4096 THEN CASE WHEN min(used) <= 4096 THEN {NL} ELSE '' END || '… (truncated)' ELSE '' END")} AS text FROM u GROUP BY file_id"""))
def cap_window_bytes(t: Tables):
    return S.cap_window_bytes(_docs(t), 4096)


SHARE = "greatest(1, 10 // n)"
SCAN_SQL = TEXT_SQL.replace(f"line_no - {CONTEXT}", "line_no - 30").replace(f"line_no + {CONTEXT}", "line_no + 30").replace(
    "FROM kl JOIN la USING (file_id) WHERE k <= 20", f"FROM kl JOIN la USING (file_id) JOIN sh USING (query_id) WHERE k <= 2 * {SHARE}").replace(
    "rg AS (", "sh AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),\nrg AS (")


@query("d4_scan_raw", with_views("lines", f"""WITH {SCAN_SQL},
{_chosen_sql(f"SELECT q.query_id, q.file_id, {SHARE} AS m FROM q JOIN sh USING (query_id)", 60)},
ov AS (SELECT q.query_id, q.file_id, 1 AS line_start, CAST(least(120, last) AS INTEGER) AS line_end FROM q JOIN la USING (file_id)
  WHERE NOT EXISTS (SELECT 1 FROM bs WHERE bs.query_id = q.query_id AND bs.file_id = q.file_id) AND {_text('1', 'least(120, last)', 'q.file_id')} <> '')
SELECT query_id, file_id, line_start, line_end, score, CAST(place AS INTEGER) AS place, false AS neighbor FROM bs
UNION ALL SELECT query_id, file_id, line_start, line_end, 0.0::DOUBLE, place, true FROM nb
UNION ALL SELECT query_id, file_id, line_start, line_end, 0.1::DOUBLE, 1, false FROM ov"""))
def scan_raw(t: Tables):
    return jobs.scan_raw(_q(t), t.docs.select("file_id", "text")).select("query_id", "file_id", "line_start", "line_end", "score", "place", "neighbor")


