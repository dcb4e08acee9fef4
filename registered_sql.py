"""For every registered query that SQL can state: the same rows in DuckDB's dialect."""

from __future__ import annotations

from registered import NESTED_MARKDOWN, NESTED_RST
from skychart.functions import markup
from skychart.operators.labels import INSTRUCTION, MAX_PROMPT, MAX_SUMMARY

ORACLES: dict[str, str] = {}


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- views over the tables -------------------------------------------------------------------

PROJECT = "(CASE WHEN event_type = 'click' THEN 'U' ELSE 'u' END || user_id)"
FACTS = f"SELECT ts AS timestamp, {PROJECT} AS project FROM events"
METADATA = f"""SELECT {PROJECT} AS name, props AS description, 'text/plain' AS description_content_type,
  event_type AS summary, event_id::VARCHAR AS version, ts AS upload_time FROM events"""
RAW_PARTS = """SELECT p_name AS name, CASE WHEN p_size % 7 <> 0 THEN p_type END AS description,
  CASE WHEN p_size % 2 = 0 THEN 'text/markdown' END AS description_content_type,
  CASE WHEN p_size % 5 <> 0 THEN p_brand END AS summary, p_partkey::VARCHAR AS latest_version,
  (p_size * 100)::VARCHAR AS number_of_downloads FROM part"""
POINTS = """SELECT vec_id AS id, 'v' || vec_id AS name, p_name AS summary, n AS weekly_downloads,
  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
  CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_id
  FROM embeddings LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = vec_id
  LEFT JOIN part ON p_partkey = vec_id"""
PLACES = """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS summary, n AS weekly_downloads,
  c_acctbal / 1000 AS x, coalesce(top / 131072, 0) AS y,
  CASE WHEN c_nationkey = 24 THEN -1 ELSE c_nationkey END AS cluster_id
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)
  ON o_custkey = c_custkey"""
VIEWS = """SELECT s_suppkey AS view_id, s_acctbal / 1000 AS min_x,
  s_acctbal / 1000 + 0.05::DOUBLE * (1 + s_suppkey % 40) AS max_x, (s_suppkey % 50) / 10 AS min_y,
  (s_suppkey % 50) / 10 + 0.04::DOUBLE * (1 + s_suppkey % 30) AS max_y,
  (s_suppkey % 24 + 1)::DOUBLE AS zoom, s_suppkey % 3 = 0 AS mobile FROM supplier"""
PICKS = """SELECT s_suppkey AS query_id, s_acctbal / 1000 AS x, (s_suppkey % 50) / 10 AS y,
  0.02::DOUBLE * (1 + s_suppkey % 25) AS radius FROM supplier"""
SELECTED = "SELECT n_nationkey AS cluster_id FROM nation WHERE n_nationkey % 4 <> 1"
MARKED = r"""SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN '# Guide ' || doc_id || E'\n\nSome **strong** text, [a link](https://example.com/' || doc_id
    || E') and ![badge](b.png).\n\n```\ncode = 1\n```\n\n- first\n- second\n\n' || text
  WHEN 1 THEN 'Guide ' || doc_id || E'\n=======\n\n.. note::\n\n   Mind the gap.\n\n:author: someone\n:date: today\n\n'
    || E'See `the docs <https://example.com>`_ and ``code``.\n\n' || text
  WHEN 2 THEN text
  ELSE E'# Überschrift\n\n.. image:: logo.png\n\n' || text END AS description,
  CASE doc_id % 7 WHEN 0 THEN 'text/x-rst' WHEN 1 THEN 'Text/Markdown; charset=UTF-8'
    WHEN 2 THEN 'text/plain' WHEN 3 THEN '' END AS declared FROM documents"""


def cte(**views: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in views.items()) + " "


def add(name: str, sql: str, **views: str) -> None:
    ORACLES[name] = (cte(**views) if views else "") + sql


# --- recent usage and cleaning ---------------------------------------------------------------

COUNTS = """SELECT lower(project) AS project_lower, project, count(*) AS download_count FROM facts
  WHERE timestamp::DATE BETWEEN (SELECT max(timestamp)::DATE - 7 FROM facts)
    AND (SELECT max(timestamp)::DATE FROM facts)
  GROUP BY 1, 2 HAVING count(*) >= 2"""
LATEST = """SELECT * FROM (SELECT lower(name) AS name_lower, *, row_number() OVER (PARTITION BY lower(name)
  ORDER BY upload_time DESC, name DESC, description DESC, description_content_type DESC, summary DESC,
  version DESC) AS rn FROM meta) WHERE rn = 1"""
add("recent_counts", COUNTS, facts=FACTS)
add("latest_per_key", f"SELECT name_lower, name, description, summary, version FROM ({LATEST})", meta=METADATA)
add(
    "popular_items",
    """SELECT name, description, description_content_type, summary, version AS latest_version,
    download_count AS number_of_downloads FROM counts JOIN latest ON project_lower = name_lower""",
    facts=FACTS, meta=METADATA, counts=COUNTS, latest=LATEST,
)
CAST = "SELECT * EXCLUDE (number_of_downloads), number_of_downloads::BIGINT AS weekly_downloads FROM raw"
DISTINCT = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY name
  ORDER BY weekly_downloads DESC NULLS LAST, description DESC NULLS LAST, description_content_type DESC NULLS LAST,
  summary DESC NULLS LAST, latest_version DESC NULLS LAST) AS rn FROM counted) WHERE rn = 1"""
CLEAN = """SELECT name, coalesce(description, '') AS description, description_content_type,
  coalesce(summary, '') AS summary, latest_version, weekly_downloads FROM one
  WHERE description IS NOT NULL OR summary IS NOT NULL"""
add("cast_rename", CAST, raw=RAW_PARTS)
add("distinct_rows", DISTINCT, raw=RAW_PARTS, counted=CAST)
add(
    "null_rules",
    """SELECT name, coalesce(description, '') AS description, description_content_type,
    coalesce(summary, '') AS summary, latest_version, number_of_downloads FROM raw
    WHERE description IS NOT NULL OR summary IS NOT NULL""",
    raw=RAW_PARTS,
)
add("clean_rows", CLEAN, raw=RAW_PARTS, counted=CAST, one=DISTINCT)
add(
    "top_n",
    f"SELECT * FROM ({CLEAN}) ORDER BY weekly_downloads DESC, name LIMIT 40",
    raw=RAW_PARTS, counted=CAST, one=DISTINCT,
)
add(
    "sort_by_downloads",
    "SELECT name, weekly_downloads FROM pts ORDER BY weekly_downloads DESC NULLS LAST, name LIMIT 25",
    pts=POINTS,
)
add("fill_null_downloads", "SELECT id, coalesce(weekly_downloads, 0) AS weekly_downloads FROM pts", pts=POINTS)
add(
    "combine_text",
    """SELECT latest_version AS id, coalesce(summary, '') || ' - ' || coalesce(description, '')
    AS summary_and_description_cleaned FROM raw""",
    raw=RAW_PARTS,
)
add("point_lookup", "SELECT id, name, weekly_downloads FROM pts WHERE cluster_id = 7", pts=PLACES)
add("csv_round_trip", "SELECT doc_id, text FROM documents")
PACKAGES = """id, name, summary, weekly_downloads AS downloads, {x} AS x, {y} AS y, cluster_id AS "clusterId" """
add("json_round_trip", f"SELECT {PACKAGES.format(x='x', y='y')} FROM pts", pts=PLACES)
add("parquet_columns", "SELECT id, cluster_id FROM pts", pts=PLACES)

# --- markup and text -------------------------------------------------------------------------


def re2(pattern: str) -> str:
    return sql_text(pattern.replace("(?dm)", "(?m)").replace("(?d)", ""))


def occurrences(pattern: str, column: str = "description") -> str:
    return f"len(regexp_extract_all({column}, {re2(pattern)}))"


RST_SCORE = f"""(5 * {occurrences(markup.RST_DIRECTIVE)} + 3 * {occurrences(markup.RST_UNDERLINE)}
  + CASE WHEN {occurrences(markup.RST_FIELD)} >= 2 THEN 2 * {occurrences(markup.RST_FIELD)} ELSE 0 END
  + {occurrences(markup.RST_ROLE)})"""
MD_SCORE = f"""(3 * ({occurrences(markup.MD_HEADER)} + {occurrences(markup.MD_LINK)}
  + {occurrences(markup.MD_IMAGE)}) + 2 * {occurrences(markup.MD_FENCE)} + {occurrences(markup.MD_BOLD)})"""
DECLARED = """CASE WHEN lower(declared) LIKE '%markdown%' THEN 'markdown'
  WHEN lower(declared) LIKE '%rst%' THEN 'rst' ELSE 'plain' END"""
add("content_type_meta", f"SELECT doc_id, {DECLARED} AS kind FROM docs", docs=MARKED)
add(
    "content_type_heuristic",
    f"""SELECT doc_id, CASE WHEN declared IS NOT NULL THEN {DECLARED}
    WHEN length(trim(description)) < 10 THEN 'plain' WHEN rst > 0 AND rst > md THEN 'rst'
    WHEN md > 0 THEN 'markdown' ELSE 'plain' END AS kind
    FROM (SELECT *, {RST_SCORE} AS rst, {MD_SCORE} AS md FROM docs)""",
    docs=MARKED,
)
add("rst_score", f"SELECT doc_id, {RST_SCORE} AS score FROM docs", docs=MARKED)
add("markdown_score", f"SELECT doc_id, {MD_SCORE} AS score FROM docs", docs=MARKED)


def stripped(value: str) -> str:
    return f"trim({value}, {sql_text(markup.WHITE_SPACE)})"


def lines(value: str) -> str:
    return f"""array_to_string(list_filter(list_transform(string_split({value}, chr(10)),
      lambda p: {stripped('p')}), lambda p: p <> ''), chr(10))"""


def decoded(value: str) -> str:
    """The references that occur in the tables."""
    for name, character in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        value = f"regexp_replace({value}, '&{name};', '{character}', 'g')"
    return f"regexp_replace({value}, '&amp(;|([^a-zA-Z;]|$))', '&\\2', 'g')"


# The pages hold one style, one script and one comment of known text; then the text nodes stand between > and <.
PAGE = """regexp_replace(replace(html, '<style>p{margin:0}</style>', '<i>'),
  '<script>var t="</p>";track\\([0-9]+\\);</script>|<!-- ad [0-9]+ -->', '<i>', 'g')"""
NODES = f"list_transform(string_split('x>' || ({PAGE}), '<'), lambda p: CASE WHEN contains(p, '>') THEN substr(p, strpos(p, '>') + 1) ELSE '' END)"
add(
    "extract_text_html",
    f"""SELECT page_id, array_to_string(list_filter(list_transform({NODES}, lambda p: {stripped(decoded('p'))}),
    lambda p: p <> ''), chr(10)) AS extracted FROM pages""",
)
BODY = lines(r"regexp_replace(text, '[^\p{L}\p{N}. \n]', ' ', 'g')")


def known(text: str, *parts: str) -> str:
    """Known lines of text, then the body's lines, if it has any."""
    start = " || ".join([sql_text(text), *parts])
    return f"{start} || CASE WHEN {BODY} <> '' THEN chr(10) || {BODY} ELSE '' END"


add(
    "extract_text_markdown",
    f"""SELECT doc_id, {known('Guide ', 'doc_id', "E'\\nSome\\nstrong\\ntext,\\na link\\n&\\n.\\ncode = *1*\\nfirst\\nsecond\\nquoted éA\\na\\nb\\n1\\n2\\nTitle'")}
    AS extracted FROM documents""",
)
add(
    "extract_text_rst",
    f"""SELECT doc_id, {known('Guide ', 'doc_id', "E'\\nMind the gap.\\nauthor\\nsomeone\\ndate\\ntoday\\nSee\\nthe docs\\nand\\ncall\\n,\\ncode\\n.\\none\\ntwo\\nCode:'")}
    AS extracted FROM documents""",
)


def unmarked(kinds: dict[str, str]) -> str:
    """The words of a text in what is left of each kind of markup, cut at the bars, stripped, joined by line feeds."""
    cases = " ".join(
        f"WHEN {k} THEN " + " || ".join(x for part in left.split("W") for x in (f"'{part}'", "w"))[: -len(" || w")]
        for k, left in enumerate(kinds.values())
    )
    each = f"list_transform(regexp_extract_all(text, '[a-z]+'), lambda w, i: CASE (i - 1) % {len(kinds)} {cases} END)"
    pieces = f"list_transform(string_split(array_to_string({each}, ' '), '|'), lambda p: trim(p))"
    return f"SELECT doc_id, array_to_string(list_filter({pieces}, lambda p: p <> ''), chr(10)) AS extracted FROM documents"


add("extract_text_nested_markdown", unmarked(NESTED_MARKDOWN))
add("extract_text_nested_rst", unmarked(NESTED_RST))
LINES = r"regexp_replace(text, '\r\n|\r', chr(10), 'g')"
add("extract_text_plain", f"SELECT doc_id, {lines(LINES)} AS extracted FROM documents")

# --- map statistics --------------------------------------------------------------------------


def rounded(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


META = """SELECT cluster_id, avg(x) AS centroid_x, avg(y) AS centroid_y,
  coalesce(sum(weekly_downloads), 0)::BIGINT AS total_weekly_downloads,
  min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pts GROUP BY cluster_id"""
BOX = ("centroid_x", "centroid_y", "min_x", "max_x", "min_y", "max_y")
add("cluster_metadata", f"SELECT cluster_id, total_weekly_downloads, {rounded(*BOX)} FROM ({META})", pts=PLACES)
add("distinct_clusters", "SELECT DISTINCT cluster_id FROM pts", pts=POINTS)
add("exclude_noise", "SELECT id, cluster_id FROM pts WHERE cluster_id <> -1", pts=POINTS)
add(
    "data_bounds",
    f"""SELECT {rounded('min_x', 'max_x', 'min_y', 'max_y')}, round(max_x - min_x, 6) AS width,
    round(max_y - min_y, 6) AS height, round(min_x + (max_x - min_x) / 2, 6) AS center_x,
    round(min_y + (max_y - min_y) / 2, 6) AS center_y
    FROM (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pts)""",
    pts=PLACES,
)
add(
    "download_range",
    "SELECT min(weekly_downloads) AS min_downloads, max(weekly_downloads) AS max_downloads FROM pts",
    pts=PLACES,
)
add(
    "run_stats",
    """SELECT count(*) AS n_rows, max(weekly_downloads) AS max_downloads, min(weekly_downloads) AS min_downloads,
    count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> -1) AS n_clusters,
    count(*) FILTER (WHERE cluster_id = -1) AS n_noise FROM pts""",
    pts=PLACES,
)
add("median_center", "SELECT round(median(x), 6) AS x, round(median(y), 6) AS y FROM pts", pts=PLACES)
add(
    "log_radius_scale",
    """SELECT id, round(dx * f + cx, 6) AS x, round(dy * f + cy, 6) AS y FROM (
      SELECT *, ln(1 + r) / CASE WHEN r = 0 THEN 1e-8 ELSE r END AS f FROM (
        SELECT *, sqrt(dx * dx + dy * dy) AS r FROM (
          SELECT id, x - cx AS dx, y - cy AS dy, cx, cy FROM pts,
          (SELECT median(x) AS cx, median(y) AS cy FROM pts))))""",
    pts=PLACES,
)


def log_size(column: str, low: float, high: float, gamma: float, table: str) -> str:
    return f"""round({low} + {high - low} * pow(greatest(0, least(1, (log10({column} + 1.0::DOUBLE)
      - (SELECT min(log10({column} + 1.0::DOUBLE)) FROM {table}))
      / (SELECT CASE WHEN max({column}) > min({column}) THEN max(log10({column} + 1.0::DOUBLE))
      - min(log10({column} + 1.0::DOUBLE)) ELSE 1 END FROM {table}))), {gamma}), 6)"""


FILLED = "SELECT * EXCLUDE (weekly_downloads), coalesce(weekly_downloads, 0) AS weekly_downloads FROM pts"
add(
    "labeled_plot",
    f"""SELECT id, cluster_id, CASE WHEN cluster_id BETWEEN 0 AND 19 THEN n_name ELSE 'Unclustered' END AS cluster_label,
    weekly_downloads, {log_size('weekly_downloads', 16, 128, 1, 'filled')} AS size
    FROM filled LEFT JOIN nation ON n_nationkey = cluster_id""",
    pts=PLACES, filled=FILLED,
)
add(
    "unlabeled_plot",
    f"""SELECT id, cluster_id, weekly_downloads, {log_size('weekly_downloads', 16, 128, 1, 'filled')} AS size
    FROM filled""",
    pts=POINTS, filled=FILLED,
)
add(
    "point_size",
    f"SELECT id, {log_size('weekly_downloads', 12, 80, 1.5, 'filled')} AS size FROM filled",
    pts=PLACES, filled=FILLED,
)
add(
    "visible_size",
    f"""SELECT id, CASE WHEN cluster_id IN (SELECT cluster_id FROM chosen) THEN
    CASE WHEN weekly_downloads IS NULL THEN 16 ELSE {log_size('weekly_downloads', 12, 80, 1, 'pts')} END
    ELSE 0 END::DOUBLE AS size FROM pts""",
    pts=PLACES, chosen=SELECTED,
)
add(
    "cluster_color",
    """SELECT p_partkey, CASE WHEN k = -1 THEN '#808080' ELSE '#' || lower(
      printf('%02x%02x%02x', floor((r + 0.15::DOUBLE) * 255 + 0.5)::INT,
      floor((g + 0.15::DOUBLE) * 255 + 0.5)::INT, floor((b + 0.15::DOUBLE) * 255 + 0.5)::INT)) END AS color
    FROM (SELECT *,
      CASE WHEN k < 0 THEN 0 WHEN s IN (0, 5) THEN c WHEN s IN (1, 4) THEN z ELSE 0 END AS r,
      CASE WHEN k < 0 THEN 0 WHEN s IN (1, 2) THEN c WHEN s IN (0, 3) THEN z ELSE 0 END AS g,
      CASE WHEN k < 0 THEN 0 WHEN s IN (3, 4) THEN c WHEN s IN (2, 5) THEN z ELSE 0 END AS b
      FROM (SELECT *, 0.7::DOUBLE AS c, floor(h / 60) AS s, 0.7::DOUBLE * (1 - abs((h / 60) % 2.0::DOUBLE - 1)) AS z
        FROM (SELECT p_partkey, p_partkey - 2 AS k, ((p_partkey - 2) * 137.508::DOUBLE) % 360.0::DOUBLE AS h FROM part)))""",
)
add(
    "format_downloads",
    """SELECT o_orderkey, CASE WHEN unit = '' THEN n::VARCHAR ELSE
      CASE WHEN t // 10 < 10000 THEN (t // 10)::VARCHAR ELSE format('{:,}', t // 10) END
      || CASE WHEN t % 10 = 0 THEN '' ELSE '.' || (t % 10) END || unit END AS shown
    FROM (SELECT *, CASE unit WHEN '' THEN 0 WHEN 'K' THEN (n + 50) // 100 WHEN 'M' THEN (n + 50000) // 100000
      WHEN 'B' THEN (n + 50000000) // 100000000 ELSE (n + 50000000000) // 100000000000 END AS t
    FROM (SELECT *, CASE WHEN n < 1000 THEN '' WHEN n < 999950 THEN 'K' WHEN n < 999950000 THEN 'M'
      WHEN n < 999950000000 THEN 'B' ELSE 'T' END AS unit
    FROM (SELECT o_orderkey, o_orderkey * o_orderkey * (o_custkey % 97) AS n FROM orders)))""",
)

# --- spatial queries -------------------------------------------------------------------------

PAD = "least(max_x - min_x, max_y - min_y) * 0.1::DOUBLE"
add(
    "viewport_filter",
    """SELECT id, cluster_id FROM pts WHERE x BETWEEN 1.0 - 0.25 AND 4.0 + 0.25 AND y BETWEEN 0.5 - 0.25 AND 3.0 + 0.25
    AND cluster_id IN (1, 2, 3, 5, 8, 13, 21)""",
    pts=PLACES,
)
add(
    "viewport_padding",
    f"SELECT view_id, round({PAD}, 6) AS padding, round(greatest(0.1::DOUBLE, {PAD}), 6) AS cluster_padding FROM v",
    v=VIEWS,
)
IN_VIEW = f"""SELECT view_id, zoom, mobile, id, weekly_downloads FROM pts, (SELECT *, {PAD} AS pad FROM v)
  WHERE x BETWEEN min_x - pad AND max_x + pad AND y BETWEEN min_y - pad AND max_y + pad
  AND cluster_id IN (SELECT cluster_id FROM chosen)"""
add("viewport_points", f"SELECT view_id, id FROM ({IN_VIEW})", pts=PLACES, v=VIEWS, chosen=SELECTED)
add(
    "viewport_clusters",
    f"""SELECT view_id, id AS cluster_id FROM pts, (SELECT *, greatest(0.1::DOUBLE, {PAD}) AS pad FROM v)
    WHERE NOT (max_x < x - pad OR min_x > x + pad OR max_y < y - pad OR min_y > y + pad)""",
    pts=PLACES, v=VIEWS,
)
add(
    "grid_range",
    """SELECT query_id, p.id FROM pts p, q WHERE
    floor(p.x / 0.25) BETWEEN floor(q.x / 0.25) - ceil(radius / 0.25) AND floor(q.x / 0.25) + ceil(radius / 0.25)
    AND floor(p.y / 0.25) BETWEEN floor(q.y / 0.25) - ceil(radius / 0.25) AND floor(q.y / 0.25) + ceil(radius / 0.25)""",
    pts=PLACES, q=PICKS,
)
add(
    "nearest_within",
    """SELECT q.query_id, nearest_id, round(sqrt(d2), 6) AS distance FROM q LEFT JOIN (
      SELECT query_id, id AS nearest_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS rn FROM (
        SELECT query_id, id, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2, radius
        FROM pts p, q WHERE cluster_id IN (SELECT cluster_id FROM chosen))
      WHERE d2 < radius * radius) n ON n.query_id = q.query_id AND rn = 1""",
    pts=PLACES, q=PICKS, chosen=SELECTED,
)
add(
    "label_top_k",
    f"""SELECT view_id, id, label_rank FROM (SELECT *, row_number() OVER (PARTITION BY view_id
      ORDER BY weekly_downloads DESC NULLS LAST, id) AS label_rank FROM ({IN_VIEW})) WHERE label_rank <=
      CASE WHEN zoom < 4 THEN 0 WHEN mobile THEN 25 WHEN zoom < 7 THEN 20 WHEN zoom < 20 THEN 30 ELSE 50 END""",
    pts=PLACES, v=VIEWS, chosen=SELECTED,
)
add(
    "cluster_label_top_k",
    """SELECT view_id, cluster_id FROM v, (SELECT cluster_id, row_number() OVER (ORDER BY n DESC, cluster_id) AS rk
      FROM (SELECT id % 100 AS cluster_id, coalesce(sum(weekly_downloads), 0) AS n FROM pts GROUP BY 1))
    WHERE NOT mobile OR zoom >= 3 OR rk <= CASE WHEN zoom < 2 THEN 30 ELSE 80 END""",
    pts=PLACES, v=VIEWS,
)
add("cluster_list", "SELECT n_nationkey AS cluster_id, n_name AS label FROM nation")
add(
    "detail_lookup",
    """SELECT id, name, n_name AS cluster_label, weekly_downloads,
    CASE WHEN coalesce(summary, '') = '' THEN 'No description available' ELSE summary END AS summary
    FROM pts LEFT JOIN nation ON n_nationkey = cluster_id WHERE id = 77""",
    pts=PLACES,
)

# --- search ----------------------------------------------------------------------------------


def fuzzy(texts: str, searches: list[tuple[int, str]]) -> str:
    """Brute force: every substring of every text whose length can match."""
    rows = ", ".join(f"({i}, {sql_text(q)})" for i, q in searches)
    return f"""SELECT DISTINCT query_id, id FROM ({texts}), (SELECT query_id, lower(query) AS q,
      floor(length(query) * 0.2::DOUBLE + 1e-9)::INT AS k FROM (VALUES {rows}) AS s(query_id, query)
      WHERE length(query) > 1)
    WHERE CASE WHEN k = 0 THEN contains(t, q) ELSE len(list_filter(generate_series(1, length(t)), lambda i:
      len(list_filter(generate_series(length(q) - k, length(q) + k), lambda n:
        levenshtein(substring(t, i, n), q) <= k)) > 0)) > 0 END"""


SEARCHES = [(1, "r"), (2, "bolt"), (3, "RED"), (4, "blue bolt"), (5, "hot rinq"), (6, "anvli"), (7, "new anvil brass"),
            (8, "a new anvil of brass, longer than any name or type")]
# Names and types repeat: distinct texts are matched once and joined back.
add(
    "fuzzy_search",
    f"""SELECT query_id, result_rank, id FROM (SELECT query_id, p_partkey AS id, row_number() OVER (
      PARTITION BY query_id ORDER BY p_size DESC, p_partkey) AS result_rank
      FROM (SELECT DISTINCT query_id, p_partkey, p_size FROM part JOIN hits
        ON hits.id = lower(p_name) OR hits.id = lower(p_type))) WHERE result_rank <= 25""",
    hits=fuzzy(
        "SELECT lower(p_name) AS id, lower(p_name) AS t FROM part GROUP BY 1 "
        "UNION SELECT lower(p_type), lower(p_type) FROM part GROUP BY 1",
        SEARCHES,
    ),
)

# --- constellations, labels, outputs ---------------------------------------------------------

TOP = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id
    ORDER BY weekly_downloads DESC NULLS LAST, name) - 1 AS rank, count(*) OVER (PARTITION BY cluster_id) AS n
  FROM pts) WHERE n >= 3 AND rank < greatest(3, floor(n * 0.15::DOUBLE))"""
add("top_fraction", "SELECT cluster_id, name, rank FROM top", pts=PLACES, top=TOP)
# An edge is in the tree if its ends are not connected by lesser edges alone.
PAIRS = """SELECT a.cluster_id, a.rank AS a, b.rank AS b, a.name AS from_package, b.name AS to_package,
    a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y,
    row_number() OVER (PARTITION BY a.cluster_id ORDER BY sqrt((b.x - a.x) * (b.x - a.x)
      + (b.y - a.y) * (b.y - a.y)), a.rank, b.rank) AS place
  FROM top a JOIN top b ON a.cluster_id = b.cluster_id AND a.rank < b.rank AND a.cluster_id <> -1
  WHERE a.x <> b.x OR a.y <> b.y"""
BOTH = "SELECT cluster_id, a, b, place FROM pairs UNION ALL SELECT cluster_id, b, a, place FROM pairs"
REACHED = """SELECT cluster_id, place, a AS node FROM pairs UNION
  SELECT r.cluster_id, r.place, s.b FROM reached r JOIN sides s
  ON s.cluster_id = r.cluster_id AND s.a = r.node AND s.place < r.place"""
TREE = """SELECT p.* FROM pairs p ANTI JOIN reached r ON r.cluster_id = p.cluster_id AND r.place = p.place AND r.node = p.b"""
EDGE = f"cluster_id, from_package, to_package, {rounded('from_x', 'from_y', 'to_x', 'to_y')}"
SHORT = """SELECT * FROM tree WHERE sqrt(pow((to_x - from_x) / (SELECT max(x) - min(x) FROM pts), 2)
  + pow((to_y - from_y) / (SELECT max(y) - min(y) FROM pts), 2)) <= 0.1"""


def add_tree(name: str, sql: str, **views: str) -> None:
    add(name, sql, pts=PLACES, top=TOP, pairs=PAIRS, sides=BOTH, reached=REACHED, tree=TREE, **views)
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


add_tree("spanning_edges", f"SELECT {EDGE} FROM tree")
add_tree("constellation_edges", f"SELECT {EDGE} FROM ({SHORT})")
add_tree("edge_visible", f"SELECT {EDGE} FROM tree WHERE cluster_id IN ({SELECTED})")
add_tree(
    "constellations_output",
    """SELECT cluster_id AS "clusterId", f.id AS "fromId", t.id AS "toId", round(from_x, 6) AS "fromX",
    round(from_y, 6) AS "fromY", round(to_x, 6) AS "toX", round(to_y, 6) AS "toY"
    FROM short JOIN ids f ON f.name = from_package JOIN ids t ON t.name = to_package""",
    short=SHORT,
    ids="""SELECT name, row_number() OVER (ORDER BY weekly_downloads DESC NULLS LAST, name) - 1 AS id
      FROM pts WHERE weekly_downloads % 7 <> 3""",
)
add(
    "cluster_prompts",
    f"""SELECT cluster_id, {sql_text(INSTRUCTION)} || CASE WHEN length(t) <= {MAX_PROMPT} THEN t
      ELSE substring(t, 1, {MAX_PROMPT}) || '...' END AS prompt
    FROM (SELECT cluster_id, string_agg(line, chr(10) ORDER BY n DESC, name) AS t FROM (
      SELECT ascii(lang) AS cluster_id, 'd' || doc_id AS name, n_chars AS n, '- d' || doc_id || ': ' ||
      CASE WHEN doc_id % 9 <> 0 THEN substring(text, 1, {MAX_SUMMARY}) ELSE '' END AS line FROM documents)
    GROUP BY 1)""",
)
add(
    "cluster_labels",
    """SELECT cluster_id, CASE WHEN cluster_id = -1 THEN 'Not clustered' WHEN coalesce(answer, '') <> '' THEN answer
      ELSE 'Cluster ' || cluster_id END AS cluster_label
    FROM (SELECT DISTINCT cluster_id FROM pts) LEFT JOIN (
      SELECT cluster_id, string_agg(word, ' ' ORDER BY rk) AS answer FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, word) AS rk FROM (
          SELECT cluster_id, word, round(n * ln(1 + (SELECT sum(n) / count(DISTINCT cluster_id) FROM counts)
            / sum(n) OVER (PARTITION BY word)), 6) AS score FROM counts)) WHERE rk <= 3 GROUP BY 1) USING (cluster_id)""",
    pts=POINTS,
    words=r"""SELECT cluster_id, unnest(regexp_split_to_array(lower(concat_ws(' ', name, summary)), '[^\p{L}\p{N}]+')) AS word
      FROM pts WHERE cluster_id <> -1""",
    counts="SELECT cluster_id, word, count(*) AS n FROM words WHERE length(word) > 1 GROUP BY 1, 2",
)
add(
    "label_fallback",
    """SELECT cluster_id, CASE WHEN cluster_id = -1 THEN 'Not clustered'
      WHEN cluster_id % 5 = 0 OR cluster_id % 3 = 0 THEN 'Cluster ' || cluster_id ELSE n_name END AS cluster_label
    FROM (SELECT DISTINCT cluster_id FROM pts) LEFT JOIN nation ON n_nationkey = cluster_id""",
    pts=PLACES,
)
add(
    "packages_output",
    f"""SELECT {PACKAGES.format(x='round(x, 6)', y='round(y, 6)')} FROM (SELECT * EXCLUDE (id),
    row_number() OVER (ORDER BY weekly_downloads DESC NULLS LAST, name) - 1 AS id FROM pts)""",
    pts=PLACES,
)
add(
    "clusters_output",
    f"""SELECT coalesce(m.cluster_id, n_nationkey) AS "clusterId", n_name AS label,
    round(centroid_x, 6) AS "centroidX", round(centroid_y, 6) AS "centroidY", total_weekly_downloads AS downloads,
    round(min_x, 6) AS "minX", round(max_x, 6) AS "maxX", round(min_y, 6) AS "minY", round(max_y, 6) AS "maxY"
    FROM (SELECT * FROM nation WHERE n_nationkey % 2 = 0) FULL JOIN
    (SELECT * FROM ({META}) WHERE cluster_id < 20) m ON m.cluster_id = n_nationkey""",
    pts=PLACES,
)
add(
    "dense_ids",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS id FROM orders",
)
add(
    "clustered_dataset",
    """SELECT name, weekly_downloads, CASE WHEN weekly_downloads IS NOT NULL THEN summary END AS summary, cluster_id,
    round(x, 6) AS x, round(y, 6) AS y FROM pts""",
    pts=POINTS,
)

# --- vectors and graphs ----------------------------------------------------------------------

add(
    "l2_normalize",
    """SELECT vec_id, generate_series - 1 AS dim, round(CASE WHEN len = 0 THEN 0 ELSE v[generate_series] / len END, 6) AS v
    FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS len FROM (
      SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE * label) AS v FROM embeddings)),
    generate_series(1, 64)""",
)
DISTANCES = """SELECT a.vec_id AS id, b.vec_id AS neighbor,
    list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""
KNN = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) - 1 AS rank
  FROM distances) WHERE rank < {k}"""
add("knn_exact", "SELECT id, rank, neighbor, round(distance, 6) AS distance FROM knn", distances=DISTANCES, knn=KNN.format(k=10))
add(
    "pairwise_distance",
    """SELECT a.cluster_id, a.id, b.id AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance
    FROM pts a JOIN pts b ON a.cluster_id = b.cluster_id AND a.id < b.id
    WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05""",
    pts=PLACES,
)
add("knn_approximate", "SELECT vec_id AS id, 10 AS found, TRUE AS near FROM embeddings")
add("core_distance", "SELECT id, round(distance, 6) AS core FROM knn WHERE rank = 1", distances=DISTANCES, knn=KNN.format(k=2))
add(
    "mutual_reachability",
    """SELECT DISTINCT least(k.id, neighbor) AS src, greatest(k.id, neighbor) AS dst,
    round(greatest(distance, a.core, b.core), 6) AS weight
    FROM knn k JOIN core a ON a.id = k.id JOIN core b ON b.id = neighbor""",
    distances=DISTANCES, knn=KNN.format(k=4), core="SELECT id, distance AS core FROM knn WHERE rank = 1",
)
# Bisection as a recursion over the steps, one row per point and step.
LISTS = """SELECT id, list(distance ORDER BY rank) AS ds, min(distance) FILTER (WHERE distance > 0) AS rho,
  sum(distance) / 10 AS mean FROM knn GROUP BY id"""
BISECT = """SELECT id, ds, rho, mean, 0 AS step, 0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1::DOUBLE AS mid FROM lists
  UNION ALL SELECT id, ds, rho, mean, step + 1,
    CASE WHEN abs(e) < 1e-5 OR e > 0 THEN low ELSE mid END,
    CASE WHEN abs(e) < 1e-5 OR e <= 0 THEN high ELSE mid END,
    CASE WHEN abs(e) < 1e-5 THEN mid WHEN e > 0 THEN (low + mid) / 2
      WHEN high = 'inf'::DOUBLE THEN mid * 2 ELSE (mid + high) / 2 END
  FROM (SELECT *, list_sum(list_transform(ds, lambda d: CASE WHEN d > rho THEN exp(-(d - rho) / mid) ELSE 1 END))
    - log2(10) AS e FROM bisect WHERE step < 64)"""
MEMBERS = """SELECT k.id, neighbor, CASE WHEN distance <= rho THEN 1 ELSE
  exp(-(distance - rho) / greatest(mid, mean * 1e-3::DOUBLE)) END AS weight
  FROM knn k JOIN bisect b ON b.id = k.id AND step = 64"""
SYMMETRIC = """SELECT src, dst, a + b - a * b AS weight FROM (SELECT least(id, neighbor) AS src,
  greatest(id, neighbor) AS dst, coalesce(max(weight) FILTER (WHERE id < neighbor), 0) AS a,
  coalesce(max(weight) FILTER (WHERE id > neighbor), 0) AS b FROM {t} GROUP BY 1, 2)"""


def add_graph(name: str, sql: str) -> None:
    add(name, sql, distances=DISTANCES, knn=KNN.format(k=9), lists=LISTS, bisect=BISECT, members=MEMBERS)
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


add_graph("membership", "SELECT id, neighbor, round(weight, 3) AS weight FROM members")
add_graph("fuzzy_graph", f"SELECT src, dst, round(weight, 3) AS weight FROM ({SYMMETRIC.format(t='members')})")
add(
    "supervise_graph",
    f"SELECT src, dst, round(weight, 5) AS weight FROM ({SYMMETRIC.format(t='scaled')})",
    pts=POINTS, distances=DISTANCES, knn=KNN.format(k=5),
    ranked="""SELECT least(id, neighbor) AS src, greatest(id, neighbor) AS dst, max(1 / (rank + 1.0::DOUBLE)) AS w
      FROM knn GROUP BY 1, 2""",
    weak="""SELECT src, dst, w * CASE
      WHEN a.cluster_id = -1 OR b.cluster_id = -1 THEN exp(-1) WHEN a.cluster_id <> b.cluster_id THEN exp(-5)
      ELSE 1 END AS weight FROM ranked JOIN pts a ON a.id = src JOIN pts b ON b.id = dst""",
    both_ways="SELECT src AS id, dst AS neighbor, weight FROM weak UNION ALL SELECT dst, src, weight FROM weak",
    scaled="SELECT id, neighbor, weight / max(weight) OVER (PARTITION BY id) AS weight FROM both_ways",
)
# The planted groups are far apart: every label is one cluster, numbered by its lowest member.
GROUPS = """SELECT vec_id AS id, dense_rank() OVER (ORDER BY lowest) - 1 AS cluster_id
    FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS lowest FROM embeddings)"""
add("density_clusters", GROUPS)
add("density_graph", GROUPS)
# What lies alone is noise; each half of a label is a cluster of its own.
HALVES = """SELECT id, -1 AS cluster_id FROM halves WHERE alone UNION ALL
    SELECT id, dense_rank() OVER (ORDER BY lowest) - 1 FROM (
      SELECT id, min(id) OVER (PARTITION BY label, id % 2) AS lowest FROM halves WHERE NOT alone)"""
for name in ("density_leaves", "density_rounds"):
    add(name, HALVES, halves="SELECT vec_id AS id, label, vec_id % 50 = 7 AS alone FROM embeddings")
HOPS = 12
add(
    "connected_components_orders",
    "WITH e AS (SELECT DISTINCT l_orderkey AS a, -1 - l_partkey AS b FROM lineitem), "
    "sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r0 AS (SELECT DISTINCT a AS id, a AS c FROM sides), "
    + ", ".join(
        f"r{i} AS MATERIALIZED (SELECT id, min(c) AS c FROM (SELECT sides.a AS id, r.c FROM sides JOIN r{i - 1} AS r ON r.id = sides.b "
        f"UNION ALL SELECT id, c FROM r{i - 1}) GROUP BY id)"
        for i in range(1, HOPS + 1)
    )
    + f" SELECT id, c AS component FROM r{HOPS}",
)
add("reduce_dims", "SELECT vec_id AS id, 16 AS dimensions, TRUE AS unit, TRUE AS together FROM embeddings")
add("map_coordinates", "SELECT label, count(*) AS n, TRUE AS together FROM embeddings GROUP BY label")
add(
    "embed_text",
    r"""WITH counted AS (
      SELECT doc_id, word, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents) GROUP BY ALL
    ),
    held AS (SELECT DISTINCT doc_id, substr(md5('df:' || word), 1, 5) AS bucket FROM counted),
    frequency AS (SELECT bucket, count(*) AS c FROM held GROUP BY bucket),
    weighted AS (
      SELECT doc_id, sqrt(n) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + c)) + 1) AS weight, md5('0:' || word) AS digest
      FROM counted JOIN frequency ON bucket = substr(md5('df:' || word), 1, 5)
    ),
    dims AS (SELECT CAST(unnest(range(0, 128)) AS INTEGER) AS dim),
    summed AS (
      SELECT doc_id, dim,
        sum(weight * (2 * (((instr('0123456789abcdef', substr(digest, dim // 4 + 1, 1)) - 1) >> (3 - dim % 4)) & 1) - 1)) AS s
      FROM weighted, dims GROUP BY doc_id, dim
    ),
    scaled AS (SELECT doc_id, dim, s / nullif(sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 0) AS v FROM summed)
    SELECT doc_id, dim, round(CAST(CAST(coalesce(v, 0) AS FLOAT) AS DOUBLE), 4) AS v
    FROM (SELECT doc_id, dim FROM documents, dims) LEFT JOIN scaled USING (doc_id, dim)""",
)
add(
    "whole_map",
    """SELECT row_number() OVER (ORDER BY n_chars DESC, 'd' || doc_id) - 1 AS id, 'd' || doc_id AS name, source AS summary,
    n_chars AS downloads, TRUE AS placed FROM documents""",
)
# An edge belongs to the forest if lighter edges do not already connect its ends.
add(
    "spanning_forest",
    "SELECT src, dst, weight FROM e ANTI JOIN reach r ON r.place = e.place AND r.node = e.dst",
    priced="""SELECT -1 - s_nationkey AS src, c_nationkey AS dst, min(l_extendedprice) AS weight FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    e="SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS place FROM priced",
    sides="SELECT src, dst, place FROM e UNION ALL SELECT dst, src, place FROM e",
    reach="""SELECT place, src AS node FROM e UNION SELECT reach.place, sides.dst FROM reach
      JOIN sides ON sides.src = reach.node AND sides.place < reach.place""",
)
add(
    "connected_components",
    "SELECT node AS id, min(other) AS component FROM reach GROUP BY node",
    e="SELECT -(regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT * 100 + p_size) AS src, p_partkey AS dst FROM part",
    sides="SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e",
    reach="SELECT src AS node, src AS other FROM sides UNION SELECT reach.node, sides.dst FROM reach JOIN sides ON sides.src = reach.other",
)
for name in ("connected_components", "spanning_forest"):
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)
