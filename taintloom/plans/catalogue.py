"""The registered queries over the driver's tables, and their DuckDB SQL under the same names.

A query demonstrates one operator of the engine (or a few) on whole tables. Patterns are portable between Java and RE2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taintloom.functions import patterns as P
from taintloom.functions import text as T
from taintloom.functions.catalog import CWE, SEVERITY, cwe, severity, severity_rank
from taintloom.operators import detectors, graph, relational, report, rules
from taintloom.sources.tables import read_table

from . import code_queries, scale_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


#: (rule, portable pattern, severity) of the line scans below.
LINE_RULES = [
    ("secret", '(?:api_key|token|secret|password) = "[^"]+"', "critical"),
    ("abuse", "(?:^|[^A-Za-z])(?:idiot|moron|scum|loser)(?:[^A-Za-z]|$)", "high"),
    ("mail", "[A-Za-z0-9.]+@[A-Za-z0-9.]+", "medium"),
    ("phone", "[+][0-9][0-9 ()-]{7,}", "medium"),
    ("license", "[Ll]icensed under|[Rr]eleased under", "low"),
]
RULE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(code, '{p}') THEN '{r}'" for r, p, _ in LINE_RULES) + " END"
RULE_SEVERITY = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, _, s in LINE_RULES) + " END"
RANK = "CASE {0} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
LINES_SQL = "SELECT doc_id, source, CAST(generate_subscripts(a, 1) AS INTEGER) AS line_no, unnest(a) AS code FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents)"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = relational.lines(t(spark, sf, "documents").select("doc_id", "source", "text"), ["doc_id", "source"])
    return relational.pattern_hits(rows, [(r, p) for r, p, _ in LINE_RULES])


def with_severity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("severity", F.coalesce(*(F.when(F.col("rule_id") == r, s) for r, _, s in LINE_RULES)))


@query(f"""SELECT source, rule_id, {RULE_SEVERITY} AS severity, CAST({RANK.format(RULE_SEVERITY)} AS INTEGER) AS severity_rank, count(*) AS n_lines
FROM (SELECT *, {RULE_CASE} AS rule_id FROM ({LINES_SQL})) WHERE rule_id IS NOT NULL GROUP BY source, rule_id""")
def line_rule_report(spark, sf):
    """Lines with a rule's pattern, by source and rule, with severity and its rank."""
    counted = with_severity(hits(spark, sf)).groupBy("source", "rule_id", "severity").agg(F.count("*").alias("n_lines"))
    return counted.select("source", "rule_id", "severity", severity_rank(F.col("severity")).alias("severity_rank"), "n_lines").orderBy("severity_rank", F.desc("n_lines"), "source", "rule_id")


@query(f"SELECT doc_id, line_no, rule_id FROM (SELECT *, {RULE_CASE} AS rule_id FROM ({LINES_SQL})) WHERE rule_id IS NOT NULL")
def line_rule_first(spark, sf):
    """The first rule of every line that has one (one pattern a line)."""
    return hits(spark, sf).select("doc_id", "line_no", "rule_id")


@query("SELECT l.doc_id, l.line_no, r.rule_id FROM (" + LINES_SQL + ") l JOIN (VALUES " + ", ".join(f"('{r}', '{p}')" for r, p, _ in LINE_RULES) + ") r(rule_id, pattern) ON regexp_matches(l.code, r.pattern)")
def line_rule_join(spark, sf):
    """Every pair of a line and a rule of a rule table whose pattern it holds."""
    rows = relational.lines(t(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    return relational.rule_join(rows, [(r, p) for r, p, _ in LINE_RULES]).select("doc_id", "line_no", "rule_id")


@query("""WITH l AS (SELECT page_id, CAST(generate_subscripts(a, 1) AS INTEGER) AS line_no, unnest(a) AS code FROM (SELECT page_id, string_split(html, chr(10)) AS a FROM pages)),
s AS (SELECT *, contains(code, '<script') AS o, contains(code, '</script') AS c FROM l)
SELECT page_id, count(*) AS n_lines, count(*) FILTER (WHERE inside) AS n_inside FROM (SELECT *, sum(o::INT) OVER (PARTITION BY page_id ORDER BY line_no) - coalesce(sum(c::INT) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS inside FROM s) GROUP BY page_id""")
def script_state(spark, sf):
    """Lines of pages, and those inside a script element: an opening counts for its own line, a closing from the next."""
    rows = relational.lines(t(spark, sf, "pages").select("page_id", "html"), ["page_id"], "html")
    state = relational.running_state(rows, "page_id", "line_no", F.col("code").contains("<script"), F.col("code").contains("</script"))
    return state.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.count_if("inside").alias("n_inside"))


FINDINGS_SQL = "SELECT l_orderkey, l_linenumber, l_orderkey % 2000 AS file_id, (l_partkey * 7 + l_suppkey) % 2000 AS line_number, CASE l_returnflag WHEN 'R' THEN 'sql_injection' WHEN 'A' THEN 'command_execution' ELSE 'xss' END AS vuln_type, l_linestatus FROM lineitem"
SPOTS_SQL = "SELECT o_orderkey % 2000 AS file_id, o_custkey % 2000 AS line_number, CASE o_orderstatus WHEN 'F' THEN 'parameterized_query' ELSE 'allowlist_check' END AS pattern FROM orders"


def findings(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "sql_injection").when(F.col("l_returnflag") == "A", "command_execution").otherwise("xss")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 2000).alias("file_id"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 2000).alias("line_number"), kind.alias("vuln_type"), "l_linestatus")


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN covered THEN 'info' ELSE 'high' END AS severity, CASE WHEN covered THEN 'safe: ' || vuln_type ELSE vuln_type END AS data_flow FROM (
SELECT *, EXISTS (SELECT 1 FROM ({SPOTS_SQL}) s WHERE s.file_id = f.file_id AND abs(s.line_number - f.line_number) <= 3 AND (f.vuln_type = 'sql_injection' OR (f.vuln_type = 'command_execution' AND s.pattern = 'allowlist_check'))) AS covered FROM ({FINDINGS_SQL}) f)""")
def safe_band_downgrade(spark, sf):
    """Findings with a safe pattern that covers their type within three lines of their file become info."""
    spots = t(spark, sf, "orders").select((F.col("o_orderkey") % 2000).alias("file_id"), (F.col("o_custkey") % 2000).alias("line_number"), F.when(F.col("o_orderstatus") == "F", "parameterized_query").otherwise("allowlist_check").alias("pattern"))
    covers = F.when(F.col("pattern") == "parameterized_query", F.array(F.lit("sql_injection"))).otherwise(F.array(F.lit("sql_injection"), F.lit("command_execution"), F.lit("path_traversal")))
    spots = spots.select("file_id", "line_number", F.explode(covers).alias("vuln_type"))
    rows = relational.band_covered(findings(spark, sf), spots, ["file_id", "vuln_type"], "line_number", "line_number", 3)
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("covered"), "info").otherwise("high").alias("severity"), F.concat(F.when(F.col("covered"), "safe: ").otherwise(""), "vuln_type").alias("data_flow"))


@query("""SELECT o_orderkey AS id, o_orderkey % 100 AS line_number, 'orders' AS stage FROM orders UNION ALL
SELECT l_orderkey, l_partkey % 100, 'lineitem' FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 100 = l.l_partkey % 100)""")
def supplement_anti_union(spark, sf):
    """A stage's findings and those of the next stage whose key the first doesn't have."""
    first = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).alias("line_number"), F.lit("orders").alias("stage"))
    more = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 100).alias("line_number"), F.lit("lineitem").alias("stage"))
    return relational.supplement(first, more, ["id", "line_number"])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_wins_dedup(spark, sf):
    return relational.first_wins(t(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT a.user_id, min(a.event_id) AS event_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(a.event_id - b.event_id) <= 800 WHERE a.event_type = 'view' AND b.event_type = 'error' GROUP BY a.user_id")
def proximity_combo(spark, sf):
    """Per user the first view with an error within 800 ids: two patterns near each other, first hit per file."""
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type")
    return relational.proximity_first(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'error'").drop("event_type"), ["user_id"], "event_id", 800)


@query("SELECT o_orderkey, count(*) AS n_inside FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 400 DAY GROUP BY o_orderkey")
def interval_containment(spark, sf):
    """Points within the spans of their key."""
    spans = t(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.expr("o_orderdate + INTERVAL 400 DAY").alias("o_end"))
    points = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return relational.within_spans(points, spans, ["o_orderkey"], "l_shipdate", "o_orderdate", "o_end").groupBy("o_orderkey").agg(F.count("*").alias("n_inside"))


EDGES_SQL = "SELECT n_regionkey AS project_id, n_nationkey AS src, (n_nationkey * 7 + k * 3 + 1) % 25 AS dst FROM nation, (VALUES (0), (1)) v(k)"


def edges(spark, sf):
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    e = t(spark, sf, "nation").select(F.lit(1).alias("project_id"), "n_nationkey", k)
    return e.select("project_id", F.col("n_nationkey").cast("string").alias("src"), ((F.col("n_nationkey") * 7 + F.col("k") * 3 + 1) % 25).cast("string").alias("dst"), (F.col("n_nationkey") * 2 + F.col("k")).cast("long").alias("seq"))


DEPTH_SQL = f"""WITH RECURSIVE e AS ({EDGES_SQL}), w(source, node, depth) AS (SELECT n_nationkey, n_nationkey, 1 FROM nation WHERE n_nationkey IN (0, 3) UNION SELECT w.source, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 20)
SELECT CAST(source AS VARCHAR) AS source, CAST(node AS VARCHAR) AS node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY source, node"""


def sources(spark):
    return spark.createDataFrame([(1, "0", 1), (1, "3", 2)], "project_id int, source string, seq long")


@query(DEPTH_SQL)
def reach_bfs(spark, sf):
    """Breadth-first depth of every node from two sources, level by level over the edge table."""
    return graph.bfs_paths(edges(spark, sf), sources(spark)).select("source", "node", "depth")


@query(DEPTH_SQL)
def reach_bfs_grouped(spark, sf):
    """The same with one task per project."""
    return graph.bfs_paths_grouped(edges(spark, sf), sources(spark)).select("source", "node", "depth")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM ({EDGES_SQL})), w(node, path) AS (SELECT '0', ['0'] UNION ALL SELECT e.dst, list_append(path, e.dst) FROM w JOIN e ON e.src = w.node WHERE len(path) < 8 AND NOT list_contains(path, e.dst) AND w.node <> '9')
SELECT array_to_string(path, ' → ') AS data_flow, CAST(len(path) AS INTEGER) AS n_nodes FROM w WHERE node = '9'""")
def reach_paths(spark, sf):
    """All simple paths between two nodes up to eight nodes long."""
    paths = graph.simple_paths(edges(spark, sf), "0", "9", 8)
    return paths.select(F.array_join("path", " → ").alias("data_flow"), F.size("path").alias("n_nodes"))


PATHS_SQL = f"""WITH RECURSIVE e AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, n_nationkey * 2 + k AS seq FROM (SELECT n_regionkey, n_nationkey, k, n_nationkey AS src, (n_nationkey * 7 + k * 3 + 1) % 25 AS dst FROM nation, (VALUES (0), (1)) v(k))), w(source, node, path, seqs) AS (
SELECT CAST(n_nationkey AS VARCHAR), CAST(n_nationkey AS VARCHAR), [CAST(n_nationkey AS VARCHAR)], CAST([] AS BIGINT[]) FROM nation WHERE n_nationkey IN (0, 3) UNION ALL
SELECT w.source, e.dst, list_append(w.path, e.dst), list_append(w.seqs, CAST(e.seq AS BIGINT)) FROM w JOIN e ON e.src = w.node WHERE len(w.path) < 9 AND NOT list_contains(w.path, e.dst))
SELECT source, node, array_to_string(path, ' → ') AS data_flow, CAST(len(path) AS INTEGER) AS depth FROM w QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY len(path), seqs) = 1"""


@query(PATHS_SQL)
def reach_bfs_paths(spark, sf):
    """The first path to every node, level by level: of the shortest ones, the one whose edges come first."""
    found = graph.bfs_paths(edges(spark, sf), sources(spark), 9)
    return found.select("source", "node", F.array_join("path", " → ").alias("data_flow"), "depth")


@query(PATHS_SQL)
def reach_bfs_paths_grouped(spark, sf):
    """The same with one task per project."""
    found = graph.bfs_paths_grouped(edges(spark, sf), sources(spark), 9)
    return found.select("source", "node", F.array_join("path", " → ").alias("data_flow"), "depth")


SUFFIXES = [("html", 0), (".html", 1), ("/index.html", 2), ("1.html", 3), (".org", 4), ("9", 5), ("99", 6), ("com", 7)]


@query("SELECT page_id, (SELECT s FROM (VALUES " + ", ".join(f"('{s}', {o})" for s, o in SUFFIXES) + ") v(s, o) WHERE ends_with(url, s) ORDER BY length(s) DESC, o LIMIT 1) AS suffix FROM pages")
def suffix_longest(spark, sf):
    """The longest catalogue entry that a name ends with."""
    return relational.longest_suffix(t(spark, sf, "pages").select("page_id", "url"), SUFFIXES, "url", "suffix").select("page_id", "suffix")


SEVERITY_SQL = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END"


def scans(spark, sf):
    kind = F.col("event_type")
    sev = F.when(kind == "error", "critical").when(kind == "purchase", "high").when(kind == "signup", "medium").when(kind == "click", "low").otherwise("info")
    return t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", sev.alias("severity"), (F.col("user_id") % 50).alias("line_number"), F.when(kind == "view", "note").otherwise("finding").alias("kind"))


@query(f"SELECT user_id, event_id, severity, line_number, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {RANK.format('severity')}, line_number, event_id) AS INTEGER) AS place FROM (SELECT event_id, user_id, {SEVERITY_SQL} AS severity, event_id % 50 AS line_number FROM events WHERE event_type <> 'view')")
def severity_listing(spark, sf):
    """Every user's findings as they are listed: severity rank, line, id. Filters that aren't given are left out."""
    rows = report.optional_filter(scans(spark, sf), user_id=None, event_type="", kind="finding").withColumn("line_number", F.col("event_id") % 50)
    w = Window.partitionBy("user_id").orderBy(severity_rank(F.col("severity")), "line_number", "event_id")
    return rows.withColumn("place", F.row_number().over(w)).select("user_id", "event_id", "severity", "line_number", "place")


@query(f"SELECT event_id, severity, (SELECT count(*) FROM events) AS total FROM (SELECT event_id, ts, {SEVERITY_SQL} AS severity FROM events) ORDER BY ts DESC, event_id LIMIT 50")
def top_scans(spark, sf):
    """The newest fifty, and how many there are in all."""
    return report.top_with_total(scans(spark, sf).select("event_id", "severity", "ts"), [F.desc("ts"), "event_id"], 50).select("event_id", "severity", "total")


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS n_long, count(*) FILTER (WHERE lang = 'en') AS n_en FROM documents GROUP BY source")
def cond_counts(spark, sf):
    return report.counts(t(spark, sf, "documents"), ["source"], n_long=F.col("n_chars") > 2000, n_en=F.col("lang") == "en")


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def mode_group(spark, sf):
    """The most common language per source, ties to the first name."""
    return report.most_common(t(spark, sf, "documents"), ["source"], "lang")


@query("SELECT ext, count(*) AS n_files, list_sort(list(url))[1:200] AS files FROM (SELECT url, lower(regexp_extract(url, '[.][^./]*$')) AS ext FROM pages) GROUP BY ext")
def ext_group(spark, sf):
    """Files by suffix, with the names of the first 200."""
    return report.listed_files(t(spark, sf, "pages").select(F.col("url").alias("path")), []).select("ext", "n_files", "files")


@query("SELECT d.doc_id, d.source FROM documents d JOIN (SELECT source, bool_or(contains(text, 'worthless pathetic')) AS f FROM documents GROUP BY source) s ON s.source = d.source WHERE NOT f OR lang <> 'en'")
def has_flag_filter(spark, sf):
    """Rows that need a sign in their group go where no row of the group has it (here: stay unless it does)."""
    docs = t(spark, sf, "documents")
    flags = relational.has_flag(docs, "source", F.col("text").contains("worthless pathetic"))
    return docs.select("doc_id", "source", "lang").join(flags, "source").where(~F.col("has_flag") | (F.col("lang") != "en")).select("doc_id", "source")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_extract(spark, sf):
    k = F.from_json("props", "k long")["k"].alias("k")
    return t(spark, sf, "events").select("event_type", k).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT event_id, json_valid(props) AND json_extract(props, '$.k') IS NOT NULL AS is_analysis FROM events")
def json_kind(spark, sf):
    """Is an answer an analysis (a key is there) or something else? Tested on the parsed value."""
    return t(spark, sf, "events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "string").isNotNull(), F.lit(False)).alias("is_analysis"))


@query(f"""WITH l AS ({LINES_SQL}), h AS (SELECT doc_id, line_no AS sink_line, line_no - 3 AS source_line, doc_id * 100000 + line_no AS finding_id FROM l WHERE contains(code, 'icensed under'))
SELECT h.finding_id, l.line_no, l.code, CASE WHEN l.line_no = h.source_line THEN 'SOURCE' WHEN l.line_no = h.sink_line THEN 'SINK' END AS tag FROM h JOIN l ON l.doc_id = h.doc_id AND (abs(l.line_no - h.sink_line) <= 1 OR abs(l.line_no - h.source_line) <= 1)""")
def context_slice(spark, sf):
    """A line around the source and the sink of every finding, both tagged: an equi-join on exploded line numbers."""
    rows = relational.lines(t(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"), ["path"])
    sink = F.col("line_no")
    found = rows.where(F.col("code").contains("icensed under")).select((F.col("path") * 100_000 + sink).alias("finding_id"), F.col("path").alias("file_path"), (sink - 3).alias("source_line"), sink.alias("sink_line"))
    return report.context(rows, found, 1)


@query("""SELECT doc_id, verdict, confidence, CASE verdict WHEN 'confirmed' THEN 'confirmed' WHEN 'false_positive' THEN 'false_positive' ELSE 'pending' END AS status, CASE verdict WHEN 'confirmed' THEN 'true' WHEN 'false_positive' THEN 'false' ELSE 'uncertain' END AS is_vulnerable FROM (
SELECT doc_id, CASE WHEN quality = 0 THEN 'false_positive' WHEN toxic = 1 AND n_chars < 3000 THEN 'confirmed' ELSE 'potential' END AS verdict, CAST(CASE WHEN quality = 0 THEN 0.7 WHEN toxic = 1 AND n_chars < 3000 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence FROM documents JOIN labels USING (doc_id))""")
def verdict_case(spark, sf):
    """The heuristic verdict as a pure column rule, and what it sets."""
    from taintloom.operators import verify

    docs = t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels"), "doc_id")
    level = F.when(F.col("quality") == 0, "strong").otherwise("none")
    difficulty = F.when(F.col("n_chars") < 3000, "easy").otherwise("hard")
    judged = verify.heuristic(docs.withColumns({"protection_level": level, "is_exploitable": F.col("toxic") == 1, "exploit_difficulty": difficulty}))
    return verify.applied(judged).select("doc_id", "verdict", "confidence", "status", "is_vulnerable")


@query("""WITH f AS (SELECT doc_id, contains(text, 'idiot') OR contains(text, 'scum') OR contains(text, 'loser') AS hit FROM documents), m AS (SELECT count(*) FILTER (WHERE hit AND toxic = 1) AS tp, count(*) FILTER (WHERE hit AND toxic = 0) AS fp, count(*) FILTER (WHERE toxic = 1) AS labels FROM f JOIN labels USING (doc_id))
SELECT tp, fp, labels, round(tp / (tp + fp), 6) AS precision, round(tp / labels, 6) AS recall, round(5 * (tp / (tp + fp)) * (tp / labels) / (4 * (tp / (tp + fp)) + tp / labels), 6) AS f2 FROM m""")
def score_f2(spark, sf):
    """Precision, recall and F2 of findings against labels, by file, weakness and line band."""
    hit = F.col("text").contains("idiot") | F.col("text").contains("scum") | F.col("text").contains("loser")
    labels = t(spark, sf, "labels").select("doc_id", "toxic")
    found = t(spark, sf, "documents").where(hit).select("doc_id").join(labels, "doc_id").select(F.col("doc_id").alias("finding_id"), F.col("doc_id").cast("string").alias("file_path"), F.lit(5).alias("line_number"), F.lit("CWE-79").alias("cwe"))
    truth = labels.where("toxic = 1").select(F.col("doc_id").alias("label_id"), F.col("doc_id").cast("string").alias("file_path"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end"), F.array(F.lit("CWE-79")).alias("cwes"), F.lit(False).alias("is_trap"))
    return report.scores(found, truth).select("tp", "fp", "labels", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f2")))


@query("""SELECT CAST(user_id AS VARCHAR) AS name, bool_or(event_type = 'view') AS is_source, bool_or(event_type = 'purchase') AS is_sink, list_sort(list_distinct(list(event_type))) AS types, min_by(event_type, event_id) AS origin, max_by(event_id, event_id) AS line FROM events GROUP BY user_id""")
def node_upsert(spark, sf):
    """Nodes merged by name: flags OR-ed, sets united, the first origin, the last line."""
    kind = F.col("event_type")
    rows = t(spark, sf, "events").select(F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("name"), (kind == "view").alias("is_source"), (kind == "purchase").alias("is_sink"), F.lit(False).alias("tainted"), F.array(kind).alias("sanitized_types"), kind.alias("origin"), F.lit("").alias("snippet"), F.col("event_id").alias("line"), F.col("event_id").alias("seq"))
    return graph.upsert_nodes(rows).select("name", "is_source", "is_sink", F.col("sanitized_types").alias("types"), "origin", "line")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def last_mark_wins(spark, sf):
    """What the last mark of a variable leaves."""
    return graph.last_marks(t(spark, sf, "events").withColumn("seq", F.col("event_id")), ["user_id"], ["event_type", "value"])


@query("""WITH l AS (SELECT * FROM (""" + LINES_SQL + """) WHERE code <> ''), s AS (SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM l WHERE regexp_matches(code, '^(?:The|Der|La|El)[^a-z]'))
SELECT doc_id, line_no AS block_start, coalesce(next - 1, (SELECT max(line_no) FROM l WHERE l.doc_id = s.doc_id)) AS block_end FROM s""")
def block_segments(spark, sf):
    """Blocks from each starting line to the line before the next one, or to the last line."""
    rows = relational.lines(t(spark, sf, "documents").select("doc_id", "text"), ["doc_id"]).where("code <> ''")
    return relational.blocks(rows, ["doc_id"], F.col("code").rlike("^(?:The|Der|La|El)[^a-z]"), whole=False)


@query("""SELECT o_orderkey, vuln_type, CASE vuln_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY["python"].items()) + """ ELSE 'medium' END AS severity, CASE vuln_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CWE.items()) + """ ELSE '' END AS cwe FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'command_execution' WHEN '2-HIGH' THEN 'ssrf' WHEN '3-MEDIUM' THEN 'xss' ELSE 'other' END AS vuln_type FROM orders)""")
def dimension_lookup(spark, sf):
    """Severity and weakness number of a type, with defaults: a map literal instead of a join."""
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "command_execution").when(p == "2-HIGH", "ssrf").when(p == "3-MEDIUM", "xss").otherwise("other")
    rows = t(spark, sf, "orders").select("o_orderkey", kind.alias("vuln_type"))
    return rows.select("o_orderkey", "vuln_type", severity("python", F.col("vuln_type")).alias("severity"), cwe(F.col("vuln_type")).alias("cwe"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) END AS masked, regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g') AS safe_name FROM customer")
def masked_keys(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", T.masked(F.col("c_name")).alias("masked"), T.safe_name(F.col("c_name")).alias("safe_name"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 9000 THEN 'critical' WHEN c_acctbal >= 7000 THEN 'high' WHEN c_acctbal >= 4000 THEN 'medium' ELSE 'low' END AS severity FROM customer")
def score_buckets(spark, sf):
    """A score in severity buckets where no stated severity is there."""
    none = F.lit(None).cast("string")
    return t(spark, sf, "customer").select("c_custkey", T.cvss_bucket(none, none, F.col("c_acctbal") / 1000).alias("severity"))


@query("SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) <= 10000 AND sum(n_chars) <= 209715200 AND max(n_chars) <= 52428800 AS ok FROM documents GROUP BY source")
def archive_limits(spark, sf):
    """File and byte limits of an archive as one aggregation over member rows."""
    from taintloom.sources import corpus

    members = t(spark, sf, "documents").select(F.col("source"), F.col("n_chars").alias("size"))
    return corpus.archive_guard(members, "source")


@query("SELECT CAST(to_json({'orderkey': o_orderkey, 'status': o_orderstatus, 'at': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')}) AS VARCHAR) AS json FROM orders")
def json_rows(spark, sf):
    """Rows as JSON with ISO times."""
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), T.iso(F.col("o_orderdate")).alias("at"))
    return report.as_json(rows, ["orderkey", "status", "at"])


@query("SELECT doc_id, quality, coalesce(v.verdict, 'pending') AS status FROM labels LEFT JOIN (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'confirmed' WHEN n_chars < 600 THEN 'rejected' END AS verdict FROM documents) v USING (doc_id)")
def verdict_join(spark, sf):
    """Verdicts meet findings by key; findings without one keep their status."""
    found = t(spark, sf, "labels").select("doc_id", "quality", F.lit("pending").alias("status"))
    verdicts = t(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, "confirmed").when(F.col("n_chars") < 600, "rejected").alias("status"))
    return report.with_verdicts(found, verdicts, "doc_id").select("doc_id", "quality", "status")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def cascade_delete(spark, sf):
    """Rows whose parent isn't among those deleted."""
    gone = t(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return report.without_projects(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), gone, "c_nationkey")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'en' ELSE role END AS resolved, turn % 3 = 0 AS chosen FROM conversations")
def resolved_choice(spark, sf):
    """A user's choice, else what was detected, and which of them it is."""
    rows = t(spark, sf, "conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").cast("string").alias("language"), F.col("role").alias("detected"))
    chosen = rows.select("project_id", "language", F.when(F.col("language").cast("int") % 3 == 0, "en").otherwise("").alias("chosen"))
    out = rules.resolved_versions(rows, chosen)
    return out.select(F.col("project_id").alias("conv_id"), F.col("language").cast("long").alias("turn"), F.col("version").alias("resolved"), (~F.col("detected_by_code")).alias("chosen"))


CREDENTIAL_SQL = f"""SELECT doc_id, line_no, code FROM (SELECT doc_id, line_no, code, lower(regexp_extract(code, '^([a-z_]+) = "([^"'']*)"', 1)) AS n, trim(regexp_extract(code, '^([a-z_]+) = "([^"'']*)"', 2)) AS v FROM (SELECT doc_id, line_no, regexp_extract(code, '[a-z_]+ = "[^"'']+"') AS code FROM ({LINES_SQL})) WHERE code <> '')
WHERE length(v) >= 3 AND (regexp_matches(n, '{"|".join(P.CREDENTIAL_WORDS)}') OR ends_with(n, 'key') AND length(v) >= 12) AND NOT regexp_matches(n, '^(?:{"|".join(P.EXCLUDED_PREFIXES)})|(?:{"|".join(P.EXCLUDED_SUFFIXES)})$') AND NOT regexp_matches(v, '[${{(%]') AND lower(v) <> n AND lower(v) NOT IN ({", ".join(f"'{x}'" for x in P.PLAIN_VALUES)}) AND NOT ({" OR ".join(f"contains(lower(v), '{x}')" for x in P.PLACEHOLDERS)})"""


@query(CREDENTIAL_SQL)
def credential_scan(spark, sf):
    """The first string assignment of every line, where it is a credential."""
    rows = relational.lines(t(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    rows = rows.withColumn("code", F.regexp_extract("code", """[a-z_]+ = "[^"']+\"""", 0)).where("code <> ''")
    return rows.where(detectors.credential(F.col("code")))


@query("SELECT file_id, line_number, vuln_type, sink_line, first_key FROM (SELECT l_suppkey AS file_id, l_partkey % 50 AS line_number, l_returnflag AS vuln_type, coalesce(nullif(l_linenumber, 1), 0) AS sink_line, min(l_orderkey) AS first_key FROM lineitem GROUP BY 1, 2, 3, 4)")
def final_dedup(spark, sf):
    """First-wins dedup by file, line, type and sink line, a missing sink line counting as 0."""
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file_id"), (F.col("l_partkey") % 50).alias("line_number"), F.col("l_returnflag").alias("vuln_type"), F.coalesce(F.nullif("l_linenumber", F.lit(1)), F.lit(0)).alias("sink_line"), F.col("l_orderkey").alias("first_key"))
    return relational.first_wins(rows, ["file_id", "line_number", "vuln_type", "sink_line"], ["first_key"])


@query("""WITH f AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 90) AS sink, bool_or(event_type = 'signup' AND value > 90) AS source FROM events GROUP BY user_id)
SELECT user_id AS sink_file, (SELECT min(user_id) FROM f WHERE source) AS source_file FROM f WHERE sink AND NOT source""")
def cross_file_sources(spark, sf):
    """Files with a sink and no source, each with the first file that has one."""
    kind, large = F.col("event_type"), F.col("value") > 90
    f = t(spark, sf, "events").groupBy("user_id").agg(F.bool_or((kind == "purchase") & large).alias("sink"), F.bool_or((kind == "signup") & large).alias("source"))
    return relational.with_first(f.where("sink and not source").select(F.col("user_id").alias("sink_file")), f.where("source"), "user_id", "source_file")


@query(f"""WITH l AS ({LINES_SQL}) SELECT doc_id, line_no, code FROM (SELECT doc_id, CAST(CASE WHEN line_no > 2 THEN line_no + 1 ELSE line_no END AS INTEGER) AS line_no, code FROM l WHERE line_no <> 2 UNION ALL SELECT doc_id, 2, 'new line' FROM l WHERE line_no = 2 UNION ALL SELECT doc_id, 3, 'and another' FROM l WHERE line_no = 2)""")
def line_replacement(spark, sf):
    """Every file's second line replaced by two, lines behind it numbered anew."""
    rows = relational.lines(t(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"), ["path"])
    return report.replaced_lines(rows, None, 2, 2, ["new line", "and another"]).select(F.col("path").alias("doc_id"), "line_no", "code")


@query(f"SELECT doc_id AS path, line_no, printf('%4d | %s', line_no, code) AS shown FROM ({LINES_SQL}) WHERE line_no BETWEEN 2 AND 4")
def file_region(spark, sf):
    """A region of every file with numbers."""
    rows = relational.lines(t(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"), ["path"])
    return report.region(rows, None, 2, 4)


@query("SELECT o_orderkey, coalesce(n.n_name, c.c_mktsegment, 'none') AS resolved FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 2")
def resolution_cascade(spark, sf):
    """The first of several lookups that finds something: left joins and a coalesce."""
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "left")
    n = t(spark, sf, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    found = relational.first_found(o, [(n, ["c_nationkey"], "n_name"), (c, ["c_custkey"], "c_mktsegment")], "resolved", F.lit("none"))
    return found.select("o_orderkey", "resolved")


@query("""WITH a AS (SELECT conv_id, turn, CAST(generate_subscripts(w, 1) AS BIGINT) - 1 AS pos, unnest(w) AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))
SELECT a.conv_id, a.turn, a.pos, a.word AS src, b.word AS dst FROM a JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.pos = a.pos""")
def positional_join(spark, sf):
    """Arguments meet parameters by position: both sides exploded with positions, then an equi-join."""
    rows = t(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ", -1).alias("words"))
    later = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), "words")
    return relational.by_position(rows, later, ["conv_id", "turn"], "words", "words").withColumn("pos", F.col("pos").cast("long"))


for module in (code_queries, scale_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
