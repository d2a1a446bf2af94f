"""Queries of the code analysis over projects that are made of the tables' rows (`code_forms`), with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taintloom.functions import patterns as P
from taintloom.functions import text as T
from taintloom.operators import callgraph, cve, detectors, enrich, facts, graph, relational, report, rules, taint, templates
from taintloom.sources import corpus
from taintloom.sources.tables import read_table

from . import code_forms as C
from . import pipeline

QUERIES = {}
ORACLES = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def extracted(files: DataFrame, kinds: list[str]) -> DataFrame:
    """Facts of some kinds that several joins read: extracted once."""
    return graph.cut(facts.extract(files, kinds))


#: Kinds of facts that calls and links between files are made of.
CALL_KINDS = ["function", "call"]
LINK_KINDS = [*CALL_KINDS, "edge", "var", "module_attr"]


#: Columns of facts as queries name them.
SHOWN = {"variable": "var AS variable", "target": "dst AS target", "types": "array_join(types, ',') AS types"}


def _fact_queries() -> None:
    """code_<language>_<kind>s: the facts of one kind of every order's file."""
    wanted = {"source": "path, line, variable, name", "sink": "path, line, variable, name, vuln_type", "edge": "path, line, variable, target, name", "sanitize": "path, line, variable, name, types"}
    for language in C.FORMS:
        for kind, columns in wanted.items():

            def run(spark, sf, language=language, kind=kind, columns=columns):
                named = columns.split(", ")
                read = [{"variable": "var", "target": "dst"}.get(c, c) for c in named]
                rows = facts.extract(C.code_files(spark, sf, language), [kind], ordered=False, columns=read)
                return rows.selectExpr(*(SHOWN.get(c, c) for c in named))

            run.__name__ = f"code_{language}_{kind}s"
            run.__doc__ = f"Facts of kind {kind} of every order's {language} file."
            query(C.facts_sql(language, [kind], columns))(run)


_fact_queries()


def rows_of(spark, sf, table: str, **columns: str) -> DataFrame:
    """Columns of a table by SQL expressions, as text."""
    return read_table(spark, sf, table).select(*(F.expr(e).cast("string").alias(c) for c, e in columns.items()))


# Modules of customers: a class, a function, imports.

CUSTOMERS_SQL = "SELECT c_custkey AS c, c_nationkey AS n, 'src/n' || c_nationkey || '/m' || c_custkey || '.py' AS p, c_custkey % 2 = 0 AS even FROM customer"
MODULE = """import os.path as p{c}
from . import near{c}
from ..up import far{c}
top{c} = 1
class K{c}:
    {word} m{c}(self, a{c}, *, k=None):
        return a{c}
def f{c}(x{c}{slash}, y):
    return x{c}
r{c} = f{c}(q{c}, 5)
"""


def modules(spark, sf) -> DataFrame:
    rows = rows_of(spark, sf, "customer", c="c_custkey", n="c_nationkey", word="CASE WHEN c_custkey % 3 = 0 THEN 'async def' ELSE 'def' END", slash="CASE WHEN c_custkey % 2 = 0 THEN ', /' ELSE '' END")
    return C.made_files(rows, F.concat(F.lit("p"), (F.col("c").cast("long") % 5).cast("string")), [("src/n{n}/m{c}.py", "python", MODULE), ("src/base{c}.py", "python", "z = 1\n")])


SCOPES = [
    ("function", "6", "K{c}.m{c}", None, "self,a{c}", "k", "{p}@K{c}.m{c}:", "true"),
    ("function", "8", "f{c}", None, "x{c},y", "", "{p}@f{c}:", "true"),
    ("source", "6", "function.parameter", "{p}@K{c}.m{c}:a{c}", None, None, None, "true"),
    ("source", "6", "function.parameter", "{p}@K{c}.m{c}:k", None, None, None, "true"),
    ("source", "8", "function.parameter", "{p}@f{c}:x{c}", None, None, None, "true"),
    ("source", "8", "function.parameter", "{p}@f{c}:y", None, None, None, "true"),
    ("var", None, "top{c}", "{p}@:top{c}", None, None, None, "true"),
    ("var", None, "r{c}", "{p}@:r{c}", None, None, None, "true"),
]


@query(C.each_row_sql(CUSTOMERS_SQL, ["c", "p"], SCOPES, ["kind", "line", "name", "variable", "params", "kwonly", "prefix"], {"line": "INTEGER"}))
def code_scopes(spark, sf):
    """Functions with qualified names, parameters as sources, and module variables, of every customer's module."""
    rows = facts.extract(modules(spark, sf), ["function", "var", "source"], ordered=False).where("kind in ('function', 'var') or name = 'function.parameter'").where("path like 'src/n%'")
    join = lambda c: F.when(F.col("kind") == "function", F.array_join(c, ",")).alias(c)
    return rows.select("kind", "line", "name", F.col("var").alias("variable"), join("params"), join("kwonly"), "prefix")


@query(C.each_row_sql(CUSTOMERS_SQL, ["c", "n", "p"], [("{p}", "1", "p{c}", "os.path", "true"), ("{p}", "2", "near{c}", "n{n}.near{c}", "true"), ("{p}", "3", "far{c}", "up.far{c}", "true")], ["path", "line", "name", "target"], {"line": "INTEGER"}))
def code_imports(spark, sf):
    """Aliases of imports: renamed, and relative ones of the own and the next higher package."""
    return facts.extract(modules(spark, sf), ["alias"], ordered=False).select("path", "line", "name", F.col("dst").alias("target"))


@query(C.each_row_sql(CUSTOMERS_SQL, ["c", "n", "p"], [("{p}", "n{n}.m{c}", "top{c}", "true"), ("{p}", "n{n}.m{c}", "r{c}", "true"), ("src/base{c}.py", "base{c}", "z", "true")], ["path", "module", "name"]))
def code_modules(spark, sf):
    """Names of modules, below the folder that all files of a project share."""
    return facts.extract(modules(spark, sf), ["var"], ordered=False).select("path", "module", "name")


@query(C.each_row_sql(CUSTOMERS_SQL, ["c", "p"], [("{p}", "7", "{p}@K{c}.m{c}:a{c}", "{p}@K{c}.m{c}:#ret", "true"), ("{p}", "9", "{p}@f{c}:x{c}", "{p}@f{c}:#ret", "true")], ["path", "line", "variable", "target"], {"line": "INTEGER"}))
def code_returns(spark, sf):
    """Edges from what functions return to their results."""
    return facts.extract(modules(spark, sf), ["edge"], ordered=False).where("name = 'return'").select("path", "line", F.col("var").alias("variable"), F.col("dst").alias("target"))


@query(C.each_row_sql("SELECT s_suppkey AS c, s_suppkey % 3 = 0 AS bad FROM supplier", ["c"], [("b{c}.py", "error", None, "bad"), ("b{c}.py", "var", "x", "NOT bad")], ["path", "kind", "name"]))
def code_errors(spark, sf):
    """A file that can't be parsed is an error row, and no file beside it suffers."""
    rows = rows_of(spark, sf, "supplier", c="s_suppkey", code="CASE WHEN s_suppkey % 3 = 0 THEN 'def f(:' ELSE 'x = 1' END")
    files = C.made_files(rows, F.lit("p"), [("b{c}.py", "python", "{code}\n")])
    return facts.extract(files, ["error", "var"], ordered=False).select("path", "kind", F.when(F.col("kind") == "var", F.col("name")).alias("name"))


# A library and its user for each customer.

LIBRARY = "limit{c} = 3\ndef f{c}(x, y, *, k=0):\n    return y\n"
USER = "import l{c}\nfrom l{c} import f{c} as g{c}\nr = l{c}.f{c}(p, q, k=s)\nn = l{c}.limit{c}\nt = g{c}(p)\nz = other{c}.f{c}(p)\n"


def libraries(spark, sf) -> DataFrame:
    rows = rows_of(spark, sf, "customer", c="c_custkey")
    return C.made_files(rows, F.concat(F.lit("p"), (F.col("c").cast("long") % 7).cast("string")), [("l{c}.py", "python", LIBRARY), ("u{c}.py", "python", USER)])


@query(C.each_row_sql("SELECT c_custkey AS c FROM customer", ["c"], [("u{c}.py", "3", "l{c}.f{c}", "l{c}.py@f{c}:", "true"), ("u{c}.py", "5", "g{c}", "l{c}.py@f{c}:", "true")], ["path", "line", "name", "prefix"], {"line": "INTEGER"}))
def code_calls(spark, sf):
    """Calls with the project function that each means, through the imports of the file; none of an unknown object."""
    rows = taint.resolved_calls(extracted(libraries(spark, sf), CALL_KINDS))
    return rows.select("path", "line", "name", F.col("target.prefix").alias("prefix"))


LINKS = [
    ("u{c}.py@:p", "l{c}.py@f{c}:x", "3", "true"),
    ("u{c}.py@:q", "l{c}.py@f{c}:y", "3", "true"),
    ("u{c}.py@:s", "l{c}.py@f{c}:k", "3", "true"),
    ("l{c}.py@f{c}:#ret", "u{c}.py@:call@3:4", "3", "true"),
    ("l{c}.py@:limit{c}", "u{c}.py@:attr@4:4", "4", "true"),
    ("u{c}.py@:p", "l{c}.py@f{c}:x", "5", "true"),
    ("l{c}.py@f{c}:#ret", "u{c}.py@:call@5:4", "5", "true"),
]


@query(C.each_row_sql("SELECT c_custkey AS c FROM customer", ["c"], LINKS, ["variable", "target", "line"], {"line": "INTEGER"}))
def code_links(spark, sf):
    """Edges between files: arguments to parameters by position and by name, results, attributes of modules."""
    rows = taint.link_edges(extracted(libraries(spark, sf), LINK_KINDS))
    return rows.where("left(src, 1) <> left(dst, 1)").select(F.col("src").alias("variable"), F.col("dst").alias("target"), "line")


# Flows through whole files: an order's lines hand a value on, clean it or not, up to a sink.

CHAIN_SQL = f"""WITH l AS (SELECT *, pick % 5 AS form, max(k) OVER (PARTITION BY o) AS last FROM ({C.LINES_SQL}))
SELECT 'o' || o || '.py' AS file_path, CAST(last + 3 AS INTEGER) AS line_number, 'command_execution' AS vuln_type, 'critical' AS severity, 'CWE-78' AS cwe, 'builtins.input' AS source_func FROM l GROUP BY o, last HAVING count(*) FILTER (WHERE form IN (2, 3)) = 0"""


@query(CHAIN_SQL)
def code_chains(spark, sf):
    """Findings of every order's file with grades: input, then a step a line (plain, joined, cleaned of everything or of
    commands, cleaned of scripts only), then a shell."""
    lines = C.order_lines(spark, sf)
    step = F.concat(F.lit("x"), F.col("k").cast("string"))
    before = F.concat(F.lit("x"), (F.col("k") - 1).cast("string"))
    forms = F.array(*(F.lit(s) for s in ("{x} = {b}", "{x} = {b} + 'a'", "{x} = int({b})", "{x} = shlex.quote({b})", "{x} = html.escape({b})")))
    code = C.filled(F.get(forms, (F.col("pick") % 5).cast("int")), x=step, b=before)
    lines = lines.withColumn("last", F.max("k").over(Window.partitionBy("o")))
    end = F.when(F.col("k") == F.col("last"), F.concat(F.lit("\nos.system(x"), F.col("k").cast("string"), F.lit(")"))).otherwise("")
    path = F.concat(F.lit("o"), F.col("o"), F.lit(".py"))
    files = C.as_files(lines.select("o", "n", F.concat(code, end).alias("code")), F.concat(F.lit("p"), F.col("o") % 97), path, "python", ["import html, os, shlex", "x0 = input()"], by="n")
    found = pipeline.graded(taint.flows_of_files(files))
    return found.select("file_path", "line_number", "vuln_type", "severity", "cwe", F.col("source_func"))


# Tools over lines of PHP.


def php_lines(spark, sf) -> DataFrame:
    return corpus.code_lines(C.code_files(spark, sf, "php"))


PHP_LINES_SQL = f"SELECT 'o' || o || '.php' AS path, k + 1 AS line_no, replace(replace(f.code, '{{v}}', v), '{{w}}', w) AS code, v FROM ({C.LINES_SQL}) l JOIN (VALUES {', '.join(f'({k}, {C.text(s)})' for k, (s, _) in enumerate(C.FORMS['php']))}) f(form, code) ON f.form = pick % {len(C.FORMS['php'])}"


@query(f"SELECT path, line_no, CASE WHEN code LIKE '%system(%' THEN 'command' WHEN code LIKE 'mysqli_query(%' OR code LIKE '$db->query(%' THEN 'sql' WHEN code LIKE 'unserialize(%' THEN 'deserialize' ELSE 'code' END AS category FROM ({PHP_LINES_SQL}) WHERE regexp_matches(code, 'system\\(|mysqli_query\\(|db->query\\(|unserialize\\(|eval\\(')")
def tool_calls_of_orders(spark, sf):
    """Dangerous calls of every line, by category."""
    return detectors.tagged_calls(php_lines(spark, sf), P.DANGEROUS_CALLS).select("path", "line_no", "category")


@query(f"SELECT path, line_no, lower(regexp_extract(code, '\\$_(GET|POST|COOKIE|SERVER)', 1)) AS category FROM ({PHP_LINES_SQL}) WHERE regexp_matches(code, '\\$_(GET|POST|COOKIE|SERVER)')")
def tool_inputs_of_orders(spark, sf):
    """User inputs of every line, by category."""
    return detectors.user_inputs(php_lines(spark, sf)).select("path", "line_no", "category")


@query(f"SELECT path, line_no, code, count(*) OVER () AS total FROM ({PHP_LINES_SQL}) WHERE contains(lower(code), 'escapeshell') ORDER BY path, line_no LIMIT 50")
def tool_search_of_orders(spark, sf):
    """A search over all lines: the first fifty, and how many there are."""
    return detectors.search(php_lines(spark, sf), "EscapeShell", "*.php").select("path", "line_no", "code", "total")


@query(f"WITH t AS (SELECT '$' || min(v) AS name FROM ({PHP_LINES_SQL})) SELECT path, line_no FROM ({PHP_LINES_SQL}), t WHERE contains(code, name)")
def tool_trace_of_a_part(spark, sf):
    """Where a variable stands: that of the first part."""
    name = C.order_lines(spark, sf).agg(F.min("v")).first()[0]
    return detectors.variable_trace(php_lines(spark, sf), f"${name}").select("path", "line_no")


# Rules by versions, versions by code.

RULE_FORMS = ["mysql_query($x);", "$f = create_function('', $x);", "unserialize($x);", "$y = 1;", "preg_replace('/x/e', $x, 'y');"]
VERSION_SQL = "CASE o % 97 % 4 WHEN 0 THEN '5.3' WHEN 1 THEN '7.0' WHEN 2 THEN '8.1' END"


def rule_lines(spark, sf) -> tuple[DataFrame, DataFrame]:
    lines = C.order_lines(spark, sf)
    code = F.get(F.array(*map(F.lit, RULE_FORMS)), (F.col("pick") % len(RULE_FORMS)).cast("int"))
    files = C.as_files(lines.select("o", "k", code.alias("code")), F.concat(F.lit("p"), F.col("o") % 97), F.concat(F.lit("o"), F.col("o"), F.lit(".php")), "php", ["<?php"])
    versions = lines.select((F.col("o") % 97).alias("o")).distinct().select(F.concat(F.lit("p"), F.col("o")).alias("project_id"), F.lit("php").alias("language"), F.expr("CASE o % 4 WHEN 0 THEN '5.3' WHEN 1 THEN '7.0' WHEN 2 THEN '8.1' END").alias("version"))
    return corpus.code_lines(files), versions.where("version is not null")


RULES_SQL = f"""WITH l AS (SELECT 'o' || o || '.php' AS path, k + 1 AS line_no, pick % {len(RULE_FORMS)} AS form, {VERSION_SQL} AS version FROM ({C.LINES_SQL}))
SELECT path, line_no, 'DEPRECATED_MYSQL_FUNCTIONS' AS rule_id, CASE version WHEN '7.0' THEN 'critical' ELSE 'high' END AS severity FROM l WHERE form = 0
UNION ALL SELECT path, line_no, 'DEPRECATED_CREATE_FUNCTION', 'high' FROM l WHERE form = 1 AND version IS DISTINCT FROM '8.1'
UNION ALL SELECT path, line_no, 'DESERIALIZE_UNSAFE', 'high' FROM l WHERE form = 2
UNION ALL SELECT path, line_no, 'DEPRECATED_PREG_REPLACE_E', 'critical' FROM l WHERE form = 4 AND (version IS NULL OR version = '5.3')"""


@query(RULES_SQL)
def rules_of_orders(spark, sf):
    """Lines with a rule that is active for their project's version, and its severity there."""
    lines, versions = rule_lines(spark, sf)
    return rules.scan(lines, versions=versions).select("path", "line_no", "rule_id", "severity")


@query(RULES_SQL)
def rules_of_orders_by_table(spark, sf):
    """The same with the rules as a table, by the automaton of their literals."""
    lines, versions = rule_lines(spark, sf)
    return rules.scan(lines, rules.rules(spark), versions).select("path", "line_no", "rule_id", "severity")


SIGNS = [("$x = $a ?? 1;", 2), ("$f = fn($x) => 1;", 3), ("echo 1;", 0), ("$x?->y();", 4), ("// fn($x) ?->z", 0), ("function g($x): void {}", 2.5), ("echo 2;", 0), ("echo 3;", 0), ("echo 4;", 0)]


@query(f"""SELECT 'p' || o AS project_id, CASE max(f.rank) WHEN 4 THEN '8.0' WHEN 3 THEN '7.4' WHEN 2.5 THEN '7.2' WHEN 2 THEN '7.0' ELSE '5.0' END AS detected FROM ({C.LINES_SQL}) l JOIN (VALUES {', '.join(f'({k}, {r})' for k, (_, r) in enumerate(SIGNS))}) f(form, rank) ON f.form = pick % {len(SIGNS)} GROUP BY o""")
def versions_of_orders(spark, sf):
    """The highest version that an order's code gives away; comments don't count."""
    lines = C.order_lines(spark, sf)
    code = F.get(F.array(*(F.lit(s) for s, _ in SIGNS)), (F.col("pick") % len(SIGNS)).cast("int"))
    files = C.as_files(lines.select("o", "k", code.alias("code")), F.concat(F.lit("p"), F.col("o")), F.lit("a.php"), "php", ["<?php"])
    return rules.detected_versions(files).select("project_id", "detected")


V = "(c_custkey % 5 + 4)", "(c_custkey % 11)"


@query(f"""SELECT c_custkey, v >= [5, 3, 6] AS trusted, CASE WHEN v >= [7, 0] THEN 'removed' WHEN v >= [5, 5] THEN 'deprecated' ELSE 'available' END AS mysql_functions, CASE WHEN v >= [7, 4] THEN 'removed' WHEN v >= [7, 2] THEN 'deprecated' ELSE 'available' END AS create_function, v >= [7, 0] AS is_php7, v >= [8, 0] AS is_php8 FROM (SELECT c_custkey, [{V[0]}, {V[1]}, c_custkey % 9] AS v FROM customer)""")
def version_contexts_of_customers(spark, sf):
    """What a version has, for versions of three numbers."""
    rows = read_table(spark, sf, "customer").select("c_custkey", F.concat_ws(".", F.expr(V[0]).cast("string"), F.expr(V[1]).cast("string"), (F.col("c_custkey") % 9).cast("string")).alias("version"))
    c = rules.php_context(F.col("version"))
    return rows.select("c_custkey", c["dsn_charset_trusted"].alias("trusted"), c["mysql_functions"].alias("mysql_functions"), c["create_function"].alias("create_function"), c["is_php7"].alias("is_php7"), c["is_php8"].alias("is_php8"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'low' ELSE 'high' END AS severity FROM orders")
def overrides_of_orders(spark, sf):
    """Severities by version where a rule states some, else the rule's own."""
    table = F.create_map(F.lit("1-URGENT"), F.lit("critical"), F.lit("2-HIGH"), F.lit("low"))
    return read_table(spark, sf, "orders").select("o_orderkey", T.overridden(table, F.col("o_orderpriority"), F.lit("high")).alias("severity"))


# Call graphs of customers.

GRAPH = "def get_input{c}():\n    return input()\n\ndef run{c}(c):\n    os.system(c)\n\ndef main{c}():\n    x = get_input{c}()\n    {step}\n"


def graph_files(spark, sf) -> DataFrame:
    rows = rows_of(spark, sf, "customer", c="c_custkey", step="CASE WHEN c_custkey % 3 = 0 THEN 'pass' ELSE concat('run', c_custkey, '(x)') END")
    return C.made_files(rows, F.concat(F.lit("p"), F.col("c")), [("c{c}.py", "python", GRAPH)])


FUNCTIONS = [
    ("c{c}.py", "get_input{c}", "1", "name:get_input,stdin", "", None, "input", "true"),
    ("c{c}.py", "run{c}", "4", "", "Command execution", "command_execution", "", "true"),
    ("c{c}.py", "main{c}", "7", "", "", None, "get_input{c},run{c}", "c % 3 <> 0"),
    ("c{c}.py", "main{c}", "7", "", "", None, "get_input{c}", "c % 3 = 0"),
]


@query(C.each_row_sql("SELECT c_custkey AS c FROM customer", ["c"], FUNCTIONS, ["path", "name", "line", "source_labels", "sink_labels", "vuln_type", "called"], {"line": "INTEGER"}))
def call_functions_of_customers(spark, sf):
    """Functions with what their names and bodies say of them, and what they call."""
    rows = callgraph.functions(graph_files(spark, sf))
    return rows.select("path", "name", "line", F.array_join("source_labels", ",").alias("source_labels"), F.array_join("sink_labels", ",").alias("sink_labels"), "vuln_type", F.array_join("called", ",").alias("called"))


@query(C.each_row_sql("SELECT c_custkey AS c FROM customer", ["c"], [("c{c}.py", "4", "1", "command_execution", "critical", "get_input{c} → main{c} → run{c}", "c % 3 <> 0")], ["file_path", "line_number", "source_line", "vuln_type", "severity", "data_flow"], {"line_number": "INTEGER", "source_line": "INTEGER"}))
def call_findings_of_customers(spark, sf):
    """A caller of a source that reaches a sink."""
    rows = callgraph.findings(callgraph.nodes(callgraph.functions(graph_files(spark, sf))))
    return rows.select("file_path", "line_number", "source_line", "vuln_type", "severity", "data_flow")


# Templates of customers.

VIEW = "from flask import request, render_template\ndef v(q):\n    a{c} = request.args.get('x')\n    return render_template('page{c}.html', a={given}, b='x')\n"
PAGE = "{{ a|safe }}\n{{ b|safe }}\n<script>\nx = {{ a }};\n</script>\n{{ a }}\n{% autoescape off %}\n{{ a }}\n{% endautoescape %}\n"


def template_files(spark, sf) -> DataFrame:
    rows = rows_of(spark, sf, "customer", c="c_custkey", given="CASE WHEN c_custkey % 3 = 0 THEN '''y''' ELSE concat('a', c_custkey) END")
    return C.made_files(rows, F.concat(F.lit("p"), (F.col("c").cast("long") % 5).cast("string")), [("app/views{c}.py", "python", VIEW), ("t/page{c}.html", "template", PAGE)])


@query(C.each_row_sql("SELECT c_custkey AS c FROM customer", ["c"], [("t/page{c}.html", "a", "c % 3 <> 0")], ["path", "variables"]))
def template_variables_of_customers(spark, sf):
    """Templates with the variables with user input that views pass to them."""
    rows = templates.template_variables(template_files(spark, sf))
    return rows.select("path", F.array_join("variables", ",").alias("variables"))


PLACES = [("t/page{c}.html", line, code) for line, code in (("1", "{{ a|safe }}"), ("4", "x = {{ a }};"), ("7", "{% autoescape off %}"))]


@query(C.each_row_sql("SELECT c_custkey AS c FROM customer", ["c"], [(*p, "c % 3 <> 0") for p in PLACES], ["file_path", "line_number", "sink_code"], {"line_number": "INTEGER"}))
def template_findings_strict(spark, sf):
    """Variables that views pass user input in, marked safe, in a script, or in a block without escaping."""
    return templates.findings(template_files(spark, sf), "strict").select("file_path", "line_number", "sink_code")


@query(C.each_row_sql("SELECT c_custkey AS c FROM customer", ["c"], [*((*p, "true") for p in PLACES), ("t/page{c}.html", "2", "{{ b|safe }}", "c % 3 = 0")], ["file_path", "line_number", "sink_code"], {"line_number": "INTEGER"}))
def template_findings_lenient(spark, sf):
    """The same, with all variables of templates that no view passes any to."""
    return templates.findings(template_files(spark, sf), "lenient").select("file_path", "line_number", "sink_code")


# Detections, a line of a form for each order line; forms that another line could change are left out.

DETECTED = {
    "python": [("DEBUG = True", "debug_mode", "debug_mode"), ("app.run(host='x', debug=True)", "debug_mode", "debug_mode"), ("z.extractall(path)", "archive_extract", "path_traversal"), ("x = 1", None, None), ("DEBUG = False", None, None), ("z.extract2(path)", None, None)],
    "php": [
        ("extract($_POST);", "extract_override", "command_execution,path_traversal"),
        ("extract($data);", None, None),
        ("if (in_array($a, ['x', 'y'])) {}", "allowlist_check", "command_execution,path_traversal,sql_injection"),
        ("$c = str_replace('select', '', $c);", "blacklist_filter", "sql_injection,xss"),
        ("$d = strip_tags($d);", "blacklist_filter", "sql_injection,xss"),
        ("$db->query('q ' . $x);", "string_concat_sql", "sql_injection"),
        ("$s->bindValue(1, $x); // SELECT", "parameterized_query", "sql_injection"),
        ("$y = 1;", None, None),
        ("$allowed = ['a'];", "allowlist_check", "command_execution,path_traversal,sql_injection"),
        ("$e = str_replace('a', 'b', $e);", None, None),
    ],
}


def _detections() -> None:
    for language, forms in DETECTED.items():
        suffix, head = C.SUFFIX[language], {"python": ["import app"], "php": ["<?php"]}[language]
        values = ", ".join(f"({k}, {C.text(p)}, {C.text(types)})" for k, (_, p, types) in enumerate(forms) if p)

        def run(spark, sf, forms=forms, language=language, suffix=suffix, head=head):
            lines = C.order_lines(spark, sf)
            code = F.get(F.array(*(F.lit(s) for s, _, _ in forms)), (F.col("pick") % len(forms)).cast("int"))
            path = F.concat(F.lit("o"), F.col("o"), F.lit("." + suffix))
            files = C.as_files(lines.select("o", "k", code.alias("code")), F.concat(F.lit("p"), F.col("o") % 97), path, language, head)
            rows = detectors.detect(corpus.code_lines(files))
            return rows.select("file_path", "line_number", "pattern", F.array_join(F.array_sort("related_types"), ",").alias("types"))

        run.__name__ = f"detections_of_{language}"
        run.__doc__ = f"What the detectors see in every order's {language} file."
        query(f"SELECT 'o' || o || '.{suffix}' AS file_path, k + 1 AS line_number, pattern, types FROM ({C.LINES_SQL}) l JOIN (VALUES {values}) f(form, pattern, types) ON f.form = pick % {len(forms)}")(run)


_detections()

NAMES = ["password", "api_key", "monkey", "demo_password", "password_field", "token", "label"]
NAME_SQL = "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END"
VALUE_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'changeme' WHEN 1 THEN 'ab' ELSE c_name END"


@query(f"SELECT 'k' || c_custkey || '.py' AS file_path, 1 AS line_number FROM (SELECT c_custkey, {NAME_SQL} AS n, {VALUE_SQL} AS v FROM customer) WHERE length(v) >= 3 AND v <> 'changeme' AND n NOT IN ('demo_password', 'password_field', 'token', 'label')")
def credentials_of_customers(spark, sf):
    """Credentials in assignments, by the name and the value; samples and placeholders are none."""
    rows = rows_of(spark, sf, "customer", c="c_custkey", n=NAME_SQL, v=VALUE_SQL)
    files = C.made_files(rows, F.lit("p"), [("k{c}.py", "python", '{n} = "{v}"\n'), ("tests/k{c}.py", "python", '{n} = "{v}"\n')])
    found = detectors.detect(corpus.code_lines(files)).where("pattern = 'hardcoded_credentials'")
    return found.select("file_path", F.col("line_number").cast("int").alias("line_number"))


# Lines and blocks of functions and classes; comments; text of lines.

BLOCKS = "<?php\nclass A{c} {\n  // }\n  function f() {\n{body}    return '}';\n  }\n}\n$g = 1;\n"


@query("""SELECT 's' || c_custkey || '.php' AS path, kind, CAST(a AS INTEGER) AS first_line, CAST(b + c_custkey % 4 AS INTEGER) AS last_line FROM customer, (VALUES ('class', 2, 7), ('function', 4, 6)) v(kind, a, b)""")
def spans_of_code(spark, sf):
    """Lines of classes and functions, with braces in strings and comments left out, bodies of different lengths."""
    rows = rows_of(spark, sf, "customer", c="c_custkey", body="repeat('    x();\n', int(c_custkey % 4))")
    found = detectors.block_spans(facts.extract(C.made_files(rows, F.lit("p"), [("s{c}.php", "php", BLOCKS)]), ["span"], ordered=False))
    return found.select("path", "kind", F.col("start").alias("first_line"), F.col("end").alias("last_line"))


@query("SELECT c_custkey, 'a' || c_custkey || ' ' || chr(10) || 'c ' || CASE WHEN c_custkey % 2 = 0 THEN '# d' ELSE '' END || chr(10) || 'f' AS text FROM customer")
def comments_of_customers(spark, sf):
    """Code without its comments: `#` begins one in PHP, but not in C."""
    rows = read_table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("a"), F.col("c_custkey"), F.lit(" // b\nc # d\n/* e\n*/f")).alias("text"))
    return rows.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, T.strip_c_comments(F.col("text"))).otherwise(T.strip_php_comments(F.col("text"))).alias("text"))


@query("SELECT 'd' || doc_id AS path, CAST(generate_subscripts(a, 1) AS INTEGER) AS line_no, unnest(a) AS code FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)")
def lines_of_documents(spark, sf):
    """Every line of every text with its number, from 1."""
    files = read_table(spark, sf, "documents").select(F.lit("p").alias("project_id"), F.concat(F.lit("d"), F.col("doc_id")).alias("path"), F.lit("text").alias("language"), "text")
    return corpus.code_lines(files).select("path", F.col("line_no").cast("int").alias("line_no"), "code")


# Paths.

ENDS = ["py", "PY", "php", "phps", "c", "hpp", "h++", "html", "txt"]
FOLDERS = ["src", "env", "vendor", "static", "tmp"]
PATHS_SQL = "SELECT c_custkey, '/w/p/' || CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(FOLDERS)) + " END || '/f' || c_custkey || '.' || CASE c_custkey % 9 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(ENDS)) + " END AS path FROM customer"


def paths(spark, sf) -> DataFrame:
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs)).cast("int"))
    return read_table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("/w/p/"), pick(FOLDERS), F.lit("/f"), F.col("c_custkey"), F.lit("."), pick(ENDS)).alias("path"))


@query(f"SELECT c_custkey, CASE WHEN e = 'py' THEN 'python' WHEN e = 'php' THEN 'php' WHEN e = 'c' THEN 'c' WHEN e IN ('hpp', 'h++') THEN 'cpp' ELSE '' END AS language FROM (SELECT c_custkey, lower(regexp_extract(path, '[.]([^.]*)$', 1)) AS e FROM ({PATHS_SQL}))")
def languages_of_paths(spark, sf):
    """Languages by suffix, in any case."""
    return paths(spark, sf).select("c_custkey", T.suffix_language(F.col("path")).alias("language"))


@query(f"""SELECT c_custkey, concat_ws(',', CASE WHEN lower(e) = 'py' AND f NOT IN ('env', 'vendor') THEN 'python' END, CASE WHEN lower(e) = 'php' AND f NOT IN ('env', 'vendor') THEN 'php' END) AS taken
FROM (SELECT c_custkey, regexp_extract(path, '[.]([^.]*)$', 1) AS e, split_part(path, '/', 4) AS f FROM ({PATHS_SQL}))""")
def collected_of_paths(spark, sf):
    """Which of the pipeline's collectors takes which path, by suffix and folder."""
    relative = F.substring_index("path", "/", -2)
    names = F.array_compact(F.array(*(F.when(corpus.in_scope(relative, lang, "pipeline"), F.lit(lang)) for lang in ("python", "php"))))
    return paths(spark, sf).select("c_custkey", F.array_join(names, ",").alias("taken"))


@query(f"""WITH p AS ({PATHS_SQL}) SELECT asked, CASE WHEN m = 3 THEN NULL ELSE path END AS path FROM (SELECT path, c_custkey % 4 AS m, CASE c_custkey % 4 WHEN 0 THEN path WHEN 1 THEN substr(path, 6) WHEN 2 THEN upper(regexp_extract(path, '[^/]*$')) ELSE 'none' || c_custkey END AS asked FROM p)""")
def resolved_of_paths(spark, sf):
    """The file that a path means: itself, below the root, or the first that ends with it, in any case."""
    p = paths(spark, sf)
    m = F.col("c_custkey") % 4
    asked = F.when(m == 0, F.col("path")).when(m == 1, F.expr("substr(path, 6)")).when(m == 2, F.upper(F.substring_index("path", "/", -1))).otherwise(F.concat(F.lit("none"), F.col("c_custkey")))
    return report.resolved_paths(p.select(asked.alias("asked")), p.select("path"), "/w/p")


# Records of vulnerabilities, one a part.

PRODUCTS = [("wordpress", "PHP"), ("scikit_learn", "Python"), ("php", "PHP"), ("unknown_thing", None)]
TOPICS = [("SQL injection in {x}", "CWE-89", "sql_injection"), ("path traversal in {x}", "CWE-22", "path_traversal"), ("stored xss in {x}", None, "xss")]
PARTS_SQL = f"""SELECT 'CVE-' || p_partkey AS cve_id, p_name, p_partkey % 3 AS topic, p_partkey % 4 AS product, p_retailprice / 200 AS score FROM part"""
RECORDS_SQL = f"""SELECT cve_id, CASE product {' '.join(f"WHEN {k} THEN '{e}'" for k, (_, e) in enumerate(PRODUCTS) if e)} END AS ecosystem, CASE topic {' '.join(f"WHEN {k} THEN '{c}'" for k, (_, _, c) in enumerate(TOPICS))} END AS category, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' ELSE 'medium' END AS severity, score AS cvss_score, CASE product {' '.join(f"WHEN {k} THEN '{p}'" for k, (p, _) in enumerate(PRODUCTS))} END AS product, 'v' AS vendor FROM ({PARTS_SQL}) WHERE product < 3 AND score >= 4"""


def part_records(spark, sf) -> DataFrame:
    part = read_table(spark, sf, "part")
    pick = lambda xs: F.get(F.array(*(F.lit(x) for x in xs)), (F.col("p_partkey") % len(xs)).cast("int"))
    text = F.replace(pick([d for d, _, _ in TOPICS]), F.lit("{x}"), F.col("p_name"))
    cwe = pick([c or "NVD-CWE-noinfo" for _, c, _ in TOPICS])
    answer = F.struct(
        F.concat(F.lit("CVE-"), F.col("p_partkey")).alias("id"),
        F.array(F.struct(F.lit("de").alias("lang"), F.lit("x").alias("value")), F.struct(F.lit("en").alias("lang"), text.alias("value"))).alias("descriptions"),
        F.struct(F.array(F.struct(F.struct((F.col("p_retailprice") / 200).alias("baseScore")).alias("cvssData"))).alias("cvssMetricV2")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(F.lit("en").alias("lang"), cwe.alias("value"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.array(F.struct(F.array(F.struct(F.concat(F.lit("cpe:2.3:a:v:"), pick([p for p, _ in PRODUCTS]), F.lit(":1")).alias("criteria"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
    )
    return cve.answered(part.select(F.to_json(F.struct(F.array(F.struct(answer.alias("cve"))).alias("vulnerabilities"))).alias("text")), "text")


@query(RECORDS_SQL)
def records_of_parts(spark, sf):
    """Relevant records, flat, out of saved answers: ecosystem by product, category by weakness or words, severity by score."""
    return cve.parsed(part_records(spark, sf)).select("cve_id", "ecosystem", "category", "severity", "cvss_score", "product", "vendor")


@query(f"SELECT ecosystem, category, count(*) AS n FROM ({RECORDS_SQL}) GROUP BY ecosystem, category")
def record_counts_of_parts(spark, sf):
    return cve.counts(cve.parsed(part_records(spark, sf)))


@query(f"SELECT CASE ecosystem WHEN 'PHP' THEN 'php' ELSE 'python' END AS language, replace(cve_id, '-', '_') AS rule_id, category, severity AS default_severity FROM ({RECORDS_SQL})")
def record_rules_of_parts(spark, sf):
    """Records with a search pattern as rows of the rule table."""
    return cve.as_rules(cve.parsed(part_records(spark, sf))).select("language", "rule_id", "category", "default_severity")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS vendor, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'p' || s_suppkey END AS product FROM supplier")
def cpe_of_suppliers(spark, sf):
    """Vendor and product of a CPE; one of another form has none."""
    s = read_table(spark, sf, "supplier").withColumn("cpe", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("cpe:/a:"), F.col("s_name"))).otherwise(F.concat(F.lit("cpe:2.3:a:"), F.col("s_name"), F.lit(":p"), F.col("s_suppkey"), F.lit(":1"))))
    return s.select("s_suppkey", T.cpe_part(F.col("cpe"), 3).alias("vendor"), T.cpe_part(F.col("cpe"), 4).alias("product"))


# Answers and stored rows.

ANSWERS = ["props", "concat('Sure:\n```json\n', replace(props, '}', ', }'), '\n```')", "concat('so ', replace(props, '}', ''))", "concat('no value here ', event_id)"]


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def repaired_of_events(spark, sf):
    """The JSON value in an answer: plain, fenced with a comma too many, cut off, or none."""
    rows = read_table(spark, sf, "events").select("event_id", F.expr("CASE event_id % 4 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(ANSWERS)) + " END").alias("text"))
    return rows.select("event_id", F.from_json(T.json_repair(F.col("text")), "k long")["k"].alias("k"))


@query("SELECT event_id, 'no value here ' || event_id AS text FROM events WHERE event_id % 4 = 3")
def failures_of_events(spark, sf):
    """Answers that hold no JSON even after repair."""
    rows = read_table(spark, sf, "events").select("event_id", F.expr("CASE event_id % 4 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(ANSWERS)) + " END").alias("text"))
    return report.parse_failures(rows, "event_id").select("event_id", "text")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '' ELSE '[\"' || role || '\"]' END AS json FROM conversations")
def fields_of_conversations(spark, sf):
    """Lists as JSON; an empty one is empty text."""
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("role")).alias("x"))
    return rows.select("conv_id", "turn", T.json_field(F.col("x")).alias("json"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'medium' END AS severity, 'pending' AS status, CASE WHEN event_id % 3 = 0 THEN user_id % 50 ELSE user_id END AS line_number FROM events")
def stored_events(spark, sf):
    """What storing a finding fills in: severity, stage and status, and the sink's line where a line is missing."""
    e = read_table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("finding_id"), F.when(F.col("event_type") == "error", "critical").alias("severity"), F.lit(None).cast("string").alias("pipeline_stage"), F.lit(None).cast("string").alias("status"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("int")).alias("line_number"), (F.col("user_id") % 50).cast("int").alias("sink_line"))
    out = report.stored(rows)
    return out.select(F.col("finding_id").alias("event_id"), "severity", "status", F.col("line_number").cast("long").alias("line_number"))


@query("SELECT event_id, event_type = 'error' AS analysed FROM events")
def analysed_events(spark, sf):
    """Rows with and without a verdict, told apart by null tests."""
    rows = read_table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit("x")).alias("verdict"))
    one, other = report.analysed(rows, "verdict"), report.analysed(rows, "verdict", False)
    return one.select("event_id", F.lit(True).alias("analysed")).unionByName(other.select("event_id", F.lit(False).alias("analysed")))


@query("SELECT conv_id, turn, CAST(generate_subscripts(w, 1) AS BIGINT) - 1 AS pos, unnest(w) AS src, 'r' || turn AS dst FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def parts_of_conversations(spark, sf):
    """Edges from every part of a concatenation to its result, in the parts' order."""
    rows = read_table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), F.split("text", " ", -1).alias("parts"), F.concat(F.lit("r"), F.col("turn")).alias("result"))
    return graph.part_edges(rows, "conv_id").select("conv_id", F.col("seq").alias("turn"), F.col("pos").cast("long").alias("pos"), "src", "dst")


@query("SELECT l_orderkey AS project_id, 'p' || l_partkey AS src, 's' || l_suppkey || '::x' || l_linenumber AS dst FROM lineitem")
def arguments_of_lines(spark, sf):
    """Edges from an argument to its function's parameter."""
    n = lambda p, c: F.concat(F.lit(p), F.col(c))
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("seq"), n("p", "l_partkey").alias("argument"), n("s", "l_suppkey").alias("function"), n("x", "l_linenumber").alias("parameter"))
    return graph.argument_edges(rows).select("project_id", "src", "dst")


# Sessions and function sources of PHP, and what lies between source and sink.


@query(C.each_row_sql("SELECT c_custkey AS c FROM customer", ["c"], [("bad.php", "4", "xss", "$_SESSION", "c % 2 = 0")], ["file_path", "line_number", "vuln_type", "source_func"], {"line_number": "INTEGER"}).replace("v.file_path", "r.c || '/' || v.file_path", 1))
def sessions_of_customers(spark, sf):
    """Session values are shown harmlessly until a user's value has been written to the session."""
    rows = rows_of(spark, sf, "customer", c="c_custkey", value="CASE WHEN c_custkey % 2 = 0 THEN '$u' ELSE '''me''' END")
    files = C.made_files(rows, F.concat(F.lit("p"), F.col("c")), [("{c}/bad.php", "php", "<?php\n$u = $_POST['u'];\n$_SESSION['n'] = {value};\necho $_SESSION['n'];\n")])
    return taint.flows_of_files(files).select("file_path", "line_number", "vuln_type", "source_func").distinct()


@query(C.each_row_sql("SELECT c_custkey AS c, 'g' || c_custkey || '.php' AS p FROM customer", ["p"], [("{p}@:getenv()@2:5", "getenv()", "true")], ["variable", "name"]))
def function_sources_of_customers(spark, sf):
    """Calls whose value the environment, a file or a database gives."""
    files = C.made_files(rows_of(spark, sf, "customer", c="c_custkey"), F.lit("p"), [("g{c}.php", "php", "<?php\n$h = getenv('X{c}');\n$k = strlen('X{c}');\n")])
    return facts.extract(files).where("kind = 'function_source'").select(F.col("var").alias("variable"), "name")


@query("SELECT c_custkey AS finding_id, CASE WHEN c_custkey % 2 = 0 THEN 'call_graph' ELSE 'taint' END AS stage FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0")
def sourceless_of_customers(spark, sf):
    """Findings of the call graph go where their file shows no user input."""
    rows = rows_of(spark, sf, "customer", c="c_custkey", code="CASE WHEN c_custkey % 3 = 0 THEN '$_GET[''a'']' ELSE 'f()' END")
    files = C.made_files(rows, F.lit("p"), [("i{c}.php", "php", "<?php\n{code};\n")])
    found = read_table(spark, sf, "customer").select(F.lit("p").alias("project_id"), F.concat(F.lit("i"), F.col("c_custkey"), F.lit(".php")).alias("file_path"), F.lit("php").alias("language"), F.lit("xss").alias("vuln_type"), F.when(F.col("c_custkey") % 2 == 0, "call_graph").otherwise("taint").alias("pipeline_stage"), F.col("c_custkey").alias("finding_id"))
    return enrich.without_sourceless(found, files).select("finding_id", F.col("pipeline_stage").alias("stage"))


# Paths within a project, files that findings name, differences of sets, protections on the way.

ASKED = ["'/w/p/src/f' || c_custkey || '.py'", "'/w/p/../x/f' || c_custkey || '.py'", "'/w/p/src/./a/../f' || c_custkey || '.py'", "''", "'/w/pp/f' || c_custkey || '.py'"]
ASKED_SQL = "CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(ASKED)) + " END"


@query("SELECT c_custkey, CASE WHEN m IN (0, 2) AND c_custkey % 3 > 0 THEN '/w/p/src/f' || c_custkey || '.py' END AS path, CASE WHEN m = 3 THEN 'empty' WHEN m IN (1, 4) THEN 'outside' WHEN c_custkey % 3 = 0 THEN 'missing' END AS fault FROM (SELECT c_custkey, c_custkey % 5 AS m FROM customer)")
def contained_of_customers(spark, sf):
    """Which paths may be read: those of files below the project's root, once their parts are resolved."""
    rows = read_table(spark, sf, "customer").select("c_custkey", F.expr(ASKED_SQL).alias("asked"))
    files = read_table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("/w/p/src/f"), F.col("c_custkey"), F.lit(".py")).alias("path"))
    return report.contained(rows, files, "/w/p").select("c_custkey", "path", "fault")


@query("""SELECT o AS finding_id, path FROM (SELECT o, '/w/p/v' || CAST(pick AS VARCHAR) || '.py' AS path FROM (""" + C.LINES_SQL + """) WHERE pick % 3 > 0 GROUP BY o, pick) QUALIFY row_number() OVER (PARTITION BY o ORDER BY path) <= 3""")
def referenced_of_orders(spark, sf):
    """The first three files that a finding's flow names and that are there, but for its own."""
    lines = C.order_lines(spark, sf)
    flow = lines.groupBy("o").agg(F.array_join(F.collect_list(F.concat(F.lit("v"), F.col("pick"), F.lit(".py"))), " → ").alias("data_flow"))
    found = flow.select(F.col("o").alias("finding_id"), F.concat(F.lit("/w/p/o"), F.col("o"), F.lit(".py")).alias("file_path"), F.lit(None).cast("string").alias("source_file"), F.concat("data_flow", F.lit(" → o"), F.col("o"), F.lit(".py")).alias("data_flow"), F.lit("gone.c").alias("sink_code"))
    files = lines.where("pick % 3 > 0").select(F.concat(F.lit("/w/p/v"), F.col("pick"), F.lit(".py")).alias("path")).union(found.select("file_path"))
    return report.referenced_files(found, files, "/w/p")


@query("SELECT doc_id, CAST(least(doc_id % 15, 10) AS INTEGER) AS n FROM documents")
def headers_of_documents(spark, sf):
    """The first ten entries of a map."""
    entries = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.col("doc_id") % 15 + 1), lambda i: F.struct(F.concat(F.lit("h"), i).alias("k"), F.col("source").alias("v"))))
    all_but_last = F.map_filter(entries, lambda k, v: k != F.concat(F.lit("h"), F.col("doc_id") % 15 + 1))
    return read_table(spark, sf, "documents").select("doc_id", F.size(report.first_entries(all_but_last)).alias("n"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def difference_of_customers(spark, sf):
    """Set difference by key."""
    gone = read_table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.without(read_table(spark, sf, "customer"), gone, ["c_custkey"])


GRADES = "['low', 'medium', 'high', 'critical']"


@query(f"""WITH f AS (SELECT l_orderkey * 1000 + l_linenumber AS finding_id, min(l_suppkey) % 50 AS file_id, min(l_partkey) % 300 AS line FROM lineitem GROUP BY l_orderkey, l_linenumber),
s AS (SELECT DISTINCT o_custkey % 50 AS file_id, o_orderkey % 300 AS line FROM orders WHERE o_orderstatus = 'P'),
h AS (SELECT f.*, f.line % 5 AS g, EXISTS (SELECT 1 FROM s WHERE s.file_id = f.file_id AND (abs(s.line - f.line) <= 1 OR abs(s.line - f.line - 4) <= 1 OR abs(s.line - f.line - 9) <= 1)) AS hit FROM f)
SELECT finding_id, CASE WHEN g = 4 THEN 'info' WHEN hit THEN {GRADES}[greatest(g - 1, 1)] ELSE {GRADES}[g + 1] END AS severity FROM h""")
def safe_spots_of_lines(spark, sf):
    """A safe spot at a finding's lines or beside them takes two grades, to low at the lowest."""
    f = read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_suppkey") % 50).alias("file"), (F.min("l_partkey") % 300).alias("line"))
    grade = F.get(F.array(*(F.lit(x) for x in ("low", "medium", "high", "critical", "info"))), (F.col("line") % 5).cast("int"))
    rows = f.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("finding_id"), F.col("file").cast("string").alias("file_path"), F.col("line").alias("line_number"), (F.col("line") + 4).alias("source_line"), (F.col("line") + 9).alias("sink_line"), grade.alias("severity"))
    spots = read_table(spark, sf, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 50).cast("string").alias("file_path"), (F.col("o_orderkey") % 300).alias("line_number"))
    return detectors.safe_spots(rows, spots).select("finding_id", "severity")


MIDDLES = ["$b = htmlspecialchars($a);", "$b = base64_encode($a);", "$b = $a;", "$b = substr($a, 0, 9);"]


@query("SELECT c_custkey, CASE m WHEN 0 THEN 'strong' ELSE 'none' END AS protection_level, m > 0 AS is_exploitable, CASE m WHEN 0 THEN 'unlikely' ELSE 'easy' END AS exploit_difficulty, CASE m WHEN 1 THEN 'encode' WHEN 3 THEN 'truncate' ELSE 'none' END AS transforms FROM (SELECT c_custkey, c_custkey % 4 AS m FROM customer)")
def enriched_of_customers(spark, sf):
    """Protections and changes between a finding's source and its sink, and what follows from them."""
    rows = rows_of(spark, sf, "customer", c="c_custkey", mid="CASE c_custkey % 4 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MIDDLES)) + " END")
    files = C.made_files(rows, F.lit("p"), [("e{c}.php", "php", "<?php\n$a = $_GET['x'];\n{mid}\necho $b;\n")])
    found = read_table(spark, sf, "customer").select(F.lit("p").alias("project_id"), F.concat(F.lit("e"), F.col("c_custkey"), F.lit(".php")).alias("file_path"), "c_custkey", F.lit(2).alias("source_line"), F.lit(4).alias("sink_line"), F.lit(4).alias("line_number"), F.lit("xss").alias("vuln_type"), F.array(F.lit("$a"), F.lit("$b")).alias("path"))
    out = enrich.enrich(found, files)
    return out.select("c_custkey", "protection_level", "is_exploitable", "exploit_difficulty", F.array_join("transforms", ",").alias("transforms"))
