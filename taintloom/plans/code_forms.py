"""Projects of code made of the tables' rows: a file for each order, a statement for each of its lines.

A statement is one of its language's forms, picked by the line's part and supplier, with identifiers of these: {v} and {w}
have a fixed width, so that columns of expressions behind them are known. What facts each form gives is stated beside it by
hand; SQL makes the expected rows of them, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taintloom.sources.tables import read_table

SUFFIX = {"python": "py", "php": "php", "c": "c"}
#: The lines before the statements, and behind them.
HEADS = {"python": ["from flask import request", "import html, os, requests, shlex, subprocess, sys"], "php": ["<?php"], "c": ["void f() {"]}
TAILS = {"python": [], "php": [], "c": ["}"]}


def edge(src: str, dst: str = "{v}", name: str = "assign") -> tuple:
    return ("edge", "{p}@:" + src, "{p}@:" + dst, name, None, None)


def source(var: str, name: str) -> tuple:
    return ("source", "{p}@:" + var, None, name, None, None)


def sink(name: str, vuln: str, var: str = "{v}") -> tuple:
    return ("sink", "{p}@:" + var, None, name, vuln, None)


def clean(name: str, types: str = "all", var: str = "{v}") -> tuple:
    return ("sanitize", "{p}@:" + var, None, name, None, types)


CALL, ATTR, ITEM = "call@{n}:11", "attr@{n}:11", "item@{n}:11"
#: (statement, facts): `call@n:c` and the like are expressions without a name, at line n and column c.
FORMS: dict[str, list[tuple[str, list[tuple]]]] = {
    "python": [
        ("{v} = request.args.get('{w}')", [source(CALL, "flask.request.args.get"), edge("request", ATTR, "attribute"), edge(ATTR), edge(CALL)]),
        ("{v} = input()", [source(CALL, "builtins.input"), edge(CALL)]),
        ("{v} = sys.argv[1]", [source(ITEM, "sys.argv"), source(ATTR, "sys.argv"), edge("sys", ATTR, "attribute"), edge(ATTR, ITEM, "attribute"), edge(ITEM)]),
        ("{v} = request.form['{w}']", [source(ITEM, "flask.request.form.__getitem__"), edge("request", ATTR, "attribute"), edge(ATTR, ITEM, "attribute"), edge(ITEM)]),
        ("{v} = os.getenv('{w}')", [source(CALL, "os.getenv"), edge(CALL)]),
        ("os.system({v})", [sink("os.system", "command_execution")]),
        ("subprocess.run({v}, shell=True)", [sink("subprocess.run", "command_execution")]),
        ("subprocess.run(['ls', {v}])", []),
        ("requests.get({v})", [sink("requests.get", "ssrf")]),
        ("eval({v})", [sink("builtins.eval", "command_execution")]),
        ("cursor.execute({v})", [sink("db.execute", "sql_injection")]),
        ("open({v})", [sink("builtins.open", "path_traversal")]),
        ("os.system('{w}')", []),
        ("{v}.objects.raw({w})", [sink("django.db.models.query.raw", "sql_injection", "{w}")]),
        ("{v}.execute({w})", []),
        ("{v} = {w}", [edge("{w}")]),
        ("{v} = {w} + 'x'", [edge("{w}")]),
        ("{v} = [{w}, 1]", [edge("{w}")]),
        ("for {v} in {w}: pass", [edge("{w}", name="loop")]),
        ("{v} += {w}", [edge("{w}")]),
        ("{v} = ({w} if 1 else 2)", [edge("{w}")]),
        ("{v} = int({w})", [clean("builtins.int"), edge("{w}")]),
        ("{v} = html.escape({w})", [clean("html.escape", "xss"), edge("{w}"), edge("html")]),
        ("{v} = shlex.quote({w})", [clean("shlex.quote", "command_execution"), edge("{w}"), edge("shlex")]),
        ("{v} = os.path.basename({w})", [clean("os.path.basename", "path_traversal,arbitrary_file_read"), edge("{w}"), edge("os", ATTR, "attribute"), edge(ATTR)]),
        ("{v} = str({w})", [edge("{w}"), edge(CALL)]),
        ("{v} = 5", []),
        ("# os.system({v})", []),
    ],
    "php": [
        ("${v} = $_GET['{w}'];", [source("$_GET@{n}:12", "$_GET"), edge("$_GET@{n}:12", "${v}")]),
        ("${v} = $_POST['{w}'] . 'x';", [source("$_POST@{n}:12", "$_POST"), edge("$_POST@{n}:12", "${v}")]),
        ("${v} = $_COOKIE['{w}'];", [source("$_COOKIE@{n}:12", "$_COOKIE"), edge("$_COOKIE@{n}:12", "${v}")]),
        ("${v} = $_SERVER['DOCUMENT_ROOT'];", []),
        ("system(${v});", [sink("system", "command_execution", "${v}")]),
        ("mysqli_query($c, ${v});", [sink("mysqli_query", "sql_injection", "${v}")]),
        ("unserialize(${v});", [sink("unserialize", "deserialization", "${v}")]),
        ("echo ${v};", [sink("echo", "xss", "${v}")]),
        ("echo htmlspecialchars(${v});", []),
        ("$db->query(${v});", []),
        ("eval('x' . ${v});", [sink("eval", "command_execution", "${v}")]),
        ("system('{w}');", []),
        ("# system(${v});", []),
        ("${v} = ${w};", [edge("${w}", "${v}")]),
        ("${v} .= ${w};", [edge("${w}", "${v}")]),
        ("${v} = 'a' . ${w};", [edge("${w}", "${v}")]),
        ("${v} = intval(${w});", [clean("intval", var="${v}"), edge("${w}", "${v}")]),
        ("${v} = htmlspecialchars(${w});", [clean("htmlspecialchars", "xss", "${v}"), edge("${w}", "${v}")]),
        ("${v} = escapeshellarg(${w});", [clean("escapeshellarg", "command_execution", "${v}"), edge("${w}", "${v}")]),
        ("${v} = trim(${w});", [edge("${w}", "${v}")]),
        ("${v}['k'] = ${w};", [edge("${w}", "${v}")]),
    ],
    "c": [
        ('{v} = getenv("{w}");', [source("{v}", "getenv")]),
        ("fgets({v}, 9, stdin);", [source("{v}", "fgets"), sink("fgets", "arbitrary_file_read", "stdin")]),
        ('scanf("%s", {v});', [source("{v}", "scanf")]),
        ("system({v});", [sink("system", "command_execution")]),
        ('popen({v}, "r");', [sink("popen", "command_execution")]),
        ('fopen({v}, "r");', [sink("fopen", "path_traversal")]),
        ('system("{w}");', []),
        ("char *{v} = {w};", [edge("{w}")]),
        ("{v} = {w} + 1;", [edge("{w}")]),
        ("{v} = atoi({w});", [clean("atoi")]),
        ("// system({v});", []),
        ("int {v} = 5;", []),
    ],
}

#: (o, k, v, w, pick): the lines of orders, numbered from 1; a table may repeat an order's line number.
LINES_SQL = """SELECT l_orderkey AS o, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS k, 'v' || lpad(CAST(min(l_partkey) AS VARCHAR), 7, '0') AS v, 'w' || lpad(CAST(min(l_suppkey) AS VARCHAR), 6, '0') AS w, min(l_partkey) + min(l_suppkey) AS pick FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def by_order(rows: DataFrame, order: str) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), order)


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(o, n, k, v, w, pick): n is the line's number of the table, k its place among its order's."""
    # Dealt by orders once, in a stated number of parts: aggregate, window and files all keep them, and the few bytes of a
    # line don't have parts merged that are much work once they are code.
    rows = by_order(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    name = lambda prefix, c, n: F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), n, "0"))
    return rows.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), number.alias("k"), name("v", "part", 7).alias("v"), name("w", "supp", 6).alias("w"), (F.col("part") + F.col("supp")).alias("pick"))


def filled(template, **values):
    """A column with {name}s of a text replaced."""
    for name, c in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), c)
    return template


def as_files(lines: DataFrame, project, path, language: str, head: list[str] = (), tail: list[str] = (), by: str = "k") -> DataFrame:
    """(project_id, path, language, text) of lines (o, `by`, code): those of an o are a file's, by `by`. Orders have few lines.
    A window over sorted lines gives each order's in turn: an aggregate would sort all of them, as code, twice."""
    each = Window.partitionBy("o").orderBy(by)
    body = F.collect_list("code").over(each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    texts = lines.select("o", body.alias("__lines"), F.row_number().over(each).alias("__at")).where("__at = 1")
    whole = F.concat(F.array(*map(F.lit, head)).cast("array<string>"), F.col("__lines"), F.array(*map(F.lit, tail)).cast("array<string>"))
    return texts.select(project.alias("project_id"), path.alias("path"), F.lit(language).alias("language"), F.array_join(whole, "\n").alias("text"))


def code_files(spark: SparkSession, sf: str, language: str) -> DataFrame:
    """One file an order, its statements those of the language's forms."""
    lines = order_lines(spark, sf)
    forms = F.array(*(F.lit(s) for s, _ in FORMS[language]))
    code = filled(F.get(forms, (F.col("pick") % len(FORMS[language])).cast("int")), v=F.col("v"), w=F.col("w"))
    path = F.concat(F.lit("o"), F.col("o"), F.lit("." + SUFFIX[language]))
    # By the table's numbers: lines are numbered no sooner, and the window that gathers them is the only one.
    return as_files(lines.withColumn("code", code), F.concat(F.lit("p"), F.col("o") % 97), path, language, HEADS[language], TAILS[language], by="n")


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def facts_sql(language: str, kinds: list[str], columns: str) -> str:
    """The stated facts of every line, of some kinds, as SQL over lineitem; columns: of path, kind, line, variable, target,
    name, vuln_type, types."""
    rows = [(form, *f) for form, (_, found) in enumerate(FORMS[language]) for f in found if f[0] in kinds]
    values = ", ".join("(" + ", ".join([str(r[0]), *map(text, r[1:])]) + ")" for r in rows)
    put = lambda c: f"replace(replace(replace(replace({c}, '{{p}}', path), '{{v}}', v), '{{w}}', w), '{{n}}', CAST(line AS VARCHAR))"
    return f"""SELECT {columns} FROM (SELECT path, kind, line, {put("var")} AS variable, {put("dst")} AS target, name, vuln_type, types
FROM (SELECT 'o' || o || '.{SUFFIX[language]}' AS path, k + {len(HEADS[language])} AS line, v, w, pick FROM ({LINES_SQL})) l
JOIN (VALUES {values}) f(form, kind, var, dst, name, vuln_type, types) ON f.form = l.pick % {len(FORMS[language])})"""


#: Rows whose files are one task's work: a table of short rows is one file or row group, so one task, however many they are.
TASK_ROWS = 2_000


def dealt(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt over tasks by their number, before anything is made of them; no text is shuffled."""
    return rows.repartition(min(max(-(-rows.count() // task_rows), 1), 20_000), *rows.columns)


def made_files(rows: DataFrame, project, files: list[tuple[str, str, str]]) -> DataFrame:
    """Files (path, language, text) for each row, with the row's columns (strings) put in for {their names}."""
    rows = dealt(rows)
    put = {c: F.col(c) for c in rows.columns}
    each = F.array(*(F.struct(filled(F.lit(p), **put).alias("path"), F.lit(lang).alias("language"), filled(F.lit(x), **put).alias("text")) for p, lang, x in files))
    return rows.select(project.alias("project_id"), F.explode(each).alias("f")).select("project_id", "f.*")


def each_row_sql(rows_sql: str, put: list[str], values: list[tuple], columns: list[str], kinds: dict[str, str] | None = None) -> str:
    """What is stated for each row as SQL: VALUES with {names} of `put` filled in, for every row of `rows_sql`. A last value
    of each is a condition on the row. kinds: types of columns that aren't text."""
    kinds = kinds or {}
    lit = ", ".join("(" + ", ".join([*(text(str(x) if x is not None else None) for x in v[:-1]), str(k)]) + ")" for k, v in enumerate(values))

    def filled_sql(c: str) -> str:
        out = f"v.{c}"
        for p in put:
            out = f"replace({out}, '{{{p}}}', CAST(r.{p} AS VARCHAR))"
        return f"CAST({out} AS {kinds[c]}) AS {c}" if c in kinds else f"{out} AS {c}"

    held = " OR ".join(f"(v.k = {k} AND ({v[-1]}))" for k, v in enumerate(values))
    return f"SELECT {', '.join(map(filled_sql, columns))} FROM ({rows_sql}) r JOIN (VALUES {lit}) v({', '.join(columns)}, k) ON {held}"
