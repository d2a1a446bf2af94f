"""Template checks: unsafe output filters, switched-off escaping and output inside scripts, for the variables that views pass."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taintloom.functions import patterns as P

from .graph import cut

KEY = ["project_id", "path"]
MODES = ("lenient", "strict", "unlinked")


def call_name(node: ast.AST) -> str:
    f = getattr(node, "func", None)
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""


def carries(expression: ast.AST | None, tainted: set[str], text: str) -> bool:
    """May an expression's value hold user input? Names in `tainted` do, calls of sanitizers don't, other calls do if they are
    written with a source in them or get such a value; what has no rule does if a source is written in it."""
    stack = [expression] if expression is not None else []
    while stack:
        e = stack.pop()
        if isinstance(e, ast.Name):
            if e.id in tainted:
                return True
        elif isinstance(e, ast.Call):
            if call_name(e) in P.TEMPLATE_SANITIZERS:
                continue
            if names_source(e, text):
                return True
            stack += [*e.args, *(k.value for k in e.keywords)]
        elif isinstance(e, (ast.Attribute, ast.Subscript, ast.FormattedValue)):
            stack.append(e.value)
        elif isinstance(e, ast.BinOp):
            stack += [e.left, e.right]
        elif isinstance(e, (ast.BoolOp, ast.Dict)):
            stack += [v for v in e.values if v is not None]
        elif isinstance(e, ast.JoinedStr):
            stack += [v for v in e.values if isinstance(v, ast.FormattedValue)]
        elif isinstance(e, ast.IfExp):
            stack += [e.body, e.orelse]
        elif isinstance(e, (ast.List, ast.Tuple, ast.Set)):
            stack += e.elts
        elif not isinstance(e, (ast.Lambda, ast.Constant)) and names_source(e, text):
            return True
    return False


def names_source(e: ast.AST, text: str) -> bool:
    written = ast.get_source_segment(text, e) or ""
    return any(m in written for m in P.SOURCE_MARKERS)


def _own(function: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a function in source order, without those of functions in it."""
    stack = list(reversed(list(ast.iter_child_nodes(function))))
    while stack:
        n = stack.pop()
        yield n
        if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            stack += reversed(list(ast.iter_child_nodes(n)))


def passed_variables(text: str) -> list[tuple[str, list[str]]]:
    """(template, variables with user input that it gets) of every call that renders a template, in source order."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for scope in [tree, *(n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))]:
        tainted = set() if scope is tree else {a.arg for a in scope.args.args} - {"self", "cls"}
        nodes = list(_own(scope))
        for n in nodes if scope is not tree else []:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
            if targets and carries(n.value, tainted, text):
                tainted |= {t.id for t in targets if isinstance(t, ast.Name)}
        for n in nodes:
            if isinstance(n, ast.Call) and call_name(n) in P.RENDER_CALLS and n.args:
                name = n.args[1] if call_name(n) == "render" and len(n.args) > 1 and not isinstance(n.args[0], ast.Constant) else n.args[0]
                if isinstance(name, ast.Constant) and isinstance(name.value, str) and name.value:
                    given = [(k.arg, k.value) for k in n.keywords if k.arg]
                    if len(n.args) >= 3 and isinstance(n.args[2], ast.Dict):
                        given += [(k.value, v) for k, v in zip(n.args[2].keys, n.args[2].values, strict=True) if isinstance(k, ast.Constant) and isinstance(k.value, str)]
                    out.append((name.value, [k for k, v in given if carries(v, tainted, text)]))
    return out


def view_variables(files: DataFrame) -> DataFrame:
    """(project_id, name, variables): the templates that a project's views render, each with the variables with user input
    that any of them passes."""

    def run(frames):
        for f in frames:
            rows = [(p, name, names) for p, t in f[["project_id", "text"]].itertuples(index=False) if t for name, names in passed_variables(t)]
            yield pd.DataFrame(rows, columns=["project_id", "name", "variables"])

    views = files.where((F.col("language") == "python") & F.col("text").rlike(r"\brender")).select("project_id", "text")
    each = views.mapInPandas(run, "project_id string, name string, variables array<string>")
    return each.groupBy("project_id", "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("variables")))).alias("variables"))


def linked(template: Column, name: Column) -> Column:
    """Is a template the one that a view names? Its path ends with the name, or the name with its file name."""
    bare = F.ltrim(F.replace(name, F.lit("\\"), F.lit("/")), F.lit("/"))
    path = F.replace(template, F.lit("\\"), F.lit("/"))
    return path.endswith(bare) | bare.endswith(F.substring_index(path, "/", -1))


def linked_pairs(pages: DataFrame, names: DataFrame, key: list[str], path: str = "path", name: str = "name") -> DataFrame:
    """(key, path, name): templates and the names that mean them (`linked`), each pair once, by equi-joins on path ends.

    Two texts one of which ends with the other have the same characters at the end: the shorter one's last few. So a name's
    end of each length that the file names of its project have, and a path's end of each length that names have, are
    keys; what meets is held against the rule itself. Lengths are few at any number of paths, so a path gives a bounded
    number of keys; a short end that very many paths share costs what it truly joins, dealt over tasks by blocks (`_met`). A
    pair meets by its name's whole path, else by its file name, once each, so that pairs need no distinct and aren't shuffled.
    Joins are merges: a size guessed from a table of few bytes, of which texts are made, would have a whole side sent through
    the driver.
    """
    paths = pages.select(*key, path).distinct().withColumn("__path", F.replace(path, F.lit("\\"), F.lit("/")))
    bare = names.select(*key, name).where(F.col(name).isNotNull()).distinct().withColumn("__bare", F.ltrim(F.replace(name, F.lit("\\"), F.lit("/")), F.lit("/")))
    last = paths.withColumn("__last", F.substring_index("__path", "/", -1))

    def ends(text: str, lengths: list[int]) -> Column:
        return F.explode(F.array_compact(F.array(*(F.when(F.length(text) >= n, F.right(F.col(text), F.lit(n))) for n in lengths))) if lengths else F.array().cast("array<string>"))

    def lengths(df: DataFrame, c: str) -> list[int]:
        return sorted(r[0] for r in df.select(F.length(c)).where(F.col(c).isNotNull()).distinct().collect())

    on = [*key, "__end"]
    by_name = _met(paths.withColumn("__end", ends("__path", lengths(bare, "__bare"))).select(*on, path), bare.select(*key, F.col("__bare").alias("__end"), name), on)
    by_file = _met(last.select(*key, F.col("__last").alias("__end"), path, "__path"), bare.withColumn("__end", ends("__bare", lengths(last, "__last"))).select(*on, name, "__bare"), on)
    return by_name.select(*key, path, name).unionByName(by_file.where(~F.col("__path").endswith(F.col("__bare"))).select(*key, path, name))


#: Rows of each side that a task pairs at a time.
BLOCK = 500


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The merge join of both sides. Where a key has more pairs than a block's, its rows are dealt into blocks on both sides
    and each block of one side is copied for each of the other, so that no task pairs all of a key; copies are fewer than
    pairs by a block's size. Parts are of a stated number: few bytes are many pairs, so they aren't merged by bytes."""
    count = lambda df, c: df.groupBy(*on).agg(F.count("*").alias(c))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    large = cut(count(left, "__l").join(count(right, "__r").hint("merge"), on).where(F.col("__l") * F.col("__r") > BLOCK * BLOCK).select(*on, blocks("__l"), blocks("__r")))
    if large.isEmpty():
        return left.join(right.hint("merge"), on)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(1))
        rows = df.join(large.hint("merge"), on, "left").withColumns({own: F.pmod(F.xxhash64(*df.columns), n(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), n(other) - 1))})
        return rows.repartition(parts, *on, "__l", "__r")

    return dealt(left, "__l", "__r").join(dealt(right, "__r", "__l").hint("merge"), [*on, "__l", "__r"])


def template_variables(files: DataFrame) -> DataFrame:
    """(project_id, path, variables) of the templates that some view passes user input to: the union over views. Views and
    templates meet by the ends of their paths, so a project's pages don't all meet all its views."""
    pages = files.where(F.col("language") == "template").select(*KEY)
    views = view_variables(files).where(F.size("variables") > 0)
    met = linked_pairs(pages, views, ["project_id"]).join(views.hint("merge"), ["project_id", "name"])
    return met.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("variables")))).alias("variables"))


def script_lines(lines: DataFrame) -> DataFrame:
    """Adds `in_script`: an opening mark counts for its own line, a closing one from the next; what comes last holds."""
    code = F.col("code")
    opens, closes = code.rlike("(?i)<script[^>]*>"), code.contains("</script>")
    before = Window.partitionBy(*KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(closes, False).when(opens, True), ignorenulls=True).over(before)
    return lines.withColumn("in_script", opens | F.coalesce(state, F.lit(False)))


def escape_blocks(lines: DataFrame) -> DataFrame:
    """Adds `block`, the line that switched escaping off, on the lines behind it up to the next such line or the end mark."""
    code = F.col("code")
    off, end = code.rlike(P.ESCAPE_OFF), code.rlike(P.ESCAPE_END)
    upto = Window.partitionBy(*KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("__start", F.last(F.when(off, F.col("line_no")), ignorenulls=True).over(upto))
    inside = Window.partitionBy(*KEY, "__start").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    closed = F.max(end & ~off).over(inside)
    return rows.withColumn("block", F.when(~off & ~closed, F.col("__start"))).drop("__start")


def findings(files: DataFrame, mode: str = "lenient") -> DataFrame:
    """XSS findings of templates, one a line: a variable with user input that is marked safe, that stands in a script, or in
    a block with escaping off (at the line that begins it). What views pass tells which variables those are. mode, for
    templates that no view passes any to: `lenient` takes all their variables as user input, `strict` none; `unlinked`
    asks no view and takes all variables of all templates."""
    from taintloom.sources.corpus import code_lines

    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    lines = escape_blocks(script_lines(code_lines(files.where(F.col("language") == "template"))))
    if mode == "unlinked":
        lines = lines.withColumn("variables", F.lit(None).cast("array<string>"))
    else:
        lines = lines.join(template_variables(files).hint("merge"), KEY, "inner" if mode == "strict" else "left")
    code = F.col("code")
    user = lambda e: F.col("variables").isNull() | F.arrays_overlap("variables", F.array(F.regexp_extract(F.trim(e), r"^[A-Za-z_]\w*", 0)))
    shown = F.exists(F.regexp_extract_all("code", F.lit(P.TEMPLATE_VARIABLE), F.lit(1)), user)
    marked = F.exists(F.regexp_extract_all("code", F.lit(P.SAFE_FILTER), F.lit(1)), lambda e: ~e.rlike(r"^\s*(?:['\"]|$)") & user(e))
    at = F.when(marked | F.col("in_script") & shown, F.col("line_no"))
    hit = lines.withColumn("at", F.explode(F.array_compact(F.array(at, F.when(shown, F.col("block"))))))
    told = hit.select(*KEY, F.col("at").alias("line_no")).distinct()
    hit = told.join(lines.select(*KEY, "line_no", F.trim(code).alias("sink_code")).hint("merge"), [*KEY, "line_no"])
    return hit.select("project_id", F.col("path").alias("file_path"), F.col("line_no").alias("line_number"), F.col("line_no").alias("sink_line"), F.lit("xss").alias("vuln_type"), F.lit("medium").alias("severity"), F.lit("template").alias("language"), "sink_code", F.lit(0.7).alias("confidence"), F.lit("ast").alias("pipeline_stage"))
