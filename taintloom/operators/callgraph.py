"""Call graph across functions and files: a caller that calls a source and reaches a sink."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintloom.functions import call_tables as C
from taintloom.functions.catalog import severity

from .graph import cut
from .relational import first_wins
from .syntax import spans

DEPTH = 4  # fixed value: calls below the caller
#: Nodes of small projects that share a call of the search.
CALL_NODES = 20_000
FUNCTIONS = "project_id string, path string, language string, seq int, name string, line int, source_labels array<string>, sink_labels array<string>, vuln_type string, called array<string>"


def _python(text: str) -> Iterator[tuple[str, int, str, list[str]]]:
    """(name, line, body, calls by plain names) of every function, in order; of a text that can't be parsed, none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = text.split("\n")
    for node in sorted((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), key=lambda n: (n.lineno, n.col_offset)):
        first = node.body[0]
        body = "\n".join([lines[first.lineno - 1][first.col_offset :], *lines[first.lineno : node.end_lineno]])
        yield node.name, node.lineno, body, sorted({c.func.id for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)})


def _braced(text: str, php: bool) -> Iterator[tuple[str, int, str, list[str]]]:
    for s in spans(text, php):
        if s.kind == "function":
            yield s.name, s.line, text[s.start : s.end], s.calls


def labels(name: str, body: str, family: str) -> tuple[list[str], list[str], str | None]:
    """(source labels, sink labels, type) of a function by its name and body; the first sink that has a type gives it."""
    low = name.lower()
    by_name = [(w, v) for w, v in C.SINK_WORDS[family] if w in low][:1]
    by_body = [(label, v) for p, label, v in C.SINK_BODY[family] if re.search(p, body, re.IGNORECASE)]
    sources = [f"name:{w}" for w in C.SOURCE_WORDS[family] if w in low][:1]
    sources += [label for p, label in C.SOURCE_BODY[family] if re.search(p, body, re.IGNORECASE)]
    types = [v for _, v in by_name + by_body]
    return sources, [*(f"name:{w}" for w, _ in by_name), *(label for label, _ in by_body)], types[0] if types else None


def functions_of(text: str, language: str) -> list[tuple]:
    """Functions of a file in one pass: syntax gives bodies and calls, tables give labels."""
    family = "c" if language == "cpp" else language
    found = _python(text) if language == "python" else _braced(text, language == "php")
    return [(n, name, line, *labels(name, body, family), calls) for n, (name, line, body, calls) in enumerate(found)]


def functions(files: DataFrame) -> DataFrame:
    """(FUNCTIONS) of every file; bodies stay in the worker."""

    def run(frames):
        for frame in frames:
            rows = [(p, f, lang, *x) for p, f, lang, t in frame[["project_id", "path", "language", "text"]].itertuples(index=False) if t for x in functions_of(t, lang)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FUNCTIONS.split(", ")])

    code = files.where(F.col("language").isin("python", "php", "c", "cpp"))
    return code.select("project_id", "path", "language", "text").mapInPandas(run, FUNCTIONS)


def nodes(found: DataFrame) -> DataFrame:
    """One node per name and project: file and line of the first definition, labels and calls of all of them."""
    at = F.struct("path", "seq")
    return found.groupBy("project_id", "name").agg(
        F.min_by("path", at).alias("path"),
        F.min_by("language", at).alias("language"),
        F.min_by("line", at).alias("line"),
        F.array_distinct(F.flatten(F.collect_list("source_labels"))).alias("source_labels"),
        F.array_distinct(F.flatten(F.collect_list("sink_labels"))).alias("sink_labels"),
        F.min_by("vuln_type", F.when(F.col("vuln_type").isNotNull(), at)).alias("vuln_type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("called")))).alias("called"),
    )


def paths(graph: DataFrame, depth: int = DEPTH, task_nodes: int = 1_000_000) -> DataFrame:
    """(project_id, source, sink, path): for each source and each function that calls it, the sinks that this function
    reaches in at most `depth` calls; sinks end a path, and neither the source nor the caller is met again. Of several
    paths of one length the first in order counts.

    A project is one task's work as long as it has at most `task_nodes` functions, and projects are dealt over shared calls
    of some CALL_NODES functions, since a call costs milliseconds however few it gets; if any project has more, all are
    searched in bounded rounds of joins, with the same rows.
    """
    largest, every = graph.groupBy("project_id").count().agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) > task_nodes:
        return _paths_by_rounds(graph, depth)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        projects: dict[str, list[tuple]] = {}
        for project, *node in frame[["project_id", "name", "called", "is_source", "is_sink"]].itertuples(index=False):
            projects.setdefault(project, []).append(node)
        rows = [(project, *r) for project, nodes in projects.items() for r in _paths_of(nodes, depth)]
        return pd.DataFrame(rows, columns=["project_id", "source", "sink", "path"])

    call = F.pmod(F.xxhash64("project_id"), F.lit(-(-(every or 1) // CALL_NODES)))
    nodes = graph.select(call.alias("call"), "project_id", "name", "called", (F.size("source_labels") > 0).alias("is_source"), (F.size("sink_labels") > 0).alias("is_sink"))
    return nodes.groupBy("call").applyInPandas(search, "project_id string, source string, sink string, path array<string>")


def _paths_of(nodes: list[tuple], depth: int) -> Iterator[tuple[str, str, list[str]]]:
    """Paths of a project's nodes: (name, called, is_source, is_sink)."""
    known = {n for n, _, _, _ in nodes}
    calls = {n: sorted({c for c in called if c in known and c != n}) for n, called, _, _ in nodes}
    sinks = {n for n, _, _, is_sink in nodes if is_sink}
    callers: dict[str, list[str]] = {}
    for n in sorted(calls):
        for c in calls[n]:
            callers.setdefault(c, []).append(n)
    for source in sorted(n for n, _, is_source, _ in nodes if is_source):
        for caller in callers.get(source, ()):
            seen, level = {source, caller}, [[source, caller]]
            for _ in range(depth):
                further = []
                for path in level:
                    for n in calls[path[-1]]:
                        if n not in seen:
                            seen.add(n)
                            if n in sinks:
                                yield source, n, [*path, n]
                            else:
                                further.append([*path, n])
                level = further


def _paths_by_rounds(graph: DataFrame, depth: int) -> DataFrame:
    """The frontier meets the call edges, nodes seen by (source, caller) go, the first arrival by path wins. A round is
    checkpointed, so none is computed twice."""
    edges = graph.select("project_id", F.col("name").alias("caller"), F.explode("called").alias("callee")).join(graph.select("project_id", F.col("name").alias("callee"), (F.size("sink_labels") > 0).alias("is_sink")), ["project_id", "callee"]).where("caller <> callee")
    starts = graph.where(F.size("source_labels") > 0).select("project_id", F.col("name").alias("source"))
    key = ["project_id", "source", "caller"]
    edges = cut(edges)
    first = starts.join(edges.select("project_id", F.col("callee").alias("source"), "caller"), ["project_id", "source"])
    frontier = cut(first).withColumn("node", F.col("caller")).withColumn("path", F.array("source", "caller")).withColumn("is_sink", F.lit(False))
    seen = frontier.select(*key, "node").unionByName(frontier.select(*key, F.col("source").alias("node")))
    steps = edges.select("project_id", F.col("caller").alias("node"), F.col("callee").alias("next"), F.col("is_sink").alias("next_sink"))
    out = None
    for _ in range(depth):
        moved = frontier.where(~F.col("is_sink")).join(steps, ["project_id", "node"]).select(*key, F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.col("next_sink").alias("is_sink"))
        frontier = cut(first_wins(moved.join(seen, [*key, "node"], "left_anti"), [*key, "node"], ["path"]))
        seen = seen.unionByName(frontier.select(*key, "node"))
        sinks = frontier.where("is_sink").select("project_id", "source", F.col("node").alias("sink"), "path")
        out = sinks if out is None else out.unionByName(sinks)
    return out


def findings(graph: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Call-graph findings: one per (type, file and line of the sink), the first by path. Nodes are made once: the search and
    both of its ends read them."""
    graph = cut(graph)
    sink = graph.select("project_id", F.col("name").alias("sink"), F.col("path").alias("file_path"), F.col("line").alias("line_number"), "language", F.coalesce("vuln_type", F.lit("command_execution")).alias("vuln_type"), "sink_labels")
    source = graph.select("project_id", F.col("name").alias("source"), F.col("path").alias("source_file"), F.col("line").alias("source_line"), "source_labels")
    found = paths(graph, depth).join(sink, ["project_id", "sink"]).join(source, ["project_id", "source"])
    one = first_wins(found, ["project_id", "vuln_type", "file_path", "line_number"], ["path"])
    label = lambda c, kind: F.concat(F.lit("Function: "), F.col(c), F.lit(f" ({kind}: "), F.array_join(f"{c}_labels", ", "), F.lit(")"))
    return one.select("project_id", "file_path", "line_number", "source_file", "source_line", F.col("line_number").alias("sink_line"), "vuln_type", severity("call_graph", F.col("vuln_type")).alias("severity"), "language", label("source", "Source").alias("source_code"), label("sink", "Sink").alias("sink_code"), F.array_join("path", " → ").alias("data_flow"), "path", F.lit("call_graph").alias("pipeline_stage"))
