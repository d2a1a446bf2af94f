"""Taint flows: facts become edges and marks, marks and edges become findings.

Two modes. `declarative` (default): sanitizers hold along the whole path, every sink of a variable counts. `compat`: the
facts are folded in order, the way an incremental scanner does it: the last mark of a variable wins and taint is handed
on when an edge is added.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import facts as code
from . import flat, ordered
from .graph import MAX_PATH, bfs_paths, breadth_first, cleaned, cut, near_table, path_to, stored
from .relational import first_wins

#: `seq` sorts findings of a project: by their source, the length of the path, and the sink.
FLOWS = "project_id string, file_path string, line_number int, source_file string, source_line int, sink_line int, vuln_type string, language string, source_func string, sink_func string, source_code string, sink_code string, data_flow string, path array<string>, seq string"

_FLOWS_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}[c.split()[1]]) for c in (FLOWS + ", linked boolean").split(", ")])

#: Kinds of facts that a file's own flows are made of, those that may link it with others, and all that flows are made of.
OWN_KINDS = ["source", "sink", "sanitize", "edge"]
LINKING = {"function", "module_attr"}
KINDS = [*OWN_KINDS, "function", "module_attr", "call", "var"]
#: Findings of one batch that leaves a worker.
BATCH = 20_000


def resolved_calls(facts: DataFrame) -> DataFrame:
    """Calls with the project function that each means: one of its own file, else the one that its full name (after
    imports) is. Equi-joins on names; the first definition of a name counts."""
    f = facts.where("kind = 'function'").select("project_id", "path", "module", "name", "params", "kwonly", "prefix", "seq")
    f = first_wins(f, ["project_id", "path", "name"], ["seq"])
    target = F.struct("params", "kwonly", "prefix").alias("target")
    local = f.select("project_id", "path", "name", target.alias("local"))
    other = first_wins(f.withColumn("code", F.concat_ws(".", "module", "name")), ["project_id", "code"], ["path", "seq"]).select("project_id", "code", target.alias("other"))
    calls = facts.where("kind = 'call'").select("project_id", "path", "seq", "name", "code", "var", "args", "params", "kwonly", "line")
    found = calls.join(local, ["project_id", "path", "name"], "left").join(other, ["project_id", "code"], "left")
    return found.withColumn("target", F.coalesce("local", "other")).where("target is not null").drop("local", "other")


def link_edges(facts: DataFrame) -> DataFrame:
    """Edges (project_id, path, seq, src, dst, line) that files' facts make together: within scopes, arguments to
    parameters, results from returns, and attributes of imported modules to the variables of those modules."""
    own = facts.where("kind = 'edge'").select("project_id", "path", "seq", F.col("var").alias("src"), "dst", "line")
    calls = resolved_calls(facts)
    shift = F.when(F.get("target.params", F.lit(0)).isin("self", "cls"), 1).otherwise(0)
    args = calls.select("project_id", "path", "seq", "line", "target", shift.alias("shift"), F.posexplode("args").alias("pos", "vars"))
    args = args.withColumn("param", F.get("target.params", F.col("pos") + F.col("shift"))).where("param is not null")
    into = args.select("project_id", "path", "seq", F.explode("vars").alias("src"), F.concat("target.prefix", "param").alias("dst"), "line")
    named = calls.select("project_id", "path", "seq", "line", "target", F.explode(F.arrays_zip("params", "kwonly")).alias("kw"))
    named = named.where(F.array_contains("target.kwonly", F.col("kw.params")))
    by_name = named.select("project_id", "path", "seq", F.explode(F.split("kw.kwonly", ",")).alias("src"), F.concat("target.prefix", "kw.params").alias("dst"), "line").where("src <> ''")
    back = calls.select("project_id", "path", "seq", F.concat("target.prefix", F.lit("#ret")).alias("src"), F.col("var").alias("dst"), "line")
    vars_ = facts.where("kind = 'var'").select("project_id", F.concat_ws(".", "module", "name").alias("name"), F.col("var").alias("src"))
    attrs = facts.where("kind = 'module_attr'").select("project_id", "name", "path", "seq", "dst", "line").join(vars_, ["project_id", "name"])
    return own.unionByName(into).unionByName(by_name).unionByName(back).unionByName(attrs.select("project_id", "path", "seq", "src", "dst", "line"))


#: Edges of a project that a task searches by itself, and the steps that one task's sources may take.
TASK_EDGES, TASK_STEPS = 2_000_000, 20_000_000
#: Copies of a project's edges that its sources may be dealt over: with more, it is searched by levels instead, since sources
#: and edges of a project grow together and copies would grow with their product.
MOST_SHARDS = 8


def flows(facts: DataFrame, mode: str = "declarative", most: int = MAX_PATH, functions: bool = False, around_clean: bool = False, task_edges: int = TASK_EDGES, task_steps: int = TASK_STEPS) -> DataFrame:
    """Findings of every project (FLOWS): a breadth-first tree per source, the first path to each sink, of at most `most`
    nodes.

    Files of a project that no edge links with another are searched by themselves (`_units`), and small ones share a call.
    What is linked is searched as a whole: its sources are dealt over as many shards as keep sources times edges at about
    `task_steps`, each with its edges; with more than `task_edges` edges or MOST_SHARDS shards it is searched level by level
    with joins instead, with the same rows. In the mode `compat`, which folds a project's facts in order, a project of at most `task_edges` edges is one
    task; larger ones are folded by ranges (`ordered.folded`), with the same rows.

    functions: calls that give a file's or a database's content count as sources too. around_clean (declarative): if the
    first path to a sink is cleaned, the first one around the nodes that clean for its type is looked for.
    """
    if mode not in ("declarative", "compat"):
        raise ValueError(f"no such mode: {mode}")
    edges = stored(link_edges(facts).select(F.col("project_id").alias("of"), *(F.col(c) for c in ("path", "seq", "src", "dst", "line"))))
    kinds = ["source", "sink", "sanitize", *(["function_source"] if functions else [])]
    kind = F.when(F.col("kind") == "function_source", "source").otherwise(F.col("kind")).alias("kind")
    marks = stored(facts.where(F.col("kind").isin(kinds)).select("project_id", "path", "language", "seq", kind, "var", "name", "vuln_type", "types", "code", "line"))
    names = [c.split()[0] for c in FLOWS.split(", ")]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = _by_project(left)
        rows = [(k[0], *r) for k, mine in _by_project(right).items() for r in _search(of.get(k, []), mine, mode, most, around_clean)]
        return pd.DataFrame(rows, columns=names)

    # The fold of `compat` is over a project's facts in order, so a project stays whole there.
    edges, marks = (edges.withColumn("unit", F.lit("")), marks.withColumn("unit", F.lit(""))) if mode == "compat" else _units(edges, marks)
    unit = ["project_id", "unit"]
    sizes = edges.groupBy(F.col("of").alias("project_id"), "unit").agg(F.count("*").alias("edges"))
    if mode == "compat":
        plan = sizes.withColumn("shards", F.lit(1))
    else:
        found = marks.where("kind = 'source'").groupBy(*unit).agg(F.countDistinct("var").alias("sources"))
        plan = found.join(sizes, unit, "left").na.fill(0, ["edges"]).withColumn("shards", F.greatest(F.ceil(F.col("sources") * F.col("edges") / task_steps), F.lit(1)).cast("int"))
    plan = stored(plan.select(*unit, "edges", "shards").withColumn("large", (F.col("edges") > task_edges) | (F.col("shards") > MOST_SHARDS)))
    large = plan.where("large").select(*unit)
    some_large = not large.isEmpty()
    small_marks, small_edges = marks, edges
    if some_large:
        large_marks = marks.join(large, unit, "left_semi")
        large_edges = edges.withColumnRenamed("of", "project_id").join(large, unit, "left_semi")
        if mode == "compat":
            small_marks = marks.join(large, unit, "left_anti")
    plan = plan.where("not large")
    # Projects are dealt over groups of some 250,000 edges, so that very many small ones don't cost a call each.
    total = plan.agg(F.sum(F.col("edges") * F.col("shards"))).first()[0] or 0
    groups = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 250_000))
    shards = plan.select(*unit, "shards")
    spread = lambda df: df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards").withColumn("group", F.pmod(F.xxhash64("project_id", "unit", "shard"), F.lit(groups)))
    mine = F.col("kind") == "source"
    if mode == "compat":
        dealt = spread(small_marks.withColumn("shards", F.lit(1)))
    else:
        mine &= F.pmod(F.xxhash64("var"), "all_shards") == F.col("shard")
        dealt = spread(small_marks.join(shards.withColumn("all_shards", F.col("shards")), unit))
    dealt = dealt.withColumn("mine", mine).drop("all_shards")
    near = spread(small_edges.withColumnRenamed("of", "project_id").join(shards, unit))
    out = dealt.groupBy("group").cogroup(near.groupBy("group")).applyInPandas(lambda a, b: search(b, a), FLOWS)
    if not some_large:
        return out
    return out.unionByName(_large_folded(large_edges, large_marks, most) if mode == "compat" else _large_flows(large_edges, large_marks, most, around_clean))


def flows_of_files(files: DataFrame, most: int = MAX_PATH, functions: bool = False, around_clean: bool = False) -> DataFrame:
    """What `flows` finds in the facts of files (project_id, path, language, text; each path once in its project).

    Only functions and attributes of modules lead from file to file. A project that has neither is searched a file at a time
    where the files are read: its facts are never stored, shuffled or joined, and flat files are read by the forms of their
    lines. Projects that have one go by their facts, whole, since their files' modules are named by what all of them share."""
    own = [*OWN_KINDS, *(["function_source"] if functions else [])]
    wanted = frozenset(own) | LINKING

    def run(batches):
        readers = flat.readers(wanted)
        linked: set[str] = set()
        out: list[tuple] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("project_id", "path", "language", "text"))
            for project, path, language, text in zip(*columns, strict=True):
                if not text or project in linked:
                    continue
                found = readers[language].facts(path, text) if language in readers else None
                rows = code.facts_of(language, path, text, "", wanted) if found is None else None
                kinds = {r["kind"] for r in rows} if found is None else {t.same["kind"] for t, *_ in found}
                if kinds & LINKING:
                    linked.add(project)
                    out.append((project, *[None] * (len(_FLOWS_SCHEMA) - 2), True))
                elif "sink" in kinds and kinds & {"source", "function_source"}:
                    if found is None:
                        edges = [{"src": r["var"], "dst": r["dst"]} for r in rows if r["kind"] == "edge"]
                    else:
                        edges = [{"src": a, "dst": b} for a, b in flat.edges(found)]
                        rows = flat.rows([f for f in found if f[0].same["kind"] != "edge"])
                    marks = [{**r, "kind": r["kind"].removeprefix("function_"), "mine": True} for r in rows if r["kind"] != "edge"]
                    out += [(project, *r, False) for r in _search(edges, marks, "declarative", most, around_clean)]
                if len(out) >= BATCH:
                    yield _packed(out)
                    out = []
        yield _packed(out)

    read = files.where(F.col("language").isin("python", "php", "c", "cpp")).select("project_id", "path", "language", "text")
    found = stored(read.mapInArrow(run, FLOWS + ", linked boolean"))
    linked = found.where("linked").select("project_id").distinct()
    alone = found.where("not linked").drop("linked")
    if linked.isEmpty():
        return alone
    facts = cut(code.extract(read.join(linked, "project_id", "left_semi"), [*KINDS, *(["function_source"] if functions else [])]))
    return alone.join(linked, "project_id", "left_anti").unionByName(flows(facts, most=most, functions=functions, around_clean=around_clean))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FLOWS_SCHEMA), _FLOWS_SCHEMA, strict=True)], schema=_FLOWS_SCHEMA)


def _by_project(frame: pd.DataFrame) -> dict[tuple, list[dict]]:
    """{(project, unit, shard): rows in order}."""
    out: dict[tuple, list[dict]] = {}
    for r in frame.sort_values(["path", "seq"], kind="stable").to_dict("records"):
        out.setdefault((r["project_id"], r["unit"], r["shard"]), []).append(r)
    return out


def _units(edges: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and marks with `unit`, what a path can't leave: a file that no edge links with others, else "" for all that is
    linked in the project. A variable's file is what stands before its first @; one without is linked."""
    file = lambda c: F.when(F.instr(c, "@") > 0, F.substring_index(c, "@", 1)).otherwise("")
    a, b = file("src"), file("dst")
    ends = edges.where(a != b).select(F.col("of").alias("project_id"), F.explode(F.array(a, b)).alias("unit")).where("unit <> ''").distinct()
    linked = cut(ends)
    edges, marks = edges.withColumn("unit", a), marks.withColumn("unit", file("var"))
    if linked.isEmpty():
        return edges, marks
    linked = linked.withColumn("__linked", F.lit(True))
    one = F.when(F.col("__linked"), "").otherwise(F.col("unit")).alias("unit")
    joined = edges.join(linked.withColumnRenamed("project_id", "of"), ["of", "unit"], "left").select(*[c for c in edges.columns if c != "unit"], one)
    return joined, marks.join(linked, ["project_id", "unit"], "left").select(*[c for c in marks.columns if c != "unit"], one)


def _tree_edges(edges: DataFrame) -> DataFrame:
    """Edges in order. Of two ways to a node the first edge that differs decides, and both leave the node that their equal
    parts end at, so an edge's own start needn't be compared."""
    return edges.select("project_id", F.struct("path", "seq", "dst").alias("seq"), "src", "dst")


def _sinks(marks: DataFrame) -> DataFrame:
    return marks.where("kind = 'sink'").select("project_id", F.col("var").alias("node"), F.struct("path", "line", "vuln_type", "language", "name", "code", "seq").alias("t"))


def _sources(marks: DataFrame) -> DataFrame:
    return marks.select("project_id", F.col("var").alias("source"), F.struct("path", "line", "name", "code", "seq").alias("s"))


def _large_flows(edges: DataFrame, marks: DataFrame, most: int, around_clean: bool) -> DataFrame:
    """What `_search` finds, by joins: the level search of all sources, and sinks that no node of a path cleans; paths take along
    what their nodes clean for. Paths around cleaned nodes are a second level search, of the pairs of a source and a type that
    lost a path: a tree for each, which goes on from no node that cleans for its type."""
    sources = stored(_sources(first_wins(marks.where("kind = 'source'"), ["project_id", "var"], ["path", "seq"])))
    clean = marks.where("kind = 'sanitize'").select("project_id", F.col("var").alias("node"), F.explode("types").alias("type"))
    clean = stored(clean.groupBy("project_id", "node").agg(F.array_sort(F.collect_set("type")).alias("types")))
    sinks = _sinks(marks).join(clean.withColumnRenamed("types", "own"), ["project_id", "node"], "left")
    sinks = stored(sinks.withColumn("vuln_type", F.col("t.vuln_type")).withColumn("own", cleaned(F.col("own"), F.col("vuln_type"))))
    first = edges.select("project_id", F.struct("path", "seq").alias("seq"), "src", "dst")
    with near_table(first, ranked=True, types=clean) as near:
        return _level_flows(near, sources, sinks, most, around_clean)


def _level_flows(near: DataFrame, sources: DataFrame, sinks: DataFrame, most: int, around_clean: bool) -> DataFrame:
    """sinks: with `own`, are they cleaned for their type themselves?"""
    met = bfs_paths(near, sources, most).withColumnRenamed("path", "nodes").join(sinks, ["project_id", "node"])
    met = met.withColumn("lost", F.col("own") | cleaned(F.col("types"), F.col("vuln_type")))
    columns = ["project_id", "source", "nodes", "t", "vuln_type"]
    kept = met.where("not lost").select(*columns)
    if around_clean:
        lost = ["project_id", "source", "node", "vuln_type"]
        gone = stored(met.where("lost and not own").select(*lost).distinct())
        around = bfs_paths(near, gone.select("project_id", "source", "vuln_type").distinct(), most, label="vuln_type").withColumnRenamed("path", "nodes")
        more = around.join(sinks.where("not own"), ["project_id", "node", "vuln_type"]).join(gone, lost, "left_semi")
        kept = kept.unionByName(more.select(*columns))
    return _rows(kept.join(sources, ["project_id", "source"]))


def _large_folded(edges: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """What `_search` finds in the mode `compat`, by joins: labels from the fold by ranges, taint spread from what are sources
    at the end, and of the paths of the level search those whose nodes are all tainted, to the last sink of a variable."""
    labels = ordered.folded(marks, edges)
    starts = cut(ordered.last_sources(marks, edges))
    tainted = labels.where(F.col("label") == ordered.TAINT).select("project_id", "node")
    closed = labels.where("label = 'all'").select("project_id", "node")
    tainted = ordered.spread(tainted, closed, edges, starts.select("project_id", F.col("var").alias("node")))
    sources = _sources(starts)
    sinks = _sinks(first_wins(marks.where("kind = 'sink'"), ["project_id", "var"], [F.col("path").desc(), F.col("seq").desc()]))
    met = cut(bfs_paths(_tree_edges(edges), sources, most).join(sinks, ["project_id", "node"]).drop("order").withColumnRenamed("path", "nodes").withColumn("vuln_type", F.col("t.vuln_type")))
    pure = met.select("project_id", "source", "node", F.explode("nodes").alias("on")).join(tainted.withColumnRenamed("node", "on"), ["project_id", "on"], "left_anti")
    kept = met.join(pure.select("project_id", "source", "node").distinct(), ["project_id", "source", "node"], "left_anti")
    kept = kept.join(labels.withColumnRenamed("label", "vuln_type"), ["project_id", "node", "vuln_type"], "left_anti")
    return _rows(kept.join(sources, ["project_id", "source"]))


def _rows(rows: DataFrame) -> DataFrame:
    """FLOWS of rows (project_id, source, s, t, vuln_type, nodes)."""
    pad = lambda c: F.format_string("%012d", c.cast("long"))
    order = F.concat_ws("\0", "s.path", pad(F.col("s.seq")), pad(F.size("nodes")), "t.path", pad(F.col("t.seq")))
    return rows.select("project_id", F.col("t.path").alias("file_path"), F.col("t.line").alias("line_number"), F.col("s.path").alias("source_file"), F.col("s.line").alias("source_line"), F.col("t.line").alias("sink_line"), "vuln_type", F.col("t.language").alias("language"), F.col("s.name").alias("source_func"), F.col("t.name").alias("sink_func"), F.col("s.code").alias("source_code"), F.col("t.code").alias("sink_code"), F.array_join("nodes", " → ").alias("data_flow"), F.col("nodes").alias("path"), order.alias("seq"))


def _search(edges: list[dict], marks: list[dict], mode: str, most: int, around_clean: bool) -> list[tuple]:
    near: dict[str, list[str]] = {}
    for e in edges:
        near.setdefault(e["src"], []).append(e["dst"])
    sources, sinks, clean = {}, {}, {}
    for m in marks:
        if m["kind"] == "source":
            if m["mine"] and (mode == "compat" or m["var"] not in sources):
                sources[m["var"]] = m
        elif m["kind"] == "sink":
            if mode == "compat":
                sinks[m["var"]] = [m]
            else:
                sinks.setdefault(m["var"], []).append(m)
        else:
            clean.setdefault(m["var"], set()).update(m["types"])
    tainted = None
    if mode == "compat":
        tainted, clean = _fold(edges, marks, sources, near)
    out = []
    closed: dict[str, set[str]] = {}
    for start, source in list(sources.items()):
        tree = breadth_first(near, start, most)
        around: dict[str, dict[str, str | None]] = {}
        for node in [n for n in tree if n in sinks]:
            path = path_to(tree, node)
            for sink in sinks[node]:
                kind, way = sink["vuln_type"], path
                if mode == "compat":
                    ok = all(tainted.get(n) for n in path) and kind not in clean.get(node, ())
                else:
                    ok = not any(kind in clean[n] or "all" in clean[n] for n in path if n in clean)
                    if not ok and around_clean:
                        if kind not in around:
                            if kind not in closed:
                                closed[kind] = {n for n, types in clean.items() if kind in types or "all" in types}
                            blocked = closed[kind]
                            around[kind] = {} if start in blocked else breadth_first(near, start, most, blocked)
                        if ok := node in around[kind]:
                            way = path_to(around[kind], node)
                if ok:
                    seq = "\0".join([source["path"], f"{int(source['seq']):012}", f"{len(way):012}", sink["path"], f"{int(sink['seq']):012}"])
                    out.append((sink["path"], int(sink["line"]), source["path"], int(source["line"]), int(sink["line"]), kind, sink["language"], source["name"], sink["name"], source["code"], sink["code"], " → ".join(way), way, seq))
    return out


def _fold(edges: list[dict], marks: list[dict], sources: dict, near: dict) -> tuple[dict[str, bool], dict[str, set]]:
    """Flags after all facts in order, then spread from the sources; nodes cleaned of everything stop the spread."""
    tainted: dict[str, bool] = {}
    clean: dict[str, set] = {}
    steps = [(m["path"], m["seq"], 0, m["var"], "", m["kind"], m) for m in marks] + [(e["path"], e["seq"], 1, e["src"], e["dst"], "", e) for e in edges]
    for *_, x in sorted(steps, key=lambda s: s[:6]):
        if "src" in x:
            a, b = x["src"], x["dst"]
            tainted[b] = tainted.get(b, False) or tainted.setdefault(a, False)
            clean[b] = clean.get(b, set()) | clean.get(a, set())
        elif x["kind"] == "source":
            tainted[x["var"]] = True
            sources[x["var"]] = x
        elif x["kind"] == "sink":
            tainted.setdefault(x["var"], False)
        elif x["var"] in tainted:
            if "all" in x["types"]:
                tainted[x["var"]], clean[x["var"]] = False, {"all"}
                sources.pop(x["var"], None)
            else:
                clean[x["var"]] = clean.get(x["var"], set()) | set(x["types"])
    queue = deque(sources)
    while queue:
        n = queue.popleft()
        for d in near.get(n, ()):
            if not tainted.get(d) and "all" not in clean.get(d, ()):
                tainted[d] = True
                queue.append(d)
    return tainted, clean
