"""Work is dealt over tasks by its size, and what is not asked for stays in the workers."""

import random

import pytest
from pyspark.sql import functions as F

from taintloom.functions import patterns as P
from taintloom.operators import callgraph, code_facts, detectors, facts, graph, literals, relational, taint, templates
from taintloom.plans import code_forms as C
from taintloom.plans import code_queries, scale_queries


def test_rows_of_one_task_are_dealt(spark):
    rows = spark.range(9_000).coalesce(1).selectExpr("cast(id as string) as c")
    files = C.made_files(rows, rows["c"], [("a{c}.py", "python", "x = {c}\n")])
    assert files.rdd.getNumPartitions() == 5
    assert files.distinct().count() == 9_000


def test_only_asked_kinds_leave_a_worker(spark):
    text = "import os\nx = input()\ndef f(a):\n    return a\nos.system(int(x))\n"
    files = spark.createDataFrame([("p", "a.py", "python", text), ("p", "b.py", "python", "def f(:")], "project_id string, path string, language string, text string")
    every = {r for r in facts.extract(files).select("kind", "seq", "var", "dst", "name").collect()}
    for kinds in (["edge"], ["source", "sink"], ["error"], []):
        got = {r for r in facts.extract(files, kinds).select("kind", "seq", "var", "dst", "name").collect()}
        assert got == {r for r in every if r["kind"] in kinds}


def test_unlinked_files_are_searched_by_themselves(spark):
    """A project of files that nothing links costs the sum of its files, not sources times edges; what is linked stays whole."""
    alone = [("p", f"a{k}.py", "python", "import os\nx = input()\nos.system(x)\n") for k in range(40)]
    linked = [("p", "l.py", "python", "import os\ndef run(c):\n    os.system(c)\n"), ("p", "u.py", "python", "from l import run\nrun(input())\n")]
    extracted = facts.extract(spark.createDataFrame(alone + linked, "project_id string, path string, language string, text string"))
    edges, marks = taint._units(taint.link_edges(extracted).withColumnRenamed("project_id", "of"), extracted.where("kind in ('source', 'sink')"))
    assert {r["unit"] for r in edges.select("unit").distinct().collect()} == {"", *(f"a{k}.py" for k in range(40))}
    assert {r["unit"] for r in marks.where("path in ('l.py', 'u.py')").select("unit").collect()} == {""}
    columns = ["file_path", "source_file", "vuln_type", "data_flow", "seq"]
    found = sorted(taint.flows(extracted).select(*columns).collect())
    assert len({(r["source_file"], r["file_path"]) for r in found}) == 42  # l.py has its parameter and u.py's input
    for task_edges, task_steps in ((0, 20_000_000), (2_000_000, 1)):  # by levels; by levels where copies would be many
        assert sorted(taint.flows(extracted, task_edges=task_edges, task_steps=task_steps).select(*columns).collect()) == found


def test_near_table_keeps_the_first_of_parallel_edges(spark):
    edges = spark.createDataFrame([("p", k, "a", "b") for k in range(9, 0, -1)] + [("p", 20, "b", "c")], "project_id string, seq long, src string, dst string")
    sources = spark.createDataFrame([("p", "a")], "project_id string, source string")
    with graph.near_table(edges) as near:
        assert near.count() == 2
        got = graph.bfs_paths(near, sources)
    assert sorted(map(tuple, got.select("node", "order").collect())) == [("a", []), ("b", [1]), ("c", [1, 20])]


def test_template_joins_send_no_side_through_the_driver(spark):
    """A table of few bytes gives many long texts, so sizes guessed from it mustn't choose broadcasts."""
    rows = spark.range(50).coalesce(1).selectExpr("cast(id as string) as c")
    view = "def v(q):\n    return render_template('page{c}.html', a=q)\n"
    files = C.made_files(rows, F.lit("p"), [("v{c}.py", "python", view), ("t/page{c}.html", "template", "{{ a|safe }}\n")])
    for mode in ("strict", "lenient"):
        found = templates.findings(files, mode)
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
        assert found.count() == 50


def test_order_lines_keep_a_stated_number_of_parts(spark, sf):
    """Few bytes of a line are much work as code, so parts aren't merged by bytes."""
    files = C.code_files(spark, sf, "php")
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_small_projects_share_calls_of_the_call_graph(spark):
    """A call of the search costs milliseconds, so it isn't one for each project; rows are the same however they are dealt."""
    rows = [(f"p{k}", "main", ["get"], False, False) for k in range(50)] + [(f"p{k}", "get", ["run"], True, False) for k in range(50)] + [(f"p{k}", "run", [], False, True) for k in range(50)]
    rows += [(f"p{k}", "both", ["get", "run"], False, False) for k in range(0, 50, 2)]
    graph_ = spark.createDataFrame(rows, "project_id string, name string, called array<string>, s boolean, t boolean")
    label = lambda c: F.when(F.col(c), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    found = callgraph.paths(graph_.select("project_id", "name", "called", label("s").alias("source_labels"), label("t").alias("sink_labels")))
    assert "FlatMapGroupsInPandas [call" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted((f"p{k}", "get", "run", ["get", "both", "run"]) for k in range(0, 50, 2))


def test_what_leads_to_no_asked_kind_is_not_looked_at(spark, monkeypatch):
    text = "import os\nx = input()\ndef f(a):\n    y = a.b[0]\n    return os.path.basename(y)\nos.system(int(x))\nfor z in f(x): eval(z)\n"
    php = "<?php\n$a = $_GET['x'];\nfunction f() { echo $a; }\n$b = intval($a);\nsystem('ls ' . $a);\n"
    for language, code in (("python", text), ("php", php), ("c", "int f() { system(getenv(\"x\")); }")):
        every = facts.facts_of(language, "a", code)
        assert every
        bare = lambda rows: [{k: v for k, v in r.items() if k != "seq"} for r in rows]
        for kind in {r["kind"] for r in every} | {"error"}:
            got = facts.facts_of(language, "a", code, wanted=frozenset([kind]))
            assert bare(got) == bare(r for r in every if r["kind"] == kind)
    monkeypatch.setattr(code_facts, "read", None)  # spans need tokens alone
    assert [r["name"] for r in facts.facts_of("php", "a", php, wanted=frozenset(["span"]))] == ["f"]
    rows = spark.createDataFrame([("p", "a.py", "python", text)], "project_id string, path string, language string, text string")
    columns = ["kind", "var", "dst", "name", "line"]
    assert facts.extract(rows, ["source"], ordered=False).select(columns).collect() == facts.extract(rows, ["source"]).select(columns).collect()


def test_spans_are_counted_without_pairs(spark, monkeypatch):
    """Counts are those of the join's pairs, for keys dealt out by blocks too; a row is shuffled once, not once a size class."""
    points = spark.range(400).selectExpr("id % 3 as k", "cast(id * 37 % 101 as long) as at").union(spark.sql("select 1L, null union all select null, 5L"))
    spans = spark.range(90).selectExpr("id", "id % 4 as k", "id * 13 % 97 as a", "id * 13 % 97 + id * id % 61 - 3 as b").union(spark.sql("select 90L, 1L, null, 7L union all select 91L, null, 1L, 9L union all select 92L, 2L, -9L, 900L"))
    want = sorted(map(tuple, relational.within_spans(points, spans, ["k"], "at", "a", "b").groupBy("id").count().collect()))
    assert len(want) > 40
    for most in (1_000_000, 0, 120):
        monkeypatch.setattr(relational, "KEY_ROWS", most)
        got = relational.counted_within_spans(points, spans, ["k"], "at", "a", "b", ["id"])
        assert sorted(map(tuple, got.collect())) == want


def test_absent_characters_are_spelled_out(spark):
    """A table of word pairs meets the texts that hold both words, not all that hold the longer one."""
    assert literals.spelled("abc,? def") == ["abc def", "abc, def"]
    assert literals.spelled("Ab\\.c?d") == ["ab.cd", "ab.d"]
    for pattern in ("ab?", "(abc)?d", "abc+", "abc|def", "a[bc]def", "abc.d", "abc{2}", "abc\\d", "a?b?c?d?e?f?xyz", "äbc?d", "^abc"):
        assert literals.spelled(pattern) is None
    rules = spark.createDataFrame([("r", "abc,? def"), ("s", "abc+")], "rule_id string, pattern string")
    assert {(r["pattern"], r["literal"]) for r in literals.literal_index(rules).collect()} == {("abc,? def", "abc def"), ("abc,? def", "abc, def"), ("abc+", "abc")}


def test_patterns_of_lines_are_worked_out_once(spark):
    """No condition repeats the patterns that tags are made of, and the rows are those of the patterns alone."""
    codes = ["DEBUG = True", "$x = 1;", "PASSWORD = 'hunter22'", "SeLeCt 1", "extract($_POST);", "", None, "eval (x)", "z.EXTRACT(a)"]
    lines = spark.createDataFrame([("p", f"a{k}.py", "python", k, c) for k, c in enumerate(codes)], "project_id string, path string, language string, line_no int, code string")
    found = detectors.tagged(lines)
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "RLIKE" in x]
    got = {r["line_no"]: r["tags"] for r in found.collect()}
    plain = lines.select("line_no", *(F.coalesce(F.col("code").rlike(p), F.lit(False)).alias(t) for t, p in P.TAGS.items())).collect()
    want = {r["line_no"]: [t for t in P.TAGS if r[t]] + (["credential"] if r["line_no"] == 2 else []) for r in plain}
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items() if v}


def test_sessions_are_searched_with_all_kinds_of_flows(spark, tmp_path):
    """Sources, edges and sinks of sessions leave the workers; no customers give no rows."""
    for name, keys in (("some", [2, 3, 10]), ("none", [])):
        spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/{name}/customer.parquet")
    got = code_queries.sessions_of_customers(spark, f"{tmp_path}/some")
    assert sorted(map(tuple, got.collect())) == [(f"{k}/bad.php", 4, "xss", "$_SESSION") for k in (10, 2)]
    assert code_queries.sessions_of_customers(spark, f"{tmp_path}/none").count() == 0


ALONE = {
    "c.py": "import html, os, shlex\nx0 = input()\nx1 = html.escape(x0)\nos.system(x1)\nx2 = shlex.quote(x1)\nos.system(x2)\n",
    "d.py": "import os, sys\nx1 = sys.argv[1]\nif x1:\n    os.system(x1)\nos.system(input())\n",
    "e.php": "<?php\n$a = $_GET['x'];\n$b = intval($a);\necho $a;\nsystem($b);\n$c = getenv('x');\nsystem($c);\n",
    "f.php": "<?php\n$u = $_POST['u'];\n$_SESSION['n'] = $u;\necho $_SESSION['n'];\n",
    "g.c": "int main(int argc, char **argv) { char *x = getenv(\"a\"); system(x); }",
    "h.py": "def f(:\n",
    "i.py": "",
    "j.py": "import os\nv0000001 = input()\nv0000002 = 'rm ' + v0000001\nv0000003 = int(v0000001)\nw000001 = v0000002 + v0000003\nos.system(w000001)\n",
}
LINKED = {
    "functions": {"l.py": "import os\ndef run(c):\n    os.system(c)\n", "u.py": "from l import run\nrun(input())\n"},
    "attributes": {"conf.py": "import sys\nuser = sys.argv[1]\n", "use.py": "import os, conf\nx = conf.user\nos.system(x)\n"},
}


@pytest.mark.parametrize("options", [{}, {"functions": True}, {"around_clean": True}, {"most": 3}])
def test_files_searched_where_they_are_read_give_the_flows_of_their_facts(spark, options):
    projects = {"alone": ALONE, **LINKED, "both": {**ALONE, **LINKED["functions"]}, "empty": {"h.py": "def f(:\n"}}
    rows = [(p, path, path.split(".")[1].replace("py", "python"), text) for p, held in projects.items() for path, text in held.items()] + [("alone", "n.py", "python", None), ("alone", "t.html", "template", "{{ a }}")]
    files = spark.createDataFrame(rows, "project_id string, path string, language string, text string").repartition(3)
    columns = [c.split()[0] for c in taint.FLOWS.split(", ") if c != "seq string"]
    want = sorted(map(repr, taint.flows(facts.extract(files), **options).select(*columns).collect()))
    found = taint.flows_of_files(files, **options)
    assert found.schema == taint.flows(facts.extract(files), **options).schema
    got = found.collect()
    assert sorted(repr(r) for r in found.select(*columns).collect()) == want
    assert {r["project_id"] for r in got} >= {"alone", "functions", "both"}
    order = lambda rows: [(r["project_id"], r["file_path"], r["line_number"], r["vuln_type"], r["data_flow"]) for r in sorted(rows, key=lambda r: (r["project_id"], r["seq"]))]
    assert order(got) == order(taint.flows(facts.extract(files), **options).collect())


def test_facts_of_chains_never_leave_a_worker(spark, sf, monkeypatch):
    """Files that nothing links are searched in the task that reads them, each form of their lines read once, and no facts
    are stored; before, facts of 9 million files were."""
    monkeypatch.setattr(facts, "extract", None)
    assert code_queries.code_chains(spark, sf).count() > 0
    assert code_queries.sessions_of_customers(spark, sf).count() > 0


def test_pairs_of_a_short_end_are_dealt_and_not_shuffled(spark, monkeypatch):
    """An end that all paths of a project share makes pairs of all of them: dealt over tasks by blocks, each pair made once, so
    that no distinct shuffles them."""
    monkeypatch.setattr(templates, "BLOCK", 10)
    pages = spark.range(80).selectExpr("if(id < 70, 'p', 'q') as project_id", "concat('h/', id % 75, if(id % 9 = 0, '.x', '/')) as path")
    names = spark.range(90).selectExpr("if(id < 80, 'p', 'q') as project_id", "concat('/', if(id % 4 = 0, string(id % 60), ''), if(id % 7 = 0, '.x', '/')) as name")
    rule = pages.distinct().join(names.distinct(), "project_id").where(templates.linked(F.col("path"), F.col("name")))
    found = templates.linked_pairs(pages, names, ["project_id"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rule.select("project_id", "path", "name").collect()))
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < sum(sizes) / 2


def test_what_was_shuffled_for_stored_rows_is_not_kept(spark):
    """Rounds of a level search don't pile up shuffle files, and the session's setting stays as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    rows = spark.range(1_000).selectExpr("'p' as project_id", "id as seq", "concat('n', id % 90) as src", "concat('n', id * 7 % 91) as dst")
    before, set_ = kept(), spark.conf.get(name, "false")
    got = graph.stored(rows.groupBy("src").count())
    with graph.near_table(rows) as near:
        assert near.count() > 90
    assert got.count() == 90 and spark.conf.get(name, "false") == set_
    assert kept() <= before + 40  # those of the two counts; a level's would be parts times parts


def test_ranks_of_edges_order_paths_as_their_seqs_do(spark):
    """Paths of a ranked table are those of the edges themselves, parallel ones and hubs included, and take along what all
    nodes but the last are cleaned for; with a label none goes on from what is closed to it."""
    rnd = random.Random(5)
    rows = [("p", ("f", rnd.randrange(60)), f"n{rnd.choice([0, rnd.randrange(30)])}", f"n{rnd.randrange(30)}") for _ in range(160)]
    edges = spark.createDataFrame(rows, "project_id string, seq struct<path string, seq long>, src string, dst string")
    held = {f"n{k}": (["all"], ["x"], ["y", "x"])[k % 3] for k in range(0, 30, 4)}
    types = spark.createDataFrame([("p", n, x) for n, x in held.items()], "project_id string, node string, types array<string>")
    sources = spark.createDataFrame([("p", f"n{k}") for k in range(12)], "project_id string, source string")
    full = edges.withColumn("seq", F.struct("seq.path", "seq.seq", "dst"))
    want = sorted((r["source"], r["node"], r["path"]) for r in graph.bfs_paths(full, sources, 5).collect())
    near = {}
    for *_, s, d in sorted(rows, key=lambda r: (r[1], r[3])):
        near.setdefault(s, []).append(d)
    with graph.near_table(edges, ranked=True, types=types) as table:
        got = graph.bfs_paths(table, sources, 5).collect()
        assert sorted((r["source"], r["node"], r["path"]) for r in got) == want
        for r in got:
            assert set(r["types"]) == {x for n in r["path"][:-1] for x in held.get(n, ())}
        for kind in ("x", "y"):
            closed = {n for n, x in held.items() if kind in x or "all" in x}
            trees = {(s, n): graph.path_to(tree, n) for s in {f"n{k}" for k in range(12)} - closed for tree in [graph.breadth_first(near, s, 5, closed)] for n in tree}
            found = graph.bfs_paths(table, sources.withColumn("kind", F.lit(kind)), 5, label="kind").collect()
            assert {(r["source"], r["node"]): r["path"] for r in found if r["node"] not in closed} == trees


def test_levels_are_tables_by_columns(spark, sf, monkeypatch):
    """No level is a checkpoint of whole rows, and no nodes of paths are exploded and joined again to see what cleans them."""
    graph.cut(spark.range(0))
    monkeypatch.setattr(graph, "cut", None)
    found = scale_queries.flow_layers_by_levels(spark, sf)
    assert "Generate explode(nodes" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0
