"""Graph operators against an in-memory search on random graphs."""

from collections import deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from taintloom.operators import graph


def in_memory(edges, source, most=20):
    near = {}
    for s, d in edges:
        near.setdefault(s, []).append(d)
    seen, queue, out = {source}, deque([[source]]), {}
    while queue:
        path = queue.popleft()
        out[path[-1]] = path
        if len(path) < most:
            for d in near.get(path[-1], ()):
                if d not in seen:
                    seen.add(d)
                    queue.append([*path, d])
    return out


def frames(spark, edges, sources):
    e = spark.createDataFrame([("p", i, s, d) for i, (s, d) in enumerate(edges)], "project_id string, seq long, src string, dst string")
    return e, spark.createDataFrame([("p", s, i) for i, s in enumerate(sources)], "project_id string, source string, seq long")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=18))
def test_grouped_search(spark, edges):
    e, s = frames(spark, edges, ["a", "b"])
    got = {(r.source, r.node): list(r.path) for r in graph.bfs_paths_grouped(e, s).collect()}
    assert got == {(src, n): p for src in "ab" for n, p in in_memory(edges, src).items()}


def test_level_search_and_bound(spark):
    edges = [("a", "b"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "a"), ("d", "e")]
    e, s = frames(spark, edges, ["a"])
    assert {r.node: list(r.path) for r in graph.bfs_paths(e, s).collect()} == in_memory(edges, "a")
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(25)]
    e, s = frames(spark, chain, ["n00"])
    assert graph.bfs_paths_grouped(e, s).count() == 20


def test_simple_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("b", "a")]
    e, _ = frames(spark, edges, [])
    assert sorted(list(r.path) for r in graph.simple_paths(e, "a", "c").collect()) == [["a", "b", "c"], ["a", "c"]]


def test_flows_by_levels_equal_the_search_in_a_task(spark):
    """Random projects: sharded tasks, one task and level joins give the same findings."""
    import random

    from taintloom.operators import facts, taint

    rng = random.Random(12)
    rows = []
    for project in ("p", "q"):
        names, seq = [f"v{i}" for i in range(14)], 0
        for _ in range(30):
            a, b = rng.sample(names, 2)
            rows.append({"project_id": project, "path": rng.choice("fg"), "language": "python", "seq": (seq := seq + 1), "kind": "edge", "var": a, "dst": b, "line": seq})
        for kind, n in (("source", 4), ("sink", 5), ("sanitize", 2)):
            for _ in range(n):
                rows.append({"project_id": project, "path": rng.choice("fg"), "language": "python", "seq": (seq := seq + 1), "kind": kind, "var": rng.choice(names), "vuln_type": rng.choice(["xss", "ssrf"]), "types": [rng.choice(["xss", "all"])], "name": f"{kind}{seq}", "code": "", "line": seq})
    found = spark.createDataFrame(rows, facts.FACTS)
    key = lambda df: sorted((r.project_id, r.source_func, r.sink_func, r.vuln_type, r.data_flow) for r in df.collect())
    whole = key(taint.flows(found))
    assert whole
    assert key(taint.flows(found, task_steps=7)) == whole
    assert key(taint.flows(found, task_edges=0)) == whole


def test_call_paths_by_rounds_equal_the_search_in_a_task(spark):
    import random

    from taintloom.operators import callgraph

    rng = random.Random(8)
    names = [f"f{i}" for i in range(12)]
    rows = [("p", n, rng.sample(names, rng.randrange(1, 4)), ["x"] if rng.random() < 0.5 else [], ["y"] if rng.random() < 0.3 else []) for n in names]
    graph_ = spark.createDataFrame(rows, "project_id string, name string, called array<string>, source_labels array<string>, sink_labels array<string>")
    key = lambda df: sorted((r.source, r.sink, list(r.path)) for r in df.collect())
    whole = key(callgraph.paths(graph_))
    assert whole
    assert key(callgraph.paths(graph_, task_nodes=0)) == whole
