"""Operators that are built for large keys, tables and projects, against plain loops over small random inputs."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taintloom.operators import facts, literals, ordered, relational, rules, taint, templates
from taintloom.sources import corpus

PARTS = ["abc", "Exec", "(?:ab|cde)", "(x|yz)", "[a-f]", "[^x]", "\\d", "\\s*", "\\.", "a?", "b+", "c*", "d{2}", "e{1,3}", "f{0,2}", "(?i:Gh)", "(?=ab)", "\\bcat\\b", "^", "$", ".", "(abcd)?", "(?:efgh)+", "|"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=6), st.text("abcdefghxyz. 1ECGH", max_size=24), st.booleans())
def test_a_match_holds_a_literal(parts, text, fold):
    pattern = ("(?i)" if fold else "") + "".join(parts)
    try:
        compiled = re.compile(pattern)
    except re.error:
        return
    found = literals.needed(pattern)
    if found is not None and compiled.search(text):
        assert any(x in text.lower() for x in found), (pattern, text, found)


@pytest.mark.parametrize(
    ("pattern", "found"),
    [
        ("os\\.system\\s*\\(", ["os.system"]),
        ("(?:mysql|pgsql)_query", ["_query"]),
        ("(?i)(select|insert) .* from", ["insert", "select"]),
        ("abc?def", ["def"]),
        ("(?:ab|x)", None),
        ("\\p{Lower}abc", None),
        ("\\Qabc\\E", None),
        ("a(b", None),
        ("(?x) a b c d", None),
        ("[abc]{4}", None),
        ("foo{2}bar", ["foo"]),
        ("[]x]hello", ["hello"]),
        ("ÄÖÜß", None),
    ],
)
def test_literals_of_patterns(pattern, found):
    assert literals.needed(pattern) == found


def test_a_join_with_5000_rules_equals_a_nested_loop(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(2, 6)))
    table = [(f"r{k}", ("php", "c")[k % 2], rng.choice([f"{word()}\\s*\\({word()}", f"(?:{word()}|{word()}) = {word()}", f"{word()}[xy]?{word()}", f"(?i){word()}{word()}".upper().replace("(?I)", "(?i)"), f"{word()}"])) for k in range(5000)]
    table += [("free", "c", "[0-9]{3}"), ("none", "php", None), ("twice", "c", "(?:aab|bba)")]
    rows = [(k, ("php", "c")[k % 2], " ".join(word() + rng.choice(["", "(", " = ", "y"]) for _ in range(8))) for k in range(60)] + [(60, "c", None), (61, "c", ""), (62, "c", "x 123 aab bba"), (63, "php", "AAB = aab")]
    lines = spark.createDataFrame(rows, "line_no long, language string, code string")
    df = spark.createDataFrame(table, "rule_id string, language string, pattern string")
    want = sorted((n, r) for n, lang, t in rows if t is not None for r, of, p in table if p is not None and of == lang and re.search(p, t))
    got = sorted(map(tuple, literals.indexed_join(lines, df, "code", ["language"]).select("line_no", "rule_id").collect()))
    assert got == want and any(r == "free" for _, r in got) and sum(r == "twice" for _, r in got) == len({n for n, r in got if r == "twice"})
    assert literals.indexed_join(lines, df.limit(0), "code", ["language"]).count() == 0
    plain = sorted((n, r) for n, _, t in rows if t is not None for r, _, p in table if p is not None and re.search(p, t))
    assert sorted(map(tuple, relational.rule_join(lines.drop("language"), df.drop("language")).select("line_no", "rule_id").collect())) == plain


def test_literals_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(literals, "AUTOMATON", 3)
    df = spark.createDataFrame([(f"r{k}", f"(?:w{k}xx|w{k + 1}yy)") for k in range(8)], "rule_id string, pattern string")
    rows = spark.createDataFrame([(1, "w3xx w4yy w9"), (2, "w8yy"), (3, "no")], "line_no long, code string")
    assert sorted(map(tuple, literals.indexed_join(rows, df).select("line_no", "rule_id").collect())) == [(1, "r3"), (2, "r7")]


def test_rules_of_a_table_scan_as_literal_ones(spark):
    files = spark.createDataFrame([("old", "a.php", "php", "<?php\nmysql_query($a);\n$f = create_function('', $b);\nunserialize($c);\n"), ("py", "a.py", "python", "exec(a)\nos.system(b)\nyaml.load(x)\n"), ("c", "a.c", "c", "gets(a);\nsystem(b);\nstrcpy(a, b);\n")], corpus.FILES)
    versions = spark.createDataFrame([("old", "php", "7.0"), ("c", "c", "c17")], "project_id string, language string, version string")
    for known in (None, versions):
        one, two = (sorted(map(tuple, rules.scan(corpus.code_lines(files), table, known).collect())) for table in (None, rules.rules(spark)))
        assert one == two and one


def test_within_spans_equals_a_loop(spark):
    rng = random.Random(8)
    spans = [(rng.choice("aab"), s := rng.randrange(-5000, 5000), s + rng.choice([-1, 0, 1, 7, 8, 100, 4000])) for _ in range(200)] + [("a", None, 3), ("a", -(2**63), 2**63 - 1), (None, 0, 5)]
    points = [(rng.choice("aab"), rng.randrange(-6000, 6000)) for _ in range(300)] + [("a", None), (None, 3), ("c", 3)]
    want = sorted((k, p, s, e) for k, p in points for q, s, e in spans if k is not None and k == q and p is not None and s is not None and s <= p <= e)
    for kind in ("long", "double"):
        x = spark.createDataFrame([(k, p if p is None else float(p) if kind == "double" else p) for k, p in points], f"k string, at {kind}")
        y = spark.createDataFrame(spans, "k string, s long, e long").withColumns({"s": F.col("s").cast(kind), "e": F.col("e").cast(kind)})
        got = relational.within_spans(x, y, ["k"], "at", "s", "e").select("k", "at", "s", "e").collect()
        assert sorted((r.k, r.at, r.s, r.e) for r in got) == [tuple(float(v) if kind == "double" and not isinstance(v, str) else v for v in r) for r in want]
    assert relational.within_spans(x, y.limit(0), ["k"], "at", "s", "e").count() == 0


def test_longest_suffix_of_a_table_equals_a_loop(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("ab", k=rng.randrange(0, 8))) for _ in range(80)] + [None, "b" * 40]
    table = [("".join(rng.choices("ab", k=rng.randrange(1, 6))), k) for k in range(40)] + [(None, 1), ("", 99)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id long, name string")
    got = {r.id: r.suffix for r in relational.longest_suffix(df, spark.createDataFrame(table, "suffix string, ord long"), "name", "suffix", "ord").collect()}
    for k, n in enumerate(names):
        held = [s for s, _ in table if s is not None and n is not None and n.endswith(s)]
        assert got[k] == (max(held, key=len) if held else None)
    assert relational.longest_suffix(df, spark.createDataFrame([], "suffix string, ord long"), "name", "suffix", "ord").where("suffix is not null").count() == 0


def test_linked_pairs_equal_the_rule_on_all_pairs(spark):
    rng = random.Random(6)
    some = lambda: "/".join(rng.choice(["a", "b", "ab", "x.html", "b.html"]) for _ in range(rng.randrange(1, 4)))
    pages = spark.createDataFrame([(rng.choice("pq"), some()) for _ in range(60)] + [("p", "a\\x.html")], "project_id string, path string")
    names = spark.createDataFrame([(rng.choice("pq"), rng.choice(["", "/", "//"]) + some()) for _ in range(60)] + [("p", "l"), ("q", None), ("p", "t\\x.html")], "project_id string, name string")
    every = pages.distinct().join(names.distinct(), "project_id").where(templates.linked(F.col("path"), F.col("name"))).select("project_id", "path", "name").distinct()
    got = sorted(map(tuple, templates.linked_pairs(pages, names, ["project_id"]).collect()))
    assert got == sorted(map(tuple, every.collect())) and got


def random_facts(seed, n, nodes):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.choice(["edge"] * 6 + ["source", "sink", "sink", "sanitize"])
        row = {"project_id": rng.choice("pq"), "path": rng.choice("fg"), "language": "python", "seq": k, "kind": kind, "var": f"x{rng.randrange(nodes)}", "name": f"{kind}{k}", "code": "", "line": k}
        if kind == "edge":
            row["dst"] = f"x{rng.randrange(nodes)}"
        elif kind == "sink":
            row["vuln_type"] = rng.choice(["xss", "ssrf"])
        elif kind == "sanitize":
            row["types"] = rng.choice([["xss"], ["ssrf"], ["all"]])
        rows.append(row)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [{"mode": "compat"}, {"around_clean": True}, {}])
def test_large_projects_have_the_rows_of_small_ones(spark, monkeypatch, seed, options):
    monkeypatch.setattr(ordered, "RANGE_FACTS", 9)
    monkeypatch.setattr(ordered.folded, "__defaults__", (9,))
    df = spark.createDataFrame(random_facts(seed, 160, 14), facts.FACTS)
    one, two = (sorted(map(tuple, taint.flows(df, most=6, task_edges=e, **options).collect())) for e in (10_000, 0))
    assert one == two and one


def test_folded_equals_facts_in_order(spark):
    """Against a plain fold of label sets, fact by fact."""
    rows = random_facts(9, 300, 10)
    known, state = set(), {}
    for r in sorted(rows, key=lambda r: (r["path"], r["seq"])):
        p, v = r["project_id"], r["var"]
        if r["kind"] == "edge":
            d = r["dst"]
            known |= {(p, v), (p, d)}
            state[p, d] = state.get((p, d), set()) | state.get((p, v), set())
        elif r["kind"] == "sanitize":
            if (p, v) in known:
                state[p, v] = {"all"} if "all" in r["types"] else state.get((p, v), set()) | set(r["types"])
        else:
            known.add((p, v))
            if r["kind"] == "source":
                state[p, v] = state.get((p, v), set()) | {ordered.TAINT}
    df = spark.createDataFrame(rows, facts.FACTS)
    edges = df.where("kind = 'edge'").select("project_id", "path", "seq", F.col("var").alias("src"), "dst")
    for size in (1, 7, 1000):
        got = {}
        for r in ordered.folded(df.where("kind <> 'edge'"), edges, size).collect():
            got.setdefault((r.project_id, r.node), set()).add(r.label)
        assert got == {k: v for k, v in state.items() if v}


def test_numbered_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(1000)) for _ in range(500)]
    got = ordered.numbered(spark.createDataFrame(rows, "k string, v long").repartition(7), "k", ["v"]).collect()
    for key in ("hot", "a", None):
        mine = sorted((r.pos, r.v) for r in got if r.k == key)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for k, v in rows if k == key)
