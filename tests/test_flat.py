"""Flat files are read by the forms of their lines, with the facts that reading them whole gives."""

import random

import pytest

from taintloom.operators import facts, flat
from taintloom.plans import code_forms as C

#: Lines that a file isn't flat with, that change what others mean, or that look like one of both.
ODD = {
    "python": ["from sqlite3 import connect as cn", "c = cn('x')", "c.execute(v0000001)", "xargs.get(v0000001)", "request = 3", "def f(a): return a", "if v0000001: os.system(v0000002)", "else: pass", "x = 1.e500", "x = f'{input()!r:>10}{w000002}'", '"""', "x = (", "  y = input()", "with open(v0000001) as c1234: pass", "input = 4", "os = 5", "v0000001, v0000002 = input(), sys.argv[2]", "Q0_ = input()", "x = 'é' + input()", "import v0000001", "from flask import request as req9999", "x = req9999.args.get('a')", "(v0000001 := input())", "x = input() \\", "from . import os", "", "import os; os.system(v0000001)", "run(v0000001, shell=True)", "from subprocess import run", "v0000001.connect = psycopg2.connect(v0000002)", "v0000001.objects.raw(v0000001)"],
    "php": ["function f1234($v0000001) {", "}", "if ($v0000001) { echo $v0000001; }", "$_SESSION['a'] = $_GET['b'];", "echo $_SESSION['a'];", 'echo "a $v0000001 {$w000002[\'x\']} $_GET[abc1234]";', "/* a", "*/", "$x = 'abc", "';", "?>", "<b>", "echo <<<EOT", "EOT;", "foo($a", "); system($v0000001);", "$a = 5", "+ $_GET['b'];", "# c ' \"", "$x = $v0000001 . $w000002 . $_SERVER['HTTP_HOST'];", "$x = $_SERVER['ABCD1234'];", "SYSTEM($v0000001);", "$x = file_get_contents($v0000001); echo $x;", "$x = function($v0000001) { return $_GET['a']; };", "$Q0 = $_GET['a'];", "[$v0000001, $w000001] = [$_GET['a'], 5];", "$x = ($v0000001;);", "case 5: echo $_GET['x'];", "static $v0000001 = 5;", ""],
}


def files_of(language: str, number: int):
    rnd = random.Random(number)
    for _ in range(number):
        lines = [rnd.choice(C.FORMS[language])[0] if rnd.random() < 0.9 else rnd.choice(ODD[language]) for _ in range(rnd.randint(0, 5))]
        lines = [x.replace("{v}", f"v{rnd.randint(1, 3):07}").replace("{w}", f"w{rnd.randint(1, 3):06}") for x in lines]
        yield "\n".join([*C.HEADS[language], *lines])


def held(rows):
    return [{k: v for k, v in r.items() if v is not None} for r in rows]


def made(found):
    """Rows of facts whose columns aren't made yet."""
    columns = {c: x for c in facts.COLUMNS if (x := flat.column(found, c)) is not None}
    return [dict(zip(columns, r, strict=True)) for r in zip(*columns.values(), strict=True)]


def check_same(language: str, kinds: list[str], number: int = 1_500) -> None:
    wanted, read = frozenset(kinds), 0
    reader = flat.readers(wanted)[language]
    for text in files_of(language, number):
        got = reader.facts("d/a1.x", text, "d/")
        if got is not None:
            read += 1
            assert held(made(got)) == held(facts.facts_of(language, "d/a1.x", text, "d/", wanted)), text
    assert number / 2 < read < number


def check_forms_are_read_once(monkeypatch, language: str, kind: str, reads: str) -> None:
    """The work of reading grows with the forms of lines, not with files."""
    flat.readers.cache_clear()
    reader, calls = flat.readers(frozenset([kind]))[language], []
    whole = getattr(reader, reads)
    monkeypatch.setattr(reader, reads, lambda *a: calls.append(a) or whole(*a))
    for k in range(400):
        lines = [s.replace("{v}", f"v{k:07}").replace("{w}", f"w{k:06}") for s, _ in C.FORMS[language]]
        text = "\n".join([*C.HEADS[language], *lines])
        assert len(reader.facts(f"a{k}.x", text)) == sum(f[0] == kind for _, found in C.FORMS[language] for f in found)
    assert len(calls) <= len(C.FORMS[language]) + len(C.HEADS[language])


@pytest.mark.parametrize("kinds", [["source"], ["sink"], ["edge"], ["sanitize"], ["source", "sink", "edge", "sanitize"]])
def test_python_facts_are_those_of_whole_files(kinds):
    check_same("python", kinds)


def test_python_forms_are_read_once(monkeypatch):
    check_forms_are_read_once(monkeypatch, "python", "source", "read")
    check_forms_are_read_once(monkeypatch, "python", "source", "outline")


def test_other_kinds_are_read_whole():
    assert flat.readers(frozenset(["source", "var"])) == {}


def test_php_edges_are_those_of_whole_files(monkeypatch):
    check_same("php", ["edge"])
    check_same("php", ["source", "function_source", "sink", "edge", "sanitize"])
    check_forms_are_read_once(monkeypatch, "php", "edge", "read")


def test_php_sanitizers_are_those_of_whole_files(monkeypatch):
    check_same("php", ["sanitize"])
    check_forms_are_read_once(monkeypatch, "php", "sanitize", "read")


def test_php_sinks_are_those_of_whole_files(monkeypatch):
    check_same("php", ["sink"])
    check_same("php", ["source"])
    check_forms_are_read_once(monkeypatch, "php", "sink", "read")


def test_only_asked_columns_leave_a_worker(spark):
    """And without modules no pass over all paths is made, nor a join."""
    whole = "import os\ndef f(a):\n    os.system(a)\n"
    files = [(f"p{k}", f"d/a{k}.py", "python", f"import os\nv{k:07} = input()\nos.system(v{k:07})\n") for k in range(30)] + [("p", "b.py", "python", whole), ("p", "c.php", "php", "<?php\nsystem($v0000001);"), ("p", "d.c", "c", "system(x);"), ("p", "e.py", "python", None)]
    files = spark.createDataFrame(files, "project_id string, path string, language string, text string").repartition(3)
    every = facts.extract(files, ["sink"], ordered=False)
    for columns in (["path", "line", "var", "name", "vuln_type"], ["vuln_type", "project_id"], ["code", "seq", "types", "kind"], ["module", "path"]):
        got = facts.extract(files, ["sink"], ordered=False, columns=columns)
        assert got.columns == columns and got.schema == every.select(columns).schema
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == ("module" in columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, every.select(columns).collect()))
    assert every.count() == 33


@pytest.mark.parametrize("language", ["php", "python"])
def test_names_of_lines_without_facts_are_not_looked_at(monkeypatch, language):
    """A form is told by its mask, so the work of a line that gives nothing doesn't grow with its names."""
    looked, whole = [], flat.names_of
    monkeypatch.setattr(flat, "names_of", lambda line, mask: looked.append(line) or whole(line, mask))
    reader = flat.readers(frozenset(["sanitize"]))[language]
    given = [[s.replace("{v}", f"v{k:07}").replace("{w}", f"w{k:06}") for s, _ in C.FORMS[language]] for k in range(2)]
    for lines in given:
        looked.clear()
        reader.facts("a.x", "\n".join([*C.HEADS[language], *lines]))
    assert looked == [x for x, (_, found) in zip(given[1], C.FORMS[language], strict=True) if any(f[0] == "sanitize" for f in found)]


def test_lines_of_one_mask_that_name_the_same_are_another_form():
    reader = flat.readers(frozenset(["edge", "sanitize"]))["php"]
    for lines, n in ((["$v0000001 = intval($v0000002);"], 2), (["$v0000001 = intval($v0000001);"], 1), (["$v0000002 = intval($v0000001);", "$v0000003 = intval($v0000003);"], 3)):
        text = "\n".join(["<?php", *lines])
        got = made(reader.facts("a.php", text))
        assert len(got) == n and held(got) == held(facts.facts_of("php", "a.php", text, "", reader.wanted))


def test_lines_of_an_order_are_gathered_by_one_sort(spark, tmp_path):
    """An aggregate of lists sorts all lines as code, twice; the texts are the same."""
    rows = [(7, n, 5 * n, n) for n in (3, 1, 7, 2, 12)] + [(7, 1, 4, 9), (8, 2, 1, None), (8, 1, 25, 3), (8, 3, 11, 2)] + [(9, 1, None, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    files = C.code_files(spark, str(tmp_path), "php")
    plan = files._jdf.queryExecution().sparkPlan().toString()
    assert "collect_list" in plan and "ObjectHashAggregate" not in plan
    assert files._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    forms = [s for s, _ in C.FORMS["php"]]
    code = lambda part, supp: forms[(part + supp) % len(forms)].replace("{v}", f"v{part:07}").replace("{w}", f"w{supp:06}")
    seven = [code(4, 1), code(10, 2), code(15, 3), code(35, 7), code(60, 12)]
    assert {r.path: r.text.split("\n") for r in files.collect()} == {"o7.php": ["<?php", *seven], "o8.php": ["<?php", code(25, 3), code(11, 2)], "o9.php": ["<?php"]}


def test_known_lines_of_php_are_told_by_their_mask_alone(monkeypatch):
    told, whole = [], flat.form_of
    monkeypatch.setattr(flat, "form_of", lambda line, mask: told.append(line) or whole(line, mask))
    reader = flat.PhpLines(frozenset(["sanitize"]))
    for k in range(400):
        lines = [s.replace("{v}", f"v{k:07}").replace("{w}", f"w{k:06}") for s, _ in C.FORMS["php"]]
        assert len(reader.facts("a.php", "\n".join(["<?php", *lines]))) == 3
    assert len(told) == len(C.FORMS["php"])


def test_only_needed_columns_go_to_a_worker(spark):
    files = spark.createDataFrame([("p", "a.php", "php", "<?php\n$v0000001 = intval($w000002);")], "project_id string, path string, language string, text string")
    for columns, sent in ((["path", "name"], "run(path#"), (["path", "name", "project_id"], "run(project_id#")):
        got = facts.extract(files, ["sanitize"], ordered=False, columns=columns)
        assert sent in got._jdf.queryExecution().optimizedPlan().toString()
        assert [r.asDict() for r in got.collect()] == [{"path": "a.php", "name": "intval"} | ({"project_id": "p"} if "project_id" in columns else {})]
