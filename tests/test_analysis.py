"""The regression projects against their stated outcomes, in both modes."""

import pytest

from taintloom.plans import cases

#: (project, file, type, severity) that must be reported; projects that aren't named report nothing of theirs.
EXPECTED = {
    ("T1", "run.php", "command_execution", "critical"),
    ("T3", "fake.php", "command_execution", "critical"),
    ("T4", "list.php", "command_execution", "info"),
    ("T5", "echo.php", "xss", "low"),
    ("T6", "far.php", "deserialization", "high"),
    ("T7", "names.py", "path_traversal", "medium"),
    ("T8", "shell.py", "command_execution", "critical"),
    ("T10", "sql.php", "sql_injection", "high"),
    ("T11", "b.py", "ssrf", "high"),
    ("T12", "scopes.py", "ssti", "critical"),
    ("C2", "cmd.c", "command_execution", "critical"),
    ("E1", "config.py", "debug_mode", "low"),
    ("E1", "config.py", "hardcoded_credentials", "high"),
    ("E2", "chain.py", "command_execution", "critical"),
    ("E3", "page.html", "xss", "medium"),
}


@pytest.mark.parametrize("mode", ["declarative", "compat"])
def test_cases(spark, mode):
    rows = cases.findings(spark, mode).collect()
    assert {(r.project_id, r.file_path, r.vuln_type, r.severity) for r in rows} == EXPECTED
    assert len({r.finding_id for r in rows}) == len(rows)
    t12 = [r.line_number for r in rows if r.project_id == "T12"]
    assert t12 == [11]
    assert [r.line_number for r in rows if r.project_id == "E3"] in ([1, 3], [3, 1])
    assert any(r.pipeline_stage == "call_graph" and r.data_flow == "read_input → main → run_cmd" for r in rows)
    assert all("#ret" in r.data_flow for r in rows if r.project_id == "T11")
    assert {r.project_id for r in rows}.isdisjoint({"T2", "T9", "C1", "E4"})
    assert not [r for r in rows if r.project_id == "T7" and r.pipeline_stage == "call_graph"]


def test_parse_errors_are_rows(spark):
    from taintloom.operators import facts

    errors = facts.extract(cases.files(spark)).where("kind = 'error'").collect()
    assert [r.path for r in errors] == ["bad.py"]


def test_empty_project(spark):
    from taintloom.plans.pipeline import analyse

    assert analyse(cases.files(spark).where("project_id = 'none'")).count() == 0
