"""Operators that have no table of the driver to run on: rules, versions, records, archives, JSON repair, streams."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from taintloom.functions import patterns as P
from taintloom.functions import text as T
from taintloom.operators import cve, detectors, relational, report, rules
from taintloom.plans import cases
from taintloom.sources import corpus
from taintloom.streaming import rule_scan


def test_rules_by_version(spark):
    table = rules.rules(spark)
    assert {r.rule_id for r in rules.lookup(table, version="7.4").where("language = 'php'").collect()}.isdisjoint({"DEPRECATED_PREG_REPLACE_E", "DEPRECATED_CREATE_FUNCTION"})
    old = rules.active(table.where("language = 'php'").withColumn("version", F.lit("7.0"))).where("rule_id = 'DEPRECATED_MYSQL_FUNCTIONS'").first()
    assert old.severity == "critical"
    assert rules.lookup(table, version="c++17").where("rule_id = 'C_GETS_FUNCTION'").count() == 0
    assert rules.lookup(table, version="c89").where("rule_id = 'CXX_NEW_NO_DELETE'").count() == 0
    assert rules.lookup(table, category="file_upload").count() == 1


def test_rule_scan_and_versions(spark):
    files = cases.files(spark)
    hits = rules.scan(corpus.code_lines(files), rules.rules(spark), rules.detected_versions(files).withColumnRenamed("detected", "version"))
    found = {(r.project_id, r.rule_id) for r in hits.collect()}
    assert {("T6", "DESERIALIZE_UNSAFE"), ("T8", "PY_OS_SYSTEM"), ("C2", "C_SYSTEM_CALL")} <= found
    more = spark.createDataFrame([("v", "a.php", "php", "<?php\n$x = $a ?? 1; // fn("), ("w", "a.py", "python", "if (n := 3): pass"), ("x", "a.cpp", "cpp", "auto f = 3;"), ("y", "a.php", "php", "<?php $f = fn($x) => 1;")], corpus.FILES)
    got = {r.project_id: r.detected for r in rules.detected_versions(more).collect()}
    assert got == {"v": "7.0", "w": "3.8", "x": "c++11", "y": "7.4"}
    chosen = spark.createDataFrame([("v", "php", "8.2"), ("y", "php", "")], "project_id string, language string, chosen string")
    assert {(r.project_id, r.version, r.detected_by_code) for r in rules.resolved_versions(rules.detected_versions(more), chosen).collect()} >= {("v", "8.2", False), ("y", "7.4", True)}


def test_records(spark, tmp_path):
    def record(i, desc, v31=None, v2=None, cwe=None, cpe=None, lang="en"):
        r = {"id": i, "published": "2024", "descriptions": [{"lang": lang, "value": desc}], "metrics": {}, "weaknesses": [], "configurations": []}
        if v31:
            r["metrics"]["cvssMetricV31"] = [{"cvssData": {"baseScore": v31[0], "baseSeverity": v31[1]}}]
        if v2:
            r["metrics"]["cvssMetricV2"] = [{"cvssData": {"baseScore": v2}}]
        if cwe:
            r["weaknesses"] = [{"description": [{"lang": "en", "value": cwe}]}]
        if cpe:
            r["configurations"] = [{"nodes": [{"cpeMatch": [{"criteria": cpe, "versionEndExcluding": "2.0"}]}]}]
        return {"cve": r}

    rows = [
        record("CVE-1", "SQL injection in a plugin", (9.8, "CRITICAL"), None, "CWE-89", "cpe:2.3:a:v:wordpress:1.0"),
        record("CVE-2", "an issue", None, 7.5, None, "cpe:2.3:o:linux:linux_kernel:5"),
        record("CVE-3", "pickle in a python tool, code execution", None, None, "CWE-1"),
        record("CVE-4", "low", (2.0, "LOW"), None, None, "cpe:2.3:a:v:php:1"),
        record("CVE-5", "nur deutsch", (9.0, "HIGH"), lang="de"),
        record("CVE-6", "nothing known here", (9.0, "HIGH")),
    ]
    (tmp_path / "a.json").write_text(json.dumps({"vulnerabilities": rows}))
    got = {r.cve_id: r for r in cve.parsed(cve.read(spark, str(tmp_path / "a.json"))).collect()}
    assert set(got) == {"CVE-1", "CVE-2", "CVE-3"}
    assert (got["CVE-1"].ecosystem, got["CVE-1"].severity, got["CVE-1"].category, got["CVE-1"].version_end) == ("PHP", "critical", "sql_injection", "2.0")
    assert (got["CVE-2"].ecosystem, got["CVE-2"].severity, got["CVE-2"].product) == ("C", "high", "linux_kernel")
    assert (got["CVE-3"].ecosystem, got["CVE-3"].severity, got["CVE-3"].category) == ("Python", "medium", "command_execution")
    flat = cve.parsed(cve.read(spark, str(tmp_path / "a.json")))
    assert rules.rules(spark).unionByName(cve.as_rules(flat)).where("ord = 1000").count() == 2


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/x.py", "print(1)")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("../up.py")
        info.size = 1
        t.addfile(info, io.BytesIO(b"x"))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    rows = {r.archive.rsplit("/", 1)[-1]: r for r in corpus.read_archives(spark, str(tmp_path)).collect()}
    assert (rows["a.zip"].name, bytes(rows["a.zip"].content)) == ("src/x.py", b"print(1)")
    assert "escaping" in rows["b.tar.gz"].fault and rows["c.zip"].fault
    assert [corpus.member_fault(n) for n in ("", "/a", "C:\\a", "a/../b", "a/b")] == ["empty", "absolute", "absolute", "escaping", None]


def test_folders(spark, tmp_path):
    for name in ("build/app/a.PY", "build/venv/b.py", "build/app/c.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x = '\xff1'\n")
    rows = corpus.read_files(spark, str(tmp_path / "build"), "p", "python").collect()
    assert [(r.path, r.text) for r in rows] == [("app/a.PY", "x = '1'\n")]


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', '{"a": 1}'), ('Sure:\n```json\n{"a": [1, 2,]}\n```', '{"a": [1, 2]}'), ('so {a: "x", // no\n "b": {"c": 1', '{"a": "x", "b": {"c": 1}}'), ("nothing", None), (None, None)])
def test_json_repair(text, want):
    assert T.repair_json(text) == want


def test_searches(spark):
    lines = corpus.code_lines(cases.files(spark).where("project_id in ('T3', 'T10')"))
    rows = detectors.search(lines, "SYSTEM", "*.php", 50).collect()
    assert [(r.path, r.line_no, r.total) for r in rows] == [("fake.php", 3, 1)]
    assert {(r.category, r.line_no) for r in detectors.user_inputs(lines).collect()} == {("get", 2)}
    assert {r.category for r in detectors.tagged_calls(lines, P.DANGEROUS_CALLS).collect()} == {"command", "sql"}
    assert {(r.line_no, r.use) for r in detectors.variable_trace(lines.where("path = 'sql.php'"), "$id").collect()} == {(2, "assign"), (3, "reference")}


def test_region_context_and_replacement(spark):
    lines = spark.createDataFrame([("a", n, f"l{n}") for n in range(1, 7)], "path string, line_no int, code string")
    assert [r.shown for r in report.region(lines, "a", 2, 3).orderBy("line_no").collect()] == ["   2 | l2", "   3 | l3"]
    new = report.replaced_lines(lines, "a", 2, 4, ["x"]).orderBy("line_no").collect()
    assert [(r.line_no, r.code) for r in new] == [(1, "l1"), (2, "x"), (3, "l5"), (4, "l6")]
    f = spark.createDataFrame([(1, "a", 2, 5)], "finding_id long, file_path string, source_line int, sink_line int")
    got = {r.line_no: r.tag for r in report.context(lines, f, 1).collect()}
    assert got == {1: None, 2: "SOURCE", 3: None, 4: None, 5: "SINK", 6: None}


def test_pdo(spark):
    rows = [
        ("p", "db.php", "php", "<?php\n$db = new PDO('mysql:host=x;charset=gbk');\n"),
        ("p", "a.php", "php", "<?php\n$s = $db->prepare('SELECT 1');\n$s->execute([1]);\n$db->query('SELECT ' . $x);\n"),
        ("q", "b.php", "php", "<?php\n$db->setAttribute(PDO::ATTR_EMULATE_PREPARES, true);\n"),
    ]
    got = {(r.file_path, r.line_number, r.pattern, r.confidence) for r in detectors.pdo(corpus.code_lines(spark.createDataFrame(rows, corpus.FILES))).collect()}
    assert got == {
        ("a.php", 4, "string_concat_sql", 0.9),
        ("a.php", 2, "dangerous_combo", 0.85),
        ("db.php", 2, "dangerous_combo", 0.85),
        ("db.php", 2, "dangerous_combo", 0.65),
        ("b.php", 2, "dangerous_combo", 0.8),
    }


def test_large_suffix_table_gives_the_same(spark):
    rows = spark.createDataFrame([(1, "flask.request.args.get"), (2, "args.get"), (3, "other")], "id int, name string")
    table = spark.createDataFrame([("get", 0), ("args.get", 1), ("request.args.get", 2)], "suffix string, ord int")
    for most in (100, 1):
        got = {r.id: r.suffix for r in relational.longest_suffix(rows, table, "name", "suffix", "ord", most).collect()}
        assert got == {1: "request.args.get", 2: "args.get", 3: None}


def test_first_wins_is_idempotent(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(20)], "k int, seq int")
    once = relational.first_wins(rows, ["k"], ["seq"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, relational.first_wins(once, ["k"], ["seq"]).collect())) == [(0, 0), (1, 1), (2, 2)]


def test_safe_spots_and_persist(spark, tmp_path):
    f = spark.createDataFrame([(1, "a", 5, 5, 5, "critical", "p"), (2, "a", 50, 50, 50, "high", "p")], "finding_id long, file_path string, line_number int, source_line int, sink_line int, severity string, project_id string")
    spots = spark.createDataFrame([("a", 6)], "file_path string, line_number int")
    assert {r.finding_id: r.severity for r in detectors.safe_spots(f, spots).collect()} == {1: "medium", 2: "high"}
    full = cases.findings(spark)
    report.persist(full, str(tmp_path / "t"))
    report.persist(full, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 * full.count()


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cases.files(spark).where("language = 'c'").coalesce(1).write.parquet(src)
    for _ in range(2):
        q = rule_scan.scan_stream(spark, src, out, str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert {r.rule_id for r in spark.read.parquet(out).collect()} >= {"C_SYSTEM_CALL"}
    n = spark.read.parquet(out).count()
    cases.files(spark).where("language = 'c'").coalesce(1).write.mode("append").parquet(src)
    rule_scan.scan_stream(spark, src, out, str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2 * n
