"""The engine's own operators on small stated inputs. What each must give is stated in `stated_rows`: rows that were printed
by a run and then held against the rules one by one; from there on they are what a change must not alter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintloom.functions import patterns as P
from taintloom.functions import text as T
from taintloom.operators import callgraph, cve, detectors, enrich, facts, graph, relational, report, rules, taint, templates, verify
from taintloom.plans import pipeline
from taintloom.sources import corpus

from .stated_rows import EXPECTED

QUERIES = {}


def stated(f):
    QUERIES[f.__name__] = f
    return f


def sources(spark: SparkSession, *rows: tuple[str, str, str]) -> DataFrame:
    """Files (path, language, text) of one project."""
    return spark.createDataFrame([("p", *r) for r in rows], corpus.FILES)


def shown(rows: DataFrame, *kinds: str) -> DataFrame:
    """Facts of some kinds, with what tells them apart."""
    return rows.where(F.col("kind").isin(*kinds)).select("path", "kind", "line", F.col("var").alias("variable"), F.col("dst").alias("target"), "name", "vuln_type")


def of(spark: SparkSession, language: str, text: str, *kinds: str) -> DataFrame:
    name = {"python": "a.py", "php": "a.php", "c": "a.c"}[language]
    return shown(facts.extract(sources(spark, (name, language, text))), *kinds).drop("path")


# Python facts

SCOPES = """from m import x
top = x
for item in top:
    pass
class Outer:
    attr = 1
    def method(self, a, *rest, key=None, **more):
        def inner(b):
            return b
        return inner(a)
async def plain(c, /, d):
    return d
"""


@stated
def py_scopes(spark, sf):
    """Functions with their qualified names, module variables, and parameters as sources."""
    rows = facts.extract(sources(spark, ("a.py", "python", SCOPES))).where("kind in ('function', 'var') or name = 'function.parameter'")
    return rows.select("kind", "name", F.col("var").alias("variable"), F.array_join("params", ",").alias("params"), F.array_join("kwonly", ",").alias("kwonly"), "prefix")


@stated
def py_imports(spark, sf):
    """Aliases of imports: absolute, renamed, from a module, relative, and none of a star."""
    text = "import os\nimport os.path as osp\nimport a.b\nfrom flask import request as r\nfrom . import near\nfrom ..up import far\nfrom m import *\n"
    return shown(facts.extract(sources(spark, ("pkg/sub/mod.py", "python", text), ("top.py", "python", "x = 1\n"))), "alias").select("path", "line", "name", "target")


@stated
def py_modules(spark, sf):
    """Module names start below the folder that all files share; a package's own file has the package's name."""
    files = sources(spark, ("src/store/db.py", "python", "x = 1\n"), ("src/store/__init__.py", "python", "y = 1\n"), ("src/app.py", "python", "z = 1\n"))
    return facts.extract(files).where("kind = 'var'").select("path", "module", "name")


@stated
def py_errors(spark, sf):
    """A file that can't be parsed is a row of its own."""
    return facts.extract(sources(spark, ("bad.py", "python", "def f(:\n"), ("good.py", "python", "x = 1\n"))).where("kind in ('error', 'var')").select("path", "kind", "name", "line")


@stated
def py_sources(spark, sf):
    """Sources by calls, attributes and items: by full name, else the longest catalogue name that ends what is written."""
    text = "from flask import request\nimport sys, os\na = request.args.get('k')\nb = opts.args.get('k')\nc = request.form['k']\nd = sys.argv[1]\ne = input()\nf = os.getenv('K')\ng = api.payload\nh = other.get('k')\ni = request.data\n"
    return of(spark, "python", text, "source")


@stated
def py_sinks(spark, sf):
    """Sinks by full and by short names, raw queries, cursors by what made them and by their names, and lists that no shell
    reads."""
    text = "import os, subprocess, sqlite3, pickle\nfrom lxml import etree\nos.system(a)\nsubprocess.run(['ls', b])\nsubprocess.run(['ls', b], shell=True)\nsubprocess.call(c)\nUser.objects.raw(d)\nconn = sqlite3.connect('x')\nk = conn.cursor()\nk.execute(e)\ncur.executemany(f)\ndb.session.execute(g)\neval(h)\netree.parse(i)\nfoo.execute(j)\nopen('fixed')\npickle.loads(data=l)\n"
    return of(spark, "python", text, "sink")


@stated
def py_edges(spark, sf):
    """What values are made of: assignments, loops, returns, items, attributes, f-strings, calls and conditions."""
    text = "def f(a, d):\n    x = a + d['k']\n    y = f'{x} {a.b}'\n    z, w = [x, y]\n    w += a\n    for i in z:\n        pass\n    v = x if a else y\n    u = d.get(a)\n    t = {'k': a}\n    s: int = x\n    return v\n"
    return of(spark, "python", text, "edge").drop("vuln_type")


@stated
def py_sanitizers(spark, sf):
    """Calls that clean what they return: of everything, or of some types."""
    text = "import html, shlex, os.path\na = int(x)\nb = html.escape(x)\nc = shlex.quote(x)\nd = os.path.basename(x)\ne = str(x)\n"
    rows = facts.extract(sources(spark, ("a.py", "python", text))).where("kind = 'sanitize'")
    return rows.select("line", F.col("var").alias("variable"), "name", F.array_join("types", ",").alias("types"))


@stated
def py_calls(spark, sf):
    """Calls with the project function that each means: of the same file, imported, of an imported module, of a class, of
    the own class, and none of another object."""
    a = "class Box:\n    def put(self, v):\n        return self.get(v)\n    def get(self, w):\n        return w\ndef near(x):\n    return x\n"
    b = "from a import near, Box\nimport a\nimport a as other\ndef go(q):\n    near(q)\n    a.near(q)\n    other.near(q)\n    Box.put(q, q)\n    q.put(q)\n    go(q)\n"
    rows = taint.resolved_calls(facts.extract(sources(spark, ("a.py", "python", a), ("b.py", "python", b))))
    return rows.select("path", "line", "name", F.col("target.prefix").alias("prefix"))


@stated
def py_links(spark, sf):
    """Edges over files: arguments to parameters by position, keyword-only ones by name, results from returns, attributes of
    imported modules."""
    a = "limit = 3\ndef f(x, y, *, k=0):\n    return y\n"
    b = "import a\nr = a.f(p, q, k=s)\nn = a.limit\n"
    rows = taint.link_edges(facts.extract(sources(spark, ("a.py", "python", a), ("b.py", "python", b))))
    return rows.where("src like '%b.py%' and dst like '%a.py%' or src like '%a.py%' and dst like '%b.py%'").select(F.col("src").alias("variable"), F.col("dst").alias("target"), "line")


# PHP and C facts


@stated
def php_sources(spark, sf):
    """Items of superglobals; of the server's only those that a request sets."""
    text = "<?php\n$a = $_GET['x'];\n$b = $_SERVER['HTTP_HOST'] . $_SERVER['DOCUMENT_ROOT'];\n$c = $_SERVER[$k];\nf($_POST['y']);\n$d = $_GET;\n// $_GET['no']\n$e = '$_GET[no]';\n$g = \"q $_GET[z]\";\n$h = getenv('X');\n"
    return of(spark, "php", text, "source", "function_source").drop("target", "vuln_type")


@stated
def php_sinks(spark, sf):
    """Sinks are plain calls with their dangerous argument; methods and commented calls are none."""
    text = "<?php\nsystem($a);\nmysqli_query($conn, \"SELECT $b\");\n$db->query($c);\neval('x' . $d);\n# system($e);\nunserialize(intval($f));\nexec(escapeshellarg($g));\nmove_uploaded_file($h, $i);\n"
    return of(spark, "php", text, "sink").drop("target")


@stated
def php_echo(spark, sf):
    """Output of variables, but not if it is escaped, a number, a comparison or one of two constants."""
    text = "<?php\necho $a, 'x' . $b;\necho number_format($c, $d);\necho htmlspecialchars('x' . $e);\nprint $f == 1;\nprint $g ? 'a' : 'b';\necho 'n: ' . intval($h) . $i;\n?>\n<b><?= $j ?></b>\n"
    return of(spark, "php", text, "sink").drop("target")


@stated
def php_edges(spark, sf):
    """Assignments, appended strings, lists, and both sides of a concatenation."""
    text = "<?php\n$a = $b . $c;\n$d['k'] = foo($e, $f[0]);\n$g .= $h;\n[$i, $j] = $k;\nif (($l = $m) > 1) { $n = \"$o {$p}\"; }\n"
    return of(spark, "php", text, "edge").drop("vuln_type")


@stated
def php_sanitizers(spark, sf):
    text = "<?php\n$a = intval($x);\n$b = htmlspecialchars($x);\n$c = mysqli_real_escape_string($l, $x);\n$d = escapeshellarg($x);\n$e = trim($x);\n"
    rows = facts.extract(sources(spark, ("a.php", "php", text))).where("kind = 'sanitize'")
    return rows.select("line", F.col("var").alias("variable"), "name", F.array_join("types", ",").alias("types"))


@stated
def php_session(spark, sf):
    """Session values are shown harmlessly until a user's value has been written to the session."""
    files = sources(spark, ("safe.php", "php", "<?php\n$_SESSION['n'] = 'me';\necho $_SESSION['n'];\n"), ("bad.php", "php", "<?php\n$u = $_POST['u'];\n$_SESSION['n'] = $u;\necho $_SESSION['n'];\n"))
    return taint.flows(facts.extract(files)).select("file_path", "line_number", "vuln_type", "source_func").distinct()


@stated
def c_sources(spark, sf):
    """Values that calls return or write, and arguments of a program."""
    text = "int main(int argc, char **argv) {\n  char *a = getenv(\"A\"), *b;\n  b = getenv(\"B\");\n  fgets(c, 10, f);\n  scanf(\"%s\", d);\n  read(0, e, 9);\n  g(getchar());\n}\n"
    return of(spark, "c", text, "source").drop("target", "vuln_type")


@stated
def c_sinks(spark, sf):
    """Sinks by their dangerous argument, or by all of them."""
    text = "void f() {\n  system(a);\n  execl(b, c, d);\n  fopen(path + n, \"r\");\n  system(getenv(\"X\"));\n  popen(\"fixed\", mode);\n  p->open(e);\n}\n"
    return of(spark, "c", text, "sink").drop("target")


@stated
def c_edges(spark, sf):
    """Declarations, declarators of all kinds and assignments; a call's value is its own but for copies of strings."""
    text = "void f(char *q) {\n  char *a = b, c[9] = d;\n  t = foo(1) + s;\n  p->x = q[i];\n  u = strcpy(v, w);\n  const char *m = (const char *) n;\n  int (*fp)(int) = h;\n  k += l * (r - 1);\n}\n"
    return of(spark, "c", text, "edge").drop("vuln_type")


@stated
def c_sanitizers(spark, sf):
    text = "void f() {\n  int n = atoi(s);\n  m = strtol(s, NULL, 10);\n  k = strlen(s);\n}\n"
    rows = facts.extract(sources(spark, ("a.cpp", "cpp", text))).where("kind = 'sanitize'")
    return rows.select("line", F.col("var").alias("variable"), "name", F.array_join("types", ",").alias("types"), "language")


@stated
def code_spans(spark, sf):
    """Lines of classes and functions, with braces in strings and comments left out; classes inside others too."""
    php = "<?php\nclass A {\n  // }\n  function f() { return '}'; }\n}\nclass B extends A\n{\n}\n$g = function () {\n  x();\n};\n"
    c = "static int f(void)\n{\n  if (x) { g(); }\n}\nint h();\n"
    py = "class K:\n    def m(self):\n        return 1\n\n    async def n(self):\n        pass\n"
    return detectors.block_spans(facts.extract(sources(spark, ("a.php", "php", php), ("b.c", "c", c), ("c.py", "python", py)))).select("path", "kind", F.col("start").alias("first_line"), F.col("end").alias("last_line"))


# flows

GRAPH = [("edge", "a", "b", None), ("edge", "b", "c", None), ("edge", "a", "d", None), ("edge", "d", "c", None), ("edge", "c", "e", None), ("edge", "x", "e", None)]


def marked(spark: SparkSession, *marks: tuple[str, str, str | None, list[str] | None]) -> DataFrame:
    """Facts of one file: GRAPH's edges and marks (kind, variable, type, cleaned types)."""
    rows = [{"project_id": "p", "path": "f", "language": "python", "seq": k, "kind": kind, "var": v, "dst": d, "line": k} for k, (kind, v, d, _) in enumerate(GRAPH)]
    rows += [{"project_id": "p", "path": "f", "language": "python", "seq": 100 + k, "kind": kind, "var": v, "vuln_type": vuln, "types": types, "name": f"{kind}:{v}", "code": "", "line": 100 + k} for k, (kind, v, vuln, types) in enumerate(marks)]
    return spark.createDataFrame(rows, facts.FACTS)


CLEANED = [("source", "a", None, None), ("source", "x", None, None), ("sink", "c", "xss", None), ("sink", "c", "ssrf", None), ("sink", "e", "xss", None), ("sanitize", "b", None, ["xss"]), ("sanitize", "x", None, ["all"])]


@stated
def flow_paths(spark, sf):
    """The first path from each source to each sink, unless a node of it cleans for the sink's type."""
    return taint.flows(marked(spark, *CLEANED)).select("source_func", "sink_func", "vuln_type", "data_flow")


@stated
def flow_paths_by_levels(spark, sf):
    """The same for projects with too many edges for a task."""
    return taint.flows(marked(spark, *CLEANED), task_edges=0).select("source_func", "sink_func", "vuln_type", "data_flow")


@stated
def flow_paths_around(spark, sf):
    """Around nodes that clean, where the first path has one."""
    return taint.flows(marked(spark, *CLEANED), around_clean=True).select("source_func", "sink_func", "vuln_type", "data_flow")


@stated
def flow_paths_in_order(spark, sf):
    """Facts folded in order: the last mark of a variable counts, cleaned types are handed on when an edge is added."""
    marks = [("source", "a", None, None), ("sink", "e", "xss", None), ("sink", "e", "ssrf", None), ("sanitize", "d", None, ["ssrf"])]
    return taint.flows(marked(spark, *marks), "compat").select("source_func", "sink_func", "vuln_type", "data_flow")


@stated
def graph_edges(spark, sf):
    """Edges of concatenations and of arguments."""
    rows = spark.createDataFrame([("p", 1, ["a", "b"], "s"), ("p", 2, ["c"], "t")], "project_id string, seq long, parts array<string>, result string")
    args = spark.createDataFrame([("p", 3, "v", "f", "x")], "project_id string, seq long, argument string, function string, parameter string")
    return graph.part_edges(rows).select("seq", "src", "dst").unionByName(graph.argument_edges(args).select("seq", "src", "dst"))


@stated
def taint_grades(spark, sf):
    """Severity by language and type, and weakness numbers; what runs code has its own."""
    py = "import os\ndef f(a):\n    eval(a)\n    os.system(a)\n    open(a)\n"
    files = sources(spark, ("a.py", "python", py), ("b.php", "php", "<?php\nunserialize($_GET['x']);\n"), ("c.c", "c", "int main(int argc, char **argv) {\n  fopen(argv[1], \"r\");\n}\n"))
    return pipeline.taint_findings(facts.extract(files)).select("file_path", "line_number", "vuln_type", "severity", "cwe", "language")


# sources


@stated
def archive_members(spark, sf):
    """Members of archives; a refused archive is one row with its fault."""
    import io
    import tarfile
    import zipfile

    def packed(kind: str, *names: str) -> bytes:
        out = io.BytesIO()
        if kind == "zip":
            with zipfile.ZipFile(out, "w") as z:
                for n in names:
                    z.writestr(n, f"text of {n}")
        else:
            with tarfile.open(fileobj=out, mode=f"w:{kind}") as t:
                for n in names:
                    info = tarfile.TarInfo(n)
                    info.size = len(f"text of {n}")
                    t.addfile(info, io.BytesIO(f"text of {n}".encode()))
        return out.getvalue()

    rows = [("a.zip", packed("zip", "src/x.py", "y.py")), ("b.tar.gz", packed("gz", "../up.py")), ("c.tar.xz", packed("xz", "z.c")), ("d.zip", packed("zip")), ("e.bin", b"no archive")]
    found = corpus.unpacked(spark.createDataFrame(rows, "path string, content binary"))
    return found.select("archive", "name", "size", F.col("content").cast("string").alias("text"), F.split("fault", ":")[0].alias("fault"))


@stated
def files_decoded(spark, sf):
    """Bytes that are no UTF-8 are deleted."""
    rows = [(1, b"plain"), (2, "\u00e9t\u00e9".encode()), (3, b"x = '\xff\xfe1'"), (4, b"")]
    return spark.createDataFrame(rows, "id int, content binary").select("id", corpus.decoded(F.col("content")).alias("text"))


@stated
def numbered_lines(spark, sf):
    """Lines from 1; a last newline begins an empty line."""
    return corpus.code_lines(sources(spark, ("a.py", "python", "x\n\ny\n"), ("b.c", "c", ""))).select("path", "line_no", "code")


@stated
def catalogue_sizes(spark, sf):
    """How many sources, sinks and rules the catalogues hold."""
    from taintloom.functions import catalog

    n = lambda df, what: df.groupBy("language").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "language", "n")
    return n(catalog.sources(spark), "source").unionByName(n(catalog.sinks(spark), "sink")).unionByName(n(rules.rules(spark), "rule"))


@stated
def record_answers(spark, sf):
    """Records of saved answers; a text that is no answer has none."""
    rows = [('{"vulnerabilities": [{"cve": {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "a"}]}}, {"cve": {"id": "CVE-2"}}]}',), ("no json",), ("{}",)]
    return cve.answered(spark.createDataFrame(rows, "text string"), "text").select("id", F.get(F.col("descriptions"), F.lit(0))["value"].alias("description"))


# enrichment


def flows_for(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    files = sources(spark, ("a.php", "php", "<?php\n$a = $_GET['x'];\n$b = htmlspecialchars($a);\necho $b;\n$c = base64_encode($a);\nsystem($c);\n$s = $db->prepare('SELECT ?');\nmysqli_query($c, $s);\n$n = intval($a);\nsystem(escapeshellarg($n));\n"))
    rows = [(1, 2, 4, "xss"), (2, 5, 6, "command_execution"), (3, 7, 8, "sql_injection"), (4, 10, 9, "command_execution"), (5, 2, 2, "ssrf")]
    found = spark.createDataFrame([("p", "a.php", n, a, b, b, v, [f"v{n}", "m", f"w{n}"]) for n, a, b, v in rows], "project_id string, file_path string, finding_id long, source_line int, sink_line int, line_number int, vuln_type string, path array<string>")
    return found, files


@stated
def enriched_flows(spark, sf):
    """Protections and changes between source and sink, whatever their order, and what follows from them."""
    rows = enrich.enrich(*flows_for(spark))
    return rows.select("finding_id", "protection_level", F.array_join("transforms", ",").alias("transforms"), "is_exploitable", "exploit_difficulty", "data_flow_notes", "source_var", "sink_var", "pipeline_stage")


@stated
def safe_downgrade(spark, sf):
    """A safe pattern of the finding's type within three lines makes it info; others stay."""
    found = spark.createDataFrame([("p", "a", line, v, "high", "x → y") for line, v in ((10, "sql_injection"), (14, "sql_injection"), (10, "xss"), (21, "path_traversal"))], "project_id string, file_path string, line_number int, vuln_type string, severity string, data_flow string")
    spots = spark.createDataFrame([("p", "a", 13, "parameterized_query", True), ("p", "a", 18, "allowlist_check", True), ("p", "a", 10, "allowlist_check", False)], "project_id string, file_path string, line_number int, pattern string, is_safe boolean")
    return enrich.downgrade(found, spots).select("line_number", "vuln_type", "severity", "data_flow")


@stated
def sourceless_findings(spark, sf):
    """Findings of the call graph go where their file shows no user input; a missing file, other stages and types stay."""
    files = sources(spark, ("in.php", "php", "<?php $_GET['a'];"), ("no.php", "php", "<?php f();"), ("no.py", "python", "x = 1\n"), ("in.c", "c", "input(x);"))
    rows = [("in.php", "php", "xss", "call_graph"), ("no.php", "php", "xss", "call_graph"), ("no.php", "php", "xss", "taint"), ("no.py", "python", "debug_mode", "call_graph"), ("no.py", "python", "ssrf", "call_graph"), ("gone.py", "python", "ssrf", "call_graph"), ("in.c", "c", "ssrf", "call_graph")]
    found = spark.createDataFrame([("p", *r) for r in rows], "project_id string, file_path string, language string, vuln_type string, pipeline_stage string")
    return enrich.without_sourceless(found, files).select("file_path", "vuln_type", "pipeline_stage")


# detectors


def detected(spark: SparkSession, *files: tuple[str, str, str], spans: bool = False) -> DataFrame:
    code = sources(spark, *files)
    rows = detectors.detect(corpus.code_lines(code), detectors.block_spans(facts.extract(code)) if spans else None)
    return rows.select("file_path", "line_number", "pattern", "confidence", F.array_join("related_types", ",").alias("types"), "is_safe")


@stated
def detect_safe(spark, sf):
    """Parameterised queries with an SQL word near, allow lists, and filters that can be got around."""
    text = "<?php\n$s->bind_param('s', $x);\n$q = 1;\n$r = 'SELECT a';\n\n\n\n$t->bindValue(1, $x);\nif (in_array($a, ['x', 'y'])) {}\n$allowed = ['a'];\n$allowed = $_GET['b'];\n$c = str_replace('select', '', $c);\n$d = strip_tags($d);\n"
    return detected(spark, ("a.php", "php", text))


@stated
def detect_credentials(spark, sf):
    """Credentials by names and values, in files that hold no samples."""
    text = 'password = "hunter2"\napi_key = "changeme"\nkey = "0123456789ab"\nkey = "short"\ndemo_password = "abcdef"\npassword_field = "abcdef"\nsecret = "${X}"\ndb_password = \'it(x)\'\nsecret = "secret"\nmonkey = "0123456789ab"\ntoken = "abcdefgh"\njwt_secret = "ab"  # no\nclient_secret = "q1w2e3"  # yes\n'
    return detected(spark, ("conf.py", "python", text), ("tests/conf.py", "python", text), ("seed_data.py", "python", text), ("test_conf.py", "python", text))


@stated
def detect_others(spark, sf):
    """Debug mode, unchecked archives, and variables that a request overrides."""
    py = "DEBUG = True\napp.run(host='x', debug=True)\nz.extractall(path)\nDEBUG = False\n"
    return detected(spark, ("app.py", "python", py), ("test_app.py", "python", py), ("safe.py", "python", "z.extract(m)\nos.path.commonpath([a])\n"), ("a.php", "php", "<?php extract($_POST);\nextract($data);\n"))


@stated
def detect_combos(spark, sf):
    """Dangerous pairs within eight lines, in one class, or in one Python function; the first line of each pair in a file."""
    far = "$x = 1;\n" * 12
    php = "<?php\nclass A {\nfunction f($d) { return unserialize($d); }\n" + far + "function __wakeup() {}\n}\n"
    other = "<?php\nfunction f($d) { return unserialize($d); }\n" + far + "function __wakeup() {}\n"
    py = "def f(a):\n    eval(a)\n" + "    x = 1\n" * 12 + "    exec(a)\ndef g(a):\n" + "    y = 1\n" * 9 + "    compile(a)\n"
    return detected(spark, ("a.php", "php", php), ("b.php", "php", other), ("c.php", "php", "<?php\neval(1);\n$a = file_get_contents($b);\n"), ("d.py", "python", py), spans=True)


@stated
def detect_charsets(spark, sf):
    """SQL under a wide-byte charset: in the file that sets it, and in others of its project."""
    return detected(spark, ("db.php", "php", "<?php\nmysql_query(\"SET NAMES 'gbk'\");\n$c = \"charset=gbk\";\n"), ("use.php", "php", "<?php\n$a = addslashes($_GET['a']);\nmysql_query($q);\n"))


@stated
def detect_pdo(spark, sf):
    """Concatenated queries, emulated prepares, and charsets in the file or elsewhere in the project."""
    files = [("db.php", "php", "<?php\n$db = new PDO('mysql:host=x;charset=gbk');\n"), ("a.php", "php", "<?php\n$s = $db->prepare('UPDATE x');\n$s->execute([1]);\n$db->query('q ' . $x);\n$db->exec(\"q\" . $x);\n"), ("b.php", "php", "<?php\n$db->setAttribute(PDO::ATTR_EMULATE_PREPARES, true);\n")]
    rows = detectors.pdo(corpus.code_lines(sources(spark, *files)))
    return rows.select("file_path", "line_number", "pattern", "confidence")


@stated
def pattern_grades(spark, sf):
    """Detections as findings: the first related type names them, patterns give severities, safe and weak ones are none."""
    files = sources(spark, ("a.php", "php", "<?php\nextract($_GET);\nif (in_array($a, ['x'])) {}\n$c = str_replace('select', '', $c);\n$db->query('q' . $x);\n"), ("b.py", "python", "DEBUG = True\nz.extractall(p)\npassword = 'hunter2'\neval(a)\nexec(a)\n"))
    rows = pipeline.pattern_findings(detectors.detect(corpus.code_lines(files)).where("pattern <> 'x'"), files)
    return rows.select("file_path", "line_number", "vuln_type", "severity", "language", "confidence")


@stated
def safe_spot_reduction(spark, sf):
    """A safe spot at a finding's lines or beside them takes two grades, to low at the lowest."""
    rows = spark.createDataFrame([(1, "a", 5, 2, 9, "critical"), (2, "a", 20, 20, 20, "high"), (3, "a", 31, 31, 40, "medium"), (4, "b", 5, 5, 5, "high"), (5, "a", 5, 5, 5, "info")], "finding_id long, file_path string, line_number int, source_line int, sink_line int, severity string")
    spots = spark.createDataFrame([("a", 10), ("a", 32), ("a", 6)], "file_path string, line_number int")
    return detectors.safe_spots(rows, spots).select("finding_id", "severity")


# call graph

CALLS = ("chain.py", "python", "def read_input():\n    return input()\n\nasync def run_cmd(c):\n    os.system(c)\n\ndef main():\n    x = read_input()\n    step(x)\n\ndef step(x):\n    run_cmd(x)\n\ndef alone(x):\n    main()\n")


@stated
def call_functions(spark, sf):
    """Functions with what their names and bodies say of them, and what they call."""
    php = "<?php\nfunction load() { return $_GET['a']; }\n$go = function ($x) { system($x); };\nclass A { function m() { load(); $this->n(); } }\n"
    c = "static char *get_input(void) {\n  return x;\n}\nint main() { popen(get_input(), \"r\"); }\n"
    rows = callgraph.functions(sources(spark, CALLS, ("a.php", "php", php), ("b.c", "c", c)))
    return rows.select("path", "name", "line", F.array_join("source_labels", ",").alias("source_labels"), F.array_join("sink_labels", ",").alias("sink_labels"), "vuln_type", F.array_join("called", ",").alias("called"))


@stated
def call_findings(spark, sf):
    """A caller of a source that reaches a sink, in at most four calls."""
    rows = callgraph.findings(callgraph.nodes(callgraph.functions(sources(spark, CALLS))))
    return rows.select("file_path", "line_number", "source_line", "vuln_type", "severity", "data_flow")


# templates

VIEWS = ("views.py", "python", "from flask import request, render_template\ndef v(q):\n    a = request.args.get('x')\n    b = escape(a)\n    c = [a, 1]\n    return render_template('page.html', a=a, b=b, c=c[0], d=f'{q}', e='x', f=str(2))\ndef w(r):\n    g = r if r else ''\n    return render(r, 'page.html', {'g': g, 'h': 1})\ndef u():\n    return render_template('plain.html', z=1)\n")
PAGES = [("t/page.html", "template", "{{ a|safe }}\n{{ b | safe }}\n{% autoescape off %}\n{{ b }}\n{{ c }}\n{% endautoescape %}\n{{ a }}\n<script>\nx = {{ d }};\ny = {{ e }};\n</script>\n{{ a }}\n{{ 'lit'|safe }}\n"), ("t/plain.html", "template", "{{ z|safe }}\n"), ("t/free.html", "template", "{{ q|safe }}\n")]


@stated
def view_variables(spark, sf):
    """Variables with user input that views pass to templates, united over views."""
    rows = templates.template_variables(sources(spark, VIEWS, *PAGES))
    return rows.select("path", F.array_join("variables", ",").alias("variables"))


def template_lines(spark: SparkSession, mode: str) -> DataFrame:
    return templates.findings(sources(spark, VIEWS, *PAGES), mode).select("file_path", "line_number", "sink_code")


@stated
def template_lenient(spark, sf):
    """Variables marked safe, in scripts and in blocks with escaping off; a template that gets no user input is suspect."""
    return template_lines(spark, "lenient")


@stated
def template_strict(spark, sf):
    return template_lines(spark, "strict")


@stated
def template_unlinked(spark, sf):
    return template_lines(spark, "unlinked")


# rules and versions


@stated
def rule_hits(spark, sf):
    """Lines that hold a rule which is active for their project's version, with the severity that it has there."""
    files = spark.createDataFrame([("old", "a.php", "php", "<?php\nmysql_query($a);\n$f = create_function('', $b);\nunserialize($c);\n"), ("new", "a.php", "php", "<?php\nmysql_query($a);\n$f = create_function('', $b);\n"), ("py", "a.py", "python", "exec(a)\nos.system(b)\n"), ("c", "a.c", "c", "gets(a);\nsystem(b);\n")], corpus.FILES)
    versions = spark.createDataFrame([("old", "php", "7.0"), ("new", "php", "8.0"), ("c", "c", "c17")], "project_id string, language string, version string")
    return rules.scan(corpus.code_lines(files), versions=versions).select("project_id", "line_no", "rule_id", "severity")


@stated
def rule_hits_of_table(spark, sf):
    """The same by a join with a table of rules."""
    files = spark.createDataFrame([("old", "a.php", "php", "<?php\nmysql_query($a);\n$f = create_function('', $b);\nunserialize($c);\n"), ("new", "a.php", "php", "<?php\nmysql_query($a);\n$f = create_function('', $b);\n"), ("py", "a.py", "python", "exec(a)\nos.system(b)\n"), ("c", "a.c", "c", "gets(a);\nsystem(b);\n")], corpus.FILES)
    versions = spark.createDataFrame([("old", "php", "7.0"), ("new", "php", "8.0"), ("c", "c", "c17")], "project_id string, language string, version string")
    return rules.scan(corpus.code_lines(files), rules.rules(spark), versions).select("project_id", "line_no", "rule_id", "severity")


@stated
def rule_lookup(spark, sf):
    """Rules by id, and by category and version together."""
    table = rules.rules(spark)
    one = rules.lookup(table, rule_id="PY_OS_SYSTEM").select("language", "rule_id", "category")
    return one.unionByName(rules.lookup(table.where("language = 'php'"), category="command_execution", version="8.0").select("language", "rule_id", "category")).unionByName(rules.lookup(table.where("language = 'php'"), category="command_execution", version="5.3").select("language", "rule_id", "category"))


@stated
def versions_detected(spark, sf):
    """The highest PHP version, or the first of the other languages' lists, that code gives away; comments don't count."""
    files = spark.createDataFrame([("a", "a.php", "php", "<?php $x = $a ?? 1; // fn(\n"), ("b", "a.php", "php", "<?php $f = fn($x) => 1;"), ("b", "b.php", "php", "<?php echo 1;"), ("c", "a.py", "python", "if (n := 3): pass\n# match x:\n"), ("d", "a.py", "python", "x = 1\n"), ("e", "a.cpp", "cpp", "auto f = 3;"), ("f", "a.c", "c", "for (int i = 0;;) {}")], corpus.FILES)
    return rules.detected_versions(files)


@stated
def version_contexts(spark, sf):
    """What versions have, as text."""
    rows = spark.createDataFrame([("php", "5.2"), ("php", "5.5"), ("php", "7.2"), ("php", "8.1"), ("python", "2.7"), ("python", "3.8"), ("python", "3.10"), ("c", "c99"), ("c", "c17"), ("c", "c++11"), ("c", "c++20")], "language string, version string")
    v = F.col("version")
    context = F.when(F.col("language") == "php", F.to_json(rules.php_context(v))).when(F.col("language") == "python", F.to_json(rules.python_context(v))).otherwise(F.to_json(rules.c_context(v)))
    return rows.select("language", "version", context.alias("context"))


@stated
def version_labels(spark, sf):
    return rules.labels(spark)


@stated
def severity_overrides(spark, sf):
    rows = spark.createDataFrame([(1, "7.0"), (2, "5.6"), (3, None)], "id int, version string")
    table = F.create_map(F.lit("7.0"), F.lit("critical"))
    return rows.select("id", T.overridden(table, F.col("version"), F.lit("high")).alias("severity"))


@stated
def comments_stripped(spark, sf):
    rows = spark.createDataFrame([("php", "a // b\nc # d\n/* e\n*/f"), ("c", "a // b\nc # d\n/* e\n*/f"), ("python", "a // b\nc # d\n")], "language string, text string")
    t = F.col("text")
    return rows.select("language", F.when(F.col("language") == "php", T.strip_php_comments(t)).when(F.col("language") == "c", T.strip_c_comments(t)).otherwise(T.strip_python_comments(t)).alias("text"))


# vulnerability records


@stated
def records_parsed(spark, sf):
    """Relevant records, flat, with ecosystem, category, severity and search pattern."""
    text = lambda d, lang="en": [{"lang": lang, "value": d}]
    metric = lambda score, severity: [{"cvssData": {"baseScore": score, "baseSeverity": severity}}]
    at = lambda cpe: [{"nodes": [{"cpeMatch": [{"criteria": cpe, "versionStartIncluding": "1.0", "versionEndExcluding": "2.0"}]}]}]
    rows = [
        {"id": "CVE-1", "published": "2024", "descriptions": text("SQL injection in a plugin"), "metrics": {"cvssMetricV31": metric(9.8, "CRITICAL")}, "weaknesses": [{"description": text("CWE-89")}], "configurations": at("cpe:2.3:a:v:wordpress:1.0")},
        {"id": "CVE-2", "descriptions": text("overflow in function parse_it()"), "metrics": {"cvssMetricV2": metric(7.5, None)}, "configurations": at("cpe:2.3:o:linux:linux_kernel:5")},
        {"id": "CVE-3", "descriptions": text("a python tool allows xss"), "metrics": {}, "weaknesses": [{"description": text("CWE-1")}]},
        {"id": "CVE-4", "descriptions": text("low"), "metrics": {"cvssMetricV31": metric(2.0, "LOW")}, "configurations": at("cpe:2.3:a:v:php:1")},
        {"id": "CVE-5", "descriptions": text("nur deutsch", "de"), "metrics": {}, "configurations": at("cpe:2.3:a:v:php:1")},
        {"id": "CVE-6", "descriptions": text("nothing that is known"), "metrics": {"cvssMetricV30": metric(8.0, "HIGH")}},
        {"id": "CVE-7", "descriptions": text("path traversal"), "metrics": {"cvssMetricV2": metric(4.2, None)}, "configurations": at("cpe:2.3:a:v:scikit_learn:1")},
    ]
    flat = cve.parsed(spark.createDataFrame(rows, cve.RECORD))
    return flat.select("cve_id", "severity", "cvss_score", "ecosystem", "product", "vendor", "version_start", "version_end", "category", "pattern")


@stated
def record_counts(spark, sf):
    rows = spark.createDataFrame([("PHP", "xss"), ("PHP", "xss"), ("C", "ssrf")], "ecosystem string, category string")
    return cve.counts(rows)


@stated
def record_rules(spark, sf):
    """Records with a pattern as rows of the rule table."""
    rows = spark.createDataFrame([("CVE-1-2", "PHP", "xss", "high", "a\\("), ("CVE-3", "Go", "ssrf", "low", "b"), ("CVE-4", "C", "xss", "high", "")], "cve_id string, ecosystem string, category string, severity string, pattern string")
    return cve.as_rules(rows).select("language", "rule_id", "category", "default_severity", "pattern", "confidence")


@stated
def cpe_parts(spark, sf):
    rows = spark.createDataFrame([("cpe:2.3:a:vendor:product:1.0",), ("cpe:2.3:a:vendor",), ("cpe:/a:old:thing",)], "cpe string")
    return rows.select("cpe", T.cpe_part(F.col("cpe"), 3).alias("vendor"), T.cpe_part(F.col("cpe"), 4).alias("product"))


# tools and reports


def tool_lines(spark: SparkSession) -> DataFrame:
    return corpus.code_lines(sources(spark, ("a.php", "php", "<?php\n$id = $_GET['id'] . $_POST['x'];\nsystem($id); eval($id);\n$id2 = $id;\nreturn $idx;\n"), ("b.py", "python", "system(1)\n")))


@stated
def tool_dangerous_calls(spark, sf):
    return detectors.tagged_calls(tool_lines(spark), P.DANGEROUS_CALLS).select("path", "line_no", "category")


@stated
def tool_user_inputs(spark, sf):
    return detectors.user_inputs(tool_lines(spark)).select("path", "line_no", "category")


@stated
def tool_search(spark, sf):
    """A search with a name pattern, and one that is no regular expression."""
    lines = tool_lines(spark)
    found = detectors.search(lines, "SYSTEM", "*.php").select("path", "line_no", "code", "total", F.col("error").isNotNull().alias("failed"))
    return found.unionByName(detectors.search(lines, "(").select("path", "line_no", "code", "total", F.col("error").isNotNull().alias("failed")))


@stated
def tool_trace(spark, sf):
    return detectors.variable_trace(tool_lines(spark), "$id").select("path", "line_no", "use")


@stated
def tool_paths(spark, sf):
    """The file that a path means: itself, below the root, or the first that ends with it."""
    files = spark.createDataFrame([("/w/p/src/A.php",), ("/w/p/lib/a.php",), ("/w/p/b.py",), ("x.c",)], "path string")
    asked = spark.createDataFrame([("x.c",), ("b.py",), ("src\\a.php",), ("a.php",), ("none.c",)], "asked string")
    return report.resolved_paths(asked, files, "/w/p")


@stated
def collected_paths(spark, sf):
    """Which collector takes which path."""
    paths = ["a.py", "A.PY", "env/a.py", "build/a.php", "a.phps", "tmp/a.php", "x.c", "x.hpp", "cmake-x/a.c", "extern/a.c", "third/a.h++", "t.html", "static/t.html", "vendor/a.py", "dist/a.py", "x.cxx"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    taken = [("pipeline", "python"), ("python", "python"), ("pipeline", "php"), ("php", "php"), ("pipeline", "cpp"), ("c", "c"), ("template", "template"), ("tools", "c")]
    names = F.array_compact(F.array(*(F.when(corpus.in_scope(F.col("path"), lang, c), F.lit(f"{c}/{lang}")) for c, lang in taken)))
    return rows.select("path", F.array_join(names, ",").alias("collectors"))


@stated
def member_faults(spark, sf):
    """Why a member of an archive is refused."""
    names = ["", " / ", "/a", "C:\\a", "a/../b", "a/b", "a\\..\\b", "..a"]
    return spark.createDataFrame([(n, corpus.member_fault(n)) for n in names], "name string, fault string")


@stated
def file_languages(spark, sf):
    rows = spark.createDataFrame([("a/B.PHP",), ("x.h",), ("x.h++",), ("y.py",), ("z.txt",), ("none",), ("a.php/b",)], "path string")
    return rows.select("path", T.suffix_language(F.col("path")).alias("language"))


@stated
def listing_order(spark, sf):
    """Findings by severity rank, line and id, with their places."""
    rows = spark.createDataFrame([(1, "low", 3), (2, "critical", 9), (3, "info", 1), (4, "critical", 2), (5, "critical", 2)], "finding_id long, severity string, line_number int")
    ordered = report.ranked(rows)
    return ordered.coalesce(1).agg(F.array_join(F.collect_list("finding_id"), ",").alias("ids"))


@stated
def stored_defaults(spark, sf):
    """What storing a finding fills in."""
    rows = spark.createDataFrame([(1, None, None, None, None, 7), (2, "low", "ast", "confirmed", 3, 4), (3, "high", None, None, 0, None)], "finding_id long, severity string, pipeline_stage string, status string, line_number int, sink_line int")
    return report.stored(rows)


@stated
def analysed_rows(spark, sf):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, verdict string")
    return report.analysed(rows, "verdict").select("id", F.lit("yes").alias("analysed")).unionByName(report.analysed(rows, "verdict", False).select("id", F.lit("no").alias("analysed")))


@stated
def json_repaired(spark, sf):
    """The JSON value in an answer, repaired where it has to be."""
    texts = ['{"a": 1}', 'Sure:\n```json\n{"a": [1, 2,]}\n```', 'so {a: "x", // no\n "b": {"c": 1', "nothing", '{"t": "a\tb"}', "[1, 2] and more"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return rows.select("id", T.json_repair(F.col("text")).alias("json"))


@stated
def parse_failures(spark, sf):
    """Answers that hold no JSON even after repair, for a table of their own."""
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "no json here"), (3, None), (4, "")], "id int, text string")
    return report.parse_failures(rows, "id").select("id", "text")


@stated
def json_fields(spark, sf):
    rows = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "id int, x array<string>")
    return rows.select("id", T.json_field(F.col("x")).alias("json"))


@stated
def keys_masked(spark, sf):
    rows = spark.createDataFrame([("abcdefghijkl",), ("abcdefgh",), ("abc",), ("",)], "key string")
    return rows.select("key", T.masked(F.col("key")).alias("masked"), T.tail_masked(F.col("key")).alias("tail"))


@stated
def heuristic_verdicts(spark, sf):
    rows = spark.createDataFrame([(1, "strong", False, "unlikely", False), (2, "none", True, "easy", False), (3, "partial", True, "medium", True), (4, "none", True, "hard", False)], "id int, protection_level string, is_exploitable boolean, exploit_difficulty string, filtered boolean")
    return verify.applied(verify.heuristic(rows, "filtered")).select("id", "verdict", "confidence", "status", "is_vulnerable")


@stated
def text_blocks(spark, sf):
    """Blocks of lines from each definition to the line before the next; a file without any is one block."""
    rows = corpus.code_lines(sources(spark, ("a.py", "python", "import x\ndef f():\n    pass\nclass A:\n    y = 1"), ("b.py", "python", "x = 1\ny = 2")))
    return relational.blocks(rows, ["path"], F.col("code").rlike(r"^\s*(?:def|class)\s+")).select("path", "block_start", "block_end")


@stated
def braced_blocks(spark, sf):
    """Blocks in languages with braces: one that isn't closed where the next begins is none."""
    php = "<?php\nfunction f() {\n  x();\n}\nfunction g() {\nfunction h() {\n}\n}\nfunction k() {"
    rows = corpus.code_lines(sources(spark, ("a.php", "php", php), ("b.c", "c", "int x;\n}\nint y;")))
    return relational.brace_blocks(rows, ["path"], F.col("code").rlike(r"(?:function|void|int|char|bool|string|class)\s+\w+\s*\(")).select("path", "block_start", "block_end")


@stated
def analysis_cases(spark, sf):
    """The whole analysis over the regression projects."""
    from taintloom.plans import cases

    return cases.findings(spark).select("project_id", "file_path", "line_number", "vuln_type", "severity", "pipeline_stage")


@stated
def analysis_cases_in_order(spark, sf):
    """The same with facts folded in order."""
    from taintloom.plans import cases

    return cases.findings(spark, "compat").select("project_id", "file_path", "line_number", "vuln_type", "severity", "pipeline_stage")
