"""The regression projects: small sources, what they must and must not report, and their analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PHP = "<?php\n"
#: (project, path, language, text)
FILES = [
    ("T1", "run.php", "php", PHP + "$cmd = htmlspecialchars($_GET['cmd']);\nsystem($cmd);\n"),
    ("T2", "show.php", "php", PHP + "$name = htmlspecialchars($_GET['name']);\necho $name;\n"),
    ("T3", "fake.php", "php", PHP + "$allowed = $_GET['c'];\nsystem($allowed);\n"),
    ("T4", "list.php", "php", PHP + "$allowed = ['up', 'down'];\n$c = $_GET['c'];\nif (in_array($c, ['up', 'down'])) {\n  system($c);\n}\n"),
    ("T5", "echo.php", "php", PHP + "echo $_GET['q'];\n"),
    ("T6", "far.php", "php", PHP + "$data = unserialize($_COOKIE['d']);\n" + "$a = 1;\n" * 20 + "class Box {\n  function __destruct() { }\n}\n"),
    ("T7", "names.py", "python", "def read_config(path):\n    return open(path).read()\n\n\ndef query_cache(key):\n    return key\n"),
    ("T8", "shell.py", "python", "import html\nimport os\n\nname = html.escape(input())\nos.system(name)\n"),
    ("T9", "number.py", "python", "import sqlite3\n\nconn = sqlite3.connect('x.db')\ncur = conn.cursor()\nuid = int(input())\ncur.execute('SELECT * FROM t WHERE id = ' + str(uid))\n"),
    ("T10", "sql.php", "php", PHP + "$id = $_GET['id'];\n$sql = \"SELECT * FROM users WHERE id = \" . $id;\nmysqli_query($conn, $sql);\n"),
    ("T11", "a.py", "python", "def build(base, part):\n    return base + part\n"),
    ("T11", "b.py", "python", "import requests\nfrom flask import request\nfrom a import build\n\nurl = build('http://', request.args.get('host'))\nrequests.get(url)\n"),
    ("T12", "scopes.py", "python", "from flask import request, render_template_string\n\n\ndef first():\n    page = 'fixed'\n    return render_template_string(page)\n\n\ndef second():\n    page = request.data\n    return render_template_string(page)\n"),
    ("C1", "num.c", "c", '#include <stdio.h>\nint main() {\n  char *s = getenv("N");\n  int n = atoi(s);\n  printf("%d", n);\n  return 0;\n}\n'),
    ("C2", "cmd.c", "c", '#include <stdlib.h>\nint main() {\n  char *s = getenv("CMD");\n  system(s);\n  return 0;\n}\n'),
    ("E1", "config.py", "python", 'DEBUG = True\ndb_password = "hunter2hunter2"\napi_key = "changeme"\n'),
    ("E2", "chain.py", "python", "def read_input():\n    return input()\n\n\ndef run_cmd(c):\n    import os\n    os.system(c)\n\n\ndef main():\n    run_cmd(read_input())\n"),
    ("E3", "page.html", "template", "<p>{{ name|safe }}</p>\n<script>\nvar a = {{ q }};\n</script>\n{{ fine }}\n"),
    ("E4", "bad.py", "python", "def broken(:\n"),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "project_id string, path string, language string, text string")


def findings(spark: SparkSession, mode: str = "declarative") -> DataFrame:
    from .pipeline import analyse

    return analyse(files(spark), mode)
