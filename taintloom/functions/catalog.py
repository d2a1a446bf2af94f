"""Catalogues that the analysis joins with: sources, sinks, severities, weakness numbers and version orders.

The tables hold API facts. They are small and of fixed size, which is what allows them to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Weakness number of a vulnerability type.
CWE = {
    "sql_injection": "CWE-89",
    "command_execution": "CWE-78",
    "code_injection": "CWE-94",
    "ssrf": "CWE-918",
    "path_traversal": "CWE-22",
    "arbitrary_file_read": "CWE-22",
    "insecure_deserialization": "CWE-502",
    "deserialization": "CWE-502",
    "open_redirect": "CWE-601",
    "xxe": "CWE-611",
    "xss": "CWE-79",
    "ssti": "CWE-94",
    "hardcoded_credentials": "CWE-798",
    "debug_mode": "CWE-215",
    "file_upload": "CWE-434",
}

# Severity of a vulnerability type by stage or language; what is absent is medium.
SEVERITY = {
    "python": {"command_execution": "critical", "sql_injection": "high", "ssrf": "high", "path_traversal": "medium", "arbitrary_file_read": "medium", "insecure_deserialization": "high", "code_injection": "critical", "open_redirect": "medium", "xxe": "high", "xss": "low", "ssti": "critical", "hardcoded_credentials": "high", "debug_mode": "low"},
    "php": {"command_execution": "critical", "sql_injection": "high", "ssrf": "high", "deserialization": "high", "file_upload": "high", "path_traversal": "medium", "arbitrary_file_read": "medium", "xss": "low"},
    "c": {"command_execution": "critical", "path_traversal": "medium", "arbitrary_file_read": "medium"},
    "call_graph": {"command_execution": "critical", "sql_injection": "high", "deserialization": "high", "insecure_deserialization": "high", "code_injection": "critical", "file_upload": "high", "ssrf": "high", "path_traversal": "medium", "arbitrary_file_read": "medium", "xss": "low", "xxe": "high", "open_redirect": "medium", "ssti": "critical"},
}

# Calls that clean a value; no types are all types.
SANITIZERS = {
    "python": {
        "builtins.int": [],
        "builtins.float": [],
        "builtins.bool": [],
        "html.escape": ["xss"],
        "cgi.escape": ["xss"],
        "markupsafe.escape": ["xss"],
        "bleach.clean": ["xss"],
        "shlex.quote": ["command_execution"],
        "os.path.basename": ["path_traversal", "arbitrary_file_read"],
    },
    "php": {
        "intval": [],
        "floatval": [],
        "boolval": [],
        "htmlspecialchars": ["xss"],
        "htmlentities": ["xss"],
        "strip_tags": ["xss"],
        "filter_var": ["xss"],
        "mysqli_real_escape_string": ["sql_injection"],
        "mysql_real_escape_string": ["sql_injection"],
        "pg_escape_string": ["sql_injection"],
        "pg_escape_literal": ["sql_injection"],
        "sqlite_escape_string": ["sql_injection"],
        "escapeshellcmd": ["command_execution"],
        "escapeshellarg": ["command_execution"],
    },
    "c": {
        "atoi": [],
        "atol": [],
        "atoll": [],
        "atof": [],
        "strtol": [],
        "strtoul": [],
        "strtoll": [],
        "strtoull": [],
        "strtod": [],
        "strtof": [],
        "strtold": [],
    },
}

# Listing order of severities; every other value, such as info, comes behind.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}

# Python sinks with the dangerous argument; None is unset, which means the first.
PYTHON_SINKS = {
    "sql_injection": [
        ("sqlite3.Cursor.execute", 0),
        ("sqlite3.Cursor.executemany", 0),
        ("sqlite3.execute", 0),
        ("pymysql.cursors.Cursor.execute", 0),
        ("MySQLdb.cursors.Cursor.execute", 0),
        ("psycopg2.extensions.execute", 0),
        ("django.db.connection.execute", 0),
        ("records.Database.query", 0),
        ("sqlalchemy.engine.execute", 0),
        ("builtins.str.format", None),
        ("builtins.fstring", None),
        ("db.Cursor.execute", 0),
        ("db.Cursor.executemany", 0),
        ("db.Cursor.executescript", 0),
        ("db.Connection.execute", 0),
        ("db.Connection.executemany", 0),
        ("django.db.models.query.raw", 0),
    ],
    "command_execution": [
        ("os.system", 0),
        ("os.popen", 0),
        ("os.execv", None),
        ("os.execve", None),
        ("os.execl", None),
        ("os.execlp", None),
        ("os.execvp", None),
        ("os.spawnl", None),
        ("os.spawnlp", None),
        ("os.posix_spawn", None),
        ("pty.spawn", 0),
        ("subprocess.call", None),
        ("subprocess.run", None),
        ("subprocess.Popen", None),
        ("subprocess.check_output", None),
        ("subprocess.check_call", None),
        ("builtins.eval", 0),
        ("builtins.exec", 0),
        ("builtins.compile", None),
        ("asyncio.create_subprocess_shell", None),
    ],
    "ssrf": [
        ("requests.get", 0),
        ("requests.post", 0),
        ("requests.put", 0),
        ("requests.delete", 0),
        ("requests.head", 0),
        ("requests.request", 0),
        ("httpx.get", 0),
        ("httpx.post", 0),
        ("httpx.request", 0),
        ("urllib.request.urlopen", 0),
        ("urllib.request.urlretrieve", 0),
        ("aiohttp.ClientSession.get", 0),
        ("aiohttp.ClientSession.post", 0),
    ],
    "path_traversal": [
        ("builtins.open", 0),
        ("pathlib.Path", 0),
        ("pathlib.read_text", 0),
        ("flask.send_file", 0),
        ("flask.send_from_directory", 0),
        ("fastapi.responses.FileResponse", 0),
        ("starlette.responses.FileResponse", 0),
        ("aiohttp.web.FileResponse", 0),
        ("os.rename", None),
        ("os.remove", 0),
        ("os.unlink", 0),
        ("os.makedirs", 0),
        ("shutil.move", None),
        ("shutil.copy", None),
        ("shutil.copyfile", None),
        ("shutil.copytree", None),
    ],
    "insecure_deserialization": [
        ("pickle.loads", 0),
        ("pickle.load", 0),
        ("yaml.load", 0),
        ("yaml.unsafe_load", 0),
        ("marshal.loads", 0),
    ],
    "xxe": [
        ("lxml.etree.parse", 0),
        ("xmltodict.parse", 0),
        ("lxml.etree.fromstring", 0),
        ("xml.etree.ElementTree.parse", 0),
        ("xml.etree.ElementTree.fromstring", 0),
        ("xml.dom.minidom.parse", 0),
        ("xml.dom.minidom.parseString", 0),
    ],
    "open_redirect": [
        ("flask.redirect", 0),
        ("django.http.HttpResponseRedirect", 0),
        ("django.http.HttpResponsePermanentRedirect", 0),
        ("fastapi.responses.RedirectResponse", 0),
        ("starlette.responses.RedirectResponse", 0),
    ],
    "ssti": [
        ("flask.render_template_string", 0),
        ("jinja2.Template", 0),
        ("jinja2.Environment.from_string", 0),
    ],
    "xss": [
        ("markupsafe.Markup", 0),
        ("flask.Response", 0),
        ("django.http.HttpResponse", 0),
        ("django.http.JsonResponse", 0),
    ],
}

# PHP sinks.
PHP_SINKS = {
    "sql_injection": [
        ("mysqli_query", 1),
        ("mysqli_real_query", 1),
        ("mysql_query", 0),
        ("mysqli_prepare", 1),
        ("pg_query", 0),
        ("sqlite_query", 0),
        ("PDO::query", 0),
        ("PDO::exec", 0),
        ("odbc_exec", 0),
    ],
    "command_execution": [
        ("system", 0),
        ("exec", 0),
        ("shell_exec", 0),
        ("passthru", 0),
        ("popen", 0),
        ("proc_open", 0),
        ("pcntl_exec", 0),
        ("eval", 0),
        ("assert", 0),
        ("create_function", 0),
        ("preg_replace", 0),
        ("call_user_func", 0),
    ],
    "ssrf": [
        ("curl_exec", 0),
        ("curl_multi_exec", 0),
        ("fsockopen", 0),
        ("stream_socket_client", 0),
        ("pfsockopen", 0),
    ],
    "path_traversal": [
        ("include", 0),
        ("require", 0),
        ("include_once", 0),
        ("require_once", 0),
        ("file_get_contents", 0),
        ("file_put_contents", 0),
        ("fopen", 0),
        ("readfile", 0),
        ("unlink", 0),
        ("copy", 0),
        ("rename", 0),
        ("mkdir", 0),
        ("rmdir", 0),
        ("chdir", 0),
        ("chmod", 0),
        ("chown", 0),
        ("glob", 0),
        ("scandir", 0),
    ],
    "arbitrary_file_read": [
        ("fread", 0),
        ("fgets", 0),
        ("fgetcsv", 0),
    ],
    "xss": [
        ("echo", 0),
        ("print", 0),
        ("printf", 0),
        ("die", 0),
    ],
    "deserialization": [
        ("unserialize", 0),
    ],
    "file_upload": [
        ("move_uploaded_file", 1),
    ],
}

# C and C++ sinks; None means every argument here.
C_SINKS = {
    "command_execution": [
        ("system", 0),
        ("popen", 0),
        ("execve", None),
        ("execvp", None),
        ("execl", None),
        ("execle", None),
        ("execlp", None),
        ("execvpe", None),
        ("CreateProcess", None),
        ("CreateProcessA", None),
        ("CreateProcessW", None),
        ("ShellExecute", None),
        ("WinExec", None),
        ("dlopen", None),
        ("LoadLibrary", None),
        ("LoadLibraryA", None),
    ],
    "path_traversal": [
        ("fopen", 0),
        ("open", 0),
        ("openat", 1),
        ("opendir", 0),
        ("freopen", None),
        ("remove", 0),
        ("rename", None),
        ("chmod", 0),
        ("stat", 0),
        ("lstat", 0),
        ("access", 0),
        ("realpath", None),
        ("mkdir", 0),
    ],
    "arbitrary_file_read": [
        ("read", 0),
        ("fread", 3),
        ("fgets", 2),
        ("fscanf", 0),
        ("write", 0),
        ("fwrite", 3),
    ],
}

# Sources by language. C: "return", or the arguments that are written.
PYTHON_SOURCES = [
    "flask.request.args.get",
    "flask.request.args.__getitem__",
    "flask.request.form.get",
    "flask.request.form.__getitem__",
    "flask.request.json.get",
    "flask.request.json.__getitem__",
    "flask.request.values.get",
    "flask.request.values.__getitem__",
    "flask.request.cookies.get",
    "flask.request.cookies.__getitem__",
    "flask.request.headers.get",
    "flask.request.headers.__getitem__",
    "flask.request.data",
    "flask.request.json",
    "flask.request.get_json",
    "flask.request.get_data",
    "flask.request.headers",
    "flask.request.cookies",
    "flask_restful.api.payload",
    "flask_restful.parser.parse_args",
    "django.http.request.GET",
    "django.http.request.POST",
    "django.http.request.GET.get",
    "django.http.request.GET.__getitem__",
    "django.http.request.POST.get",
    "django.http.request.POST.__getitem__",
    "django.http.request.COOKIES.get",
    "django.http.request.COOKIES.__getitem__",
    "django.http.request.headers.get",
    "django.http.request.headers.__getitem__",
    "builtins.input",
    "sys.argv",
    "os.environ",
    "os.getenv",
    "builtins.__import__",
    "urllib.parse.parse_qs",
    "urllib.parse.parse_qsl",
]
PHP_SOURCES = ["$_GET", "$_REQUEST", "$_POST", "$_SERVER", "getallheaders()", "apache_request_headers()", "$_COOKIE", "$_FILES", "php://input", "file_get_contents('php://input')", "$HTTP_RAW_POST_DATA", "$_ENV", "getenv()", "$argv", "$argc", "$_SESSION", "file_get_contents()", "fread()", "fgets()", "file()", "readfile()", "mysqli_fetch_assoc()", "mysqli_fetch_array()", "PDO::fetch()"]
C_SOURCES = {"getenv": "return", "secure_getenv": "return", "scanf": "1", "fscanf": "1", "fgets": "0", "gets": "0", "getc": "return", "fgetc": "return", "getchar": "return", "read": "1", "recv": "1", "recvfrom": "1", "readline": "return", "GetCommandLineW": "return", "CommandLineToArgvW": "return", "readfile": "return", "mmap": "return"}

# Order of the C and C++ standards; what is absent counts as 0.
STANDARD_RANK = {"c89": 0, "c90": 0, "c99": 1, "c11": 2, "c17": 3, "c23": 4, "c++98": 10, "c++03": 10, "c++11": 11, "c++14": 12, "c++17": 13, "c++20": 14, "c++23": 15}

# File suffixes by language, and folders that are left out.
SUFFIXES = {
    "python": [".py"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".c++", ".h++"],
    "php": [".php", ".php3", ".php4", ".php5", ".phtml", ".pht", ".inc"],
    "template": [".html", ".htm", ".jinja2", ".j2", ".tmpl"],
}
EXCLUDED_FOLDERS = ["__pycache__", ".git", "vendor", "node_modules", ".venv", "venv", "env", "site-packages", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".eggs"]


# Folders and suffixes of the other collectors.
PYTHON_SKIPPED = ["__pycache__", ".git", ".venv", "venv", "env", "node_modules", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", "site-packages", "vendor"]
PHP_SKIPPED = ["__pycache__", ".git", ".venv", "venv", "build", "node_modules", "vendor", "cache", "storage", "tmp"]
C_SKIPPED = ["__pycache__", ".git", ".venv", "venv", "build", "node_modules", "third_party", "vendor", "extern", "external"]
TEMPLATE_SKIPPED = ["__pycache__", ".git", "node_modules", "vendor", "venv", "env", "dist", "build", "site-packages", "static", "bower_components"]
TOOL_SKIPPED = ["__pycache__", ".git", "vendor", "node_modules", ".venv", "venv"]
TOOL_SUFFIXES = [".php", ".php3", ".php4", ".php5", ".phtml", ".pht", ".inc", ".py", ".c", ".h", ".cpp", ".hpp"]

# What each collector takes and leaves out.
COLLECTORS = {
    "pipeline": {"suffixes": SUFFIXES, "any_case": True, "excluded": EXCLUDED_FOLDERS, "excluded_beginnings": [], "folders_only": False},
    "python": {"suffixes": {"python": [".py"]}, "any_case": False, "excluded": PYTHON_SKIPPED, "excluded_beginnings": [], "folders_only": True},
    "php": {"suffixes": {"php": [*SUFFIXES["php"], ".phps"]}, "any_case": True, "excluded": PHP_SKIPPED, "excluded_beginnings": [], "folders_only": True},
    "c": {"suffixes": {x: [*SUFFIXES["c"], *SUFFIXES["cpp"]] for x in ("c", "cpp")}, "any_case": True, "excluded": C_SKIPPED, "excluded_beginnings": ["cmake"], "folders_only": True},
    "template": {"suffixes": {"template": SUFFIXES["template"]}, "any_case": True, "excluded": TEMPLATE_SKIPPED, "excluded_beginnings": [], "folders_only": True},
    "tools": {"suffixes": {x: TOOL_SUFFIXES for x in ("php", "python", "c", "cpp")}, "any_case": True, "excluded": TOOL_SKIPPED, "excluded_beginnings": [], "folders_only": False},
}


def sink_rows(table: dict[str, list[tuple[str, int | None]]]) -> list[tuple[int, str, str, str, int | None]]:
    """(order, vuln_type, name, short name, argument or None) of a sink table, in its order."""
    every = [(vuln, name, arg) for vuln, names in table.items() for name, arg in names]
    return [(k, vuln, name, name.replace("::", ".").rsplit(".", 1)[-1], arg) for k, (vuln, name, arg) in enumerate(every)]


def sinks(spark: SparkSession) -> DataFrame:
    """(language, ord, vuln_type, name, short, arg): all sinks of the three languages."""
    rows = [(lang, *r) for lang, t in (("python", PYTHON_SINKS), ("php", PHP_SINKS), ("c", C_SINKS)) for r in sink_rows(t)]
    return spark.createDataFrame(rows, "language string, ord int, vuln_type string, name string, short string, arg int")


def sources(spark: SparkSession) -> DataFrame:
    """(language, ord, name, mode): all sources of the three languages."""
    rows = [("python", k, n, "value") for k, n in enumerate(PYTHON_SOURCES)]
    rows += [("php", k, n, "array_item" if n.startswith("$_") or n == "$argv" else "value") for k, n in enumerate(PHP_SOURCES)]
    rows += [("c", k, n, m) for k, (n, m) in enumerate(C_SOURCES.items())]
    return spark.createDataFrame(rows, "language string, ord int, name string, mode string")


def lookup(values: dict[str, object], column, default):
    """A map literal's value for a column, `default` where it has none: a lookup join without a join."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def severity(stage: str, vuln_type):
    return lookup(SEVERITY[stage], vuln_type, "medium")


def cwe(vuln_type):
    return lookup(CWE, vuln_type, "")


def severity_rank(column):
    return lookup(SEVERITY_RANK, column, 4)
