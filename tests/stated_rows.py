"""What the queries of `stated_queries` must give: per query the columns with their types, and the rows."""

EXPECTED = {
    "py_scopes": (
        "kind string, name string, variable string, params string, kwonly string, prefix string",
        [
            ("function", "Outer.method", None, "self,a", "key", "a.py@Outer.method:"),
            ("function", "Outer.method.inner", None, "b", "", "a.py@Outer.method.inner:"),
            ("function", "plain", None, "c,d", "", "a.py@plain:"),
            ("source", "function.parameter", "a.py@Outer.method.inner:b", None, None, None),
            ("source", "function.parameter", "a.py@Outer.method:a", None, None, None),
            ("source", "function.parameter", "a.py@Outer.method:key", None, None, None),
            ("source", "function.parameter", "a.py@Outer.method:more", None, None, None),
            ("source", "function.parameter", "a.py@Outer.method:rest", None, None, None),
            ("source", "function.parameter", "a.py@plain:c", None, None, None),
            ("source", "function.parameter", "a.py@plain:d", None, None, None),
            ("var", "attr", "a.py@:attr", None, None, None),
            ("var", "item", "a.py@:item", None, None, None),
            ("var", "top", "a.py@:top", None, None, None),
        ],
    ),
    "py_imports": (
        "path string, line int, name string, target string",
        [
            ("pkg/sub/mod.py", 1, "os", "os"),
            ("pkg/sub/mod.py", 2, "osp", "os.path"),
            ("pkg/sub/mod.py", 3, "a", "a"),
            ("pkg/sub/mod.py", 4, "r", "flask.request"),
            ("pkg/sub/mod.py", 5, "near", "pkg.sub.near"),
            ("pkg/sub/mod.py", 6, "far", "pkg.up.far"),
        ],
    ),
    "py_modules": (
        "path string, module string, name string",
        [
            ("src/app.py", "app", "z"),
            ("src/store/__init__.py", "store", "y"),
            ("src/store/db.py", "store.db", "x"),
        ],
    ),
    "py_errors": (
        "path string, kind string, name string, line int",
        [
            ("bad.py", "error", "SyntaxError", 1),
            ("good.py", "var", "x", None),
        ],
    ),
    "py_sources": (
        "kind string, line int, variable string, target string, name string, vuln_type string",
        [
            ("source", 3, "a.py@:call@3:4", None, "flask.request.args.get", None),
            ("source", 4, "a.py@:call@4:4", None, "flask.request.args.get", None),
            ("source", 5, "a.py@:item@5:4", None, "flask.request.form.__getitem__", None),
            ("source", 6, "a.py@:attr@6:4", None, "sys.argv", None),
            ("source", 6, "a.py@:item@6:4", None, "sys.argv", None),
            ("source", 7, "a.py@:call@7:4", None, "builtins.input", None),
            ("source", 8, "a.py@:call@8:4", None, "os.getenv", None),
            ("source", 9, "a.py@:attr@9:4", None, "api.payload", None),
            ("source", 11, "a.py@:attr@11:4", None, "flask.request.data", None),
        ],
    ),
    "py_sinks": (
        "kind string, line int, variable string, target string, name string, vuln_type string",
        [
            ("sink", 3, "a.py@:a", None, "os.system", "command_execution"),
            ("sink", 5, "a.py@:b", None, "subprocess.run", "command_execution"),
            ("sink", 6, "a.py@:c", None, "subprocess.call", "command_execution"),
            ("sink", 7, "a.py@:d", None, "django.db.models.query.raw", "sql_injection"),
            ("sink", 10, "a.py@:e", None, "db.Cursor.execute", "sql_injection"),
            ("sink", 11, "a.py@:f", None, "db.executemany", "sql_injection"),
            ("sink", 12, "a.py@:g", None, "db.execute", "sql_injection"),
            ("sink", 13, "a.py@:h", None, "builtins.eval", "command_execution"),
            ("sink", 14, "a.py@:i", None, "lxml.etree.parse", "xxe"),
        ],
    ),
    "py_edges": (
        "kind string, line int, variable string, target string, name string",
        [
            ("edge", 2, "a.py@f:a", "a.py@f:x", "assign"),
            ("edge", 2, "a.py@f:d", "a.py@f:item@2:12", "attribute"),
            ("edge", 2, "a.py@f:item@2:12", "a.py@f:x", "assign"),
            ("edge", 3, "a.py@f:a", "a.py@f:attr@3:15", "attribute"),
            ("edge", 3, "a.py@f:attr@3:15", "a.py@f:y", "assign"),
            ("edge", 3, "a.py@f:x", "a.py@f:y", "assign"),
            ("edge", 4, "a.py@f:x", "a.py@f:w", "assign"),
            ("edge", 4, "a.py@f:x", "a.py@f:z", "assign"),
            ("edge", 4, "a.py@f:y", "a.py@f:w", "assign"),
            ("edge", 4, "a.py@f:y", "a.py@f:z", "assign"),
            ("edge", 5, "a.py@f:a", "a.py@f:w", "assign"),
            ("edge", 6, "a.py@f:z", "a.py@f:i", "loop"),
            ("edge", 8, "a.py@f:x", "a.py@f:v", "assign"),
            ("edge", 8, "a.py@f:y", "a.py@f:v", "assign"),
            ("edge", 9, "a.py@f:a", "a.py@f:u", "assign"),
            ("edge", 9, "a.py@f:call@9:8", "a.py@f:u", "assign"),
            ("edge", 9, "a.py@f:d", "a.py@f:u", "assign"),
            ("edge", 11, "a.py@f:x", "a.py@f:s", "assign"),
            ("edge", 12, "a.py@f:v", "a.py@f:#ret", "return"),
        ],
    ),
    "py_sanitizers": (
        "line int, variable string, name string, types string",
        [
            (2, "a.py@:a", "builtins.int", "all"),
            (3, "a.py@:b", "html.escape", "xss"),
            (4, "a.py@:c", "shlex.quote", "command_execution"),
            (5, "a.py@:d", "os.path.basename", "path_traversal,arbitrary_file_read"),
        ],
    ),
    "py_calls": (
        "path string, line int, name string, prefix string",
        [
            ("a.py", 3, "Box.get", "a.py@Box.get:"),
            ("b.py", 5, "near", "a.py@near:"),
            ("b.py", 6, "a.near", "a.py@near:"),
            ("b.py", 7, "other.near", "a.py@near:"),
            ("b.py", 8, "Box.put", "a.py@Box.put:"),
            ("b.py", 10, "go", "b.py@go:"),
        ],
    ),
    "py_links": (
        "variable string, target string, line int",
        [
            ("a.py@:limit", "b.py@:attr@3:4", 3),
            ("a.py@f:#ret", "b.py@:call@2:4", 2),
            ("b.py@:p", "a.py@f:x", 2),
            ("b.py@:q", "a.py@f:y", 2),
            ("b.py@:s", "a.py@f:k", 2),
        ],
    ),
    "php_sources": (
        "kind string, line int, variable string, name string",
        [
            ("function_source", 10, "a.php@:getenv()@10:5", "getenv()"),
            ("source", 2, "a.php@:$_GET@2:5", "$_GET"),
            ("source", 3, "a.php@:$_SERVER@3:5", "$_SERVER"),
            ("source", 4, "a.php@:$_SERVER@4:5", "$_SERVER"),
            ("source", 5, "a.php@:$_POST@5:2", "$_POST"),
            ("source", 9, "a.php@:$_GET@9:8", "$_GET"),
        ],
    ),
    "php_sinks": (
        "kind string, line int, variable string, name string, vuln_type string",
        [
            ("sink", 2, "a.php@:$a", "system", "command_execution"),
            ("sink", 3, "a.php@:$b", "mysqli_query", "sql_injection"),
            ("sink", 5, "a.php@:$d", "eval", "command_execution"),
            ("sink", 9, "a.php@:$i", "move_uploaded_file", "file_upload"),
        ],
    ),
    "php_echo": (
        "kind string, line int, variable string, name string, vuln_type string",
        [
            ("sink", 2, "a.php@:$a", "echo", "xss"),
            ("sink", 2, "a.php@:$b", "echo", "xss"),
            ("sink", 7, "a.php@:$i", "echo", "xss"),
            ("sink", 9, "a.php@:$j", "echo", "xss"),
        ],
    ),
    "php_edges": (
        "kind string, line int, variable string, target string, name string",
        [
            ("edge", 2, "a.php@:$b", "a.php@:$a", "assign"),
            ("edge", 2, "a.php@:$b", "a.php@:$c", "concat"),
            ("edge", 2, "a.php@:$c", "a.php@:$a", "assign"),
            ("edge", 2, "a.php@:$c", "a.php@:$b", "concat"),
            ("edge", 3, "a.php@:$e", "a.php@:$d", "assign"),
            ("edge", 3, "a.php@:$f", "a.php@:$d", "assign"),
            ("edge", 4, "a.php@:$h", "a.php@:$g", "assign"),
            ("edge", 5, "a.php@:$k", "a.php@:$i", "assign"),
            ("edge", 5, "a.php@:$k", "a.php@:$j", "assign"),
            ("edge", 6, "a.php@:$m", "a.php@:$l", "assign"),
            ("edge", 6, "a.php@:$o", "a.php@:$n", "assign"),
            ("edge", 6, "a.php@:$p", "a.php@:$n", "assign"),
        ],
    ),
    "php_sanitizers": (
        "line int, variable string, name string, types string",
        [
            (2, "a.php@:$a", "intval", "all"),
            (3, "a.php@:$b", "htmlspecialchars", "xss"),
            (4, "a.php@:$c", "mysqli_real_escape_string", "sql_injection"),
            (5, "a.php@:$d", "escapeshellarg", "command_execution"),
        ],
    ),
    "php_session": (
        "file_path string, line_number int, vuln_type string, source_func string",
        [
            ("bad.php", 4, "xss", "$_SESSION"),
        ],
    ),
    "c_sources": (
        "kind string, line int, variable string, name string",
        [
            ("source", 1, "a.c@:argv", "function_argv"),
            ("source", 2, "a.c@:a", "getenv"),
            ("source", 3, "a.c@:b", "getenv"),
            ("source", 4, "a.c@:c", "fgets"),
            ("source", 5, "a.c@:d", "scanf"),
            ("source", 6, "a.c@:e", "read"),
            ("source", 7, "a.c@:getchar@7:4", "getchar"),
        ],
    ),
    "c_sinks": (
        "kind string, line int, variable string, name string, vuln_type string",
        [
            ("sink", 2, "a.c@:a", "system", "command_execution"),
            ("sink", 3, "a.c@:b", "execl", "command_execution"),
            ("sink", 3, "a.c@:c", "execl", "command_execution"),
            ("sink", 3, "a.c@:d", "execl", "command_execution"),
            ("sink", 4, "a.c@:n", "fopen", "path_traversal"),
            ("sink", 4, "a.c@:path", "fopen", "path_traversal"),
            ("sink", 5, "a.c@:getenv@5:9", "system", "command_execution"),
        ],
    ),
    "c_edges": (
        "kind string, line int, variable string, target string, name string",
        [
            ("edge", 2, "a.c@:b", "a.c@:a", "assign"),
            ("edge", 2, "a.c@:d", "a.c@:c", "assign"),
            ("edge", 3, "a.c@:s", "a.c@:t", "assign"),
            ("edge", 4, "a.c@:i", "a.c@:p", "assign"),
            ("edge", 4, "a.c@:q", "a.c@:p", "assign"),
            ("edge", 5, "a.c@:w", "a.c@:u", "assign"),
            ("edge", 6, "a.c@:n", "a.c@:m", "assign"),
            ("edge", 7, "a.c@:h", "a.c@:fp", "assign"),
            ("edge", 8, "a.c@:l", "a.c@:k", "assign"),
            ("edge", 8, "a.c@:r", "a.c@:k", "assign"),
        ],
    ),
    "c_sanitizers": (
        "line int, variable string, name string, types string, language string",
        [
            (2, "a.cpp@:n", "atoi", "all", "c"),
            (3, "a.cpp@:m", "strtol", "all", "c"),
        ],
    ),
    "code_spans": (
        "path string, kind string, first_line int, last_line int",
        [
            ("a.php", "class", 2, 5),
            ("a.php", "class", 6, 8),
            ("a.php", "function", 4, 4),
            ("a.php", "function", 9, 11),
            ("b.c", "function", 1, 4),
            ("c.py", "function", 2, 3),
            ("c.py", "function", 5, 6),
        ],
    ),
    "flow_paths": (
        "source_func string, sink_func string, vuln_type string, data_flow string",
        [
            ("source:a", "sink:c", "ssrf", "a → b → c"),
        ],
    ),
    "flow_paths_by_levels": (
        "source_func string, sink_func string, vuln_type string, data_flow string",
        [
            ("source:a", "sink:c", "ssrf", "a → b → c"),
        ],
    ),
    "flow_paths_around": (
        "source_func string, sink_func string, vuln_type string, data_flow string",
        [
            ("source:a", "sink:c", "ssrf", "a → b → c"),
            ("source:a", "sink:c", "xss", "a → d → c"),
            ("source:a", "sink:e", "xss", "a → d → c → e"),
        ],
    ),
    "flow_paths_in_order": (
        "source_func string, sink_func string, vuln_type string, data_flow string",
        [
            ("source:a", "sink:e", "ssrf", "a → b → c → e"),
        ],
    ),
    "graph_edges": (
        "seq long, src string, dst string",
        [
            (1, "a", "s"),
            (1, "b", "s"),
            (2, "c", "t"),
            (3, "v", "f::x"),
        ],
    ),
    "taint_grades": (
        "file_path string, line_number int, vuln_type string, severity string, cwe string, language string",
        [
            ("a.py", 3, "command_execution", "critical", "CWE-94", "python"),
            ("a.py", 4, "command_execution", "critical", "CWE-78", "python"),
            ("a.py", 5, "path_traversal", "medium", "CWE-22", "python"),
            ("b.php", 2, "deserialization", "high", None, "php"),
            ("c.c", 2, "path_traversal", "medium", None, "c"),
        ],
    ),
    "enriched_flows": (
        "finding_id long, protection_level string, transforms string, is_exploitable boolean, exploit_difficulty string, data_flow_notes string, source_var string, sink_var string, pipeline_stage string",
        [
            (1, "strong", "none", False, "unlikely", "protected", "v1", "w1", "data_flow"),
            (2, "none", "encode", True, "easy", "no protection on the way; the value is encoded", "v2", "w2", "data_flow"),
            (3, "strong", "none", False, "unlikely", "protected", "v3", "w3", "data_flow"),
            (4, "partial", "type_cast", True, "medium", "protected in part; the value is cast", "v4", "w4", "data_flow"),
            (5, "none", "none", True, "easy", "no protection on the way", "v5", "w5", "data_flow"),
        ],
    ),
    "safe_downgrade": (
        "line_number int, vuln_type string, severity string, data_flow string",
        [
            (10, "sql_injection", "info", "[safe pattern] x → y"),
            (10, "xss", "high", "x → y"),
            (14, "sql_injection", "info", "[safe pattern] x → y"),
            (21, "path_traversal", "info", "[safe pattern] x → y"),
        ],
    ),
    "sourceless_findings": (
        "file_path string, vuln_type string, pipeline_stage string",
        [
            ("gone.py", "ssrf", "call_graph"),
            ("in.c", "ssrf", "call_graph"),
            ("in.php", "xss", "call_graph"),
            ("no.php", "xss", "taint"),
            ("no.py", "debug_mode", "call_graph"),
        ],
    ),
    "detect_safe": (
        "file_path string, line_number int, pattern string, confidence double, types string, is_safe boolean",
        [
            ("a.php", 2, "parameterized_query", 0.85, "sql_injection", True),
            ("a.php", 9, "allowlist_check", 0.85, "command_execution,path_traversal,sql_injection", True),
            ("a.php", 10, "allowlist_check", 0.85, "command_execution,path_traversal,sql_injection", True),
            ("a.php", 12, "blacklist_filter", 0.9, "sql_injection,xss", False),
            ("a.php", 13, "blacklist_filter", 0.9, "sql_injection,xss", False),
        ],
    ),
    "detect_credentials": (
        "file_path string, line_number int, pattern string, confidence double, types string, is_safe boolean",
        [
            ("conf.py", 1, "hardcoded_credentials", 0.9, "hardcoded_credentials", False),
            ("conf.py", 3, "hardcoded_credentials", 0.9, "hardcoded_credentials", False),
            ("conf.py", 10, "hardcoded_credentials", 0.9, "hardcoded_credentials", False),
            ("conf.py", 13, "hardcoded_credentials", 0.9, "hardcoded_credentials", False),
        ],
    ),
    "detect_others": (
        "file_path string, line_number int, pattern string, confidence double, types string, is_safe boolean",
        [
            ("a.php", 1, "extract_override", 0.95, "command_execution,path_traversal", False),
            ("app.py", 1, "debug_mode", 0.85, "debug_mode", False),
            ("app.py", 2, "debug_mode", 0.85, "debug_mode", False),
            ("app.py", 3, "archive_extract", 0.6, "path_traversal", False),
        ],
    ),
    "detect_combos": (
        "file_path string, line_number int, pattern string, confidence double, types string, is_safe boolean",
        [
            ("a.php", 3, "dangerous_combo", 0.7, "command_execution,deserialization", False),
            ("c.php", 3, "dangerous_combo", 0.7, "command_execution,deserialization", False),
            ("d.py", 2, "dangerous_combo", 0.8, "code_injection", False),
        ],
    ),
    "detect_charsets": (
        "file_path string, line_number int, pattern string, confidence double, types string, is_safe boolean",
        [
            ("db.php", 2, "dangerous_combo", 0.85, "sql_injection", False),
            ("use.php", 2, "blacklist_filter", 0.75, "sql_injection", False),
            ("use.php", 2, "dangerous_combo", 0.75, "sql_injection", False),
        ],
    ),
    "detect_pdo": (
        "file_path string, line_number int, pattern string, confidence double",
        [
            ("a.php", 2, "dangerous_combo", 0.85),
            ("a.php", 4, "string_concat_sql", 0.9),
            ("a.php", 5, "string_concat_sql", 0.85),
            ("b.php", 2, "dangerous_combo", 0.8),
            ("db.php", 2, "dangerous_combo", 0.65),
            ("db.php", 2, "dangerous_combo", 0.65),
            ("db.php", 2, "dangerous_combo", 0.85),
        ],
    ),
    "pattern_grades": (
        "file_path string, line_number int, vuln_type string, severity string, language string, confidence double",
        [
            ("a.php", 2, "command_execution", "high", "php", 0.95),
            ("a.php", 5, "sql_injection", "high", "php", 0.9),
            ("b.py", 1, "debug_mode", "low", "python", 0.85),
            ("b.py", 2, "path_traversal", "medium", "python", 0.6),
            ("b.py", 3, "hardcoded_credentials", "high", "python", 0.9),
            ("b.py", 4, "code_injection", "medium", "python", 0.8),
        ],
    ),
    "safe_spot_reduction": (
        "finding_id long, severity string",
        [
            (1, "medium"),
            (2, "high"),
            (3, "low"),
            (4, "high"),
            (5, "info"),
        ],
    ),
    "call_functions": (
        "path string, name string, line int, source_labels string, sink_labels string, vuln_type string, called string",
        [
            ("a.php", "$go", 3, "", "Command execution", "command_execution", "system"),
            ("a.php", "load", 2, "HTTP GET", "", None, ""),
            ("a.php", "m", 4, "", "", None, "load"),
            ("b.c", "get_input", 1, "name:get_input", "", None, ""),
            ("b.c", "main", 4, "", "Command execution", "command_execution", "get_input,popen"),
            ("chain.py", "alone", 14, "", "", None, "main"),
            ("chain.py", "main", 7, "stdin", "", None, "read_input,step"),
            ("chain.py", "read_input", 1, "name:read_input,stdin", "", None, "input"),
            ("chain.py", "run_cmd", 4, "", "name:run_cmd,Command execution", "command_execution", ""),
            ("chain.py", "step", 11, "", "", None, "run_cmd"),
        ],
    ),
    "call_findings": (
        "file_path string, line_number int, source_line int, vuln_type string, severity string, data_flow string",
        [
            ("chain.py", 4, 1, "command_execution", "critical", "read_input → main → step → run_cmd"),
        ],
    ),
    "view_variables": (
        "path string, variables string",
        [
            ("t/page.html", "a,c,d,g"),
        ],
    ),
    "template_lenient": (
        "file_path string, line_number int, sink_code string",
        [
            ("t/free.html", 1, "{{ q|safe }}"),
            ("t/page.html", 1, "{{ a|safe }}"),
            ("t/page.html", 3, "{% autoescape off %}"),
            ("t/page.html", 9, "x = {{ d }};"),
            ("t/plain.html", 1, "{{ z|safe }}"),
        ],
    ),
    "template_strict": (
        "file_path string, line_number int, sink_code string",
        [
            ("t/page.html", 1, "{{ a|safe }}"),
            ("t/page.html", 3, "{% autoescape off %}"),
            ("t/page.html", 9, "x = {{ d }};"),
        ],
    ),
    "template_unlinked": (
        "file_path string, line_number int, sink_code string",
        [
            ("t/free.html", 1, "{{ q|safe }}"),
            ("t/page.html", 1, "{{ a|safe }}"),
            ("t/page.html", 2, "{{ b | safe }}"),
            ("t/page.html", 3, "{% autoescape off %}"),
            ("t/page.html", 9, "x = {{ d }};"),
            ("t/page.html", 10, "y = {{ e }};"),
            ("t/plain.html", 1, "{{ z|safe }}"),
        ],
    ),
    "rule_hits": (
        "project_id string, line_no int, rule_id string, severity string",
        [
            ("c", 2, "C_SYSTEM_CALL", "high"),
            ("new", 2, "DEPRECATED_MYSQL_FUNCTIONS", "high"),
            ("old", 2, "DEPRECATED_MYSQL_FUNCTIONS", "critical"),
            ("old", 3, "DEPRECATED_CREATE_FUNCTION", "high"),
            ("old", 4, "DESERIALIZE_UNSAFE", "high"),
            ("py", 1, "PY_EXEC_CODE", "critical"),
            ("py", 2, "PY_OS_SYSTEM", "high"),
        ],
    ),
    "rule_hits_of_table": (
        "project_id string, line_no int, rule_id string, severity string",
        [
            ("c", 2, "C_SYSTEM_CALL", "high"),
            ("new", 2, "DEPRECATED_MYSQL_FUNCTIONS", "high"),
            ("old", 2, "DEPRECATED_MYSQL_FUNCTIONS", "critical"),
            ("old", 3, "DEPRECATED_CREATE_FUNCTION", "high"),
            ("old", 4, "DESERIALIZE_UNSAFE", "high"),
            ("py", 1, "PY_EXEC_CODE", "critical"),
            ("py", 2, "PY_OS_SYSTEM", "high"),
        ],
    ),
    "rule_lookup": (
        "language string, rule_id string, category string",
        [
            ("php", "DEPRECATED_ASSERT_STRING", "command_execution"),
            ("php", "DEPRECATED_CREATE_FUNCTION", "command_execution"),
            ("php", "DEPRECATED_PREG_REPLACE_E", "command_execution"),
            ("python", "PY_OS_SYSTEM", "command_execution"),
        ],
    ),
    "versions_detected": (
        "project_id string, language string, detected string",
        [
            ("a", "php", "7.0"),
            ("b", "php", "7.4"),
            ("c", "python", "3.8"),
            ("d", "python", "3.6"),
            ("e", "cpp", "c++11"),
            ("f", "c", "c99"),
        ],
    ),
    "version_contexts": (
        "language string, version string, context string",
        [
            ("c", "c++11", '{"is_cpp":true,"has_nullptr":true,"has_smart_ptr":true,"has_string_view":false,"gets_removed":true}'),
            ("c", "c++20", '{"is_cpp":true,"has_nullptr":true,"has_smart_ptr":true,"has_string_view":true,"gets_removed":true}'),
            ("c", "c17", '{"is_cpp":false,"has_nullptr":false,"has_smart_ptr":false,"has_string_view":false,"gets_removed":true}'),
            ("c", "c99", '{"is_cpp":false,"has_nullptr":false,"has_smart_ptr":false,"has_string_view":false,"gets_removed":false}'),
            ("php", "5.2", '{"dsn_charset_trusted":false,"emulate_risk_level":"critical","mysql_functions":"available","preg_replace_e":"available","create_function":"available","is_php7":false,"is_php8":false}'),
            ("php", "5.5", '{"dsn_charset_trusted":true,"emulate_risk_level":"medium","mysql_functions":"deprecated","preg_replace_e":"deprecated","create_function":"available","is_php7":false,"is_php8":false}'),
            ("php", "7.2", '{"dsn_charset_trusted":true,"emulate_risk_level":"medium","mysql_functions":"removed","preg_replace_e":"removed","create_function":"deprecated","is_php7":true,"is_php8":false}'),
            ("php", "8.1", '{"dsn_charset_trusted":true,"emulate_risk_level":"medium","mysql_functions":"removed","preg_replace_e":"removed","create_function":"removed","is_php7":true,"is_php8":true}'),
            ("python", "2.7", '{"is_python2":true,"has_fstring":false,"has_walrus":false,"has_match":false,"input_is_safe":false}'),
            ("python", "3.10", '{"is_python2":false,"has_fstring":true,"has_walrus":true,"has_match":true,"input_is_safe":true}'),
            ("python", "3.8", '{"is_python2":false,"has_fstring":true,"has_walrus":true,"has_match":false,"input_is_safe":true}'),
        ],
    ),
    "version_labels": (
        "language string, version string, label string, note string",
        [
            ("c", "c11", "", ""),
            ("c", "c17", "", ""),
            ("c", "c23", "", ""),
            ("c", "c89", "", ""),
            ("c", "c99", "", ""),
            ("cpp", "c++11", "", ""),
            ("cpp", "c++14", "", ""),
            ("cpp", "c++17", "", ""),
            ("cpp", "c++20", "", ""),
            ("cpp", "c++23", "", ""),
            ("cpp", "c++98", "", ""),
            ("php", "5.0", "PHP 5.0 ~ 5.3.5", "DSN charset is ignored"),
            ("php", "5.3", "PHP 5.3.6 ~ 5.4.x", "DSN charset works"),
            ("php", "5.5", "PHP 5.5 ~ 5.6.x", "mysql_* is deprecated"),
            ("php", "7.0", "PHP 7.0 ~ 7.1.x", "mysql_* is gone"),
            ("php", "7.2", "PHP 7.2 ~ 7.3.x", "create_function is deprecated"),
            ("php", "7.4", "PHP 7.4.x", "create_function is gone"),
            ("php", "8.0", "PHP 8.0+", "the latest"),
            ("python", "2.7", "", ""),
            ("python", "3.10", "", ""),
            ("python", "3.11", "", ""),
            ("python", "3.12", "", ""),
            ("python", "3.13", "", ""),
            ("python", "3.6", "", ""),
            ("python", "3.7", "", ""),
            ("python", "3.8", "", ""),
            ("python", "3.9", "", ""),
        ],
    ),
    "severity_overrides": (
        "id int, severity string",
        [
            (1, "critical"),
            (2, "high"),
            (3, "high"),
        ],
    ),
    "comments_stripped": (
        "language string, text string",
        [
            ("c", "a \nc # d\nf"),
            ("php", "a \nc \nf"),
            ("python", "a // b\nc \n"),
        ],
    ),
    "records_parsed": (
        "cve_id string, severity string, cvss_score double, ecosystem string, product string, vendor string, version_start string, version_end string, category string, pattern string",
        [
            ("CVE-1", "critical", 9.8, "PHP", "wordpress", "v", "1.0", "2.0", "sql_injection", "(?:mysql_query|mysqli_query|->query|->exec|PDO::query)\\s*\\("),
            ("CVE-2", "high", 7.5, "C", "linux_kernel", "linux", "1.0", "2.0", "command_execution", "\\bparse_it\\s*\\("),
            ("CVE-3", "medium", 0.0, "Python", "unknown", "", "", "", "xss", "(?:echo|print)\\s*\\$_(?:GET|POST|REQUEST)"),
            ("CVE-7", "medium", 4.2, "Python", "scikit_learn", "v", "1.0", "2.0", "path_traversal", "(?:fopen|file_get_contents|(?:include|require)(?:_once)?)\\b.*\\.\\."),
        ],
    ),
    "record_counts": (
        "ecosystem string, category string, n long",
        [
            ("C", "ssrf", 1),
            ("PHP", "xss", 2),
        ],
    ),
    "record_rules": (
        "language string, rule_id string, category string, default_severity string, pattern string, confidence double",
        [
            ("c", "CVE_3", "ssrf", "low", "b", 0.6),
            ("php", "CVE_1_2", "xss", "high", "a\\(", 0.6),
        ],
    ),
    "cpe_parts": (
        "cpe string, vendor string, product string",
        [
            ("cpe:/a:old:thing", None, None),
            ("cpe:2.3:a:vendor", None, None),
            ("cpe:2.3:a:vendor:product:1.0", "vendor", "product"),
        ],
    ),
    "tool_dangerous_calls": (
        "path string, line_no int, category string",
        [
            ("a.php", 3, "code"),
            ("a.php", 3, "command"),
            ("b.py", 1, "command"),
        ],
    ),
    "tool_user_inputs": (
        "path string, line_no int, category string",
        [
            ("a.php", 2, "get"),
        ],
    ),
    "tool_trace": (
        "path string, line_no int, use string",
        [
            ("a.php", 2, "assign"),
            ("a.php", 3, "reference"),
            ("a.php", 4, "reference"),
        ],
    ),
    "tool_paths": (
        "asked string, path string",
        [
            ("a.php", "/w/p/lib/a.php"),
            ("b.py", "/w/p/b.py"),
            ("none.c", None),
            ("src\\a.php", "/w/p/src/A.php"),
            ("x.c", "x.c"),
        ],
    ),
    "member_faults": (
        "name string, fault string",
        [
            ("", "empty"),
            (" / ", "empty"),
            ("..a", None),
            ("/a", "absolute"),
            ("C:\\a", "absolute"),
            ("a/../b", "escaping"),
            ("a/b", None),
            ("a\\..\\b", "escaping"),
        ],
    ),
    "file_languages": (
        "path string, language string",
        [
            ("a.php/b", ""),
            ("a/B.PHP", "php"),
            ("none", ""),
            ("x.h", "c"),
            ("x.h++", "cpp"),
            ("y.py", "python"),
            ("z.txt", ""),
        ],
    ),
    "listing_order": (
        "ids string",
        [
            ("4,5,2,1,3",),
        ],
    ),
    "stored_defaults": (
        "finding_id long, severity string, pipeline_stage string, status string, line_number int, sink_line int",
        [
            (1, "medium", "taint", "pending", 7, 7),
            (2, "low", "ast", "confirmed", 3, 4),
            (3, "high", "taint", "pending", 0, None),
        ],
    ),
    "analysed_rows": (
        "id int, analysed string",
        [
            (1, "yes"),
            (2, "no"),
        ],
    ),
    "json_repaired": (
        "id int, json string",
        [
            (0, '{"a": 1}'),
            (1, '{"a": [1, 2]}'),
            (2, '{"a": "x", "b": {"c": 1}}'),
            (3, None),
            (4, '{"t": "a\\tb"}'),
            (5, "[1, 2]"),
        ],
    ),
    "parse_failures": (
        "id int, text string",
        [
            (2, "no json here"),
        ],
    ),
    "json_fields": (
        "id int, json string",
        [
            (1, '["a"]'),
            (2, ""),
            (3, ""),
        ],
    ),
    "keys_masked": (
        "key string, masked string, tail string",
        [
            ("", "", ""),
            ("abc", "***", "****"),
            ("abcdefgh", "********", "****efgh"),
            ("abcdefghijkl", "abcd****ijkl", "****ijkl"),
        ],
    ),
    "heuristic_verdicts": (
        "id int, verdict string, confidence double, status string, is_vulnerable string",
        [
            (1, "false_positive", 0.7, "false_positive", "false"),
            (2, "confirmed", 0.6, "confirmed", "true"),
            (3, "false_positive", 0.7, "false_positive", "false"),
            (4, "potential", 0.4, "pending", "uncertain"),
        ],
    ),
    "text_blocks": (
        "path string, block_start int, block_end int",
        [
            ("a.py", 2, 3),
            ("a.py", 4, 5),
            ("b.py", 1, 2),
        ],
    ),
    "analysis_cases": (
        "project_id string, file_path string, line_number int, vuln_type string, severity string, pipeline_stage string",
        [
            ("C2", "cmd.c", 4, "command_execution", "critical", "data_flow"),
            ("E1", "config.py", 1, "debug_mode", "low", "ast"),
            ("E1", "config.py", 2, "hardcoded_credentials", "high", "ast"),
            ("E2", "chain.py", 5, "command_execution", "critical", "call_graph"),
            ("E2", "chain.py", 7, "command_execution", "critical", "data_flow"),
            ("E3", "page.html", 1, "xss", "medium", "ast"),
            ("E3", "page.html", 3, "xss", "medium", "ast"),
            ("T1", "run.php", 3, "command_execution", "critical", "data_flow"),
            ("T10", "sql.php", 4, "sql_injection", "high", "data_flow"),
            ("T11", "b.py", 6, "ssrf", "high", "data_flow"),
            ("T12", "scopes.py", 11, "ssti", "critical", "data_flow"),
            ("T3", "fake.php", 3, "command_execution", "critical", "data_flow"),
            ("T4", "list.php", 5, "command_execution", "info", "data_flow"),
            ("T5", "echo.php", 2, "xss", "low", "data_flow"),
            ("T6", "far.php", 2, "deserialization", "high", "data_flow"),
            ("T7", "names.py", 2, "path_traversal", "medium", "data_flow"),
            ("T8", "shell.py", 5, "command_execution", "critical", "data_flow"),
        ],
    ),
    "analysis_cases_in_order": (
        "project_id string, file_path string, line_number int, vuln_type string, severity string, pipeline_stage string",
        [
            ("C2", "cmd.c", 4, "command_execution", "critical", "data_flow"),
            ("E1", "config.py", 1, "debug_mode", "low", "ast"),
            ("E1", "config.py", 2, "hardcoded_credentials", "high", "ast"),
            ("E2", "chain.py", 5, "command_execution", "critical", "call_graph"),
            ("E2", "chain.py", 7, "command_execution", "critical", "data_flow"),
            ("E3", "page.html", 1, "xss", "medium", "ast"),
            ("E3", "page.html", 3, "xss", "medium", "ast"),
            ("T1", "run.php", 3, "command_execution", "critical", "data_flow"),
            ("T10", "sql.php", 4, "sql_injection", "high", "data_flow"),
            ("T11", "b.py", 6, "ssrf", "high", "data_flow"),
            ("T12", "scopes.py", 11, "ssti", "critical", "data_flow"),
            ("T3", "fake.php", 3, "command_execution", "critical", "data_flow"),
            ("T4", "list.php", 5, "command_execution", "info", "data_flow"),
            ("T5", "echo.php", 2, "xss", "low", "data_flow"),
            ("T6", "far.php", 2, "deserialization", "high", "data_flow"),
            ("T7", "names.py", 2, "path_traversal", "medium", "data_flow"),
            ("T8", "shell.py", 5, "command_execution", "critical", "data_flow"),
        ],
    ),
    "tool_search": (
        "path string, line_no int, code string, total long, failed boolean",
        [
            ("a.php", 3, "system($id); eval($id);", 1, False),
            (None, None, None, 0, True),
        ],
    ),
    "collected_paths": (
        "path string, collectors string",
        [
            ("A.PY", "pipeline/python,tools/c"),
            ("a.phps", "php/php"),
            ("a.py", "pipeline/python,python/python,tools/c"),
            ("build/a.php", "tools/c"),
            ("cmake-x/a.c", "tools/c"),
            ("dist/a.py", "tools/c"),
            ("env/a.py", "tools/c"),
            ("extern/a.c", "tools/c"),
            ("static/t.html", ""),
            ("t.html", "template/template"),
            ("third/a.h++", "pipeline/cpp,c/c"),
            ("tmp/a.php", "pipeline/php,tools/c"),
            ("vendor/a.py", ""),
            ("x.c", "c/c,tools/c"),
            ("x.cxx", "pipeline/cpp,c/c"),
            ("x.hpp", "pipeline/cpp,c/c,tools/c"),
        ],
    ),
    "archive_members": (
        "archive string, name string, size long, text string, fault string",
        [
            ("a.zip", "src/x.py", 16, "text of src/x.py", None),
            ("a.zip", "y.py", 12, "text of y.py", None),
            ("b.tar.gz", None, None, None, "escaping member name"),
            ("c.tar.xz", "z.c", 11, "text of z.c", None),
            ("d.zip", None, None, None, "the archive is empty"),
            ("e.bin", None, None, None, "not a zip or tar archive"),
        ],
    ),
    "files_decoded": (
        "id int, text string",
        [
            (1, "plain"),
            (2, "été"),
            (3, "x = '1'"),
            (4, ""),
        ],
    ),
    "numbered_lines": (
        "path string, line_no int, code string",
        [
            ("a.py", 1, "x"),
            ("a.py", 2, ""),
            ("a.py", 3, "y"),
            ("a.py", 4, ""),
            ("b.c", 1, ""),
        ],
    ),
    "catalogue_sizes": (
        "what string, language string, n long",
        [
            ("rule", "c", 15),
            ("rule", "cpp", 15),
            ("rule", "php", 11),
            ("rule", "python", 16),
            ("sink", "c", 35),
            ("sink", "php", 53),
            ("sink", "python", 90),
            ("source", "c", 17),
            ("source", "php", 24),
            ("source", "python", 37),
        ],
    ),
    "record_answers": (
        "id string, description string",
        [
            ("CVE-1", "a"),
            ("CVE-2", None),
        ],
    ),
    "braced_blocks": (
        "path string, block_start int, block_end int",
        [
            ("a.php", 2, 4),
            ("a.php", 6, 8),
            ("a.php", 9, 9),
            ("b.c", 1, 3),
        ],
    ),
}
