"""Line rules by language and version signatures."""

# Fixed values: (rule_id, category, severity, lowest version, highest version, severities by version, pattern, confidence).
RULES = {
    "php": [
        ("WIDE_BYTE_PDO_EMULATE", "wide_byte_injection", "high", None, None, {}, r"new\s+PDO|->prepare\s*\(", 0.85),
        ("WIDE_BYTE_ADDSLASHES_GBK", "wide_byte_injection", "high", None, None, {}, r"addslashes\s*\(", 0.9),
        ("WIDE_BYTE_MYSQL_ESCAPE_GBK", "wide_byte_injection", "medium", None, None, {}, r"mysql_real_escape_string\s*\(", 0.5),
        ("SQLI_STRING_CONCAT", "sql_injection", "high", None, None, {}, r"(?:mysql_query|mysqli_query|->query|->exec)\s*\(\s*[\"'].*\.", 0.9),
        ("SQLI_PDO_PREPARE_CONCAT", "sql_injection", "high", None, None, {}, r"->prepare\s*\(\s*[\"'].*\.\s*\$", 0.8),
        ("DEPRECATED_PREG_REPLACE_E", "command_execution", "critical", None, "5.4", {}, r"preg_replace\s*\(\s*[\"'].*/e[\w]*[\"']", 0.95),
        ("DEPRECATED_MYSQL_FUNCTIONS", "deprecated_api", "high", None, None, {"7.0": "critical"}, r"\bmysql_(?:query|connect|db_query|select_db|escape_string|real_escape_string|fetch|result)\s*\(", 0.95),
        ("DEPRECATED_CREATE_FUNCTION", "command_execution", "high", None, "7.1", {"7.2": "critical"}, r"create_function\s*\(", 0.95),
        ("DEPRECATED_ASSERT_STRING", "command_execution", "high", None, "7.1", {}, r"assert\s*\(\s*[\"']", 0.85),
        ("DESERIALIZE_UNSAFE", "deserialization", "high", None, None, {}, r"unserialize\s*\(", 0.85),
        ("FILE_UPLOAD_MOVE", "file_upload", "high", None, None, {}, r"move_uploaded_file\s*\(", 0.8),
    ],
    "python": [
        ("PY_INPUT_EVAL", "command_execution", "critical", None, "2.7", {}, r"(?<!\.)input\s*\(", 0.95),
        ("PY_RAW_INPUT", "deprecated_api", "low", "3.0", None, {}, r"raw_input\s*\(", 0.9),
        ("PY_EXEC_CODE", "command_execution", "critical", None, None, {}, r"\bexec\s*\(", 0.9),
        ("PY_EVAL_CODE", "command_execution", "high", None, None, {}, r"\beval\s*\(", 0.85),
        ("PY_SUBPROCESS_SHELL", "command_execution", "high", None, None, {}, r"shell\s*=\s*True", 0.85),
        ("PY_OS_SYSTEM", "command_execution", "high", None, None, {}, r"os\.system\s*\(", 0.9),
        ("PY_OS_POPEN", "command_execution", "medium", None, None, {}, r"os\.popen\s*\(", 0.85),
        ("PY_PICKLE_UNSAFE", "deserialization", "high", None, None, {}, r"pickle\.(?:loads?|Unpickler)\s*\(", 0.9),
        ("PY_YAML_UNSAFE", "deserialization", "high", None, None, {}, r"yaml\.load\s*\(", 0.9),
        ("PY_SQL_CONCAT", "sql_injection", "high", None, None, {}, r"(?:execute|cursor)\.*(?:f['\"]|['\"].*%)", 0.85),
        ("PY_FSTRING_SQL", "sql_injection", "high", "3.6", None, {}, r"execute\s*\(\s*f['\"]", 0.9),
        ("PY_MARSHAL_UNSAFE", "deserialization", "medium", None, None, {}, r"marshal\.(?:loads?|dumps?)\s*\(", 0.8),
        ("PY_SHELVE_UNSAFE", "deserialization", "medium", None, None, {}, r"shelve\.open\s*\(", 0.7),
        ("PY_OPEN_PATH_TRAVERSAL", "path_traversal", "high", None, None, {}, r"\bopen\s*\([^)]*\+", 0.8),
        ("PY_REQUESTS_NO_VERIFY", "ssrf", "medium", None, None, {}, r"verify\s*=\s*False", 0.75),
        ("PY_TEMPLATE_INJECTION", "command_execution", "critical", None, None, {}, r"(?:Template|Environment|render_template_string)\s*\([^)]*\+", 0.8),
    ],
    "c": [
        ("C_GETS_FUNCTION", "command_execution", "critical", None, "c99", {}, r"\bgets\s*\(", 0.95),
        ("C_STRCPY_UNSAFE", "command_execution", "high", None, None, {"c11": "critical", "c++11": "critical"}, r"\bstrcpy\s*\(", 0.9),
        ("C_STRCAT_UNSAFE", "command_execution", "high", None, None, {}, r"\bstrcat\s*\(", 0.9),
        ("C_SPRINTF_UNSAFE", "command_execution", "high", None, None, {}, r"\bsprintf\s*\(", 0.9),
        ("C_SCANF_UNSAFE", "command_execution", "medium", None, None, {}, r"\bscanf\s*\([^)]*%s", 0.85),
        ("C_SYSTEM_CALL", "command_execution", "high", None, None, {}, r"\bsystem\s*\(", 0.9),
        ("C_POPEN_CALL", "command_execution", "high", None, None, {}, r"\bpopen\s*\(", 0.85),
        ("C_SQL_INJECTION", "sql_injection", "high", None, None, {}, r"(?:sprintf|strcat)\s*\([^)]*SELECT", 0.8),
        ("C_FORMAT_STRING", "command_execution", "high", None, None, {}, r"(?:printf|fprintf|sprintf)\s*\(\s*\w+\s*\)", 0.85),
        ("C_MEMORY_LEAK", "command_execution", "medium", None, None, {}, r"\b(?:malloc|calloc|realloc)\s*\(", 0.6),
        ("C_NO_BOUNDS_CHECK", "command_execution", "medium", None, None, {}, r"\w+\s*\[\s*\w+\s*\]", 0.55),
        ("CXX_NEW_NO_DELETE", "command_execution", "medium", "c++98", None, {"c++11": "high"}, r"\bnew\s+\w+", 0.55),
        ("CXX_RAW_POINTER", "command_execution", "low", "c++11", None, {}, r"\w+\s*\*\s*\w+\s*=\s*new", 0.5),
        ("C_FOPEN_PATH_TRAVERSAL", "path_traversal", "high", None, None, {}, r"\bfopen\s*\([^)]*\+", 0.8),
        ("C_REALLOC_NULL", "command_execution", "medium", None, None, {}, r"\w+\s*=\s*realloc\s*\(\s*\w+", 0.7),
    ],
}

# What gives a version away. PHP takes the highest that is found, the others the first in order.
SIGNATURES = {
    "php": [
        ("8.0", r"(?<!\w)match\s*\([^)]*\)\s*\{"),
        ("8.0", r"\?->\w+"),
        ("8.0", r"#\[[A-Z]\w*"),
        ("8.0", r"function\s+\w+\s*\([^)]*\w+\s*:\s*\w+\s*,\s*\w+\s*:\s*\w+\s*\)"),
        ("8.0", r"\bstr_(?:contains|starts_with|ends_with)\s*\("),
        ("8.0", r"(?:string|int|float|bool)\s*\|\s*(?:string|int|float|bool|null)"),
        ("7.4", r"\w+\s*=\s*fn\s*\("),
        ("7.4", r"(?:public|protected|private)\s+(?:string|int|float|bool)\s+\$\w+"),
        ("7.2", r"function\s+\w+\([^)]*\)\s*:\s*void"),
        ("7.0", r"\?\?\s*\S"),
        ("7.0", r"\$\w+\s*<=>\s*\$\w+"),
        ("7.0", r"function\s+\w+\([^)]*\)\s*:\s*\w+"),
        ("7.0", r"\bdeclare\s*\(\s*strict_types\s*=\s*1\s*\)"),
        ("7.0", r"\buse\s+[A-Z].*\s+use\s+[A-Z]"),
        ("5.5", r"\byield\b"),
        ("5.5", r"finally\s*\{"),
        ("5.5", r"::class\b"),
        ("5.5", r"\bempty\s*\(\s*\$\w+\[.+\]\s*\)"),
        ("5.5", r"\barray\s*\[\s*\]\s*=\s*"),
        ("5.3", r"\bnamespace\s+\w+"),
        ("5.3", r"\buse\s+[A-Z]\w+"),
        ("5.3", r"function\s*\([^)]*\)\s*use\s*\("),
        ("5.3", r"static\s*::"),
        ("5.3", r"\b__DIR__\b"),
        ("5.3", r"\?:"),
    ],
    "python": [
        ("3.13", r"\btype\s+\w+\s*=\s*\([^)]+\)\s*:"),
        ("3.12", r"\btype\s+\w+\s*\([^)]*\)\s*:"),
        ("3.10", r"\bmatch\s+\w+\s*:"),
        ("3.9", r"list\[str\]|dict\[str,\s*int\]"),
        ("3.8", r":=\s*\w+"),
        ("3.7", r"from\s+__future__\s+import\s+annotations"),
        ("3.6", r"f['\"].*\{.*\}.*['\"]"),
        ("2.7", r"(?<!def\s)(?<!\.)(?<!import\s)\bprint\s+[^(]"),
    ],
    "c": [
        ("c23", r"\bconstexpr\b"),
        ("c23", r"\bnullptr\b"),
        ("c17", r"\b_Generic\b"),
        ("c11", r"\b_Alignas\b|\b_Alignof\b|\b_Noreturn\b"),
        ("c99", r"//"),
        ("c99", r"for\s*\(\s*(?:int|float|double|char)\s+\w+\s*="),
    ],
    "cpp": [
        ("c++23", r"import\s+<\w+>"),
        ("c++20", r"\bco_await\b|\bco_yield\b|\bco_return\b"),
        ("c++20", r"\bconcept\s+\w+\s*="),
        ("c++17", r"if\s*\(\s*constexpr"),
        ("c++17", r"std::string_view"),
        ("c++14", r"auto\s+\w+\s*\([^)]*\)\s*->\s*\w+"),
        ("c++11", r"\bnullptr\b"),
        ("c++11", r"std::unique_ptr|std::shared_ptr|std::make_shared"),
        ("c++11", r"auto\s+\w+\s*=\s*.*;"),
    ],
}
DEFAULT_VERSION = {"php": "5.0", "python": "3.6", "c": "c89", "cpp": "c++98"}

# PHP versions that can be chosen: (version, label, note).
PHP_VERSIONS = [
    ("5.0", "PHP 5.0 ~ 5.3.5", "DSN charset is ignored"),
    ("5.3", "PHP 5.3.6 ~ 5.4.x", "DSN charset works"),
    ("5.5", "PHP 5.5 ~ 5.6.x", "mysql_* is deprecated"),
    ("7.0", "PHP 7.0 ~ 7.1.x", "mysql_* is gone"),
    ("7.2", "PHP 7.2 ~ 7.3.x", "create_function is deprecated"),
    ("7.4", "PHP 7.4.x", "create_function is gone"),
    ("8.0", "PHP 8.0+", "the latest"),
]
# Versions of the other languages.
VERSIONS = {
    "python": ["2.7", "3.6", "3.7", "3.8", "3.9", "3.10", "3.11", "3.12", "3.13"],
    "c": ["c89", "c99", "c11", "c17", "c23"],
    "cpp": ["c++98", "c++11", "c++14", "c++17", "c++20", "c++23"],
}
