"""Pattern tables (Java regular expressions, portable to RE2) that detectors match lines and files with."""

def any_of(patterns: list[str]) -> str:
    """One alternation of patterns; a pattern's own flags hold within it."""
    return "|".join(f"(?:{p})" for p in patterns)


# Safe patterns of a line, and the types that they cover.
SQL_WORDS = r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|LIMIT|GROUP\s+BY|ORDER\s+BY)\b"
PARAMETERIZED = [r"\bprepare\s*\(\s*[\"']\s*(?:SELECT|INSERT|UPDATE|DELETE)", r"\bexecute\s*\(\s*\[.*\]\s*\)", r"\bbind_param\s*\(", r"\bbindValue\s*\("]
ALLOWLIST = [r"in_array\s*\(\s*\$[a-zA-Z_]\w*\s*,\s*\[", r"\$allowed\w*\s*=\s*\[", r"\$allowed\w*\s*=\s*array\s*\(", r"\$whitelist\w*\s*=\s*(?:\[|array\s*\()"]
SAFE_COVERS = {"parameterized_query": ["sql_injection"], "allowlist_check": ["command_execution", "path_traversal", "sql_injection"]}

# Filters that can be got around.
BLACKLIST = [r"str_replace\s*\(\s*['\"]select['\"]", r"preg_replace\s*\(\s*['\"]/(?:select|union|drop)", r"strip_tags\s*\(\s*\$[a-zA-Z_]\w*"]

# Pairs of patterns that are dangerous near each other or in one span, with the kind of span, the confidence
# and the types.
COMBO_WINDOW = 8
COMBOS = [
    (r"(?i)unserialize\s*\(", r"(?i)__destruct|__wakeup|__toString", "class", 0.7, ["command_execution", "deserialization"]),
    (r"(?i)file_get_contents\s*\(", r"(?i)eval\s*\(", "class", 0.7, ["command_execution", "deserialization"]),
    (r"(?i)extract\s*\(\s*\$_(?:GET|POST|REQUEST)", r"(?i)include\s*\(\s*\$", "class", 0.7, ["command_execution", "deserialization"]),
    (r"(?i)move_uploaded_file\s*\(", r"(?i)\.php['\"]", "class", 0.7, ["command_execution", "deserialization"]),
    (r"\beval\s*\(", r"\bexec\s*\(|\bcompile\s*\(", "function", 0.8, ["code_injection"]),
    (r"\bexec\s*\(", r"\bcompile\s*\(", "function", 0.8, ["code_injection"]),
]

# Hard-coded credentials.
CREDENTIAL = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:u|r|f|b)?(?:\"([^\"']*)\"|'([^\"']*)')\s*(?:#.*)?$"
CREDENTIAL_WORDS = ["password", "passwd", "secret", "api_key", "api_token", "auth_token", "access_token", "private_key", "db_pass", "database_url", "jwt_secret", "hmac_secret", "signing_key", "webhook_secret", "client_secret"]
PLACEHOLDERS = ["changeme", "change-me", "placeholder", "your-", "your_", "example", "xxxx", "redacted", "***", "...", "todo", "<secret>", "<password>", "<your", "password>", "secret>", "put-", "replace", "fill-", "dev-insecure", "do-not-use"]
EXCLUDED_SUFFIXES = ["_header", "_name", "_field", "_key_name", "_param"]
EXCLUDED_PREFIXES = ["demo_", "sample_"]
PLAIN_VALUES = ["password", "passwd", "secret", "apikey", "api_key"]

# Other detectors.
DEBUG = [r"^\s*DEBUG\s*=\s*True\b", r"\bDEBUG\s*=\s*True\b", r"(?i)app\.run\s*\([^)]*debug\s*=\s*True"]
ARCHIVE = [r"\.extractall\s*\(", r"\.extract\s*\(", r"shutil\.unpack_archive\s*\("]
GBK = r"(?i)(?:charset|SET\s+NAMES)\s*=\s*['\"]?\s*(?:gbk|gb2312|big5)"

# The tags that a line can get.
TAGS = {
    "sql_word": SQL_WORDS,
    "query_call": r"(?:mysql_query|mysqli_query|->query)\s*\(",
    "parameterized": "(?i)" + any_of(PARAMETERIZED),
    "allowlist": "(?i)" + any_of(ALLOWLIST),
    "blacklist": "(?i)" + any_of(BLACKLIST),
    "extract": r"extract\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)",
    "weak_escape": r"addslashes\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)",
    "debug": any_of(DEBUG),
    "archive": any_of(ARCHIVE),
    "archive_safe": r"is_within_directory|_safe_extract|member\.name\.startswith|os\.path\.commonpath|realpath\(",
    "gbk_local": r"(?i)(?:SET\s+NAMES|SET\s+CHARACTER\s+SET|mysql_set_charset|mysqli_set_charset)\s*['(]\s*(?:gbk|gb2312|big5)",
    "gbk": GBK,
    "addslashes": r"addslashes",
    "sql_call": r"(?:mysql_query|mysqli_query|->query|mysql_db_query)\s*\(",
    "charset_set": r"(?i)SET\s+NAMES|mysql_set_charset|SET\s+CHARACTER",
    "sql_use": r"(?:mysql_query|mysqli_query|->query|addslashes)",
    "pdo": r"\bPDO\b|->query|->exec|->prepare",
    "concat_query": r"->query\s*\(\s*[\"'].*\.\s*\$",
    "concat_exec": r"->exec\s*\(\s*[\"'].*\.\s*\$",
    "concat_prepare": r"->prepare\s*\(\s*[\"'].*\.\s*\$",
    "emulate": r"ATTR_EMULATE_PREPARES",
    "emulate_on": r"ATTR_EMULATE_PREPARES\s*,\s*(?:true|1|TRUE)",
    "emulate_off": r"ATTR_EMULATE_PREPARES\s*,\s*(?:false|0|FALSE)",
    "charset_gbk": r"(?i)charset\s*=\s*['\"]?\s*(?:gbk|gb2312|big5)",
    "pdo_use": r"new\s+PDO|->query|->exec|->prepare",
    "pdo_new": r"new\s+PDO\s*\(",
    "pdo_charset": r"(?i)new\s+PDO\s*\([^)]*charset\s*=\s*(\w+)",
    "prepare": r"->prepare\s*\(",
    "bound": r"->execute\s*\(\s*\[",
    **{f"combo_{side}{k}": pair[i] for k, pair in enumerate(COMBOS) for i, side in enumerate("ab")},
}
#: Tags that are asked of a whole file, and of a whole project.
FILE_FLAGS = ["archive_safe", "gbk_local", "gbk", "addslashes", "sql_call", "pdo", "emulate_on", "prepare", "bound", "pdo_charset"]
PROJECT_FLAGS = ["gbk", "emulate_off"]

# File-level signs of user input.
INPUT_TYPES = ["sql_injection", "command_execution", "ssrf", "path_traversal", "arbitrary_file_read", "xss", "file_upload", "deserialization"]
EXEMPT_TYPES = ["wide_byte_injection", "deprecated_api"]
PHP_INPUT = [r"\$_GET\b", r"\$_POST\b", r"\$_REQUEST\b", r"\$_COOKIE\b", r"\$_SERVER\b", r"\$_FILES\b", r"\$_SESSION\b", r"\$_ENV\b", r"getenv\s*\(", r"php://input", r"file_get_contents\s*\(\s*['\"]php://", r"getallheaders\s*\(", r"\$argv\b"]
PYTHON_INPUT = [r"request\.(?:args|form|json|data|values)\.get\b", r"input\s*\(", r"sys\.argv\b"]

# What protects a value on its way, and what changes it; in the order in which they are looked for.
PROTECTIONS = {
    "prepared_statement": [r"mysqli_prepare", r"PDO::prepare", r"pg_prepare", r"\bprepare\s*\(.*(?:SELECT|INSERT|UPDATE|DELETE)"],
    "sql_escape": [r"mysqli_real_escape_string", r"mysql_real_escape_string", r"addslashes", r"pg_escape_string"],
    "sql_parameterized": [r"\?.*placeholder", r":\w+.*placeholder"],
    "escapeshellarg": [r"escapeshellarg", r"escapeshellcmd"],
    "command_allowlist": [r"in_array\s*\(.*\[.*\]"],
    "html_encode": [r"htmlspecialchars", r"htmlentities", r"strip_tags"],
    "type_validation": [r"is_numeric", r"is_int", r"is_float", r"ctype_digit"],
    "filter_var": [r"filter_var\s*\(.*FILTER_"],
    "regex_validation": [r"preg_match\s*\(.*/.*/"],
    "allowlist_check": [r"in_array\s*\(.*\$allowed", r"in_array\s*\(.*\$whitelist"],
}
TRANSFORMS = {
    "concat": [r"\.(\s*\$)", r"\$\w+\s*\.", r"\.=\s*\$"],
    "format": [r"sprintf\s*\(.*\$", r"printf\s*\(.*\$"],
    "encode": [r"base64_encode", r"urlencode", r"rawurlencode"],
    "decode": [r"base64_decode", r"urldecode"],
    "truncate": [r"substr\s*\(.*\$", r"mb_substr\s*\(.*\$"],
    "escape": [r"addslashes", r"mysqli_real_escape_string"],
    "type_cast": [r"intval\s*\(.*\$", r"floatval\s*\(.*\$", r"\(int\)\s*\$"],
    "filter": [r"strip_tags", r"filter_var"],
}

# Searches over a project's lines.
USER_INPUTS = [("get", r"\$_GET"), ("post", r"\$_POST"), ("request", r"\$_REQUEST"), ("cookie", r"\$_COOKIE"), ("files", r"\$_FILES"), ("server", r"\$_SERVER"), ("session", r"\$_SESSION"), ("env", r"\$_ENV|getenv\s*\("), ("raw", r"php://input"), ("headers", r"getallheaders\s*\("), ("argv", r"\$argv\b")]
DANGEROUS_CALLS = [("command", r"\b(?:system|exec|shell_exec|passthru|popen|proc_open)\s*\("), ("code", r"\b(?:eval|assert|create_function)\s*\("), ("sql", r"(?:mysql_query|mysqli_query|->query|pg_query)\s*\("), ("include", r"\b(?:include|require)(?:_once)?\b[\s(]*\$"), ("file", r"\b(?:file_get_contents|fopen|readfile|unlink)\s*\("), ("deserialize", r"\bunserialize\s*\("), ("request", r"\b(?:curl_exec|fsockopen)\s*\(")]

# Templates. Output of a variable, of one that is marked safe, and blocks with escaping off.
TEMPLATE_VARIABLE = r"\{\{\s*([A-Za-z_][\w.]*)\s*(?:\|[^}]*)?\}\}"
SAFE_FILTER = r"\{\{\s*(.*?)\s*\|\s*safe\s*\}\}"
ESCAPE_OFF = r"(?i)\{%\s*autoescape\s+(?:off|false)\s*%\}"
ESCAPE_END = r"(?i)\{%\s*endautoescape\s*%\}"
# What a source looks like where it is written, and calls whose result can be shown.
SOURCE_MARKERS = ["request.args", "request.form", "request.values", "request.json", "request.cookies", "request.headers", "request.data", "request.files", "request.get_json", "request.get_data", "api.payload", "parse_args", "sys.argv", "input(", "os.environ", "os.getenv", "request.POST", "request.GET", "request.COOKIES", "request.META"]
TEMPLATE_SANITIZERS = ["escape", "clean", "escapejs", "int", "float", "round", "abs"]
RENDER_CALLS = ["render_template", "render", "render_template_string"]
