"""Sources, sinks and sanitisers of data flow: fixed values, as patterns over calls and expressions."""

# Class to (CWE, severity).
CLASSES = {
    "SQL Injection": ("CWE-89", "CRITICAL"),
    "OS Command Injection": ("CWE-78", "CRITICAL"),
    "Code Injection": ("CWE-94", "CRITICAL"),
    "Path Traversal": ("CWE-22", "HIGH"),
    "Server-Side Template Injection": ("CWE-94", "HIGH"),
    "Insecure Deserialization": ("CWE-502", "HIGH"),
    "Server-Side Request Forgery (SSRF)": ("CWE-918", "HIGH"),
    "Open Redirect": ("CWE-601", "MEDIUM"),
    "NoSQL Injection": ("CWE-943", "HIGH"),
    "LDAP Injection": ("CWE-90", "HIGH"),
    "XPath Injection": ("CWE-643", "HIGH"),
    "HTTP Response Splitting / CRLF Injection": ("CWE-113", "MEDIUM"),
}
SQL, CMD, CODE, PATH, SSTI, OBJ, SSRF, REDIRECT, NOSQL, LDAP, XPATH, CRLF = CLASSES

# What reads untrusted input, by language.
SOURCES = {
    "python": (
        r"request\.(?:args|form|values|json|get_json|data|cookies|headers|files|query_string|GET|POST|body|META|FILES|query_params)|\.(?:args|form|values|headers)\.get"
        r"|req\.(?:query|body|params|headers)|\$_(?:GET|POST|REQUEST|COOKIE)|\binput\s*\(|sys\.argv|flask\.request|\.files\s*\[[^\]]*\]\.filename|\.files\.get\s*\([^)]*\)\.filename"
    ),
    "javascript": (
        r"req\.(?:query|body|params|headers|cookies|originalUrl)|request\.(?:query|body)|\.query\b|location\.(?:search|hash|href)|document\.URL|process\.argv|window\.name"
        r"|getParameter|req\.get\s*\(|\breq\.url\b"
    ),
    "php": r"\$_(?:GET|POST|REQUEST|COOKIE|FILES)|php://input",
    "java": r"getParameter\s*\(|getHeader\s*\(|getQueryString\s*\(|getInputStream|getReader|@RequestParam|@PathVariable|getCookies|@RequestBody",
    "ruby": r"params\[|request\.(?:params|query_parameters|GET|POST)|cookies\[|request\.body|ENV\[",
    "go": r"r\.URL\.Query\(\)|r\.FormValue\s*\(|r\.PostFormValue|r\.Header\.Get|mux\.Vars|c\.Param\s*\(|c\.Query\s*\(",
    "c_sharp": r"Request\.(?:Query|Form|Params|QueryString|Cookies|Headers|Body)|Console\.ReadLine|\[From(?:Query|Body|Route|Form)\]|HttpContext\.Request",
    "rust": r"web::(?:Query|Form|Path)|\.query_string\s*\(|(?:Query|Path|Form)<|env::args|req(?:uest)?\.query|HttpRequest",
    "cpp": r"getenv\s*\(|\bargv\b|std::cin|request\.|\breq\.|\.query\b|getParam|FCGX|QUERY_STRING",
    "c": r"getenv\s*\(|\bargv\b|\bscanf\s*\(|\bfgets\s*\(|\brecv\s*\(|QUERY_STRING|getParam",
    "kotlin": r"getParameter\s*\(|\.getQueryParameter\s*\(|intent\.getStringExtra|request\.query|\breq\.query|@RequestParam|@PathVariable|call\.parameters|\.queryParameters|getHeader\s*\(",
}

# What a class' sinks are called, by language.
SINKS = {
    "python": {
        SQL: r"\.(?:execute|executemany|executescript|raw|query)\($|cursor\.execute",
        CMD: r"os\.system\(|os\.popen\(|subprocess\.\w+\(|commands\.getoutput\(",
        CODE: r"(?<![\w.])(?:eval|exec|compile|__import__)\(",
        PATH: r"(?<![\w.])open\(|io\.open\(|os\.(?:remove|unlink|makedirs|rename)\(|send_file\(|send_from_directory\(|\.read_text\(|shutil\.(?:rmtree|copy\w*|move)\(|\.save\(",
        SSTI: r"render_template_string\(|Template\(|\.from_string\(",
        OBJ: r"pickle\.loads?\(|yaml\.(?:unsafe_)?load\(|marshal\.loads?\(|dill\.loads?\(",
        SSRF: r"requests\.(?:get|post|put|delete|head|patch|options|request)\(|urlopen\(|httpx\.\w+\(|urllib\.request",
        REDIRECT: r"\bredirect\(",
        NOSQL: r"\.(?:find|find_one|find_one_and_\w+|update_one|update_many|delete_one|delete_many|count_documents|aggregate)\(|\$where",
        LDAP: r"\bsearch(?:_ext)?_s\(|\bsearch_st\(|\bsearch_ext\(",
        XPATH: r"\.xpath\(|\.iterfind\(|\bXPath\(",
        CRLF: r"\.(?:set_cookie|add_header|set_header)\(|\.headers\.(?:add|set)\(",
    },
    "javascript": {
        SQL: r"\.(?:query|execute|raw)\(",
        CMD: r"child_process\.\w+\(|\b(?:execSync|execFileSync|spawnSync)\(",
        PATH: r"fs\.(?:readFile\w*|createReadStream|unlink\w*|rm\w*|readdir\w*)\(|res\.sendFile\(",
        SSRF: r"axios\.\w+\(|\bfetch\(|https?\.(?:get|request)\(|\brequest\(",
        REDIRECT: r"res\.redirect\(",
        NOSQL: r"\.(?:findOne|updateOne|updateMany|deleteOne|deleteMany|aggregate)\(|\$where",
    },
    "php": {
        SQL: r"->(?:query|get_results|get_col|get_var|get_row)\(|(?:mysqli|mysql|pg)_query\(",
        CMD: r"\b(?:system|exec|shell_exec|passthru|popen|proc_open)\(",
        PATH: r"\b(?:file_get_contents|fopen|readfile|include|require|include_once|require_once|unlink|rename|scandir)\(",
        SSRF: r"curl_exec\(|file_get_contents\(|get_headers\(|fsockopen\(|wp_remote_(?:get|post|request|head)\(|WP_Http\(",
        REDIRECT: r"header\(\s*['\"]Location",
        LDAP: r"ldap_(?:search|list|read)\(",
    },
    "java": {
        SQL: r"\.(?:executeQuery|executeUpdate|execute|createQuery)\(|createStatement", CMD: r"Runtime\.getRuntime\(\)\.exec|ProcessBuilder|\.exec\(",
        PATH: r"\b(?:File|FileInputStream|FileReader)\(|Files\.readAllBytes",
    },
    "ruby": {SQL: r"\.(?:execute|where|find_by_sql)\(", CMD: r"\b(?:system|exec|eval)\(|Open3\.|IO\.popen", PATH: r"(?:File\.(?:read|open)|IO\.read)\("},
    "go": {SQL: r"\.(?:Query|Exec|QueryRow)\(", CMD: r"exec\.Command(?:Context)?\(", PATH: r"ioutil\.ReadFile\(|os\.(?:Open|ReadFile)\("},
    "c_sharp": {
        SQL: r"Execute(?:Reader|NonQuery|Scalar)\(|(?:Sql|MySql|Npgsql)Command\(|FromSqlRaw\(|ExecuteSqlRaw\(", CMD: r"Process\.Start\(|ProcessStartInfo\(",
        PATH: r"File\.(?:ReadAllText|ReadAllBytes|OpenRead|WriteAllText)\(|(?:FileStream|StreamReader)\(", SSRF: r"WebClient\(|DownloadString\(|Get(?:String)?Async\(", REDIRECT: r"\bRedirect(?:Permanent)?\(",
    },
    "rust": {SQL: r"\.(?:execute|query|fetch_all|fetch_one)\(|sqlx::query\(|sql_query\(", CMD: r"Command::new\(", PATH: r"File::(?:open|create)\(|fs::(?:read|read_to_string|write)\("},
    "cpp": {SQL: r"mysql_query\(|PQexec\(|sqlite3_exec\(|->execute\(|execute_query\(", CMD: r"\b(?:system|popen|execlp?)\(", PATH: r"\bfopen\(|std::[io]fstream"},
    "c": {SQL: r"mysql_query\(|PQexec\(|sqlite3_exec\(", CMD: r"\b(?:system|popen|execlp?)\(", PATH: r"\bfopen\("},
    "kotlin": {SQL: r"(?:rawQuery|execSQL|executeQuery|createStatement)\(", CMD: r"getRuntime\(\)\.exec|ProcessBuilder\(", PATH: r"(?:openFileInput|FileInputStream)\("},
}

# What makes a value safe for a class, by language.
SANITISERS = {
    "python": {
        SQL: r"\.execute(?:many)?\s*\(\s*[^,]*['\"]\s*,\s*[(\[]?|sqlalchemy|\.scalar\(|\btext\(|bindparam|parameterized|\.filter\s*\(|\.filter_by\s*\(|\.exclude\s*\(",
        CMD: r"shlex\.(?:quote|split)|pipes\.quote|shell\s*=\s*False|escapeshellarg|\[\s*['\"]|\.quote\(",
        CODE: r"ast\.literal_eval|\bint\s*\(|\bfloat\s*\(|json\.loads",
        PATH: r"os\.path\.basename|secure_filename|realpath|\.startswith\s*\(|abspath|\.resolve\s*\(|re\.(?:full)?match\s*\(|\.isdigit\s*\(|\.isalnum\s*\(",
        SSTI: r"\|\s*e\b|escape\s*\(|markupsafe|autoescape",
        OBJ: r"\bsafe_load|SafeLoader|json\.loads",
        SSRF: r"urlparse|allowlist|whitelist|netloc\s+(?:in|not in)|is_allowed|validate_url|ipaddress|hostname|_host\s+(?:in|not in)|blocked|403",
        REDIRECT: r"urlparse|netloc|(?i:allow_?list)|is_safe_url|url_has_allowed|\bin\s+[A-Z][A-Z0-9_]{2,}\b|(?i:whitelist)",
        NOSQL: r"\b(?:str|int|float)\s*\(|ObjectId\s*\(|bson|re\.escape|sanitize",
        LDAP: r"escape_filter_chars|escape_dn_chars|ldap\.filter|ldap3\.utils|re\.escape",
        XPATH: r"\$\w+|etree\.XPath|quoteattr|re\.escape",
        CRLF: r"\.replace\s*\(|\bquote\s*\(|urlencode|re\.sub|\\r|\\n",
    },
    "javascript": {
        SQL: r"\?|\$\d|:\w+|\.escape\s*\(|parameterized|prepared|\[\s*\w+\s*\]", CMD: r"execFile|\bspawn\s*\(|shell:\s*false|\.split\s*\(", PATH: r"path\.(?:basename|normalize)|\.replace\s*\(",
        SSRF: r"allowlist|whitelist|new URL", REDIRECT: r"allowlist|startsWith|URL\(", NOSQL: r"\b(?:String|parseInt|Number)\s*\(|mongo-?[sS]anitize|sanitizeFilter|typeof\s+\w+\s*===\s*['\"]string['\"]|\$eq",
    },
    "php": {
        SQL: r"->prepare\s*\(|bindParam|bindValue|mysqli_real_escape_string|PDO::|\?|:\w+|quote\s*\(|in_array\s*\(\s*\$?\w+\s*,|esc_sql\s*\(|\$wpdb->_escape\s*\(", CMD: r"escapeshell(?:arg|cmd)",
        PATH: r"basename\s*\(|realpath\s*\(|str_replace\s*\(|validate_file", SSRF: r"filter_var|allowlist|realpath\s*\(|strpos\s*\(|wp_http_validate_url\s*\(|wp_safe_remote_get\s*\(",
        LDAP: r"ldap_escape\s*\(", REDIRECT: r"allowlist|parse_url|wp_(?:validate|sanitize|safe)_redirect\s*\(|esc_url(?:_raw)?\s*\(",
    },
    "java": {SQL: r"PreparedStatement|\?|setString|setInt|createQuery|NamedParameter", CMD: r"ProcessBuilder\s*\(\s*new|\[\s*\]", PATH: r"getCanonicalPath|normalize\s*\(|FilenameUtils"},
    "ruby": {SQL: r"\?|sanitize_sql|\.where\s*\(\s*\w+:\s*", CMD: r"Shellwords|shellescape", PATH: r"File\.(?:basename|expand_path)"},
    "go": {SQL: r"\$\d|\?|Prepare\s*\(", CMD: r"exec\.Command\s*\(\s*['\"]\w", PATH: r"filepath\.(?:Base|Clean)"},
    "c_sharp": {SQL: r"(?:Sql|Db|Npgsql)Parameter|Parameters\.Add|AddWithValue|@\w+", CMD: r"ArgumentList", PATH: r"Path\.Get(?:FileName|FullPath)"},
    "rust": {SQL: r"\.bind\s*\(|\$\d|sqlx::query!|query_as!|\?", CMD: r"\.args\s*\("},
    "cpp": {SQL: r"mysql_real_escape_string|PQexecParams|sqlite3_(?:bind|prepare)|\?", CMD: r"execvp?\b"},
    "c": {SQL: r"mysql_real_escape_string|PQexecParams|sqlite3_bind|\?", CMD: r"execvp?\b"},
    "kotlin": {SQL: r"PreparedStatement|\?|setString|compileStatement|selectionArgs", CMD: r"arrayOf\s*\("},
}
for _table in (SOURCES, SINKS, SANITISERS):
    _table["typescript"] = _table["tsx"] = _table["javascript"]

# Calls that clean a value whatever its use; shell characters; classes guarded anywhere in a function.
CLEANERS = r"\b(?:int|float|bool)\s*\(|shlex\.(?:quote|split)|escapeshellarg|secure_filename|os\.path\.basename|\.quote\(|hashlib\.|uuid\."
SHELL_META = r"[;&|`>$<]|\\n"
GUARDED = (SSRF, REDIRECT, PATH)
WHOLE_VALUE = tuple(c for c in CLASSES if c != SQL)

# Library calls that neither pass taint on nor are sinks.
BENIGN = (
    r"(?i)(?:_meta|_option|_setting|_transient)$|^(?:sanitize_|esc_|wp_validate|wpmu_validate|wp_kses)|^(?:wp_(?:verify_nonce|create_nonce|nonce_url|nonce_field|referer_field|get_referer"
    r"|redirect|safe_redirect|hash|salt|get_session_token|nonce_tick|unslash|slash|die|handle_upload|handle_sideload|check_filetype|check_filetype_and_ext|crop_image|get_image_editor"
    r"|update_post|insert_post|update_attachment_metadata|edit_theme_plugin_file)|check_(?:admin|ajax)_referer|apply_filters(?:_ref_array)?|do_action|absint|intval|get_terms?|get_posts?"
    r"|get_plugin_data|create_attachment_object)$"
)
