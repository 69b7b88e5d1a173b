"""Rewrites that close a finding, each accepted only if the code still parses and no rule fires any more.

A fixer takes the unit's text and gives a new one; nothing is written to the
scanned tree, the rewritten text is a column.
"""

from __future__ import annotations

import ast
import difflib
import re
import textwrap
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators import detectors, taint
from lintel.operators.batches import flat_map
from lintel.sources.shared import dealt

SCHEMA = "file string, function string, type string, fixed_source string, status string, note string, diff string"
Fixer = Callable[[str], str]


def _sub(*steps: tuple[str, str]) -> Fixer:
    def fix(text: str) -> str:
        for pattern, new in steps:
            text = re.sub(pattern, new, text)
        return text

    return fix


def _bind_sql(text: str) -> str:
    """execute("... " + x + "...") and its f-string and % forms with x as a bound parameter."""

    def joined(m: re.Match) -> str:
        parts = re.split(r"\s*\+\s*", m.group("arg"))
        names = [p for p in parts if not re.match(r"[\"']", p)]
        query = "".join("?" if p in names else p[1:-1] for p in parts)
        return f'{m.group("call")}"{re.sub(chr(39) + "[?]" + chr(39), "?", query)}", ({", ".join(names)},))' if names else m.group()

    def filled(m: re.Match) -> str:
        names = re.findall(r"\{\s*([^{}!:]+?)\s*\}", m.group("body"))
        query = re.sub(r"'?\{[^{}]+\}'?", "?", m.group("body"))
        return f'{m.group("call")}"{query}", ({", ".join(names)},))' if names else m.group()

    literal = r"(?:\"[^\"\n]*\"|'[^'\n]*')"
    call = r"(?P<call>\.(?:execute|query|raw)\()"
    text = re.sub(rf"{call}(?P<arg>{literal}(?:\s*\+\s*(?:[\w.]+|{literal}))+)\)", joined, text)
    text = re.sub(rf"{call}f\"(?P<body>[^\"\n]*)\"\)", filled, text)
    return re.sub(rf"{call}(?P<q>{literal})\s*%\s*\(?(?P<v>[\w., ]+?),?\)?\)", lambda m: f"{m.group('call')}{re.sub(r'%[sd]', '?', m.group('q'))}, ({m.group('v').strip()},))", text)


def _quote_command(text: str) -> str:
    def quoted(m: re.Match) -> str:
        parts = re.split(r"\s*\+\s*", m.group(2))
        return m.group(1) + " + ".join(p if re.match(r"[\"']", p) or "quote(" in p else f"shlex.quote({p})" for p in parts) + ")"

    return re.sub(r"(os\.(?:system|popen)\()((?:[\"'][^\"'\n]*[\"']|[\w.]+)(?:\s*\+\s*(?:[\"'][^\"'\n]*[\"']|[\w.]+))+)\)", quoted, text)


def _read_secret(text: str) -> str:
    return re.sub(r"(?i)(\b\w*(?:api[_-]?key|secret|passwd|password|token)\w*)(\s*=\s*)['\"][^'\"]{8,}['\"]", lambda m: f'{m.group(1)}{m.group(2)}os.environ["{m.group(1).upper()}"]', text)


def _lock_python(unit: detectors.Unit) -> str:
    """The body under a lock that all calls share: of the class for a method, else of the module.

    What such a lock can't hold stays: decorated functions (the lock's line would
    part them from their decorators), coroutines, generators, lines inside strings.
    """
    text = unit.source
    indent = text[: len(text) - len(text.lstrip())]
    flat = textwrap.dedent(text)
    try:
        function = ast.parse(flat).body[0]
    except (SyntaxError, ValueError, IndexError):
        return text
    inside = list(ast.walk(function))
    if unit.decorators or not isinstance(function, ast.FunctionDef) or any(isinstance(x, ast.Yield | ast.YieldFrom) for x in inside):
        return text
    if any(isinstance(x, ast.Constant | ast.JoinedStr) and x.end_lineno > x.lineno for x in inside):
        return text
    body = function.body[1:] if ast.get_docstring(function) is not None else function.body
    if not body or body[0].lineno == function.lineno:
        return text
    lines, lock = flat.split("\n"), f"{function.name}_lock"
    method = bool(function.args.args) and function.args.args[0].arg == "self"
    pad = " " * body[0].col_offset
    first = body[0].lineno - 1
    held = [f"{pad}with {'self.' if method else ''}{lock}:", *("    " + x if x.strip() else x for x in lines[first:])]
    head = ["import threading", f"{lock} = threading.Lock()", ""]
    return textwrap.indent("\n".join([*head, *lines[:first], *held]), indent)


def _after_brace(*opening: str, closing: str = "") -> Fixer:
    """Lines after the unit's first opening brace, and one before its last closing one."""

    def fix(text: str) -> str:
        head, brace, rest = text.partition("{")
        body, end, tail = rest.rpartition("}")
        if not brace or not end:
            return text
        inner = re.search(r"\n([ \t]*)\S", body)
        pad = inner.group(1) if inner else "    "
        lines = "".join(f"\n{pad}{x}" for x in opening)
        last = f"{pad}{closing}\n" if closing else ""
        return f"{head}{{{lines}{body}{last if body.endswith(chr(10)) else chr(10) * bool(last) + last}{end}{tail}"

    return fix


def _synchronize_ruby(text: str) -> str:
    lines = text.rstrip("\n").split("\n")
    if len(lines) < 3 or lines[-1].strip() != "end":
        return text
    pad = lines[1][: len(lines[1]) - len(lines[1].lstrip())]
    return "\n".join([lines[0], f"{pad}UNIT_MUTEX.synchronize do", *("  " + x for x in lines[1:-1]), f"{pad}end", lines[-1]])


#: How a check and the change after it are held together, by language. The names of the locks are the owner's to declare.
LOCKS: dict[str, Fixer] = {
    "java": lambda text: re.sub(r"^(\s*(?:(?:public|protected|private|static|final)\s+)*)(?!.*\bsynchronized\b)(?=[\w<>\[\], ]+\s+\w+\s*\()", r"\1synchronized ", text, count=1),
    "go": _after_brace("unitMutex.Lock()", "defer unitMutex.Unlock()"),
    "c_sharp": _after_brace("lock(unitLock)", "{", closing="}"),
    "ruby": _synchronize_ruby,
    "javascript": _after_brace("return unitMutex.runExclusive(async () => {", closing="});"),
    "typescript": _after_brace("return unitMutex.runExclusive(async () => {", closing="});"),
    "tsx": _after_brace("return unitMutex.runExclusive(async () => {", closing="});"),
    "php": _after_brace("$unitLock = fopen(sys_get_temp_dir() . '/unit.lock', 'c');", "flock($unitLock, LOCK_EX);"),
}
RACE = "Race Condition (TOCTOU)"

_REQUEST = r"request\.(?:args|form|json|values|data|get_json\(\))(?:\.get)?"
_DEF = r"(?m)\A([ \t]*)((?:async\s+)?def\s)"

FIXERS: dict[str, Fixer] = {
    "SQL Injection": _bind_sql,
    "OS Command Injection": _quote_command,
    "Code Injection": _sub((r"(?<![\w.])eval\(", "ast.literal_eval(")),
    "Insecure Deserialization": _sub((r"\byaml\.(?:unsafe_)?load\(([^,)]*)(?:,[^)]*)?\)", r"yaml.safe_load(\1)"), (r"\b(?:c?[Pp]ickle|marshal|dill)\.loads\(", "json.loads(")),
    "Debug Mode / Verbose Errors Enabled": _sub((r"(?i)\bdebug(\s*)=(\s*)True", r"debug\1=\2False")),
    "Disabled TLS Certificate Verification": _sub((r"\bverify(\s*)=(\s*)False", r"verify\1=\2True"), (r"rejectUnauthorized(\s*):(\s*)false", r"rejectUnauthorized\1:\2true"), (r"check_hostname(\s*)=(\s*)False", r"check_hostname\1=\2True")),
    "Weak / Broken Cryptography": _sub((r"hashlib\.(?:md5|sha1)\(", "hashlib.sha256("), (r"MODE_ECB", "MODE_GCM")),
    "Insecure Randomness for Security Value": _sub((r"\brandom\.choice\(", "secrets.choice("), (r"\brandom\.(?:randrange|randint)\(\s*0\s*,\s*(\w+)\s*\)", r"secrets.randbelow(\1)"), (r"\brandom\.random\(\)", "secrets.SystemRandom().random()")),
    "Overly Permissive File Permissions": _sub((r"(chmod\s*\([^,)]*,\s*)0o?[0-7]{0,2}[2367]\b", r"\g<1>0o600")),
    "Insecure Temporary File": _sub((r"\b(tempfile\.)?mktemp\(\s*\)", r"tempfile.mkstemp()[1]")),
    "Insecure Cookie Flags (session/auth)": _sub((r"(set_cookie\((?:[^()]|\([^()]*\))*?)(?:,\s*(?:httponly|secure|samesite)\s*=\s*[^,)]+)*\)", r"\1, httponly=True, secure=True, samesite='Lax')")),
    "CSRF Protection Disabled": _sub((r"(CSRF_(?:ENABLED|CHECK_DEFAULT)['\"]?\]?\s*[=:]\s*)False", r"\1True"), (r"(?m)^\s*@csrf(?:_exempt|\.exempt)\s*\n", "")),
    "Hardcoded Secret / Credential": _read_secret,
    "Open Redirect": _sub((r"\bredirect\((\w+)\)", r"redirect(\1 if \1 in ALLOWED_REDIRECTS else '/')")),
    "Path Traversal": _sub(
        (r"(?<![\w.])open\((['\"][^'\"\n]*['\"]\s*\+\s*)([\w.]+)(?=[,)])", r"open(\1os.path.basename(\2)"),
        (r"(?<![\w.])open\(([\w.]+)(?=[,)])", r"open(os.path.basename(\1)"),
    ),
    "Reflected Cross-Site Scripting (XSS)": _sub((r"(['\"]\s*\+\s*)(\w+)(\s*\+\s*['\"])", r"\1escape(\2)\3")),
    "Permissive CORS Configuration": _sub((r"(origins?\s*=\s*)['\"]\*['\"]", r"\1ALLOWED_ORIGINS")),
    "XML External Entity (XXE)": _sub((r"\b(?:lxml\.)?etree\.(fromstring|parse)\(([^()]*)\)", r"defusedxml.lxml.\1(\2)")),
    "Insecure Direct Object Reference (IDOR)": _sub(
        (r"(?m)^([ \t]*)return (\w+\.objects\.get\([^\n]*\)|\w+\.query\.get\([^\n]*\))$", r"\1found = \2\n\1if found.owner_id != current_user.id:\n\1    abort(403)\n\1return found"),
    ),
    "Broken Authorization (client-trusted role)": _sub((rf"{_REQUEST}\(?\[?['\"](?:is_)?(?:admin|role|staff)['\"][^)\]]*[)\]]\s*==\s*[\w'\"]+", "current_user.is_admin")),
    "Broken Authentication (static credential)": _sub((r"\b(\w+)\s*==\s*([A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD))\b", r"hmac.compare_digest(str(\1), \2)")),
    "Negative / Zero Quantity": _sub((rf"(?m)^([ \t]*)(\w*(?:qty|quantity|count|amount)\w*)\s*=\s*({_REQUEST}[^\n]+)$", r"\1\2 = int(\3)\n\1if \2 < 1:\n\1    abort(400)")),
    "Price / Quantity Manipulation": _sub((rf"(?m)^([ \t]*)(\w*(?:price|amount|total|cost)\w*)\s*=\s*({_REQUEST}[^\n]+)$", r"\1\2 = float(\3)\n\1if \2 <= 0 or not math.isfinite(\2):\n\1    abort(400)")),
    "Missing Authentication on Sensitive Action": _sub((_DEF, r"\1@login_required\n\1\2")),
    "Sensitive Action Without Rate Limiting": _sub((_DEF, r"\1@limiter.limit('5/minute')\n\1\2")),
    "JWT Verification Weakness": _sub((r"\bjwt\.decode\(([^,()]+(?:\([^()]*\))?)\s*,[^\n]*(?:verify_signature['\"]\s*:\s*False|verify\s*=\s*False|['\"]none['\"])[^\n)]*\)", r"jwt.decode(\1, JWT_KEY, algorithms=['HS256'])")),
    "Sensitive Information Exposure": _sub((r"(?m)^([ \t]*return )(?:os\.environ\b[^\n]*|str\(\w+\)|traceback\.format_exc\(\))$", r"\1'an error occurred'")),
    "Server-Side Request Forgery (SSRF)": _sub((r"(?m)^([ \t]*)([^\n]*\b(?:requests\.\w+|urlopen)\((\w+)[^\n]*)$", r"\1if urlparse(\3).hostname not in ALLOWED_HOSTS:\n\1    abort(400)\n\1\2")),
    "Server-Side Template Injection": _sub((r"render_template_string\(\s*(['\"])(.*?)\1\s*\+\s*(\w+)\s*\)", r"render_template_string(\1\2{{ value }}\1, value=\3)")),
}


def fixer_for(type_: str) -> Fixer | None:
    """By name, else the first whose name is part of the type or the other way."""
    return FIXERS.get(type_) or next((f for n, f in FIXERS.items() if n.lower() in type_.lower() or type_.lower() in n.lower()), None)


def parses(text: str, language: str) -> bool:
    if language != "python":
        return True
    try:
        ast.parse(text if not text.startswith((" ", "\t")) else "if 1:\n" + text)
    except (SyntaxError, ValueError):
        return False
    return True


def still_found(text: str, unit: detectors.Unit, type_: str) -> bool:
    """Whether a rule or a flow of that type is in the rewritten unit."""
    again = detectors.Unit(unit.file, unit.language, unit.name, unit.qualname, unit.class_name, unit.lineno, unit.end_lineno, text, unit.decorators, unit.params, unit.is_module, unit.linked, unit.file_imports)
    return any(r["type"] == type_ for r in detectors.find(again)) or any(r["type"] == type_ for r in taint.flows_of(text, unit.language))


def rewritten(unit: detectors.Unit, type_: str) -> str:
    """The unit's text with the rewrite for that type, which the language decides for races; as it is without one."""
    if type_ == RACE:
        return _lock_python(unit) if unit.language == "python" else LOCKS.get(unit.language, str)(unit.source)
    fix = fixer_for(type_)
    return fix(unit.source) if fix else unit.source


def repair(unit: detectors.Unit, type_: str) -> dict:
    new = rewritten(unit, type_)
    if new == unit.source:
        status, note = "suggested", "no rewrite of this shape"
    elif not parses(new, unit.language):
        status, note = "rejected", "the rewrite doesn't parse"
    elif still_found(new, unit, type_):
        status, note = "rejected", "the finding is still there"
    else:
        status, note = "applied", "the finding is gone"
    kept = new if status == "applied" else unit.source
    shown = "\n".join(x for x in difflib.unified_diff(unit.source.split("\n"), kept.split("\n"), lineterm="", n=0) if not x.startswith(("---", "+++")))
    return {"file": unit.file, "function": unit.qualname, "type": type_, "fixed_source": kept, "status": status, "note": note, "diff": shown}


def patches(findings: DataFrame, units: DataFrame) -> DataFrame:
    """A rewrite of its unit for each (type, file, function) of findings."""
    wanted = findings.select("type", "file", F.col("function").alias("qualname")).distinct()
    fields = ["file", "language", "name", "qualname", "class_name", "lineno", "end_lineno", "source", "decorators", "params", "is_module"]

    def run(*values: object) -> list[dict]:
        u = detectors.Unit(*values[:-1])
        u.params, u.decorators = u.params or [], u.decorators or ""
        return [repair(u, values[-1])]

    # A repair runs all rules again, so its rows are dealt over all cores, not by their bytes.
    return flat_map(dealt(units.join(wanted.hint("merge"), ["file", "qualname"]).select(*fields, "type"), "file"), run, SCHEMA)


def nearest(text: str, wanted: str, line: int) -> int:
    """Where the occurrence of wanted begins whose first line is nearest to line; the earlier of two, -1 without one."""
    places = [m.start() for m in re.finditer(re.escape(wanted), text)] if wanted else []
    return min(places, key=lambda at: (abs(text.count("\n", 0, at) + 1 - line), at), default=-1)


APPLIED = "file string, line int, status string, note string, fixed_text string, diff string"


def proposed(text: str, language: str, line: int, original: str, replacement: str) -> dict:
    """A proposed replacement at the occurrence nearest to its line, accepted if the file still parses."""
    at = nearest(text, original, line)
    new = text if at < 0 else text[:at] + replacement + text[at + len(original) :]
    if at < 0:
        status, note = "rejected", "the text to replace isn't in the file"
    elif new == text:
        status, note = "rejected", "nothing changes"
    elif not parses(new, language):
        status, note = "rejected", "the file doesn't parse any more"
    else:
        status, note = "applied", "replaced at line " + str(text.count("\n", 0, at) + 1)
    kept = new if status == "applied" else text
    shown = "\n".join(x for x in difflib.unified_diff(text.split("\n"), kept.split("\n"), lineterm="", n=0) if not x.startswith(("---", "+++")))
    return {"status": status, "note": note, "fixed_text": kept, "diff": shown}


def apply_proposals(files: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each of proposals (file, line, original, replacement) against files (rel_path, language, text), one by one.

    Null text, original or replacement counts as empty, a null line as 0; a
    proposal for a file that isn't there has no row.
    """
    some = proposals.select("file", F.coalesce("line", F.lit(0)).cast("int").alias("line"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("original", "replacement")))
    texts = files.select(F.col("rel_path").alias("file"), "language", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"file": r.file, "line": r.line} | proposed(r.text, r.language, r.line, r.original, r.replacement) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in APPLIED.split(",")])

    return some.join(texts, "file").mapInPandas(run, APPLIED)
