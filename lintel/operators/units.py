"""Code units: functions of a file, cut by Python's own parser or by a brace and end scanner.

Parsing is a property of one file, so it runs in Arrow batches of files and only
rows leave the task.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators.batches import flat_map

BATCH = "64"
SCHEMA = (
    "file string, language string, name string, qualname string, class_name string, lineno int, end_lineno int, "
    "source string, decorators string, params array<string>, is_module boolean"
)

# Headers of functions by language: each with groups name and params.
_NAME, _PARAMS = r"(?P<name>[A-Za-z_$][\w$]*)", r"\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"
_ARROW = rf"(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:function\s*\*?\s*\w*\s*)?{_PARAMS}\s*(?::\s*[\w<>\[\], |]+)?\s*(?:=>)?\s*\{{"
_INLINE = rf"(?P<call>[\w.]+\.(?:get|post|put|delete|patch|use|all))\s*\(\s*['\"](?P<route>[^'\"]*)['\"]\s*,(?:[^(){{}}]*,)?\s*(?:async\s*)?(?:function\s*)?{_PARAMS}\s*(?:=>)?\s*\{{"
_TYPED = rf"(?:[\w<>\[\],.?&*:]+\s+)+[*&]*(?:\w+::)?{_NAME}\s*{_PARAMS}\s*(?:const|noexcept|override|throws\s+[\w., ]+)?\s*\{{"
HEADERS = {
    "javascript": [rf"function\s*\*?\s+{_NAME}\s*{_PARAMS}\s*\{{", _ARROW, _INLINE, rf"^[ \t]+(?:async\s+|static\s+)*{_NAME}\s*{_PARAMS}\s*\{{"],
    "php": [rf"function\s+&?{_NAME}\s*{_PARAMS}\s*(?::\s*\??[\w\\|]+)?\s*\{{"],
    "go": [rf"func\s+(?:\([^)]*\)\s*)?{_NAME}\s*{_PARAMS}[^{{\n]*\{{"],
    "rust": [rf"fn\s+{_NAME}\s*(?:<[^>]*>)?\s*{_PARAMS}[^{{;]*\{{"],
    "kotlin": [rf"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}\s*{_PARAMS}[^{{=\n]*\{{"],
    "ruby": [rf"^[ \t]*def\s+(?:self\.)?(?P<name>[\w?!]+)(?:\s*{_PARAMS}|[ \t]+(?P<bare>[^\n;]*))?"],
    "java": [_TYPED], "c_sharp": [_TYPED], "c": [_TYPED], "cpp": [_TYPED], "scala": [rf"def\s+{_NAME}\s*{_PARAMS}[^{{\n]*\{{"],
}
HEADERS["typescript"] = HEADERS["tsx"] = HEADERS["javascript"]
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "new", "function", "synchronized", "using", "lock", "foreach", "elseif", "sizeof"}
_CLASS = re.compile(r"\b(?:class|struct|interface|trait|module|impl)\s+([A-Za-z_]\w*)")
_RUBY_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|case|while|until|for|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$")
_RUBY_END = re.compile(r"^\s*end\b")


def blanked(text: str, language: str) -> str:
    """text of equal length with literals and comments blanked, so that braces in them don't count."""
    marks = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|/\*.*?\*/|//[^\n]*'
    marks += r"|`(?:[^`\\]|\\.)*`" if language in ("javascript", "typescript", "tsx", "go") else ""
    marks += r"|#[^\n]*" if language in ("php", "ruby") else ""
    return re.sub(marks, lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)


def _close(bare: str, at: int) -> int:
    """Index after the brace that closes the one at `at`, or the end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(bare, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(bare)


def _param_names(text: str, language: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text + ",":
        if c == "," and not depth:
            part = re.split(r"=|:(?!:)", re.sub(r"<[^<>]*>", "", part))[0] if language not in ("rust",) else part.split(":")[0]
            words = re.findall(r"[A-Za-z_]\w*", part)
            if words and language == "go":
                out.append(words[0])
            elif words and words[-1] not in ("void", "self"):
                out.append(words[-1])
            part = ""
            continue
        depth += (c in "([{") - (c in ")]}")
        part += c
    return out


def scanned_units(text: str, language: str) -> list[dict]:
    """Functions of a brace or end language."""
    bare, found = blanked(text, language), []
    classes = []
    if language != "ruby":
        for m in _CLASS.finditer(bare):
            brace = bare.find("{", m.end())
            if brace >= 0:
                classes.append((m.start(), _close(bare, brace), m.group(1)))
    for pattern in HEADERS.get(language, []):
        for m in re.finditer(pattern, text if "route" in pattern else bare, re.M):
            g = m.groupdict()
            if g.get("name") in _NOT_NAMES or any(m.start() == u["start"] for u in found):
                continue
            begin = m.start() + (len(m.group()) - len(m.group().lstrip()))
            if language == "ruby":
                lines, depth, end = bare[begin:].split("\n"), 0, len(bare)
                offset = begin
                for line in lines:
                    depth += bool(_RUBY_OPEN.search(line)) - bool(_RUBY_END.search(line))
                    offset += len(line) + 1
                    if depth <= 0:
                        end = min(offset - 1, len(bare))
                        break
            else:
                end = _close(bare, m.end() - 1)
            name = g.get("name") or f"handler[{g['call'].rsplit('.', 1)[1].upper()} {g['route']}]"
            params = text[m.start("params") : m.end("params")] if g.get("params") else (g.get("bare") or "")
            cls = next((c for a, b, c in sorted(classes, reverse=True) if a < begin < b), None)
            before = text[:begin].rsplit("\n\n", 1)[-1].split("\n")[:-1]
            marks = [x.strip() for x in before if re.match(r"\s*(@\w|\[\w)", x)]
            found.append({
                "start": m.start(), "name": name, "class_name": cls, "qualname": f"{cls}.{name}" if cls else name, "lineno": text.count("\n", 0, begin) + 1,
                "end_lineno": text.count("\n", 0, end) + 1, "source": text[begin:end], "decorators": "\n".join(marks), "params": _param_names(params, language),
            })
    return sorted(found, key=lambda u: (u["lineno"], -u["end_lineno"]))


def python_units(text: str) -> list[dict]:
    """Functions by Python's parser, nested ones too; a file that doesn't parse is cut by indentation."""
    lines = text.split("\n")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return _indented_units(lines)
    found: list[dict] = []

    def walk(node: ast.AST, cls: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                a = child.args
                names = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
                marks = ["@" + (ast.get_source_segment(text, d) or "") for d in child.decorator_list]
                found.append({
                    "name": child.name, "class_name": cls, "qualname": f"{cls}.{child.name}" if cls else child.name, "lineno": child.lineno, "end_lineno": child.end_lineno,
                    "source": "\n".join(lines[child.lineno - 1 : child.end_lineno]), "decorators": "\n".join(marks), "params": names,
                })
            walk(child, child.name if isinstance(child, ast.ClassDef) else cls)

    walk(tree, None)
    return sorted(found, key=lambda u: (u["lineno"], -u["end_lineno"]))


def _indented_units(lines: list[str]) -> list[dict]:
    found = []
    for i, line in enumerate(lines):
        m = re.match(r"(\s*)(?:async\s+)?def\s+(\w+)\s*\(([^)]*)", line)
        if not m:
            continue
        depth, end = len(m.group(1)), i + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > depth):
            end += 1
        while end > i + 1 and not lines[end - 1].strip():
            end -= 1
        marks = []
        for above in reversed(lines[:i]):
            if not above.strip().startswith("@"):
                break
            marks.insert(0, above.strip())
        params = [re.split(r"[:=]", p)[0].strip(" *") for p in m.group(3).split(",") if p.strip(" *")]
        found.append({"name": m.group(2), "class_name": None, "qualname": m.group(2), "lineno": i + 1, "end_lineno": end, "source": "\n".join(lines[i:end]), "decorators": "\n".join(marks), "params": params})
    return found


def units_of(text: str, language: str) -> list[dict]:
    return python_units(text) if language == "python" else scanned_units(text, language)


def module_residue(text: str, units: list[dict]) -> str:
    """The file with the lines of its units blank, so that what is left keeps its line numbers."""
    inside = {n for u in units for n in range(u["lineno"], u["end_lineno"] + 1)}
    return "\n".join("" if i in inside else x for i, x in enumerate(text.split("\n"), 1))


def _rows(file: str, language: str, text: str) -> list[dict]:
    text = text.replace("\r\n", "\n")
    found = units_of(text, language)
    rows = [u | {"file": file, "language": language, "is_module": False} for u in found]
    rest = module_residue(text, found)
    if rest.strip():
        rows.append({"file": file, "language": language, "name": "<module>", "qualname": "<module>", "class_name": None, "lineno": 1, "end_lineno": text.count("\n") + 1, "source": rest, "decorators": "", "params": [], "is_module": True})
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Units of files (rel_path, language, text), nested functions too, and the rest of each file as <module>."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return flat_map(files.where(F.col("text").isNotNull()).select("rel_path", "language", "text"), _rows, SCHEMA)
