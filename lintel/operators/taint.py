"""Data flow from untrusted input to sinks, per file: in functions, and between functions of the file.

Python is walked statement by statement over its syntax tree; other languages by
their assignments and calls. Both give the same rows. Summaries of functions
(which parameters reach which sinks) and call sites grow to a fixpoint within the
file, so a whole file is one task's work and only rows leave it.
"""

from __future__ import annotations

import ast
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.catalog import flows as K
from lintel.catalog.rules import CASTS
from lintel.operators.batches import flat_map
from lintel.operators.units import BATCH, blanked, scanned_units

SCHEMA = (
    "type string, cwe string, severity string, confidence double, file string, language string, function string, lineno int, source string, via string, "
    "sink_function string, sink_lineno int"
)
ROUNDS = 64


def source_in(text: str, language: str) -> bool:
    return bool(re.search(K.SOURCES[language], text))


def safe_for(cls: str, text: str, language: str) -> bool:
    pattern = K.SANITISERS.get(language, {}).get(cls)
    cast = cls in (K.SQL, K.CMD) and any(re.search(c, text) for c in CASTS.get(language, ()))
    return cast or bool(pattern and re.search(pattern, text))


def sinks_of(callee: str, language: str) -> list[str]:
    return [cls for cls, pattern in K.SINKS.get(language, {}).items() if re.search(pattern, callee + "(")]


def cleans(text: str) -> bool:
    """A value is clean if a cleaner makes it; of a concatenation each variable part must be, and no
    literal may hold a shell character."""
    text = text.strip()
    if re.search(r"\+|\bf[\"']|\.format\(|%\s*[(\w]", text):
        if re.search(K.SHELL_META, text):
            return False
        return all(re.match(r"^[\"'].*[\"']$", p.strip()) or re.search(K.CLEANERS, p) for p in text.split("+") if p.strip())
    return bool(re.search(K.CLEANERS, text) or re.search(r"^\(\s*[\"'].*(?:%s|\?)\s*.*[\"']\s*,", text))


class Function:
    """A function's flow: hits, parameters that reach sinks, call sites, tainted locals, tainted return."""

    def __init__(self, name: str, qual: str, params: list[str], line: int) -> None:
        self.name, self.qual, self.params, self.line = name, qual, params, line
        self.hits: list[tuple[str, int, str, str]] = []
        self.summary: dict[str, set[str]] = defaultdict(set)
        self.calls: list[tuple[str, list[str], int]] = []
        self.tainted: set[str] = set()
        self.returns = False
        self.body = ""


_LINE = re.compile(r"(.*?(?:\r\n|\n|\r|$))", re.S)


class Shown:
    """Texts of a file's nodes, each cut or unparsed once; ast.get_source_segment splits the whole file for every node."""

    def __init__(self, text: str) -> None:
        self.lines = [x.encode() for x in _LINE.findall(text)]
        self.cut: dict[ast.AST, str] = {}
        self.unparsed: dict[ast.AST, str] = {}

    def __call__(self, node: ast.AST) -> str:
        """The node as it stands in the file."""
        if node not in self.cut:
            self.cut[node] = self.segment(node) or self.plain(node)
        return self.cut[node]

    def segment(self, node: ast.AST) -> str:
        first, last = getattr(node, "lineno", None), getattr(node, "end_lineno", None)
        if first is None or last is None:
            return ""
        begin, end, lines = node.col_offset, node.end_col_offset, self.lines
        if first == last:
            return lines[first - 1][begin:end].decode()
        return b"".join([lines[first - 1][begin:], *lines[first : last - 1], lines[last - 1][:end]]).decode()

    def plain(self, node: ast.AST) -> str:
        """The node written anew."""
        if node not in self.unparsed:
            self.unparsed[node] = ast.unparse(node)
        return self.unparsed[node]


class PythonWalk(ast.NodeVisitor):
    """Statements in order; the last assignment decides, branches are taken as they come."""

    def __init__(self, shown: "Shown", node: ast.AST, params: set[str], clean_calls: set[str]) -> None:
        self.shown, self.node, self.params, self.clean = shown, node, params, clean_calls
        self.vars: dict[str, str] = {}
        self.hits: list[tuple[str, int, str, str]] = []
        self.by_param: dict[str, set[str]] = defaultdict(set)
        self.returns: set[str] = set()
        self.calls: list[tuple[str, list[str], int]] = []
        for statement in node.body:
            self.statement(statement)

    def taint(self, node: ast.AST) -> str:
        """How an expression is tainted, or ''."""
        shown = self.shown(node)
        if source_in(shown, "python"):
            return "reads untrusted input"
        if isinstance(node, ast.Call) and self.callee(node).split(".")[-1] in self.clean:
            return ""
        for n in ast.walk(node):
            if isinstance(n, ast.Name) and self.vars.get(n.id):
                return f"derived from tainted `{n.id}`"
            if isinstance(n, ast.Name) and n.id in self.params and n.id not in self.vars:
                return f"derived from parameter `{n.id}`"
        return ""

    def callee(self, node: ast.Call) -> str:
        return self.shown.plain(node.func)

    def statement(self, s: ast.stmt) -> None:
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            return
        if isinstance(s, ast.Assign | ast.AnnAssign | ast.AugAssign):
            if s.value is None:
                return
            self.scan(s.value)
            via, value = self.taint(s.value), self.shown(s.value)
            if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name) and self.vars.get(s.target.id):
                via = via or self.vars[s.target.id]
            elif via and cleans(value):
                via = ""
            for target in s.targets if isinstance(s, ast.Assign) else [s.target]:
                names = target.elts if isinstance(target, ast.Tuple | ast.List) else [target]
                for n in names:
                    if isinstance(n, ast.Name):
                        self.vars[n.id] = via
                header = isinstance(target, ast.Subscript) and isinstance(target.value, ast.Attribute) and target.value.attr == "headers" and ast.unparse(target.value.value) != "request"
                if header and via and not safe_for(K.CRLF, value, "python"):
                    self.hits.append((K.CRLF, s.lineno, via, f"{ast.unparse(target)} = {value}"[:120]))
            return
        if isinstance(s, ast.Return):
            if s.value is not None:
                self.scan(s.value)
                via = self.taint(s.value)
                if via and not cleans(self.shown(s.value)):
                    self.returns |= self.origins(s.value) or {""}
            return
        for name, value in ast.iter_fields(s):
            if isinstance(value, list):
                for x in value:
                    if isinstance(x, ast.stmt):
                        self.statement(x)
                    elif isinstance(x, ast.ExceptHandler | ast.match_case):
                        for y in x.body:
                            self.statement(y)
                    elif isinstance(x, ast.AST):
                        self.scan(x)
                        if isinstance(x, ast.withitem) and isinstance(x.optional_vars, ast.Name):
                            self.vars[x.optional_vars.id] = self.taint(x.context_expr)
            elif isinstance(value, ast.expr):
                self.scan(value)
                if isinstance(s, ast.For) and name == "iter" and isinstance(s.target, ast.Name):
                    self.vars[s.target.id] = self.taint(value)

    def origins(self, node: ast.AST) -> set[str]:
        return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and (n.id in self.params or self.vars.get(n.id))}

    def scan(self, node: ast.AST) -> None:
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                self.call(n)

    def call(self, node: ast.Call) -> None:
        callee, shown = self.callee(node), self.shown(node)
        self.calls.append((callee.split(".")[-1], [self.shown(a) for a in node.args], node.lineno))
        words = [(None, a) for a in node.args] + [(k.arg or "**", k.value) for k in node.keywords]
        all_args = shown[len(callee) :]
        for cls in sinks_of(callee, "python"):
            arg, via = None, ""
            for i, (key, a) in enumerate(words):
                if (cls == K.SQL and (key or i)) or (cls == K.SSTI and key):
                    continue
                via = self.taint(a)
                if via:
                    arg = a
                    break
            if arg is None:
                continue
            text = self.shown(arg)
            if cls == K.NOSQL and "{" not in text and not re.search(r"\$\w+", shown):
                continue
            if cls == K.CMD:
                shell = re.search(r"os\.system|os\.popen|getoutput", callee) or re.search(r"shell\s*=\s*True", shown)
                built = re.search(r"[\"']", all_args) and re.search(r"\+|f[\"']|\.format\(|%", all_args)
                if not (shell or built) or re.match(r"\(\s*\[", all_args) or cleans(text):
                    continue
            elif safe_for(cls, shown, "python") or (cls in K.GUARDED and safe_for(cls, self.shown.plain(self.node), "python")):
                continue
            self.hits.append((cls, node.lineno, via, shown[:120]))
            for p in self.params & {n.id for n in ast.walk(arg) if isinstance(n, ast.Name)}:
                self.by_param[p].add(cls)


def python_functions(text: str) -> list[Function]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    shown = Shown(text)
    nodes: list[tuple[ast.AST, str]] = []

    def gather(node: ast.AST, cls: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                nodes.append((child, f"{cls}.{child.name}" if cls else child.name))
            gather(child, child.name if isinstance(child, ast.ClassDef) else cls)

    gather(tree, "")
    returned: dict[str, bool] = {}
    for node, _ in nodes:
        names = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
        returned[node.name] = any(PythonWalk(shown, node, {p}, set()).returns for p in names) or bool(PythonWalk(shown, node, set(), set()).returns)
    clean = {n for n, r in returned.items() if not r}
    out = []
    for node, qual in nodes:
        names = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
        f = Function(node.name, qual, names, node.lineno)
        w = PythonWalk(shown, node, set(), clean)
        f.hits, f.calls, f.body = w.hits, w.calls, shown.plain(node)
        f.tainted = {v for v, via in w.vars.items() if via}
        for p in names:
            each = PythonWalk(shown, node, {p}, clean)
            own = {h[:2] for h in w.hits}
            f.summary[p] |= {h[0] for h in each.hits if h[:2] not in own} | each.by_param[p]
        f.returns = returned[node.name]
        out.append(f)
    return out


_ASSIGN = re.compile(r"\$?(\w+)\s*(?::?=|\.=|:=)\s*([^=;\n][^;\n]*)")
_CALL = re.compile(r"(?:new\s+)?[$\w](?:[\w$]|->|::|\.)*!?\s*\(")


def calls_in(text: str, bare: str) -> Iterator[tuple[str, str, int]]:
    """(callee, arguments with their brackets, offset) of every call."""
    for m in _CALL.finditer(bare):
        depth, at = 0, m.end() - 1
        for i in range(at, len(bare)):
            depth += (bare[i] == "(") - (bare[i] == ")")
            if not depth:
                yield re.sub(r"\s+$", "", text[m.start() : at]), text[at : i + 1], m.start()
                break


def split_args(args: str) -> list[str]:
    out, depth, part, quote = [], 0, "", ""
    for c in args.strip()[1:-1] + ",":
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c == "," and not depth:
            if part.strip():
                out.append(part.strip())
            part = ""
            continue
        else:
            depth += (c in "([{") - (c in ")]}")
        part += c
    return out


def named(var: str, text: str) -> bool:
    """The bare variable stands in text, not a member of that name."""
    return bool(re.search(r"(?<![\w>.:$])\$?\b" + re.escape(var) + r"\b", text))


def close_over(seed: set[str], pairs: list[tuple[str, str]], language: str) -> set[str]:
    """Variables built from seed ones, to a fixpoint; a numeric cast ends the flow."""
    known, grew = set(seed), True
    while grew:
        grew = False
        for left, right in pairs:
            if left not in known and not any(re.search(c, right) for c in CASTS.get(language, ())) and any(named(v, right) for v in known):
                known.add(left)
                grew = True
    return known


def provenance(arg: str, pairs: list[tuple[str, str]], tainted: set[str], depth: int = 4) -> str:
    """arg with the right-hand sides that its tainted variables come from."""
    first: dict[str, str] = {}
    for left, right in pairs:
        first.setdefault(left, right)
    text, seen, edge = arg, set(), [v for v in tainted if named(v, arg)]
    while edge and depth:
        depth, following = depth - 1, []
        for v in edge:
            if v not in seen:
                seen.add(v)
                text += " " + first.get(v, "")
                following += [w for w in re.findall(r"\w+", first.get(v, "")) if w in first]
        edge = following
    return text


def other_functions(text: str, language: str) -> list[Function]:
    units = scanned_units(text, language) or [{"name": "<module>", "qualname": "<module>", "params": [], "lineno": 1, "source": text}]
    returning = {u["name"] for u in units if any(source_in(r, language) for r in re.findall(r"return\s+([^;\n]+)", u["source"]))}
    out, seen = [], set()
    for u in units:
        f, body = Function(u["name"], u["qualname"], u["params"], u["lineno"]), u["source"]
        f.body = body
        pairs = _ASSIGN.findall(body)
        helper = lambda r: any(c in returning for c in re.findall(r"([A-Za-z_]\w*)\s*\(", r))
        seed = {a for a, r in pairs if (source_in(r, language) or helper(r)) and not any(re.search(c, r) for c in CASTS.get(language, ()))}
        f.tainted = close_over(seed, pairs, language)
        derived = {p: close_over({p}, pairs, language) for p in u["params"]}
        meta = lambda a: any(re.search(r"[;|`>]|(?<![\w&])&(?![\w&])", x) for x in re.findall(r"'[^']*'|\"[^\"]*\"", a))
        for callee, args, at in calls_in(body, blanked(body, language)):
            line = u["lineno"] + body.count("\n", 0, at)
            f.calls.append((re.split(r"->|::|\.", callee.replace("new ", ""))[-1].strip(), split_args(args), line))
            # header("Location: ...") is a sink by its argument.
            shown = callee + args[:40].rstrip(")") if callee.strip() == "header" else callee
            for cls in sinks_of(shown, language):
                reads = source_in(args, language)
                uses = any(named(v, args) for v in f.tainted)
                for p, names in derived.items():
                    if any(named(v, args) for v in names) and not (safe_for(cls, args, language) and not (cls == K.CMD and meta(args))):
                        f.summary[p].add(cls)
                if not (reads or uses):
                    continue
                built = reads or any(x in args for x in ("+", "${", "#{", "`")) or re.search(r"[\"']\s*\.\s*\$?\w|\$?\w\s*\.\s*[\"']|format!?\s*\(|\{\}|\{\d|\{:|%[sd]|\"[^\"]*\$\w", args)
                whole = cls in K.WHOLE_VALUE or (not re.search(r"[\"']", args) and any(a.lstrip("&$") in f.tainted for a in split_args(args)))
                if not (built or whole) or (safe_for(cls, provenance(args, pairs, f.tainted), language) and not (cls == K.CMD and meta(args))):
                    continue
                if (cls, line) not in seen:
                    seen.add((cls, line))
                    f.hits.append((cls, line, "tainted input reaches sink", (callee + args)[:120]))
        f.returns = u["name"] in returning
        out.append(f)
    return out


def spread(functions: list[Function], language: str) -> None:
    """Summaries grow by the summaries of callees along positional arguments, but not through an
    argument that is sanitised there or where its variable is assigned."""
    by_name = defaultdict(list)
    for f in functions:
        by_name[f.name].append(f)
    for _ in range(ROUNDS):
        grew = False
        for f in functions:
            for name, args, _line in f.calls:
                if re.search(K.BENIGN, name):
                    continue
                for g in by_name.get(name, []):
                    if g is f:
                        continue
                    for p, arg in zip(g.params, args, strict=False):
                        for cls in g.summary.get(p, ()):
                            values = [r for v in re.findall(r"[A-Za-z_]\w*", arg) for left, r in _ASSIGN.findall(f.body) if left == v]
                            if safe_for(cls, arg, language) or any(safe_for(cls, r, language) for r in values):
                                continue
                            for mine in f.params:
                                if named(mine, arg) and cls not in f.summary[mine]:
                                    f.summary[mine].add(cls)
                                    grew = True
        if not grew:
            return


def flows_of(text: str, language: str) -> list[dict]:
    """Flows of one file, direct ones first, then those through calls."""
    if language not in K.SOURCES:
        return []
    functions = python_functions(text) if language == "python" else other_functions(text, language)
    spread(functions, language)
    by_name = defaultdict(list)
    for f in functions:
        by_name[f.name].append(f)
    rows, seen = [], set()
    for f in functions:
        for cls, line, via, shown in f.hits:
            rows.append({"type": cls, "confidence": 0.85 if language == "python" else 0.8, "function": f.qual, "lineno": line, "source": shown, "via": via, "sink_function": None, "sink_lineno": None})
    for f in functions:
        for name, args, line in f.calls:
            if re.search(K.BENIGN, name):
                continue
            for g in by_name.get(name, []):
                if g is f:
                    continue
                for p, arg in zip(g.params, args, strict=False):
                    if not (source_in(arg, language) or any(named(v, arg) for v in f.tainted)):
                        continue
                    for cls in sorted(g.summary.get(p, ())):
                        if (cls, f.qual, g.qual) not in seen:
                            seen.add((cls, f.qual, g.qual))
                            rows.append({
                                "type": cls, "confidence": 0.8, "function": f.qual, "lineno": line, "source": f"tainted argument of {name}() reaches a sink in {g.qual}",
                                "via": f"through {name}()", "sink_function": g.qual, "sink_lineno": g.line,
                            })
    return [{**r, "cwe": K.CLASSES[r["type"]][0], "severity": K.CLASSES[r["type"]][1], "language": language} for r in rows]


def analyse(files: DataFrame) -> DataFrame:
    """Flows of files (rel_path, language, text). A file that breaks the analysis gives none."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)

    def run(file: str, language: str, text: str | None) -> list[dict]:
        try:
            return [{**r, "file": file} for r in flows_of((text or "").replace("\r\n", "\n"), language)]
        except RecursionError:
            return []

    return flat_map(files.where(F.col("language").isin(*K.SOURCES)).select("rel_path", "language", "text"), run, SCHEMA)
