"""HTTP routes in source text: patterns of several frameworks, line by line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators.dedupe import as_of_forward, keep_first

# Kind, pattern, groups of verb and path (0: none), in the order that they are tried.
PATTERNS = (
    ("decorator", r"(?i)@\w+\.(route|get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)[\"']", 1, 2),
    ("call", r"(?i)\b\w+\.(get|post|put|delete|patch|all)\s*\(\s*[\"']([^\"']+)[\"']", 1, 2),
    ("spring", r"(?i)@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']", 1, 2),
    ("django", r"(?i)\b(path|re_path|url)\s*\(\s*r?[\"']([^\"']+)[\"']", 0, 2),
    ("go_mux", r"(?i)\bHandleFunc\s*\(\s*[\"']([^\"']+)[\"']", 0, 1),
    ("php", r"(?i)(?:Route::|->)(get|post|put|delete|patch|any)\s*\(\s*[\"']([^\"']+)[\"']", 1, 2),
    ("rails", r"(?i)^\s*(get|post|put|delete|patch)\s+[\"']([^\"']+)[\"']", 1, 2),
    ("webrick", r"(?i)\bmount_proc\s*\(?\s*[\"']([^\"']+)[\"']", 0, 1),
    ("wp_rest", r"(?i)\bregister_rest_route\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]", 0, 2),
    ("wp_ajax", r"(?i)\badd_action\s*\(\s*['\"]wp_ajax_([^'\"]+)['\"]", 0, 1),
    ("wp_ajax_nopriv", r"(?i)\badd_action\s*\(\s*['\"]wp_ajax_nopriv_([^'\"]+)['\"]", 0, 1),
    ("wp_menu", r"(?i)\badd_menu_page\s*\([^)]*['\"]([^'\"]+)['\"]\s*,\s*['\"]?([^,'\")]+)", 0, 1),
    ("wp_submenu", r"(?i)\badd_submenu_page\s*\([^)]*['\"]([^'\"]+)['\"]\s*,\s*['\"]?([^,'\")]+)", 0, 1),
)
# Methods that a verb stands for, others stand for themselves; kinds without a verb take both.
VERBS = {"all": "GET,POST", "any": "GET,POST", "route": "GET", "request": "GET,POST"}
METHODS_OF = r"methods\s*=\s*\[([^\]]*)\]"


def _methods(kind: str, verb: Column, rest: Column) -> Column:
    if not kind:
        return F.array(F.lit("GET"), F.lit("POST"))
    named = F.lit(None).cast("string")
    for v, m in VERBS.items():
        named = F.when(verb == v, m).otherwise(named)
    own = F.split(F.coalesce(named, F.upper(verb)), ",")
    if kind != "decorator":
        return own
    given = F.transform(F.regexp_extract_all(F.regexp_extract(rest, METHODS_OF, 1), F.lit(r"[\"'](\w+)[\"']"), F.lit(1)), F.upper)
    return F.when(F.size(given) > 0, given).otherwise(own)


def _path(kind: str, first: Column, path: Column) -> Column:
    if kind == "wp_rest":
        return F.concat(F.lit("/wp-json/"), first, path)
    if kind.startswith("wp_ajax"):
        return F.concat(F.lit("/wp-admin/admin-ajax.php?action="), path)
    if kind.startswith("wp_"):
        return F.concat(F.lit("/wp-admin/admin.php?page="), path)
    return path


def _route(i: int, kind: str, verb: int) -> Callable[[Column, Column], Column]:
    def route(m: Column, place: Column) -> Column:
        shown = _path(kind, m["first"], m["path"])
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(i).alias("kind_order"), place.alias("place"), shown.rlike(r"^[/^r]").alias("ok"),
            F.regexp_replace(F.regexp_replace(shown, r"^[r^]+", ""), r"\$+\z", "").alias("path"),
            _methods(kind if verb else "", F.lower(m["first"]), F.col("line")).alias("methods"),
        )

    return route


def file_routes(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, lineno, kind, place, path, methods) of every route of files (rel_path, text).

    Paths begin with /, ^ or r; leading r and ^ and a final $ go. place orders the
    matches of a kind on a line.
    """
    lines = files.select(F.col("rel_path").alias("file"), F.posexplode(F.split(text, "\r?\n", -1)).alias("at", "line"))
    found = []
    for i, (kind, pattern, verb, path) in enumerate(PATTERNS):
        take = lambda g: F.regexp_extract_all("line", F.lit(pattern), F.lit(g))  # noqa: B023, E731
        each = F.transform(F.arrays_zip(take(verb or 1).alias("first"), take(path).alias("path")), _route(i, kind, verb))
        found.append(F.when(F.col("line").rlike(pattern), each).otherwise(F.slice(each, 1, 0)))
    # One pass over the text: all kinds' matches of a line are one array.
    rows = lines.select("file", "at", F.explode(F.flatten(F.array(*found))).alias("r")).where("r.ok")
    return rows.select("file", (F.col("at") + 1).alias("lineno"), "r.kind", "r.kind_order", "r.place", "r.path", "r.methods")


def distinct_routes(routes: DataFrame) -> DataFrame:
    """The first route of each (methods, path, file): kinds in their order, then lines."""
    return keep_first(routes, ["methods", "path", "file"], [F.asc("kind_order"), F.asc("lineno"), F.asc("place")])


def linked(routes: DataFrame, units: DataFrame) -> DataFrame:
    """routes with the qualname of their handler: the first unit that starts on or after the route's
    line, else the file's only unit."""
    ahead = as_of_forward(routes, units.select("file", F.col("lineno").alias("unit_line"), F.col("qualname").alias("next")), "file", "lineno", "unit_line", ["next"])
    sole = units.groupBy("file").agg(F.count("*").alias("n"), F.first("qualname").alias("only")).where("n = 1").select("file", "only")
    return ahead.join(sole.hint("merge"), "file", "left").withColumn("handler", F.coalesce("next", "only")).drop("next", "only")
