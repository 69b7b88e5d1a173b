"""The engine's operators over the tables of a folder, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.catalog import frameworks as C
from lintel.catalog import languages as L
from lintel.catalog import roles as R
from lintel.catalog import weaknesses as W
from lintel.functions import code, cvss, paths
from lintel.operators import claims, context, dedupe, interproc, merge, reports, routes, secrets, severity, verdict
from lintel.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# Documents as virtual files: the folder and the ending go by doc_id.
DIRS = ("src", "tests", "lib/requests", "auth", "matchers", "node_modules/x", "config", "docs.d", ".hidden", "app/views")
ENDS = (".py", ".js", ".php", ".JAVA", ".md", ".min.js", ".xyz", ".rb", ".go", ".ts", ".png")


def pick(values, n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), n)


def sql_pick(values, n: str) -> str:
    return "CASE " + n + " " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def doc_path() -> Column:
    i = F.col("doc_id")
    return F.concat(pick(DIRS, (i % len(DIRS)).cast("int")), F.lit("/"), F.col("source"), F.lit("_"), i.cast("string"), pick(ENDS, (i % len(ENDS)).cast("int")))


SQL_PATH = f"{sql_pick(DIRS, f'doc_id % {len(DIRS)}')} || '/' || source || '_' || doc_id || {sql_pick(ENDS, f'doc_id % {len(ENDS)}')}"
SQL_FILES = f"files AS (SELECT *, {SQL_PATH} AS rel_path, coalesce(strlen(text), 0) AS size FROM documents)"
SQL_LANG = "CASE lower(regexp_extract(rel_path, '\\.[^./]*$')) " + " ".join(f"WHEN {q(e)} THEN {q(lang)}" for e, lang in L.by_extension().items()) + " END"
SQL_STATUS = (
    "CASE WHEN rel_path LIKE 'node_modules/%' OR rel_path LIKE '.%' THEN 'skipped_dirs' WHEN "
    + " OR ".join(f"lower(rel_path) LIKE {q('%' + e)}" for e in L.BINARY_ENDINGS)
    + f" THEN 'skipped_binary' WHEN {SQL_LANG} IS NULL THEN 'skipped_unknown_lang' WHEN size > 20000 THEN 'skipped_too_large' ELSE 'analysable' END"
)


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").withColumn("rel_path", doc_path())
    return files.with_status(rows.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")), cap=20_000)


@query(f"WITH {SQL_FILES} SELECT {SQL_LANG} AS language, count(*) AS n, coalesce(bool_or({SQL_LANG} IN {sql_list(L.DEEP)}), false) AS deep FROM files GROUP BY 1")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_files(spark, sf_dir)
    return rows.groupBy("language").agg(F.count("*").alias("n")).withColumn("deep", paths.is_deep(F.col("language")))


@query(f"WITH {SQL_FILES} SELECT {SQL_STATUS} AS status, count(*) AS n, sum(size)::BIGINT AS bytes FROM files GROUP BY 1")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_files(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


SQL_ROLE = (
    f"CASE WHEN lower(regexp_extract(rel_path, '\\.[^./]*$')) IN {sql_list(R.DOC_ENDINGS)} THEN 'doc' "
    f"WHEN list_has_any(list_transform(string_split(lower(rel_path), '/'), lambda p: string_split(p, '.')[1]), {list(R.TEST_PARTS)}) THEN 'test' "
    f"WHEN list_has_any(string_split(lower(rel_path), '/'), {list(R.VENDOR_PARTS)}) OR regexp_matches(rel_path, '[.\\-]min\\.(js|css)$') THEN 'vendor' "
    f"WHEN list_has_any(list_transform(string_split(lower(rel_path), '/'), lambda p: string_split(p, '.')[1]), {list(R.TOOL_STEMS)}) THEN 'security_tool' "
    "ELSE 'application' END"
)


@query(f"WITH {SQL_FILES} SELECT {SQL_ROLE} AS role, count(*) AS n, min(rel_path) AS first FROM files GROUP BY 1")
def file_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_files(spark, sf_dir).groupBy(paths.role(F.col("rel_path")).alias("role")).agg(F.count("*").alias("n"), F.min("rel_path").alias("first"))


@query(
    "SELECT doc_id, i AS line, length(l) AS width FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"
)
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "l"))
    return rows.select("doc_id", (F.col("at") + 1).cast("bigint").alias("line"), F.length("l").cast("bigint").alias("width"))


def _sql_strip(lang: str) -> str:
    s = "text"
    for p in ('""".*?"""', "'''.*?'''", r"/\*.*?\*/"):
        s = f"regexp_replace({s}, {q(p)}, '', 'gs')"
    s = f"regexp_replace({s}, '#[^\\n]*', '', 'g')"
    s = f"CASE WHEN {lang} IN ('python', 'ruby') THEN {s} ELSE regexp_replace({s}, '//[^\\n]*', '', 'g') END"
    drop = f"regexp_matches(x, {q(code._CATALOGUE_CALL)}) OR regexp_matches(x, {q(code._CATALOGUE_NAME)})"
    return f"array_to_string(list_filter(string_split_regex({s}, '\\r?\\n'), lambda x: NOT ({drop})), chr(10))"


@query(f"SELECT doc_id, md5({_sql_strip('lang2')}) AS code_md5 FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'php' END AS lang2 FROM documents)")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.when(F.col("doc_id") % 2 == 0, "python").otherwise("php")
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(code.without_comments(F.col("text"), lang)).alias("code_md5"))


_CLEARED = " OR ".join(
    [f"regexp_matches(line, {q(p)})" for p in (secrets.PLACEHOLDER, secrets.QUERY_LINE, secrets.F_STRING, secrets.CALLED, secrets.READ)]
    + [f"regexp_matches(regexp_extract(matched, '[''\"]([^''\"]+)[''\"]', 1), {q(secrets.INTERPOLATED)})"]
)


def _sql_secrets(table: str, key: str, text: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT {key}, {i} AS ord, {q(label)} AS label, lineno, line, regexp_extract(line, {q(p)}) AS matched FROM lines" for i, (label, p) in enumerate(secrets.PATTERNS)
    )
    return (
        f"WITH lines AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS lineno FROM {table}), "
        f"hits AS (SELECT * FROM ({each}) WHERE matched <> '' AND NOT ({_CLEARED})) "
        f"SELECT {key}, label, lineno, matched FROM hits QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ord, lineno, matched) = 1"
    )


@query(_sql_secrets("documents", "doc_id", "text"))
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(t(spark, sf_dir, "documents"), "doc_id").withColumn("lineno", F.col("lineno").cast("bigint"))


@query(_sql_secrets("(SELECT page_id, replace(replace(url, 'example', 'corp'), '://', '://bot:pa55word@') AS u FROM pages)", "page_id", "u"))
def embedded_credentials_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "pages").select("page_id", F.replace(F.replace("url", F.lit("example"), F.lit("corp")), F.lit("://"), F.lit("://bot:pa55word@")).alias("u"))
    return secrets.secrets(rows, "page_id", "u").withColumn("lineno", F.col("lineno").cast("bigint"))


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages written as route calls, which the extractor then reads."""
    rows = t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("rel_path"), F.replace("html", F.lit('<a href="'), F.lit('\napp.get("')).alias("text"))
    return routes.file_routes(rows)


_SQL_LINKS = (
    "links AS (SELECT page_id::VARCHAR AS file, lineno, regexp_extract(line, 'app\\.get\\(\"([^\"'']+)[\"'']', 1) AS raw FROM "
    "(SELECT page_id, unnest(string_split_regex(replace(html, '<a href=\"', chr(10) || 'app.get(\"'), '\\r?\\n')) AS line, "
    "generate_subscripts(string_split_regex(replace(html, '<a href=\"', chr(10) || 'app.get(\"'), '\\r?\\n'), 1) AS lineno FROM pages) "
    "WHERE regexp_matches(line, 'app\\.get\\(\"([^\"'']+)[\"'']')), "
    "found AS (SELECT file, lineno, regexp_replace(regexp_replace(raw, '^[r^]+', ''), '\\$+$', '') AS path FROM links WHERE regexp_matches(raw, '^[/^r]'))"
)


@query(f"WITH {_SQL_LINKS} SELECT file, path, count(*) AS n FROM found GROUP BY 1, 2")
def route_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_routes(spark, sf_dir).groupBy("file", "path").agg(F.count("*").alias("n"))


@query(f"WITH {_SQL_LINKS} SELECT file, path, 'GET' AS methods, min(lineno) AS lineno FROM found GROUP BY 1, 2")
def route_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routes.distinct_routes(page_routes(spark, sf_dir))
    return rows.select("file", "path", F.array_join("methods", ",").alias("methods"), F.col("lineno").cast("bigint").alias("lineno"))


def page_path() -> Column:
    return F.concat(F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1), F.lit("/"), pick(_ENDPOINTS, (F.col("page_id") % 9).cast("int")))


_SQL_BUCKET = "[" + ", ".join(
    ("CASE WHEN " + ("" if not m else f"m = '{m}' AND ") + "(" + " OR ".join(f"contains(p, {q(w)})" for w in words.split()) + f") THEN {q(b)} END") for b, (m, words) in R.ROUTE_BUCKETS.items()
) + f", CASE WHEN m = 'GET' AND regexp_matches(path, {q(R.ROUTE_ID)}) THEN 'id' END]"
_ENDPOINTS = ("search", "login", "pay", "user/:id", "file", "redirect", "balance", "admin", "home")
_SQL_PAGES = f"(SELECT page_id, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) || '/' || {sql_pick(_ENDPOINTS, 'page_id % 9')} AS path, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS m FROM pages)"


@query(f"SELECT bucket, count(*) AS n, min(path) AS first FROM (SELECT path, unnest({_SQL_BUCKET}) AS bucket FROM (SELECT *, lower(path) AS p FROM {_SQL_PAGES})) WHERE bucket IS NOT NULL GROUP BY 1")
def route_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, methods = page_path(), F.array(F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST"))
    rows = t(spark, sf_dir, "pages").select(path.alias("path"), F.explode(paths.route_buckets(path, methods)).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("path").alias("first"))


@query(
    f"SELECT bucket, path, rn FROM (SELECT bucket, path, row_number() OVER (PARTITION BY bucket ORDER BY path) AS rn FROM (SELECT DISTINCT path, unnest({_SQL_BUCKET}) AS bucket "
    f"FROM (SELECT *, lower(path) AS p FROM {_SQL_PAGES})) WHERE bucket IS NOT NULL) WHERE rn <= 3"
)
def topn_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    path, methods = page_path(), F.array(F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST"))
    rows = t(spark, sf_dir, "pages").select(path.alias("path"), F.explode(paths.route_buckets(path, methods)).alias("bucket")).distinct()
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("path")).cast("bigint"))
    return ranked.where("rn <= 3").select("bucket", "path", "rn")


@query(
    "SELECT v.event_id, epoch_us(p.ts) AS next_us FROM (SELECT * FROM events WHERE event_type = 'view') v "
    "ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.ts <= p.ts"
)
def asof_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("next_ts"))
    return dedupe.as_of_forward(views, bought, "user_id", "ts", "next_ts", ["next_ts"]).select("event_id", code.micros(F.col("next_ts")).alias("next_us"))


@query(
    "SELECT v.event_id, coalesce(epoch_us(p.ts), s.first_us, -1) AS handler FROM (SELECT * FROM events WHERE event_type = 'view') v "
    "ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.ts <= p.ts "
    "LEFT JOIN (SELECT user_id, min(epoch_us(ts)) AS first_us FROM events WHERE event_type = 'signup' GROUP BY 1) s ON v.user_id = s.user_id"
)
def asof_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("next_ts"))
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min(code.micros(F.col("ts"))).alias("first_us"))
    ahead = dedupe.as_of_forward(views, bought, "user_id", "ts", "next_ts", ["next_ts"]).join(first, "user_id", "left")
    return ahead.select("event_id", F.coalesce(code.micros(F.col("next_ts")), F.col("first_us"), F.lit(-1)).alias("handler"))


def line_findings(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").where(f"l_returnflag {flag}")
    return rows.select(
        F.col("l_linestatus").alias("type"), (F.col("l_orderkey") % 500).alias("file"), F.col("l_suppkey").alias("function"), (F.col("l_partkey") % 200).alias("lineno"),
        F.round("l_discount", 2).alias("confidence"), F.lit("static").alias("detection_method"), F.lit("CWE-1").alias("cwe"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def _sql_line_findings(flag: str) -> str:
    return (
        "(SELECT l_linestatus AS type, l_orderkey % 500 AS file, l_suppkey AS function, l_partkey % 200 AS lineno, round(l_discount, 2) AS confidence, "
        f"l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_returnflag {flag})"
    )


@query(
    f"WITH t AS {_sql_line_findings(chr(61) + chr(32) + q('R'))}, f AS {_sql_line_findings(chr(61) + chr(32) + q('A'))}, "
    "p AS (SELECT t.ord AS flow, min(f.ord) AS hit, max(t.confidence) AS c FROM t JOIN f ON t.type = f.type AND t.file = f.file AND (t.function = f.function OR abs(t.lineno - f.lineno) <= 6) GROUP BY 1), "
    "b AS (SELECT hit, max(c) AS c FROM p GROUP BY 1) "
    "SELECT 'kept' AS kind, f.ord, greatest(f.confidence, coalesce(b.c, f.confidence)) AS confidence FROM f LEFT JOIN b ON f.ord = b.hit "
    "UNION ALL SELECT 'new', ord, confidence FROM (SELECT * FROM t WHERE ord NOT IN (SELECT flow FROM p) QUALIFY row_number() OVER (PARTITION BY type, file, function, lineno ORDER BY ord) = 1)"
)
def near_dup_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, new = dedupe.merge_flows(line_findings(spark, sf_dir, "= 'A'"), line_findings(spark, sf_dir, "= 'R'"))
    return kept.select(F.lit("kept").alias("kind"), "ord", "confidence").union(new.select(F.lit("new"), "ord", "confidence"))


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '([a-z]+)', 1)), lambda w: NOT list_contains(['of', 'in', 'the', 'for', 'a', 'an', 'to', 'use', 'via', 'and'], w))"


@query(
    f"WITH p AS (SELECT p_partkey, p_brand, p_size, {_WORDS.format('p_name')} AS w FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b "
    "ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE list_has_any(a.w, b.w)"
)
def token_overlap_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = F.array(*[F.lit(w) for w in dedupe.COMMON_WORDS])
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.array_except(code.type_words(F.col("p_name")), common).alias("w"))
    a, b = p.alias("a"), p.alias("b")
    on = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.p_partkey") < F.col("b.p_partkey")) & F.arrays_overlap("a.w", "b.w")
    return a.join(b, on).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"))


@query(
    "WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS file, l_linestatus AS cwe, l_partkey % 300 AS line FROM lineitem), "
    "lead AS (SELECT file, cwe, min(line) AS line FROM l GROUP BY 1, 2 UNION ALL SELECT l.file, l.cwe, min(l.line) FROM lead JOIN l ON l.file = lead.file AND l.cwe = lead.cwe AND l.line > lead.line + 3 "
    "GROUP BY l.file, l.cwe, lead.line) SELECT DISTINCT file::VARCHAR AS file, cwe, line::BIGINT AS line FROM lead"
)
def line_window_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("file"), F.col("l_linestatus").alias("cwe"), (F.col("l_partkey") % 300).alias("line"), F.lit("x").alias("name"),
        F.lit("LOW").alias("severity"), F.lit(0.5).alias("confidence"), F.lit("matcher").alias("layer"),
    ).distinct().withColumn("ord", F.col("line"))
    return merge.merge_layers(rows).select("file", "cwe", F.col("line").cast("bigint").alias("line"))


def order_claims(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return t(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(
        "o_orderkey", F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("cwe"), F.dayofyear("o_orderdate").alias("lineno"), F.col("o_orderpriority").alias("type")
    )


def _sql_order_claims(status: str) -> str:
    return f"(SELECT o_orderkey, o_custkey AS file, o_orderpriority AS cwe, dayofyear(o_orderdate) AS lineno, {_WORDS.format('o_orderpriority')} AS w FROM orders WHERE o_orderstatus = '{status}')"


@query(
    f"SELECT o_orderkey FROM {_sql_order_claims('F')} c WHERE NOT EXISTS (SELECT 1 FROM {_sql_order_claims('O')} e WHERE c.file = e.file AND "
    "((c.cwe = e.cwe AND abs(c.lineno - e.lineno) <= 3) OR (c.lineno = e.lineno AND e.lineno > 0 AND list_has_any(c.w, e.w))))"
)
def anti_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.new_claims(order_claims(spark, sf_dir, "F"), order_claims(spark, sf_dir, "O")).select("o_orderkey")


@query(
    "SELECT lang, source, count(*) AS n FROM documents WHERE (lang, source) IN (SELECT lang, source FROM documents WHERE regexp_matches(text, 'GNU General Public')) GROUP BY 1, 2"
)
def semi_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    marked = d.where(F.col("text").rlike("GNU General Public")).select("lang", "source").distinct()
    return d.join(marked, ["lang", "source"], "left_semi").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    "WITH f AS (SELECT l_returnflag AS type, l_suppkey AS file, l_linestatus AS function, l_linenumber AS matcher_id, l_quantity AS confidence, l_partkey AS lineno, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) "
    "SELECT ord, type, file, function FROM (SELECT *, min(matcher_id) OVER g <> max(matcher_id) OVER g AS many, row_number() OVER (PARTITION BY type, file, function ORDER BY confidence DESC, lineno DESC, ord) AS rn "
    "FROM f WINDOW g AS (PARTITION BY type, file, function)) WHERE NOT many OR rn = 1"
)
def argmax_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("file"), F.col("l_linestatus").alias("function"), F.col("l_linenumber").alias("matcher_id"),
        F.col("l_quantity").alias("confidence"), F.col("l_partkey").alias("lineno"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return dedupe.collapse_matchers(rows).select("ord", "type", "file", "function")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def keep_first_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("body"))
    counted = d.withColumn("copies", F.count("*").over(Window.partitionBy("body")))
    return dedupe.keep_first(counted, ["body"], [F.asc("doc_id")]).select("doc_id", "copies")


CONFIDENCES = tuple(code.HALVED)
TYPES = ("SQL Injection", "Path Traversal", "Debug Mode / Verbose Errors Enabled", "XML External Entity (XXE)")


def doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return doc_files(spark, sf_dir).select(
        "doc_id", F.col("rel_path").alias("file"), pick(TYPES, (i % 4).cast("int")).alias("type"), pick(CONFIDENCES, (i % len(CONFIDENCES)).cast("int")).alias("confidence"), F.lit("ruby").alias("language"), F.lit("x").alias("source")
    )


@query(
    f"WITH {SQL_FILES}, f AS (SELECT doc_id, {SQL_ROLE} AS role, {sql_pick(TYPES, 'doc_id % 4')} AS type, doc_id % {len(CONFIDENCES)} AS c FROM files), "
    "a AS (SELECT *, CASE WHEN role IN ('doc', 'vendor', 'security_tool') THEN 'drop' WHEN role = 'test' AND type IN ('SQL Injection', 'Path Traversal') THEN 'penalize' ELSE 'keep' END AS action FROM f), "
    f"k AS (SELECT doc_id, action, CASE WHEN action = 'penalize' THEN {'CASE c ' + ' '.join(f'WHEN {i} THEN {v}::DOUBLE' for i, v in enumerate(code.HALVED.values())) + ' END'} ELSE {'CASE c ' + ' '.join(f'WHEN {i} THEN {v}::DOUBLE' for i, v in enumerate(code.HALVED)) + ' END'} END AS confidence FROM a WHERE action <> 'drop') "
    "SELECT doc_id, confidence FROM k WHERE action = 'keep' OR confidence >= 0.3"
)
def context_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.apply_context(doc_findings(spark, sf_dir), doc_files(spark, sf_dir).select("rel_path", F.lit("").alias("text"))).select("doc_id", "confidence")


SHAPES = ("os.system(shlex.quote(x))", "{{ name|e }}", "pickle.loads(x)", "os.path.basename(name)", "ast.literal_eval(x)")
KINDS = ("OS Command Injection", "Reflected Cross-Site Scripting (XSS)", "Insecure Deserialization", "Path Traversal", "Code Injection")


@query(
    f"WITH f AS (SELECT doc_id, {sql_pick(SHAPES, 'doc_id % 5')} AS source, {sql_pick(KINDS, '(doc_id // 5) % 5')} AS type FROM documents) SELECT doc_id FROM f WHERE NOT ("
    + " OR ".join(f"(contains(lower(type), {q(k)}) AND regexp_matches(source, {q('(?i)' + p)}))" for k, p in context.MITIGATIONS)
    + ")"
)
def mitigation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = t(spark, sf_dir, "documents").select("doc_id", pick(SHAPES, (i % 5).cast("int")).alias("source"), pick(KINDS, (F.floor(i / 5) % 5).cast("int")).alias("type"))
    return rows.where(~context.is_mitigated(F.col("type"), F.col("source"))).select("doc_id")


def _sql_weight(table: str, c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in W.WEIGHTS[table].items()) + " END"


def _sql_score() -> str:
    iss = "(1.0::DOUBLE - (1.0::DOUBLE - {C}) * (1.0::DOUBLE - {I}) * (1.0::DOUBLE - {A}))".format(**{m: _sql_weight("CIA", f'"{m}"') for m in "CIA"})
    impact = f"CASE WHEN \"S\" = 'C' THEN 7.52::DOUBLE * ({iss} - 0.029::DOUBLE) - 3.25::DOUBLE * pow({iss} - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * {iss} END"
    ease = f"8.22::DOUBLE * {_sql_weight('AV', '\"AV\"')} * {_sql_weight('AC', '\"AC\"')} * (CASE WHEN \"S\" = 'C' THEN {_sql_weight('PR_C', '\"PR\"')} ELSE {_sql_weight('PR_U', '\"PR\"')} END) * {_sql_weight('UI', '\"UI\"')}"
    return (
        f"CASE WHEN impact <= 0 THEN 0.0::DOUBLE WHEN n % 10000 = 0 THEN n / 100000.0::DOUBLE ELSE (n // 10000 + 1) / 10.0::DOUBLE END AS score FROM "
        f"(SELECT *, round_even(least(CASE WHEN \"S\" = 'C' THEN 1.08::DOUBLE * (impact + ease) ELSE impact + ease END, 10.0::DOUBLE) * 100000, 0)::BIGINT AS n FROM (SELECT *, {impact} AS impact, {ease} AS ease FROM vectors))"
    )


CODES = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}


@query(
    "WITH vectors AS (SELECT * FROM " + ", ".join(f"(SELECT unnest({list(v)}) AS \"{m}\")" for m, v in CODES.items()) + ") "
    'SELECT \'CVSS:3.1\' || \'/AV:\' || "AV" || \'/AC:\' || "AC" || \'/PR:\' || "PR" || \'/UI:\' || "UI" || \'/S:\' || "S" || \'/C:\' || "C" || \'/I:\' || "I" || \'/A:\' || "A" AS vector, ' + _sql_score()
)
def cvss_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1).select(F.lit(0).alias("x"))
    for m, v in CODES.items():
        rows = rows.withColumn(m, F.explode(F.array(*[F.lit(c) for c in v])))
    parts = {m: F.col(m) for m in CODES}
    return rows.select(cvss.vector_string(parts).alias("vector"), cvss.base_score(parts).alias("score"))


_CWES = [c["cwe"] for c in W.classes()]
_TEXTS = ("plain", "@login_required current_user", "requests.get('http://169.254.169.254')", "cursor.execute('DELETE FROM t')", "open(p, 'w')", "password balance allow_credentials", "blind fire-and-forget")
_SQL_SIGNAL = {
    "auth_required": f"regexp_matches(src, {q('(?i)' + W.AUTH_MARKS)}) AND cwe NOT IN ('CWE-602', 'CWE-639', 'CWE-306', 'CWE-287', 'CWE-915')",
    "no_auth": f"NOT regexp_matches(src, {q('(?i)' + W.AUTH_MARKS)})",
    "sensitive_target": f"cwe = 'CWE-918' AND regexp_matches(src, {q('(?i)' + W.INNER_TARGETS)}) AND NOT regexp_matches(src, '(?i)blind')",
    "internal_reachable": f"cwe = 'CWE-918' AND NOT regexp_matches(src, {q('(?i)' + W.INNER_TARGETS)}) AND NOT regexp_matches(src, '(?i)blind')",
    "blind": "cwe = 'CWE-918' AND regexp_matches(src, '(?i)blind')",
    "write_operation": f"(cwe = 'CWE-89' AND regexp_matches(src, {q('(?i)' + W.SQL_WRITES)})) OR (cwe = 'CWE-22' AND contains(src, ', ''w''')) OR (cwe = 'CWE-639' AND regexp_matches(src, 'DELETE'))",
    "password_storage": "cwe = 'CWE-327' AND contains(src, 'password')",
    "with_credentials": "cwe = 'CWE-942' AND contains(src, 'allow_credentials')",
    "financial": "cwe = 'CWE-367' AND contains(src, 'balance')",
}


def _sql_code(m: str) -> str:
    out = "CASE cwe "
    for c in W.classes():
        value = q(c["vector"][m])
        for name, over in c["signals"]:
            if m in over and name in _SQL_SIGNAL:
                value = f"CASE WHEN {_SQL_SIGNAL[name]} THEN {q(over[m])} ELSE {value} END"
        out += f"WHEN {q(c['cwe'])} THEN {value} "
    return out + f"END AS \"{m}\""


@query(
    f"WITH f AS (SELECT doc_id, {sql_pick(_CWES, f'doc_id % {len(_CWES)}')} AS cwe, {sql_pick(_TEXTS, 'doc_id % 7')} AS src FROM documents), vectors AS (SELECT doc_id, cwe, {', '.join(map(_sql_code, W.METRICS))} FROM f) "
    f"SELECT doc_id, cwe, score, CASE WHEN score <= 0 THEN 'INFO' WHEN score < 4 THEN 'LOW' WHEN score < 7 THEN 'MEDIUM' WHEN score < 9 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM (SELECT doc_id, cwe, {_sql_score()})"
)
def cvss_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = t(spark, sf_dir, "documents").select(
        "doc_id", pick(_CWES, (i % len(_CWES)).cast("int")).alias("cwe"), F.lit("").alias("type"), pick(_TEXTS, (i % 7).cast("int")).alias("source"), F.lit("").alias("explanation"), F.lit(0.5).alias("confidence"), F.lit("").alias("status")
    )
    return severity.apply_severity(rows).select("doc_id", "cwe", F.col("cvss_score").alias("score"), "severity")


SEVERITY_OF = {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM", "4-NOT SPECIFIED": "INFO", "5-LOW": "LOW"}
_SQL_SEV = "CASE o_orderpriority " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SEVERITY_OF.items()) + " END"


def order_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").withColumn("severity", paths.lookup(SEVERITY_OF, F.col("o_orderpriority")))


@query(f"SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS {s.lower()}" for s in reversed(W.SEVERITIES)) + f" FROM (SELECT *, {_SQL_SEV} AS s FROM orders) GROUP BY 1")
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_counts(order_severity(spark, sf_dir), ["o_orderstatus"])


@query(f"SELECT (count(*) FILTER (WHERE {_SQL_SEV} IN ('CRITICAL', 'HIGH')) > 0)::INTEGER AS exit_code FROM orders")
def ci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gate(order_severity(spark, sf_dir))


_PART_CWES = ("CWE-89", "CWE-79", "CWE-798", "CWE-918", "CWE-200", "CWE-502", "CWE-22", "CWE-9999")
_SQL_PART = f"(SELECT *, {sql_pick(_PART_CWES, 'p_size % 8')} AS cwe FROM part)"
_SQL_REQ = "(VALUES " + ", ".join(f"({q(f)}, {i}, {q(r)}, {q(c)})" for f, i, r, c in C.requirements()) + ") AS r(framework, place, requirement, cwe)"


def part_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), pick(_PART_CWES, (F.col("p_size") % 8).cast("int")).alias("cwe"), F.col("p_brand").alias("file"), F.col("p_size").alias("lineno"), F.col("p_name").alias("type"), F.col("p_name").alias("name"), F.lit("HIGH").alias("severity")
    )


@query(
    f"SELECT framework, place, requirement, count(p.cwe) AS findings_count, CASE WHEN count(p.cwe) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM {_SQL_REQ} LEFT JOIN {_SQL_PART} p ON p.cwe = r.cwe GROUP BY 1, 2, 3"
)
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compliance(part_findings(spark, sf_dir))


@query(
    f"SELECT framework, CASE WHEN count(p.cwe) > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status, count(p.cwe) AS total_findings FROM {_SQL_REQ} LEFT JOIN {_SQL_PART} p ON p.cwe = r.cwe GROUP BY 1"
)
def compliance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compliance_totals(reports.compliance(part_findings(spark, sf_dir)))


_SQL_STEPS = "(VALUES " + ", ".join(f"({i}, {q(n)}, {q(s)}, {k}, {q(c)})" for i, n, s, k, c in C.chain_steps()) + ") AS s(rule, name, severity, step, cwe)"


@query(
    f"SELECT rule, name, severity, min(f.ord) AS first_ord FROM {_SQL_STEPS} LEFT JOIN (SELECT cwe, min(p_partkey) AS ord FROM {_SQL_PART} GROUP BY 1) f ON f.cwe = s.cwe GROUP BY 1, 2, 3 HAVING count(f.ord) = count(*)"
)
def exploit_chain_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = part_findings(spark, sf_dir).withColumn("lineno", F.col("ord"))
    return reports.chains(found).select("rule", "name", "severity", F.array_min(F.transform("steps", lambda s: s["finding"]["lineno"])).alias("first_ord"))


@query(
    "SELECT c_custkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) c JOIN "
    "(SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) s ON c_nationkey = s_nationkey AND c.rn = s.rn"
)
def greedy_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").withColumn("type", F.col("c_nationkey"))
    s = t(spark, sf_dir, "supplier").withColumn("type", F.col("s_nationkey"))
    linked = dedupe.link_one_to_one(c, s, "type", [F.desc("c_acctbal"), F.asc("c_custkey")], [F.desc("s_acctbal"), F.asc("s_suppkey")])
    return linked.select("c_custkey", "s_suppkey")


_FP = [("a", "^SRC/", "CWE-89", ""), ("b", "tests/.*_1", "CWE-79", "the"), ("c", "src1", "cwe-79", "")]


@query(
    f"WITH {SQL_FILES}, f AS (SELECT doc_id, rel_path, text, CASE WHEN doc_id % 3 = 0 THEN 'CWE-89' ELSE 'CWE-79' END AS cwe FROM files), p AS (SELECT * FROM (VALUES "
    + ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(d)})" for a, b, c, d in _FP)
    + ") AS p(id, pat, cwe, sub)), h AS (SELECT doc_id, min(id) AS id FROM f JOIN p ON upper(f.cwe) = upper(p.cwe) AND regexp_matches(rel_path, pat, 'i') AND (sub = '' OR contains(lower(text), lower(sub))) GROUP BY 1) "
    "SELECT p.id, count(h.id) AS suppressions FROM p LEFT JOIN h ON p.id = h.id GROUP BY 1 UNION ALL SELECT 'kept', count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM h)"
)
def fp_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doc_files(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("rel_path").alias("file"), F.col("text").alias("source"), F.when(F.col("doc_id") % 3 == 0, "CWE-89").otherwise("CWE-79").alias("cwe"))
    patterns = spark.createDataFrame(_FP, "id string, file_pattern string, cwe string, snippet_substring string")
    kept, counts = claims.suppress(found, patterns)
    return counts.select("id", "suppressions").union(kept.agg(F.lit("kept"), F.count("*")))


_SQL_CASES = "(SELECT quality = 1 AS expected, n_chars > 1000 AS found, lang, source FROM labels JOIN documents USING (doc_id))"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return t(spark, sf_dir, "labels").join(d, "doc_id").select((F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 1000).alias("found"), "lang", "source")


def _sql_share(n: str, of: str) -> str:
    return f"CASE WHEN {of} = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * {n} / ({of}) END"


@query(
    "SELECT tp, fn, fp, tn, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1, fpr FROM (SELECT *, "
    f"{_sql_share('tp', '(tp + fp)')} AS precision, {_sql_share('tp', '(tp + fn)')} AS recall, {_sql_share('fp', '(fp + tn)')} AS fpr FROM (SELECT count(*) FILTER (WHERE expected AND found) AS tp, "
    f"count(*) FILTER (WHERE expected AND NOT found) AS fn, count(*) FILTER (WHERE NOT expected AND found) AS fp, count(*) FILTER (WHERE NOT expected AND NOT found) AS tn FROM {_SQL_CASES}))"
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.accuracy(cases(spark, sf_dir))


@query(
    f"SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS key, CASE WHEN grouping(lang) = 0 THEN coalesce(lang, '?') ELSE coalesce(source, '?') END AS value, "
    f"count(*) FILTER (WHERE expected = found) AS correct, count(*) AS total FROM {_SQL_CASES} GROUP BY GROUPING SETS ((lang), (source))"
)
def breakdown_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.breakdown(cases(spark, sf_dir), ["lang", "source"])


@query(
    "SELECT phase, sum(n)::BIGINT AS count, string_agg(action || '=' || n, ',' ORDER BY action) AS actions FROM (SELECT event_type AS phase, 'u' || (user_id % 3) AS action, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("action"))
    flat = F.transform(F.array_sort(F.map_entries("actions")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return reports.audit_summary(rows).select("phase", "count", F.array_join(flat, ",").alias("actions"))


@query(
    "SELECT 'hour' AS kind, event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL UNION ALL "
    "SELECT 'slide', event_type, epoch_us(time_bucket(INTERVAL '30 minutes', ts) - (k * INTERVAL '30 minutes')), count(*) FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL UNION ALL "
    "SELECT 'session', event_type, min(us), count(*) FROM (SELECT *, sum(new) OVER (PARTITION BY event_type, user_id ORDER BY us) AS s FROM (SELECT event_type, user_id, epoch_us(ts) AS us, "
    "(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, user_id ORDER BY ts) >= 1800000000, true))::INTEGER AS new FROM events)) GROUP BY event_type, user_id, s"
)
def audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.streaming import audit

    return audit.windows(t(spark, sf_dir, "events"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def batch_cache_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return claims.to_scan(d, d.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("sha"))).select("doc_id", "sha")


def _sql_tier(p: str) -> str:
    has = lambda words: " OR ".join(f"contains({p}, {q(w)})" for w in words)
    return f"CASE WHEN {has(R.FIRST_WORDS)} THEN 1 WHEN {has(R.SECOND_WORDS)} THEN 2 ELSE 3 END"


@query(f"WITH {SQL_FILES} SELECT doc_id, {_sql_tier('lower(rel_path)')} AS tier, row_number() OVER (ORDER BY {_sql_tier('lower(rel_path)')}, rel_path) AS place FROM files")
def priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = doc_files(spark, sf_dir).select("doc_id", "rel_path", paths.tier(F.col("rel_path")).alias("tier"))
    # Places run on over the tiers: ranks inside (tier, first letter) plus the sizes of those before.
    part = F.struct("tier", F.substring("rel_path", 1, 6).alias("head"))
    inside = rows.withColumn("part", part).withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("rel_path")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return inside.join(F.broadcast(sizes.select("part", "base")), "part").select("doc_id", "tier", (F.col("base") + F.col("rn")).alias("place"))


_KEYWORDS = ["auth", "app", "src1"]


@query(f"WITH {SQL_FILES} SELECT CASE " + " ".join(f"WHEN contains(lower(rel_path), {q(k)}) THEN {i}" for i, k in enumerate(_KEYWORDS)) + f" ELSE {len(_KEYWORDS)} END AS place, count(*) AS n FROM files GROUP BY 1")
def keyword_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_files(spark, sf_dir).groupBy(paths.keyword_place(F.col("rel_path"), _KEYWORDS).alias("place")).agg(F.count("*").alias("n"))


@query(
    "SELECT doc_id, i AS line, md5(string_agg(l, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS window_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    around = F.transform("lines", lambda x, i: F.md5(F.array_join(F.slice(F.col("lines"), F.greatest(i - 1, F.lit(1)), F.least(i + 3, F.lit(5))), " ")))
    return d.select("doc_id", F.posexplode(around).alias("at", "window_md5")).select("doc_id", (F.col("at") + 1).cast("bigint").alias("line"), "window_md5")


_SQL_TOKENS = "list_filter(list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda w: lower(w))), lambda w: NOT list_contains({1}, w))"


@query(
    "SELECT a.conv_id, a.turn, len(list_intersect("
    + _SQL_TOKENS.format("a.text", list(verdict.STOP_WORDS))
    + ", "
    + _SQL_TOKENS.format("b.text", list(verdict.STOP_WORDS))
    + ")) AS n_common FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
)
def grounding_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("said")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    common = F.size(F.array_intersect(verdict.distinctive(F.col("said")), verdict.distinctive(F.col("next"))))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", common.cast("bigint").alias("n_common"))


_SQL_PASSES = "(SELECT role AS file, turn % 3 + 1 AS pass, conv_id AS place, md5(lower(text)) AS fingerprint, 50 + length(text) % 45 AS confidence FROM conversations)"


@query(
    f"WITH c AS {_SQL_PASSES}, n AS (SELECT file, fingerprint, count(DISTINCT pass) AS n_passes, min(pass) AS first FROM c GROUP BY 1, 2), b AS (SELECT c.file, c.fingerprint, c.pass, c.place, n_passes, first, "
    "least(100, confidence + CASE WHEN pass <> 1 OR n_passes < 2 THEN 0 WHEN n_passes = 3 THEN 15 ELSE 5 END) AS confidence FROM c JOIN n ON c.file = n.file AND c.fingerprint = n.fingerprint) "
    "SELECT file, fingerprint, confidence, n_passes >= 2 AS consensus FROM b WHERE pass = first QUALIFY row_number() OVER (PARTITION BY file, fingerprint ORDER BY confidence DESC, pass, place) = 1"
)
def consensus_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select(
        F.col("role").alias("file"), (F.col("turn") % 3 + 1).alias("pass"), F.col("conv_id").alias("place"), F.md5(F.lower("text")).alias("fingerprint"), (F.lit(50) + F.length("text") % 45).cast("bigint").alias("confidence")
    )
    return claims.consensus(rows, 3).select("file", "fingerprint", "confidence", "consensus")


_SQL_NORM = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(
    f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents), s AS (SELECT doc_id, '  ' || string_split(text, chr(10))[2] AS snippet FROM documents WHERE len(string_split(text, chr(10))) > 1), "
    f"m AS (SELECT s.doc_id, {_SQL_NORM.format('snippet')} AS t, {_SQL_NORM.format('line')} AS n, ln FROM s JOIN l ON s.doc_id = l.doc_id) SELECT doc_id, ln AS line FROM m WHERE t <> '' AND n <> '' AND (contains(n, t) OR contains(t, n)) "
    "AND least(length(t), length(n)) / greatest(length(t), length(n)) >= 0.70 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (t <> n)::INTEGER, length(n), ln) = 1"
)
def anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    lines = d.select("doc_id", F.posexplode("lines").alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("bigint").alias("ln"), "line")
    snippets = d.where(F.size("lines") > 1).select("doc_id", F.concat(F.lit("  "), F.get("lines", F.lit(1))).alias("snippet"))
    return verdict.anchor(snippets, lines, "doc_id").select("doc_id", "line")


@query(
    "SELECT a.o_orderkey, arg_min(b.l_linenumber, (b.l_linenumber)) AS unit FROM (SELECT o_orderkey, 3 AS at FROM orders) a JOIN lineitem b ON a.o_orderkey = b.l_orderkey AND b.l_linenumber <= a.at AND b.l_linenumber + b.l_quantity::INTEGER % 5 >= a.at GROUP BY 1"
)
def function_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5).alias("end"))
    sites = t(spark, sf_dir, "orders").select("o_orderkey", F.lit(3).alias("at"))
    held = sites.join(spans, (F.col("o_orderkey") == F.col("l_orderkey")) & F.col("at").between(F.col("start"), F.col("end")))
    return held.groupBy("o_orderkey").agg(F.min("start").alias("unit"))


@query(
    "SELECT a.event_id, b.event_id AS nearest FROM (SELECT * FROM events WHERE event_type = 'error') a JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id "
    "QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.event_id) = 1"
)
def nearest_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", code.micros(F.col("ts")).alias("us"))
    a, b = e.where("event_type = 'error'").alias("a"), e.where("event_type = 'click'").alias("b")
    apart = F.struct(F.abs(F.col("a.us") - F.col("b.us")).alias("d"), F.col("b.event_id").alias("e"))
    return a.join(b, F.col("a.user_id") == F.col("b.user_id")).groupBy(F.col("a.event_id").alias("event_id")).agg(F.min(apart)["e"].alias("nearest"))


@query(
    "WITH RECURSIVE e AS (SELECT c_custkey AS caller, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS callee FROM customer), r AS (SELECT c_custkey AS qual, 'class' || (c_nationkey % 4) AS cls FROM customer WHERE c_nationkey < 4 "
    "UNION SELECT e.caller, r.cls FROM r JOIN e ON e.callee = r.qual) SELECT qual, cls FROM r"
)
def fixpoint_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer")
    n = c.count()
    edges = c.select(F.col("c_custkey").alias("caller"), ((F.col("c_custkey") * 7 + 3) % n).alias("callee"))
    seeds = c.where("c_nationkey < 4").select(F.col("c_custkey").alias("qual"), F.concat(F.lit("class"), (F.col("c_nationkey") % 4).cast("string")).alias("cls"))
    return interproc.reach(seeds, edges)


@query(
    "SELECT p_partkey, a.i::INTEGER AS at, a.x AS arg, b.x AS param FROM part, LATERAL (SELECT unnest(string_split(p_name, ' ')) AS x, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i) a, "
    "LATERAL (SELECT unnest([p_brand, p_type]) AS x, generate_subscripts([p_brand, p_type], 1) - 1 AS i) b WHERE a.i = b.i"
)
def arg_param_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    args = p.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "arg"))
    params = p.select("p_partkey", F.posexplode(F.array("p_brand", "p_type")).alias("at", "param"))
    return args.join(params, ["p_partkey", "at"]).select("p_partkey", "at", "arg", "param")


@query(
    f"SELECT cwe, row_number() OVER (ORDER BY ord) - 1 AS rule_index, name, 'error' AS level FROM (SELECT cwe, min(p_partkey) AS ord, arg_min(p_name, p_partkey) AS name FROM {_SQL_PART} GROUP BY 1)"
)
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rules(part_findings(spark, sf_dir)).withColumn("rule_index", F.col("rule_index").cast("bigint"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object(code.lenient_json(wrapped), "$.k").cast("bigint").alias("k"))


_CHECKS = ("python.lang.sql-injection", "php.eval_use", "js.xss")
_RAW_CWES = ("CWE-89: SQL Injection", "cwe-95", "")


@query(
    f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'Eval Use' ELSE 'Xss' END AS type, CASE event_id % 3 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-95' ELSE 'CWE-1035' END AS cwe, "
    "CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'view' THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM events"
)
def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "info").otherwise(F.col("event_type"))
    raw = t(spark, sf_dir, "events").select(i.cast("string").alias("path"), F.lit(1).alias("line"), pick(_CHECKS, (i % 3).cast("int")).alias("check_id"), kind.alias("severity"), F.lit("").alias("message"), pick(_RAW_CWES, (i % 3).cast("int")).alias("cwe_raw"))
    return claims.rule_results(raw).select(F.col("file").cast("bigint").alias("event_id"), "type", "cwe", "severity")


_SQL_UNION = (
    "(SELECT o_custkey AS file, o_orderpriority AS cwe, 'matcher' AS layer, 0.5::DOUBLE AS confidence FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderpriority, 'taint', 0.7::DOUBLE FROM orders WHERE o_orderstatus = 'O')"
)


@query(
    f"SELECT file, cwe, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers, count(DISTINCT layer) >= 2 AS cross_validated, CASE WHEN count(DISTINCT layer) >= 2 THEN round(max(confidence) + 0.1, 2) ELSE max(confidence) END AS confidence FROM {_SQL_UNION} GROUP BY 1, 2"
)
def union_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    part = lambda s, layer, c: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("cwe"), F.lit(layer).alias("layer"), F.lit(c).alias("confidence"))
    found = merge.agreement(part("F", "matcher", 0.5).unionByName(part("O", "taint", 0.7)), ["file", "cwe"])
    return found.select("file", "cwe", F.array_join("layers", ",").alias("layers"), "cross_validated", "confidence")


@query(
    "WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 30.0::DOUBLE WHEN 2 THEN 20.0 ELSE 10.0 END + CASE WHEN quality = 0 THEN 0.0 WHEN doc_id % 10 = 0 THEN 25.0 WHEN doc_id % 10 = 9 THEN 22.0 WHEN doc_id % 10 >= 7 THEN 15.0 ELSE 5.0 END + "
    "CASE WHEN toxic = 1 AND quality = 1 THEN 20.0 WHEN quality = 1 THEN 10.0 ELSE 20.0 END + CASE WHEN toxic = 1 THEN 20.0 ELSE 5.0 END + CASE WHEN quality = 1 THEN 5.0 ELSE 0.0 END AS total FROM labels) "
    "SELECT doc_id, least(100.0::DOUBLE, total) AS total, CASE WHEN total >= 90 THEN 'VERY HIGH' WHEN total >= 75 THEN 'HIGH' WHEN total >= 50 THEN 'MEDIUM' WHEN total >= 25 THEN 'LOW' ELSE 'VERY LOW' END AS label FROM p"
)
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, good, toxic = F.col("doc_id"), F.col("quality") == 1, F.col("toxic") == 1
    ratio = F.when(i % 10 == 0, F.lit(1.0)).otherwise((i % 10) / 10)
    total = verdict.confidence_points(i % 4, good, ratio, toxic, good, toxic, good)["total"]
    return t(spark, sf_dir, "labels").select("doc_id", total.alias("total"), verdict.confidence_label(total).alias("label"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'dropped' WHEN m = 2 THEN 'dropped' ELSE 'confirmed' END AS ruling, CASE WHEN o_orderstatus = 'P' OR m = 2 THEN '' WHEN m = 1 THEN 'rules' ELSE 'engine' END AS sources FROM (SELECT *, o_orderkey % 3 AS m FROM orders)"
)
def verdict_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (F.col("o_orderkey") % 3).cast("int")
    rows = t(spark, sf_dir, "orders").select(
        "o_orderkey", pick(("idor", "rules", "safety-net"), m).alias("matcher_id"), F.lit("static").alias("detection_method"), F.when(F.col("o_orderstatus") == "P", "LIKELY_FALSE_POSITIVE").alias("status"),
        F.lit(0.5).alias("confidence"), F.lit("x = 1").alias("source"), F.when(m == 2, F.struct(F.lit(1).alias("line"), F.lit("nothing").alias("source"), F.lit("absent").alias("sink"))).alias("evidence"),
    )
    return verdict.judge(rows).select("o_orderkey", "verdict.ruling", F.array_join("verdict.sources", ",").alias("sources"))


@query("SELECT count(*) FILTER (WHERE l_discount >= 0.05) AS kept, count(*) FILTER (WHERE l_discount < 0.05) AS hidden FROM lineitem")
def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_discount") >= 0.05).alias("kept"), F.count_if(F.col("l_discount") < 0.05).alias("hidden"))


@query("SELECT count(*) AS completed, count(*) FILTER (WHERE toxic = 1) AS failed, count(*) FILTER (WHERE toxic <> 1 AND quality = 0) AS skipped, sum(doc_id % 5)::BIGINT AS findings FROM labels")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("n_findings"), (F.col("quality") == 0).alias("cached"), F.when(F.col("toxic") == 1, "x").alias("error"))
    return claims.batch_totals(rows)
