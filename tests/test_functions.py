import itertools
import math

from pyspark.sql import functions as F

from lintel.functions import code, cvss, paths
from lintel.operators import claims, context, dedupe, merge, reports, severity, verdict

V = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}}
PR = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
CIA = {"H": 0.56, "L": 0.22, "N": 0.0}


def plain(av, ac, pr, ui, s, c, i, a):
    iss = 1 - (1 - CIA[c]) * (1 - CIA[i]) * (1 - CIA[a])
    impact = 6.42 * iss if s == "U" else 7.52 * (iss - 0.029) - 3.25 * (iss - 0.02) ** 15
    if impact <= 0:
        return 0.0
    x = impact + 8.22 * V["AV"][av] * V["AC"][ac] * PR[s][pr] * V["UI"][ui]
    n = round(min(x if s == "U" else 1.08 * x, 10.0) * 100000)
    return n / 100000 if n % 10000 == 0 else (math.floor(n / 10000) + 1) / 10


def test_all_vectors(spark):
    rows = list(itertools.product("NALP", "LH", "NLH", "NR", "UC", "HLN", "HLN", "HLN"))
    names = ["AV", "AC", "PR", "UI", "S", "C", "I", "A"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {tuple(r)[:8]: r["s"] for r in df.select("*", cvss.base_score({n: F.col(n) for n in names}).alias("s")).collect()}
    assert len(got) == 2592 and got == {r: plain(*r) for r in rows}


def test_languages_and_roles(spark):
    given = {
        "src/app.py": ("python", "application"), "a/Dockerfile": ("dockerfile", "application"), "tests/x.py": ("python", "test"), "README.md": ("markdown", "doc"),
        "lib/jquery.min.js": ("javascript", "vendor"), "scanner/x.go": ("go", "security_tool"), "noext": (None, "application"), "a/.env": ("text", "application"),
        "x/test_a.py": ("python", "test"), "a\\b\\C.CS": ("c_sharp", "application"),
    }
    df = spark.createDataFrame([(p,) for p in given], "p string").select("p", paths.language(F.col("p")).alias("l"), paths.role(F.col("p")).alias("r"))
    assert {r["p"]: (r["l"], r["r"]) for r in df.collect()} == given


def test_halved_rounds_as_doubles_do(spark):
    values = [0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.75, 0.78, 0.8, 0.85, 0.9]
    df = spark.createDataFrame([(v,) for v in values], "c double").select("c", code.halved(F.col("c")).alias("h"))
    assert {r["c"]: r["h"] for r in df.collect()} == {v: round(v * 0.5, 2) for v in values}


def test_lenient_json(spark):
    given = [('```json\n{"a": 1,}\n```', 1), ("so {'a': 2} it is", 2), ('{"a": 3}', 3), ("garbage", None), ("", None)]
    df = spark.createDataFrame([(x,) for x, _ in given], "x string").select("x", F.get_json_object(code.lenient_json(F.col("x")), "$.a").cast("int").alias("a"))
    assert [(r["x"], r["a"]) for r in df.collect()] == given


def test_leaders_of_clusters(spark):
    rows = [("f", n, "CWE-1", "x", "LOW", 0.5, "matcher", i) for i, n in enumerate([10, 12, 14, 15, 20])]
    df = spark.createDataFrame(rows, "file string, line int, cwe string, name string, severity string, confidence double, layer string, ord int")
    assert sorted(r["line"] for r in merge.merge_layers(df).collect()) == [10, 14, 20]


def test_layers_boost_once(spark):
    rows = [("f", 5, "CWE-1", "a", "LOW", 0.5, "matcher", 0), ("f", 6, "CWE-1", "b", "HIGH", 0.7, "taint", 1), ("f", 7, "CWE-1", "c", "LOW", 0.6, "taint", 2), ("f", 5, "", "d", "LOW", 0.1, "ai", 3)]
    df = spark.createDataFrame(rows, "file string, line int, cwe string, name string, severity string, confidence double, layer string, ord int")
    got = {r["name"]: (r["severity"], round(r["confidence"], 9), r["sources"]) for r in merge.merge_layers(df).collect()}
    assert got == {"b": ("HIGH", 0.8, ["matcher", "taint"]), "d": ("LOW", 0.1, ["ai"])}


def test_routes_find_the_next_unit(spark):
    left = spark.createDataFrame([("f", n) for n in (4, 7, 20)], "file string, lineno int")
    right = spark.createDataFrame([("f", n, n) for n in (1, 5, 9)], "file string, unit_line int, unit int")
    got = {r["lineno"]: r["unit"] for r in dedupe.as_of_forward(left, right, "file", "lineno", "unit_line", ["unit"]).collect()}
    assert got == {4: 5, 7: 9, 20: None}


def test_same_line_fold_is_ordered_and_idempotent(spark):
    rows = [(0, "f", 3, "Path Traversal", 0.5), (1, "f", 3, "Path Traversal Vulnerability", 0.6), (2, "f", 3, "Weak Hash", 0.4), (3, "f", 4, "Path Traversal", 0.1)]
    df = spark.createDataFrame(rows, "ord bigint, file string, lineno int, type string, confidence double")
    once = dedupe.fold_same_line(df)
    assert sorted(r["ord"] for r in once.collect()) == [1, 2, 3]
    assert sorted(r["ord"] for r in dedupe.fold_same_line(once).collect()) == [1, 2, 3]


def test_golden_severities(spark):
    rows = [("CWE-78", "os.system(x)", 9.8), ("CWE-78", "@login_required os.system(x)", 8.8), ("CWE-918", "fetch blind", 3.7), ("CWE-327", "x", 4.8), ("CWE-9", "x", 6.5)]
    df = spark.createDataFrame([(c, "", s, "", 0.5, "") for c, s, _ in rows], "cwe string, type string, source string, explanation string, confidence double, status string")
    assert [r["cvss_score"] for r in severity.apply_severity(df).collect()] == [s for *_, s in rows]


def test_replies_to_claims(spark):
    item = '{"name":"SQLi","cwe":"89","severity":"high","confidence":"%s","snippet":"db.execute(q)","sink":"execute","line":"3"}'
    replies = [("a.py", "python", p, '{"findings":[%s, {"name":""}]}' % (item % c)) for p, c in ((1, 70), (2, 60), (3, 60))] + [("a.py", "python", 2, "nonsense")]
    df = claims.parse_replies(spark.createDataFrame(replies, "file string, language string, pass int, reply string"))
    rows = claims.consensus(df, 3).collect()
    assert [(r["cwe"], r["severity"], r["confidence"], r["consensus"], r["claimed_line"]) for r in rows] == [("CWE-89", "HIGH", 85, True, 3)]


def test_grounding_and_verdict(spark):
    body = "def f():\n    uid = request.args['uid']\n    cursor.execute(uid)"
    rows = [("safety-net", body, (3, "uid", "cursor")), ("safety-net", body, (1, "nothing", "absent")), ("idor", body, None)]
    df = spark.createDataFrame([(m, "static", "OPEN", 0.5, s, e) for m, s, e in rows], "matcher_id string, detection_method string, status string, confidence double, source string, evidence struct<line:int,source:string,sink:string>")
    assert [r["verdict"]["ruling"] for r in verdict.judge(df).collect()] == ["confirmed", "dropped", "confirmed"]


def test_sarif_compliance_and_chains(spark):
    rows = [(0, "CWE-89", "SQL Injection", "CRITICAL", "a.py", 3, "x"), (1, "CWE-798", "Secret", "HIGH", "b.py", 4, "y")]
    df = spark.createDataFrame(rows, "ord bigint, cwe string, name string, severity string, file string, line int, why string")
    assert reports.sarif_faults(reports.sarif(df).first()["document"]) == []
    report = {(r["framework"], r["requirement"]): r["status"] for r in reports.compliance(df, "OWASP").collect()}
    assert len(report) == 10 and report["owasp", "A03: Injection"] == "FAIL" and report["owasp", "A04: Insecure Design"] == "PASS"
    found = df.withColumns({"lineno": F.col("line"), "type": F.col("name")})
    assert [r["name"] for r in reports.chains(found).collect()] == ["SQLi + Hardcoded Creds = Full DB Compromise"]
    assert reports.gate(df).first()["exit_code"] == 1 and "SQL Injection" in reports.html_page(found.withColumn("confidence", F.lit(0.5)))


def test_text_lines(spark):
    lines = {"# os.system(x)": True, "cursor.execute(query)": False, 'msg = "SELECT a FROM b"': True, "q = 'SELECT ' + name": False, "PATTERN = 'SELECT'": True, 'f"SELECT {x}"': False}
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", context.is_text(F.col("x")).alias("t"))
    assert {r["x"]: r["t"] for r in df.collect()} == lines


def test_components_and_enrichment(spark):
    report = '{"version":{"number":"6.1","vulnerabilities":[{"title":"A","references":{"cve":["2024-1"]}}]},"plugins":{"p":{"version":{"number":"2"},"vulnerabilities":[{"title":"B","fixed_in":"3"}]}}}'
    rows = claims.component_vulnerabilities(spark.createDataFrame([("u", report)], "url string, report string")).collect()
    assert {(r["kind"], r["component"], tuple(r["cves"])) for r in rows} == {("core", "core 6.1", ("CVE-2024-1",)), ("plugin", "plugin: p 2", ())}
    nvd = '{"vulnerabilities":[{"cve":{"id":"CVE-1","descriptions":[{"lang":"en","value":"d"}],"metrics":{"cvssMetricV30":[{"cvssData":{"baseScore":7.5}}]}}}]}'
    mitre = '{"Weaknesses":[{"Name":"N","PotentialMitigations":[{"Description":" m "}],"RelatedWeaknesses":[{"CweID":"74","Nature":"ChildOf"}]}]}'
    r = claims.enrichment(spark.createDataFrame([("CWE-89", mitre, nvd)], "cwe string, mitre string, nvd string")).first()
    assert (r["name"], r["mitigations"], r["related_weaknesses"], r["cvss"]) == ("N", ["m"], ["CWE-74 (ChildOf)"], 7.5)
