from pyspark.sql import functions as F

from lintel.operators import investigate, units

CODE = "def f():\n    uid = request.args['uid']\n    cursor.execute(uid)\n\n\ndef g():\n    cursor.execute(other)\n"


def test_claims(spark):
    files = spark.createDataFrame([("a.py", "python", CODE)], "rel_path string, language string, text string")
    rows = [
        (1, "cursor.execute(uid)", "cursor.execute", "request.args", "flow", 3), (2, "cursor.execute(other)", "execute(", "request.args", "flow", 3),
        (3, "cursor.execute(nowhere_at_all)", "execute", "", "property", 0), (4, "cursor.execute(other)", "os.system", "", "property", 0),
        (5, "  cursor.execute(other)  ", "cursor.execute", "N/A", "flow", 99),
    ]
    claims = spark.createDataFrame([(i, "a.py", "python", s, k, o, f, n) for i, s, k, o, f, n in rows], "claim_id int, file string, language string, snippet string, sink string, source string, family string, claimed_line int")
    got = investigate.validate(claims, files, units.extract(files))
    assert {r["claim_id"]: (r["accepted"], r["line"]) for r in got.collect()} == {1: (True, 3), 2: (False, 7), 3: (False, 0), 4: (False, 7), 5: (True, 7)}
    total = {r["file"]: (r["raw"], r["accepted"]) for r in investigate.diagnostics(got).collect()}
    assert total == {"a.py": (5, 2), None: (5, 2)}


def test_proofs_go_to_one_finding_each(spark):
    findings = spark.createDataFrame([("X", "php", 0.9, "a", 1), ("X", "python", 0.5, "b", 1), ("Y", "python", 0.5, "c", 1)], "type string, language string, confidence double, file string, lineno int")
    findings = findings.withColumns({"status": F.lit("OPEN"), "detection_method": F.lit("static")})
    probes = spark.createDataFrame([(1, "X", True), (2, "Y", False)], "probe_id int, type string, vulnerable boolean")
    got = {r["file"]: (r["status"], r["confidence"]) for r in investigate.link_proofs(findings, probes).collect()}
    assert got == {"a": ("OPEN", 0.9), "b": ("CONFIRMED", 0.95), "c": ("OPEN", 0.5)}


def test_entry_points(spark):
    files = spark.createDataFrame([("x/app.py", "python", "app = Flask(__name__)\napp.run()"), ("util.py", "python", "x = 1"), ("main.go", "go", "package main")], "rel_path string, language string, text string")
    assert [(r["rel_path"], r["score"]) for r in investigate.entry_points(files).collect()] == [("x/app.py", 13), ("main.go", 7)]
