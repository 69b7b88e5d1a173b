from pyspark.sql import functions as F

from lintel.operators import fixers
from lintel.plans import engine
from lintel.sources import files
from lintel.streaming import audit

APP = '''from flask import request
@app.route("/ping")
def ping():
    host = request.args.get("host")
    os.system("ping " + host)
    return "ok"


def load(data):
    return pickle.loads(data)


app.run(debug=True)
'''


def rows(df):
    return sorted((r["file"], r["type"], r["lineno"], r["detection_method"]) for r in df.select("file", "type", "lineno", "detection_method").collect())


def frame(spark, items):
    return spark.createDataFrame(items, "rel_path string, language string, text string")


def test_scan(spark):
    got = rows(engine.scan(frame(spark, [("src/a.py", "python", APP)])))
    assert got == [
        ("src/a.py", "Debug Mode / Verbose Errors Enabled", 13, "static"), ("src/a.py", "Insecure Deserialization", 10, "static"), ("src/a.py", "OS Command Injection", 5, "taint-dataflow"),
    ]
    again = rows(engine.scan(frame(spark, [("src/b.py", "python", "x = 1\n"), ("src/a.py", "python", APP.replace("\n", "\r\n"))])))
    assert again == got


def test_documents_and_tests_are_judged_by_their_place(spark):
    got = rows(engine.scan(frame(spark, [("docs/a.md", "python", APP), ("jquery/a.py", "python", APP)])))
    assert got == []


def test_directory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text(APP)
    (tmp_path / "src/bad.py").write_bytes(b"x = '\xff\x00'\n")
    (tmp_path / "src/empty.py").write_text("")
    (tmp_path / "src/pic.png").write_bytes(b"1")
    (tmp_path / "node_modules/x.js").write_text("eval(a)")
    tree = files.scan_tree(spark, str(tmp_path), cap=1000)
    s = files.stats(tree).first()
    assert (s["analysable"], s["skipped_binary"], s["skipped_dirs"], s["by_language"]) == (2, 1, 1, {"python": 2})
    assert len(rows(engine.scan(files.analysable(tree)))) == 3


def test_suspicious_units(spark):
    from lintel.operators import units

    text = "def f():\n    n = request.args['n']\n    transfer(n)\ndef g():\n    return 1\n"
    found = units.extract(frame(spark, [("a.py", "python", text)]))
    none = spark.createDataFrame([], "file string, function string, lineno int")
    assert [r["qualname"] for r in engine.suspicious_units(found, none).collect()] == ["f"]


def test_audit_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = audit.running_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    done = spark.read.parquet(str(tmp_path / "out"))
    batch = audit.hourly(events)
    assert done.exceptAll(batch.select(done.columns)).count() == 0 and done.count() > 0


def test_scan_and_repair_broadcast_no_rows_of_the_scan(spark, monkeypatch):
    plans = []

    def noted(df, name, write=engine.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(engine, "written", noted)
    files = spark.createDataFrame([("a.py", "python", "def f(c):\n    os.system('ls ' + c)\n\ndef g():\n    f(request.args['c'])\n")], "rel_path string, language string, text string")
    files, found = engine.parsed(files)
    scanned = engine.scan_parsed(files, found)
    assert [r["cwe"] for r in scanned.collect()] == ["CWE-78"]
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (scanned, fixers.patches(scanned, found))]
    assert sum(p.count("SortMergeJoin") for p in plans) > 8 and not any("BroadcastHashJoin" in p for p in plans)
