import pytest
from lintel.plans.rule_cases import CASES

from lintel.operators import detectors, fixers, units

FIXED = (
    "command-injection", "hardcoded-secret", "weak-crypto", "insecure-deserialization", "debug-mode", "tls-verification-disabled", "insecure-cookie", "csrf-disabled",
    "insecure-randomness", "permissive-file-permissions", "insecure-temp-file", "dangerous-sink", "open-redirect", "reflected-xss", "ssti", "cors-misconfig", "xxe",
    "path-traversal", "path-join-traversal", "race-condition", "price-manipulation", "idor", "broken-auth", "weak-auth", "negative-quantity", "missing-rate-limit",
    "missing-auth", "jwt-weakness", "sensitive-info-exposure", "ssrf",
)


def unit(text):
    u = units.units_of(text, "python")[0]
    keys = ("name", "qualname", "class_name", "lineno", "end_lineno", "source", "decorators", "params")
    return detectors.Unit(file="src/a.py", language="python", **{k: u[k] for k in keys})


@pytest.mark.parametrize("rule", FIXED)
def test_a_fix_closes_its_finding(rule):
    u = unit(CASES[rule][1])
    hits = list(detectors.find(u, (rule,)))
    assert fixers.repair(u, hits[0]["type"])["status"] == "applied"


@pytest.mark.parametrize("call", ['db.execute("SELECT a FROM t WHERE b = " + b)', 'db.execute(f"SELECT a FROM t WHERE b = {b}")', 'db.execute("SELECT a FROM t WHERE b = %s" % b)'])
def test_sql_is_bound(call):
    u = unit(f"def f():\n    b = request.args['b']\n    {call}\n")
    done = fixers.repair(u, "SQL Injection")
    assert done["status"] == "applied" and "= ?\", (b,))" in done["fixed_source"]


def test_what_cannot_be_fixed_stays():
    u = unit("def f():\n    return 1\n")
    assert fixers.repair(u, "Insecure Direct Object Reference (IDOR)")["status"] == "suggested"
    assert fixers.repair(u, "SQL Injection")["fixed_source"] == u.source
    # Which fields a model may take is not in the code.
    assert fixers.repair(unit(CASES["mass-assignment"][1]), "Mass Assignment / Over-posting")["status"] == "suggested"


def test_a_lock_is_shared_by_all_calls():
    done = fixers.repair(unit("def take(n):\n    if left >= n:\n        time.sleep(1)\n        left -= n\n"), fixers.RACE)
    assert done["fixed_source"].startswith("import threading\ntake_lock = threading.Lock()\n\ndef take(n):\n    with take_lock:\n        if left >= n:")


@pytest.mark.parametrize("text", ["async def f(n):\n    x = n\n", "def f(n):\n    yield n\n", 'def f(n):\n    return """a\nb"""\n'])
def test_what_a_lock_cannot_hold_stays(text):
    assert fixers.rewritten(unit(text), fixers.RACE) == unit(text).source


@pytest.mark.parametrize("language, text, mark", [
    ("java", "public void take(int n) {\n    left -= n;\n}", "public synchronized void take"),
    ("go", "func take(n int) {\n    left -= n\n}", "{\n    unitMutex.Lock()\n    defer unitMutex.Unlock()\n    left -= n\n}"),
    ("c_sharp", "void Take(int n) {\n    left -= n;\n}", "{\n    lock(unitLock)\n    {\n    left -= n;\n    }\n}"),
    ("ruby", "def take(n)\n  @left -= n\nend", "def take(n)\n  UNIT_MUTEX.synchronize do\n    @left -= n\n  end\nend"),
    ("javascript", "async function take(n) {\n  left -= n;\n}", "{\n  return unitMutex.runExclusive(async () => {\n  left -= n;\n  });\n}"),
    ("php", "function take($n) {\n  $left -= $n;\n}", "flock($unitLock, LOCK_EX);\n  $left -= $n;\n}"),
])
def test_locks_by_language(language, text, mark):
    assert mark in fixers.LOCKS[language](text)


def test_proposals_go_to_the_nearest_place(spark):
    text = "a = 1\nb = 2\na = 1\nc = 3\na = 1\n"
    files = spark.createDataFrame([("x.py", "python", text), ("n.py", "python", None)], "rel_path string, language string, text string")
    asked = [("x.py", 4, "a = 1", "a = 5"), ("x.py", None, "a = 1", "a = 6"), ("x.py", 1, "a = 1", "a = ("), ("x.py", 1, "gone", "x"), ("n.py", 1, "a", None), ("no.py", 1, "a", "b")]
    rows = fixers.apply_proposals(files, spark.createDataFrame(asked, "file string, line int, original string, replacement string")).collect()
    got = sorted((r["file"], r["status"], r["note"], r["fixed_text"].split("\n")[:3]) for r in rows)
    assert got == [
        ("n.py", "rejected", "the text to replace isn't in the file", [""]),
        ("x.py", "applied", "replaced at line 1", ["a = 6", "b = 2", "a = 1"]),
        ("x.py", "applied", "replaced at line 3", ["a = 1", "b = 2", "a = 5"]),
        ("x.py", "rejected", "the file doesn't parse any more", ["a = 1", "b = 2", "a = 1"]),
        ("x.py", "rejected", "the text to replace isn't in the file", ["a = 1", "b = 2", "a = 1"]),
    ]
