import ast

import pytest

from lintel.operators import taint

PY = {
    "direct": ("def f():\n    n = request.args.get('n')\n    db.execute('SELECT ' + n)\n", {("SQL Injection", "f", 3)}),
    "bound": ("def f():\n    n = request.args.get('n')\n    db.execute('SELECT ?', (n,))\n", set()),
    "cast": ("def f():\n    n = int(request.args.get('n'))\n    db.execute('SELECT ' + str(n))\n", set()),
    "two hops": ("def a(x):\n    os.system('ls ' + x)\ndef b(y):\n    a(y)\ndef c():\n    b(request.args['z'])\n", {("OS Command Injection", "c", 6)}),
    "quoted": ("def f():\n    h = shlex.quote(request.args['h'])\n    os.system('ping ' + h)\n", set()),
    "quoted and more": ("def f():\n    h = request.args['h']\n    os.system(shlex.quote(h) + '; rm x')\n", {("OS Command Injection", "f", 3)}),
    "argv": ("def f():\n    h = request.args['h']\n    subprocess.run(['ping', h])\n", set()),
    "clean helper": ("def clean(x):\n    return int(x)\ndef f():\n    x = request.args['n']\n    n = clean(x)\n    db.execute('S ' + str(n))\n", set()),
    "guard": ("def f():\n    u = request.args['u']\n    if urlparse(u).netloc not in OK:\n        return\n    requests.get(u)\n", set()),
    "header": ("def f():\n    v = request.args['v']\n    resp.headers['X'] = v\n", {("HTTP Response Splitting / CRLF Injection", "f", 3)}),
    "overwritten": ("def f():\n    n = request.args['n']\n    n = 'x'\n    db.execute('S ' + n)\n", set()),
    "branch": ("def f():\n    if x:\n        n = request.args['n']\n    eval(n)\n", {("Code Injection", "f", 4)}),
    "nosql": ("def f():\n    n = request.args['n']\n    c.find({'a': n})\n    s.find(n)\n", {("NoSQL Injection", "f", 3)}),
}


@pytest.mark.parametrize("name", PY)
def test_python(name):
    text, expected = PY[name]
    assert {(r["type"], r["function"], r["lineno"]) for r in taint.flows_of(text, "python")} == expected


OTHER = {
    "php": (
        "<?php\nfunction q($x) {\n  return mysqli_query($db, 'S ' . $x);\n}\nfunction f() {\n  $n = $_GET['n'];\n  return q($n);\n}\nfunction g() {\n  $n = intval($_GET['n']);\n  return mysqli_query($db, 'S ' . $n);\n}\n",
        {("SQL Injection", "f")},
    ),
    "javascript": ("function f(req, res) {\n  const u = req.query.u;\n  res.redirect(u);\n}\nfunction g(req, res) {\n  res.redirect('/home');\n}\n", {("Open Redirect", "f")}),
    "go": ('func f(w http.ResponseWriter, r *http.Request) {\n  n := r.FormValue("n")\n  db.Query("SELECT " + n)\n}\n', {("SQL Injection", "f")}),
    "java": ('class A {\n  void f(HttpServletRequest r) {\n    String n = r.getParameter("n");\n    st.executeQuery("SELECT " + n);\n  }\n}\n', {("SQL Injection", "A.f")}),
    "ruby": ("def f\n  n = params[:n]\n  db.execute(\"SELECT \" + n)\nend\n", {("SQL Injection", "f")}),
    "c": ('int f(int argc, char **argv) {\n  char *p = argv[1];\n  system(p);\n}\n', {("OS Command Injection", "f")}),
}


@pytest.mark.parametrize("language", OTHER)
def test_other_languages(language):
    text, expected = OTHER[language]
    assert {(r["type"], r["function"]) for r in taint.flows_of(text, language)} == expected


def test_empty_and_broken_files():
    for language in taint.K.SOURCES:
        assert taint.flows_of("", language) == []
        taint.flows_of("def (((\n}}}{{{ \x00 '", language)


def test_shown_is_the_source_segment():
    text = "def f(a):\r    x = 'é' + g(a,\n      1)\r\n    if x:\n        return os.system(x)\n"
    shown = taint.Shown(text)
    for node in ast.walk(ast.parse(text)):
        assert shown.segment(node) == (ast.get_source_segment(text, node) or "")
