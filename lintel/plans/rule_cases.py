"""A flagged and a safe snippet for each rule."""

ROUTE = '@app.route("/x")\n'
CASES = {
    "race-condition": (
        "python",
        "def withdraw(self, amount):\n    if self.balance >= amount:\n        time.sleep(1)\n        self.balance -= amount\n",
        "def withdraw(self, amount):\n    with self.lock:\n        if self.balance >= amount:\n            time.sleep(1)\n            self.balance -= amount\n",
    ),
    "price-manipulation": (
        "python",
        "def buy():\n    price = request.json['price']\n    total = price * 2\n    return charge(total)\n",
        "def buy():\n    price = request.json['price']\n    if price <= 0:\n        abort(400)\n    total = price * 2\n    return charge(total)\n",
    ),
    "idor": (
        "python",
        "def order(order_id):\n    request.args\n    return Order.objects.get(id=order_id)\n",
        "def order(order_id):\n    request.args\n    o = Order.objects.get(id=order_id)\n    if o.owner_id != current_user.id:\n        abort(403)\n    return o\n",
    ),
    "sql-injection": (
        "php",
        "function f() {\n  $n = $_GET['n'];\n  return mysqli_query($db, \"SELECT * FROM t WHERE n = '\" . $n . \"'\");\n}",
        "function f() {\n  $n = intval($_GET['n']);\n  return mysqli_query($db, \"SELECT * FROM t WHERE n = \" . $n);\n}",
    ),
    "broken-auth": (
        "python",
        "def page():\n    if request.args.get('is_admin') == '1':\n        return secret_page()\n",
        "@login_required\ndef page():\n    if request.args.get('is_admin') == '1' and user.has_role('x') and current_user_can('y'):\n        return secret_page()\n",
    ),
    "weak-auth": (
        "python",
        "def admin():\n    key = request.args.get('key')\n    if key == ADMIN_KEY:\n        return 1\n",
        "def admin():\n    key = request.args.get('key')\n    if hmac.compare_digest(key, ADMIN_KEY):\n        return 1\n",
    ),
    "negative-quantity": (
        "python",
        "def cart():\n    qty = request.json['qty']\n    total = unit * qty\n    return total\n",
        "def cart():\n    qty = request.json['qty']\n    if qty < 1:\n        abort(400)\n    return unit * qty\n",
    ),
    "hardcoded-secret": ("python", "def f():\n    password = \"hunter2hunter2\"\n", "def f():\n    password = \"${DB_PASSWORD}\"\n"),
    "missing-rate-limit": (
        "python",
        "def login():\n    p = request.form['password']\n    return check_password(p)\n",
        "@limiter.limit('5/m')\ndef login():\n    p = request.form['password']\n    return check_password(p)\n",
    ),
    "command-injection": ("python", "def f(host):\n    os.system('ping ' + host)\n", "def f(host):\n    subprocess.run(['ping', host])\n"),
    "path-traversal": (
        "python",
        "def f():\n    name = request.args.get('name')\n    return open(name).read()\n",
        "def f():\n    name = secure_filename(request.args.get('name'))\n    return open(name).read()\n",
    ),
    "path-join-traversal": ("python", "def f(name):\n    return open('/srv/files/' + name).read()\n", "def f(name):\n    return open('/srv/files/fixed').read()\n"),
    "ssti": (
        "python",
        "def f():\n    n = request.args.get('n')\n    return render_template_string('<p>' + n)\n",
        "def f():\n    n = request.args.get('n')\n    return render_template('p.html', n=n)\n",
    ),
    "weak-crypto": ("python", "def f(password):\n    return hashlib.md5(password)\n", "def f(cache_key):\n    return hashlib.md5(cache_key)\n"),
    "open-redirect": (
        "python",
        "def f():\n    next_url = request.args.get('next')\n    return redirect(next_url)\n",
        "def f():\n    next_url = request.args.get('next')\n    if urlparse(next_url).netloc:\n        abort(400)\n    return redirect(next_url)\n",
    ),
    "mass-assignment": ("python", "def f():\n    data = request.get_json()\n    user.update(**data)\n", "def f():\n    data = request.get_json()\n    user.name = data['name']\n"),
    "xxe": (
        "python",
        "def f():\n    return etree.fromstring(request.data)\n",
        "def f():\n    return etree.fromstring(request.data, XMLParser(resolve_entities=False))\n",
    ),
    "insecure-deserialization": ("python", "def f():\n    return yaml.load(request.data)\n", "def f():\n    return yaml.safe_load(request.data)\n"),
    "missing-auth": (
        "python",
        "def delete_user():\n    uid = request.form['u']\n    db_remove(uid)\n",
        "@login_required\ndef delete_user():\n    uid = request.form['u']\n    db_remove(uid)\n",
    ),
    "debug-mode": ("python", "def f():\n    app.run(debug=True)\n", "def f():\n    app.run(debug=False)\n"),
    "cors-misconfig": ("python", "def f():\n    CORS(app, origins='*')\n", "def f():\n    CORS(app, origins=['https://a.test'])\n"),
    "jwt-weakness": (
        "python",
        "def f():\n    return jwt.decode(request.headers['t'], options={'verify_signature': False})\n",
        "def f():\n    return jwt.decode(request.headers['t'], KEY, algorithms=['HS256'])\n",
    ),
    "tls-verification-disabled": ("python", "def f(u):\n    return requests.get(u, verify=False)\n", "def f(u):\n    return requests.get(u, verify=True)\n"),
    "insecure-cookie": (
        "python",
        "def f():\n    r = make_response('x')\n    r.set_cookie('session', v)\n",
        "def f():\n    r = make_response('x')\n    r.set_cookie('session', v, httponly=True, secure=True)\n",
    ),
    "csrf-disabled": ("python", "def f():\n    app.config['WTF_CSRF_ENABLED'] = False\n", "def f():\n    app.config['WTF_CSRF_ENABLED'] = True\n"),
    "insecure-randomness": ("python", "def reset_token():\n    return random.choice(LETTERS)\n", "def reset_token():\n    return secrets.token_hex()\n"),
    "permissive-file-permissions": ("python", "def f(p):\n    os.chmod(p, 0o777)\n", "def f(p):\n    os.chmod(p, 0o600)\n"),
    "insecure-temp-file": ("python", "def f():\n    return tempfile.mktemp()\n", "def f():\n    return tempfile.mkstemp()\n"),
    "dangerous-sink": ("python", "def f(x):\n    return eval(x)\n", "def f(x):\n    return eval('1 + 2')\n"),
    "reflected-xss": (
        "python",
        "def f():\n    n = request.args.get('n')\n    return '<h1>' + n + '</h1>'\n",
        "def f():\n    n = escape(request.args.get('n'))\n    return '<h1>' + n + '</h1>'\n",
    ),
    "sensitive-info-exposure": ("python", "def f():\n    request.args\n    return os.environ['KEY']\n", "def f():\n    request.args\n    return 'ok'\n"),
    "ssrf": (
        "python",
        "def f():\n    url = request.args.get('url')\n    return requests.get(url).text\n",
        "def f():\n    url = request.args.get('url')\n    if urlparse(url).hostname not in ALLOWED:\n        abort(400)\n    return requests.get(url).text\n",
    ),
}
