import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lintel.llm import crosspolytope, dartminhash, debruijn, graph, line_dedup
from lintel.llm.textkernel import Words

RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(t, n):
    words = t.split()
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY) + "x"
    return " ".join(words)


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_star_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (5, 4), (10, 9), (11, 10), (12, 9), (7, 7)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9, 10: 9, 11: 9, 12: 9}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_agree_like_weighted_jaccard():
    a, b = text(200) + " q" * 30, None
    b = edited(a, 12)
    words = Words(pa.array([a, b]))
    doc, items, counts = dartminhash.elements(words, 1)
    sig, _ = dartminhash.signatures(doc, items, counts, 2, 4000)
    x, y = (doc == i for i in (0, 1))
    exact = dartminhash.weighted_jaccard(items[x], counts[x], items[y], counts[y])
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_near_duplicates_against_brute_force(spark, docs):
    base = [text(RNG.choice([3, 40, 120])) for _ in range(25)]
    texts = [*base, *(edited(t, 1) for t in base), base[1], base[1], "", None, "one two", "one two", "  one\ttwo "]
    texts += [edited(base[2], RNG.randint(0, 6)) for _ in range(40)]
    rows = dartminhash.near_duplicates(docs([*texts, (None, "one two")]).withColumnRenamed("source", "class_id")).collect()
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values())]
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None} == components(range(len(texts)), links)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["class_id"]) for r in rows) and len(rows) == len(texts) + 1
    assert dartminhash.near_duplicates(docs([])).count() == 0


def test_word_windows_against_brute_force(spark, docs):
    passage = text(20)
    texts = [text(30) + " " + passage, passage + " " + text(5), passage + " " + passage, text(12), None, "", "a " * 40, "a " * 40, text(8) + " " + passage]
    got = {r["doc_id"]: r for r in debruijn.remove_repeats(docs([*texts, (None, passage)])).collect()}
    words = [(t or "").encode().split() for t in texts]
    owner = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 12):
            owner.setdefault(tuple(w[i : i + 13]), d)
    for d, w in enumerate(words):
        keep = [True] * len(w)
        for i in range(len(w) - 12):
            if owner[tuple(w[i : i + 13])] < d:
                keep[i : i + 13] = [False] * 13
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), len(w) - len(kept))
        assert got[d]["kept_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
        assert got[d]["kept_text"] == (texts[d] if len(kept) == len(w) else b" ".join(kept).decode())
    assert got[None]["n_removed"] == 0
    assert debruijn.remove_repeats(docs([])).count() == 0


def test_lines_against_brute_force(spark, docs):
    lines = [text(RNG.choice([2, 6, 14, 40])) for _ in range(30)]
    texts = ["\n".join(RNG.sample(lines, 5)) for _ in range(12)] + ["\n".join(edited(x, 1) for x in lines[:12]), "", None, "\n \n", lines[0], "ab", "ab"]
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs([*texts, (None, lines[0])])).collect()}
    first = {}
    for d, t in enumerate(texts):
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\r\v\f"):
                first.setdefault(x, (d, i))
    grams = {x: frozenset(x[i : i + 5] for i in range(len(x) - 4)) if len(x) >= 5 else frozenset([x]) for x in first}
    order = sorted(first, key=first.get)
    links = [(i, j) for i, a in enumerate(order) for j, b in enumerate(order[:i]) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    root = components(range(len(order)), links)
    keeper = {x: first[order[root[i]]] for i, x in enumerate(order)}
    for d, t in enumerate(texts):
        expected = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if x not in keeper or keeper[x] == (d, i))
        assert got[d]["kept_text"] == expected, d
    assert got[None]["kept_text"] == lines[0]
    assert line_dedup.drop_lines(docs([])).count() == 0


def test_repetitive_lines_meet_across_lengths(spark, docs):
    texts = ["=" * 60, "=" * 90, "-+" * 30, "-+" * 60, "na " * 20 + "na", "na " * 40 + "na"]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.drop_lines(docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 1, 0, 1, 0, 1]


def test_lines_with_scattered_edits_meet():
    rng = random.Random(7)
    grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    pairs = []
    while len(pairs) < 1200:
        n = rng.choice([20, 40, 100, 200, 400, 800])
        a = "".join(rng.choice("abcdefghijklmnop" + "   " * (len(pairs) % 2)) for _ in range(n))
        b = list(a)
        for at in rng.sample(range(n), max(1, n // 50)):
            b[at] = "z"
        b = "".join(b)
        if 0.8 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) <= 0.87:
            pairs.append((a, b))
    met = (line_dedup.line_keys([a for a, _ in pairs]) == line_dedup.line_keys([b for _, b in pairs])).any(axis=1)
    assert met.mean() >= 0.99
    # By length as well, short lines too.
    for n in (20, 40, 100, 200, 400, 800):
        some = [i for i, (a, _) in enumerate(pairs) if len(a) == n]
        assert not some or met[some].mean() >= 0.98, n


def test_bit_maps_rule_out_no_similar_pair():
    rng = random.Random(3)
    a = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([3, 9, 40, 300, 3000]))) for _ in range(400)]
    b = ["".join(rng.choice("xyz") if rng.random() < 0.03 else c for c in x) + x[: rng.randint(0, len(x) // 6)] for x in a]
    grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)} or {x}
    exact = np.array([len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y)) for x, y in zip(a, b, strict=True)])
    (n_a, bits_a), (n_b, bits_b) = line_dedup.sketches(a), line_dedup.sketches(b)
    assert n_a.tolist() == [len(grams(x)) for x in a]
    ok = line_dedup.possible(n_a, bits_a, n_b, bits_b, 0.8)
    assert not (exact & ~ok).any() and 50 < exact.sum() < 350 and (ok & ~exact).sum() < 100
    assert (line_dedup.similar(a, b) == exact).all()


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    rows = [*base, *(base[:30] + rng.normal(size=(30, 24)) * 0.15), *(base[5] + rng.normal(size=(40, 24)) * 0.25), base[0] * 3, base[0]]
    items = [(i, [float(v) for v in x]) for i, x in enumerate(rows)]
    n = len(items)
    items += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [None] * 24), (n + 5, [1.0, 2.0]), (None, items[0][1])]
    got = crosspolytope.near_vectors(spark.createDataFrame(items, "vec_id long, embedding array<double>")).collect()
    x = np.stack(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.95
    links = [(i, j) for i in range(n) for j in range(i) if close[i, j]]
    root = components(range(n), links)
    by_id = {r["vec_id"]: r for r in got}
    found = sum(by_id[i]["n_links"] for i in range(n))
    assert found >= 0.99 * 2 * len(links) and all(by_id[i]["n_links"] <= close[i].sum() - 1 for i in range(n))
    assert sum(by_id[i]["component_id"] == root[i] for i in range(n)) >= n - 1
    assert all(by_id[i]["n_links"] == 0 and by_id[i]["kept"] for i in range(n, n + 6)) and len(got) == len(items)
    assert crosspolytope.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_at_the_threshold_share_keys_at_every_depth():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    depths = {}
    for n in (10**3, 10**6, 10**8, 10**10):
        depth, tables, choices = crosspolytope.keys_for(n, 64)
        keys = [crosspolytope.hashes(x, tables, depth, choices) for x in (a, b)]
        depths[depth] = np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(*keys, strict=True)])
    assert len(depths) > 2 and min(depths.values()) >= 0.99, depths


def test_vectors_of_large_buckets_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    x = np.concatenate([base + rng.normal(size=(60, 16)) * 0.22, rng.normal(size=(20, 16)), [base, base]])
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(3, [float(v) for v in -x[0]], "x")]
    got = crosspolytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")).collect()
    assert len(got) == len(rows)
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1)[:, None]
    close = y @ y.T >= 0.95
    by_id = {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] != 3}
    wrong = [i for i, n in by_id.items() if n != close[i].sum() - 1]
    assert len(wrong) <= 2 and sorted(r["n_links"] for r in got if r["vec_id"] == 3)[0] == 0


def test_rows_that_share_a_doc_id_are_documents_of_their_own(spark, docs):
    passage, other = text(30), text(30)
    rows = [(0, passage), (1, passage), (1, other), (2, other), (2, other)]
    for mask in (2**64 - 1, 0xFF):
        got = {(r["doc_id"], r["n_words"] - r["n_removed"]) for r in debruijn.remove_repeats(docs(rows), mask=mask).collect()}
        assert got == {(0, 30), (1, 0), (1, 30), (2, 0)}, mask
    lines = line_dedup.drop_lines(docs([(0, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "something else here")])).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in lines) == [(0, "alpha beta gamma"), (1, ""), (1, "something else here")]
    near = dartminhash.near_duplicates(docs([(0, passage), (1, passage), (1, other)])).collect()
    assert sorted((r["doc_id"], r["class_id"], r["kept"]) for r in near) == [(0, 0, True), (1, 0, False), (1, 1, True)]


def test_clashing_columns_and_very_long_texts(spark, docs):
    long_text = text(40_000)
    names = ("c0", "c1", "spans", "gone", "text_hash", "any", "keeper", "component", "id", "line")
    held = docs([(0, long_text), (1, long_text), (2, None), (None, "a")])
    for c in names:
        held = held.withColumn(c, F.lit(7))
    for got, result in (
        (debruijn.remove_repeats(held), "n_removed"), (line_dedup.drop_lines(held), "n_removed"), (dartminhash.near_duplicates(held), "class_id")
    ):
        rows = {r["doc_id"]: r for r in got.collect()}
        assert len(rows) == 4 and all(r[c] == 7 for r in rows.values() for c in names)
        assert rows[1][result] == {"n_removed": 40_000 if "kept_sha256" in got.columns else 1, "class_id": 0}[result]


def test_line_dedup_needs_no_python_on_executors(spark, docs, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("Python on the executors")

    frame = docs(["alpha beta gamma delta\nalpha beta gamma delta\nother", "alpha beta gamma delta!"])
    monkeypatch.setattr(type(frame), "mapInArrow", refused)
    monkeypatch.setattr(type(frame.groupBy()), "applyInArrow", refused)
    assert [r["n_removed"] for r in line_dedup.drop_lines(frame).orderBy("doc_id").collect()] == [1, 1]


def test_native_line_bands_and_comparison(spark):
    rng = random.Random(11)
    grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)} or {x}
    rows = []
    while len(rows) < 2400:
        n = rng.choice([9, 14, 20, 40, 60, 100, 200, 400, 800])
        a = "".join(rng.choice("abcdefghijklmnopé ") for _ in range(n))
        b = list(a)
        for at in rng.sample([0, n - 1, *range(n)], max(1, n // 45)):
            b[at] = "z"
        b = "".join(b) + "y" * rng.randint(0, 1)
        rows.append((len(rows), a, b, len(grams(a) & grams(b)) / len(grams(a) | grams(b))))
    frame = spark.createDataFrame(rows, "i long, line_a string, line_b string, j double")
    sides = [frame.select((F.col("i") * 2 + k).alias("id"), F.col(f"line_{s}").alias("line")) for k, s in enumerate("ab")]
    both = sides[0].union(sides[1])
    keys = line_dedup.band_keys(both)
    met = {r["i"] for r in keys.select((F.col("id") / 2).cast("long").alias("i"), "id", "key").groupBy("i", "key").agg(F.count_distinct("id").alias("n")).where("n > 1").collect()}
    for n in (range(60), range(60, 1000)):
        some = [i for i, a, _, j in rows if len(a) in n and 0.8 <= j <= 0.9]
        assert len(some) > 50 and sum(i in met for i in some) >= 0.98 * len(some)
    got = frame.select("i", line_dedup.are_similar(F.col("line_a"), F.col("line_b"), 0.8).alias("ok")).collect()
    assert all(r["ok"] == (rows[r["i"]][3] >= 0.8 - 1e-9) for r in got)
    held = [line_dedup._side(line_dedup.maps(x).withColumn("id", (F.col("id") / 2).cast("long")), s) for x, s in zip(sides, "ab", strict=True)]
    maybe = {r["id_a"] for r in held[0].join(held[1], F.col("id_a") == F.col("id_b")).where(line_dedup.may_be_similar(0.8)).collect()}
    assert maybe >= {i for i, *_, j in rows if j >= 0.8}


def test_line_dedup_writes_the_keys_first_and_holds_bit_maps_against_each_other_once(spark, docs, monkeypatch):
    names = []

    def noted(df, name, write=line_dedup.staged):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(line_dedup, "staged", noted)
    monkeypatch.setattr(graph, "staged", noted)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(120))
    # Around the threshold, so that buckets hold several components and some pairs meet late.
    lines = []
    for _ in range(60):
        line = list(base)
        for at in rng.sample(range(120), rng.randint(1, 5)):
            line[at] = "Z"
        lines.append("".join(line))
    grams = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    first = list(range(len(lines)))
    for _ in lines:
        for i, a in enumerate(grams):
            for j, b in enumerate(grams):
                if len(a & b) >= 0.8 * len(a | b):
                    first[i] = first[j] = min(first[i], first[j])
    got = line_dedup.drop_lines(docs(lines)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [int(f != i) for i, f in enumerate(first)]
    assert names[0] == "shared" and names.count("possible") == 1
    assert "late" in names
