import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lintel.llm import gru_lm, langid, mcd, rff_quality

RNG = random.Random(9)
WORDS = {"en": "the of and to in is that for".split(), "de": "der die und ist nicht das mit für".split()}


def corpus(n=120):
    return [(i, " ".join(RNG.choice(WORDS[lang]) for _ in range(RNG.randint(5, 60))), lang) for i in range(n) for lang in [RNG.choice(["en", "de"])]]


def test_language(spark, docs):
    rows = corpus()
    model = langid.fit(docs([*rows, (999, None, "en"), (998, "x", None)]))
    got = {r["doc_id"]: r for r in langid.identify(docs([*rows, (500, None), (501, "123 !?"), (502, ""), (503, "der " * 5000)]), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) > 0.97 * len(rows)
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = langid.fit(docs([]))
    assert [r["lang_pred"] for r in langid.identify(docs(["a"]), empty).collect()] == ["und"]


def test_gradients_and_sum_of_probabilities():
    tokens, types = np.full(gru_lm.TAILS, 900.0), np.full(gru_lm.TAILS, 90.0)
    v = gru_lm.Vocabulary([(int(h), 10.0) for h in range(1, 100)], 20, tokens, types)
    w = {k: x.astype(np.float64) for k, x in gru_lm.initial(v).items()}
    rng = np.random.default_rng(0)
    states = rng.normal(size=(1, gru_lm.STATE))
    total = sum(math.exp(gru_lm.log_likelihood(w, v, states, np.array([t]))[0][0]) for t in range(v.size + gru_lm.TAILS))
    assert abs(total - 1) < 1e-6
    x, y = rng.integers(0, v.inputs, (4, 3)), rng.integers(0, v.size + gru_lm.TAILS, (4, 3))
    keep, h = np.ones((4, 3)), np.zeros((3, gru_lm.STATE))
    old, gru_lm.f32 = gru_lm.f32, np.float64
    try:
        g, _, _ = gru_lm.window_gradients(w, v, x, y, keep, h)
        for name, at in (("u", (1, 5)), ("u", (2, 60)), ("b", (3,)), ("e", (x[0, 0], 4)), ("e", (x[1, 1], 50)), ("c", (0, 1)), ("w", (0, 2, 1))):
            losses = []
            for step in (1e-5, -1e-5):
                moved = {k: z.copy() for k, z in w.items()}
                moved[name][at] += step
                losses.append(gru_lm.window_gradients(moved, v, x, y, keep, h)[2])
            assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-6, name
    finally:
        gru_lm.f32 = old


def test_language_model_scores(spark, docs):
    rows = [*corpus(150), (900, None), (901, ""), (902, "The the THE É"), (903, "unseen words"), (902, "The the THE É")]
    frame = docs(rows).withColumn("held_out", F.col("doc_id") % 7 == 2)
    got = gru_lm.score(frame).collect()
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
    counts, ends = Counter(), 0
    for i, t, *_ in rows:
        if i % 7 != 2:
            counts.update(lower(t))
            ends += 1
    n, distinct = sum(counts.values()) + ends, len(counts) + 1
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        words = lower(texts[r["doc_id"]])
        base = sum(math.log10((counts[w] + 1) / (n + distinct + 1)) for w in words) + math.log10((ends + 1) / (n + distinct + 1))
        assert abs(base - r["base_score"]) < 1e-6 and r["score"] < 0
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(w in counts for w in words) + 1, n)
    assert gru_lm.score(docs([]).withColumn("held_out", F.lit(False))).count() == 0


def test_every_training_text_reaches_the_network(spark, docs, monkeypatch):
    learned, summed = [], gru_lm.summed

    def counted(blocks):
        sums = summed(blocks)
        learned.append(sums[""][0] if "" in sums else 0)
        return sums

    monkeypatch.setattr(gru_lm, "summed", counted)
    rows = corpus(150)
    got = gru_lm.score(docs(rows).withColumn("held_out", F.col("doc_id") % 7 == 2)).first()
    assert sum(learned) == got["train_tokens"] == sum(len(t.split()) + 1 for i, t, _ in rows if i % 7 != 2)


def test_every_token_of_a_segment_is_a_target(monkeypatch):
    v = gru_lm.Vocabulary([(int(h), 10.0) for h in range(1, 100)], 20, np.full(gru_lm.TAILS, 900.0), np.full(gru_lm.TAILS, 90.0))
    seen, inner = set(), gru_lm.window_gradients

    def watched(w, v, x, y, keep, h):
        seen.update(y.ravel().tolist())
        return inner(w, v, x, y, keep, h)

    monkeypatch.setattr(gru_lm, "window_gradients", watched)
    for n in (2, 20, 70, v.inputs):
        seen.clear()
        gru_lm.Trainer(gru_lm.initial(v), v, 1e-3).learn(np.arange(n), np.zeros(n, bool))
        assert seen == set(range(1, n))


def test_state_goes_through_whole_documents():
    v = gru_lm.Vocabulary([(int(h), 10.0) for h in range(1, 100)], 20, np.full(gru_lm.TAILS, 900.0), np.full(gru_lm.TAILS, 90.0))
    w = gru_lm.initial(v)
    rng = np.random.default_rng(1)
    lengths = [1, 5, 200, 3, 64, 65]
    texts = [np.concatenate([[v.end], rng.integers(0, v.inputs, n)]) for n in lengths]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    together, _ = gru_lm.score_documents(w, v, np.concatenate(texts), begin)
    alone = [gru_lm.score_documents(w, v, x, np.array([0, len(x)]))[0][0] for x in texts]
    assert np.allclose(together, alone, atol=1e-3)


def test_isotonic_is_the_nearest_monotone_map():
    ones, total = np.array([3.0, 0, 1, 0, 4, 0]), np.array([4.0, 0, 4, 0, 5, 0])
    got = rff_quality.isotonic(ones, total)
    assert (np.diff(got) >= 0).all() and abs(got[0] - 0.5) < 1e-9 and abs(got[4] - 0.8) < 1e-9


def test_quality(spark, docs):
    good = [(i, " ".join(RNG.choice(WORDS["en"]) for _ in range(RNG.randint(60, 90)))) for i in range(100)]
    bad = [(200 + i, " ".join(RNG.choice(WORDS["en"]) + "###" for _ in range(RNG.randint(60, 90)))) for i in range(60)]
    frame = docs([*good, *bad, (500, None), (501, ""), (None, "x")])
    labels = spark.createDataFrame([*((i, 1) for i, _ in good[:80]), *((i, 0) for i, _ in bad[:40]), (5, None), (777, 1)], "doc_id long, quality int")
    seen = rff_quality.document_statistics(frame)
    got = {r["doc_id"]: r["score"] for r in rff_quality.score(seen, rff_quality.fit(seen, labels)).collect()}
    right = [got[i] > 0.5 for i, _ in good[80:]] + [got[i] < 0.5 for i, _ in bad[40:]]
    assert sum(right) >= 0.85 * len(right)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 163
    nothing = rff_quality.fit(seen, labels.where("false"))
    assert {r["score"] for r in rff_quality.score(seen, nothing).collect()} == {0.5}


def test_statistics_count_what_they_say():
    x = rff_quality.statistics(pa.array(["a b\na b\nc", "", None, "# ! A1 é."]))
    at = {n: i for i, n in enumerate(rff_quality.NAMES)}
    assert abs(x[0, at["dup_lines"]] - 1 / 3) < 1e-9 and abs(x[0, at["log_words"]] - math.log1p(5)) < 1e-9 and np.isfinite(x).all()


def test_outliers(spark, docs):
    vocabulary = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(3, 8))) for _ in range(2000)]
    clean = [(i, "\n".join(" ".join(RNG.choice(vocabulary) for _ in range(40)) for _ in range(RNG.randint(2, 6)))) for i in range(200)]
    odd = [(300 + i, " ".join(RNG.choice(vocabulary) + "$$#" for _ in range(150))) for i in range(5)]
    rows = [*clean, *odd, (400, None), (401, ""), (402, "a b c " * 100), (403, "x\nx\n \nx"), (None, "q")]
    got = {r["doc_id"]: r for r in mcd.judge(docs(rows)).collect()}
    assert sum(got[i]["kept"] for i, _ in clean) >= 198 and not any(got[i]["kept"] for i, _ in odd)
    for i, t in rows:
        words = (t or "").split()
        three = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines, seen = 0, set()
        for x in (t or "").split("\n"):
            if x.strip():
                lines += x in seen
                seen.add(x)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), lines, len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert mcd.judge(docs([])).count() == 0


def test_a_single_statistic_can_reject(spark, docs):
    vocabulary = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(3, 8))) for _ in range(4000)]
    line = lambda: " ".join(RNG.choice(vocabulary) for _ in range(RNG.randint(9, 15)))
    clean = [(i, "\n".join(line() for _ in range(RNG.randint(8, 12)))) for i in range(200)]
    again = "\n".join(x for _ in range(5) for x in (line() + " " + line(), "abc defg"))
    passage = line() + " " + line()
    said_twice = "\n".join([passage, *(line() for _ in range(5)), passage])
    got = {r["doc_id"]: r for r in mcd.judge(docs([*clean, (300, again), (301, said_twice)])).collect()}
    assert (got[300]["n_dup_lines"], got[300]["n_repeat_words"], got[300]["base_failed"], got[300]["kept"]) == (4, 0, False, False)
    assert not got[301]["base_failed"] and got[301]["n_repeat_words"] > 0.25 * got[301]["n_words"] and not got[301]["kept"]
    assert sum(got[i]["kept"] for i, _ in clean) >= 196


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf).collect()
    assert packed and {r["doc_id"] for r in packed} <= set(range(200))
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, sf)
        assert after.columns == frame.columns, name
        assert after.count() <= frame.count()
        frame = corpus_pipeline.staged(after, name)


def test_any_number_of_languages_and_unlearned_scripts(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    words = {"en": "the house and the tree stand there", "de": "das haus und der baum stehen dort", "fi": "talo ja puu seisovat tuolla yhdessä", "es": "la casa y el árbol están allí", "xx": "zq zqx qzq xzq zzq qxz"}
    rows = [(i, " ".join([words[x]] * 5), x) for i, x in enumerate(list(words) * 8)]
    model = langid.fit(docs(rows))
    assert len(model.blocks) == 3
    asked = [*((i, words[x], x) for i, x in enumerate(words)), (90, "дом и дерево стоят там вместе", None), (91, "the tree and the house", None), (91, "the tree and the house", None)]
    held = docs(asked).withColumn("top", F.lit(1)).withColumn("best", F.lit("b")).withColumn("score", F.lit("s"))
    got = langid.identify(held, model).collect()
    found = {r["doc_id"]: r for r in got}
    assert [found[i]["lang_pred"] for i in range(5)] == list(words) and all(0.9 < found[i]["score"] <= 1 for i in range(5))
    assert len(got) == 8 and all(r["top"] == 1 and r["best"] == "b" for r in got)
    assert found[90]["likeness"] < -2.5 < found[91]["likeness"]


def test_pipeline_stages_decide_as_they_must(spark, docs):
    import corpus_pipeline

    clean = [" ".join(f"word{(7 * i * j) % 101}" for j in range(1, 60)) for i in range(1, 6)]
    learned = [(100 + i, t, "en") for i, t in enumerate(clean * 4)]
    given = docs([*learned, (1, None, None), (2, "", None), (3, "12 34", None)])
    kept = corpus_pipeline.language_id(spark, given, "")
    assert kept.columns == given.columns and sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in learned]
    near = docs([(0, clean[0]), (1, clean[0] + " more"), (2, clean[1]), (3, None), (4, clean[0])])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, near, "").collect()) == [0, 2, 3]
    lines = corpus_pipeline.line_dedup_stage(spark, docs([(0, "one line of text here\nother"), (1, "one line of text here\nthird line"), (2, None)]), "")
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {0: "one line of text here\nother", 1: "third line", 2: None}
    cut = corpus_pipeline.substring_dedup(spark, docs([(0, clean[0]), (1, "start " + clean[0] + " end"), (2, None)]), "")
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {0: clean[0], 1: "start end", 2: None}
    for stage in (corpus_pipeline.line_dedup_stage, corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup):
        assert stage(spark, docs([]), "").columns == docs([]).columns and stage(spark, docs([]), "").count() == 0
