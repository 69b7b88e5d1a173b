"""Language-model scores: a gated recurrent network with a class-factored softmax.

Counting. Every word of every text goes, by its hash, to a part that counts it
over all training texts and sends back what its documents need: sums of
log10(count + 1) and numbers of known words, a blob for each chunk of documents. Totals, and counts by class, are
sums over parts. No vocabulary is collected; the `HEAD` most frequent tokens are.

Model. p(token) = p(class | state) p(token | class, state). Frequent tokens have
classes with a softmax of their own; all other words fall in classes by first
letter and alphabet, and share their class by add-one counts, one share being
for words that training does not have. So probabilities sum to one.

Training. Every training text is in one of the rounds, and replicas run truncated
backpropagation in numpy over all texts of a round; their weights are averaged
after it. Replicas take about `REPLICA` tokens a round, so with more tokens there
are more replicas and, from some size on, more rounds, either as the square root.
Scoring carries the state through the whole document, many documents abreast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.arraysum import SCHEMA, summed, to_blocks
from lintel.llm.common import arrow_rows, lean, staged, width_for
from lintel.llm.debruijn import _numbers, _planes
from lintel.llm.textkernel import U, Words, chunks, mix

HEAD = 2048
PER_CLASS = 64
TAILS = 32
STATE = 24
WINDOW, STREAMS = 32, 128
ROUNDS = 16  # at least
REPLICA = 200_000  # training tokens of a replica and round
RATE = 1.2e-2
SEGMENT = 1 << 20
END = 0
f32 = np.float32


def coded(words: Words) -> np.ndarray:
    """Word hashes whose low bits hold the class the word has if it is rare."""
    first = words.data[words.starts].astype(np.uint64)
    foreign = np.concatenate([[0], np.cumsum(words.data > 127)])
    accents = (foreign[words.ends] > foreign[words.starts]).astype(np.uint64)
    bucket = mix(first + U(1)) % U(TAILS // 2) * U(2) + accents
    return (words.hashes() & ~U(TAILS - 1)) | bucket


# Counting


def _pairs(parts: int):
    """Per chunk and part: hashes of each text's distinct words with their numbers of times."""

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, most=2 << 20):
                words = Words(piece.column("text"), lower=True)
                hashes, doc = coded(words), words.doc_of()
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, int)
                times = np.diff(np.append(first, len(doc)))
                hashes, doc = hashes[first], doc[first]
                part = ((hashes >> U(20)) % U(parts)).astype(np.uint16)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                hashes, doc, times = hashes[order], doc[order].astype(np.uint32), times[order].astype(np.uint32)
                keys = piece.column("key").to_numpy().tobytes()
                chunk = int.from_bytes(hashlib.blake2b(keys, digest_size=8).digest(), "little", signed=True)
                train = piece.column("train").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                some = np.flatnonzero(np.diff(cuts))
                spans = [slice(cuts[p], cuts[p + 1]) for p in some]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(some, pa.int32()),
                    "chunk": pa.array([chunk] * len(some), pa.int64()),
                    "pairs": pa.array([len(doc)] * len(some), pa.int64()),
                    "keys": pa.array([keys, *[b""] * (len(some) - 1)][: len(some)], pa.binary()),
                    "train": pa.array([train] * len(some), pa.binary()),
                    "docs": pa.array([_planes(np.diff(doc[s], prepend=np.uint32(0)), 4) for s in spans], pa.binary()),
                    "times": pa.array([_planes(times[s], 4) for s in spans], pa.binary()),
                    "hashes": pa.array([_planes(hashes[s], 8) for s in spans], pa.binary()),
                })

    return deal


CHUNK, TOKEN, TOTAL, CLASS = range(4)
_COUNTS = "kind int, key long, s double, n long, keys binary, sums binary"


def _most(parts: int) -> int:
    """Frequent words that one of some parts may hold: words fall to parts evenly, this is beyond 8 deviations."""
    return min(HEAD, int(HEAD / parts + 8 * (HEAD / parts) ** 0.5) + 32)


def _count(table: pa.Table, parts: int) -> pa.Table:
    """Of a part: sums by document of each chunk, its most frequent words, and totals.

    Rows (kind, key, s, n, keys, sums). A chunk's row has its pairs in all as s,
    those of this part as n, and sums: per document the sum of log10(count + 1)
    and the number of known words.
    """
    hashes, places, times, train, sizes = [], [], [], [], []
    heads = {c: table.column(c).to_pylist() for c in ("chunk", "pairs", "keys")}
    base = 0
    for row in table.select(["train", "docs", "times", "hashes"]).to_batches(max_chunksize=64):
        for t, d, n, h in zip(*(c.to_pylist() for c in row.columns), strict=True):
            d = np.cumsum(_numbers(d, 4).astype(np.int64))
            hashes.append(_numbers(h, 8))
            places.append(d + base)
            train.append(np.frombuffer(t, np.uint8)[d])
            times.append(_numbers(n, 4).astype(np.int64))
            sizes.append(len(t))
            base += len(t)
    own = [len(h) for h in hashes]
    hashes, places, times, train = map(np.concatenate, (hashes, places, times, train))
    order = np.argsort(hashes)
    hashes, places, times, train = hashes[order], places[order], times[order], train[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    counts = np.add.reduceat(times * train, first)
    each = np.repeat(counts, np.diff(np.append(first, len(hashes))))
    sums = np.bincount(places, weights=times * np.log10(each + 1.0), minlength=base)
    known = np.bincount(places, weights=times * (each > 0), minlength=base)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    blobs = [sums[a:b].tobytes() + known[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    top = np.argsort(-counts, kind="stable")[:_most(parts)]
    top = top[counts[top] > 0]
    cls = (hashes[first] & U(TAILS - 1)).astype(np.int64)
    tokens, types = np.bincount(cls, weights=counts, minlength=TAILS), np.bincount(cls, weights=counts > 0, minlength=TAILS)
    rest = len(top) + 1 + TAILS
    return pa.table({
        "kind": np.repeat([CHUNK, TOKEN, TOTAL, CLASS], [len(own), len(top), 1, TAILS]).astype(np.int32),
        "key": np.concatenate([np.array(heads["chunk"], np.int64), hashes[first][top].view(np.int64), [0], np.arange(TAILS)]),
        "s": np.concatenate([np.array(heads["pairs"], float), counts[top], [counts.sum()], tokens]).astype(float),
        "n": np.concatenate([own, np.zeros(len(top)), [(counts > 0).sum()], types]).astype(np.int64),
        "keys": pa.array([*heads["keys"], *[None] * rest], pa.binary()),
        "sums": pa.array([*blobs, *[None] * rest], pa.binary()),
    })


def _by_document(table: pa.Table) -> pa.Table:
    """(key, s, known) of a chunk's documents, from what all parts sent back."""
    # Chunks of equal rows count together, as their rows do later.
    if sum(table.column("n").to_pylist()) % int(table.column("s")[0].as_py()):
        raise ValueError("a part of a chunk is missing: its task was repeated on rows in another order")
    keys = np.frombuffer(next(k for k in table.column("keys").to_pylist() if k), np.int64)
    n = len(keys)
    sums, known = np.zeros(n), np.zeros(n, np.int64)
    for blob in table.column("sums").to_pylist():
        sums += np.frombuffer(blob, np.float64, n)
        known += np.frombuffer(blob, np.int32, n, 8 * n)
    return pa.table({"key": keys, "s": sums, "known": known})


# Model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


class Vocabulary:
    """Head tokens by frequency, END among them, their classes and the tail classes' totals."""

    def __init__(self, head: list[tuple[int, float]], ends: int, tokens: np.ndarray, types: np.ndarray) -> None:
        rows = sorted([(-c, h, False) for h, c in head] + [(-float(ends), END, True)])[:HEAD]
        if not any(is_end for *_, is_end in rows):
            rows[-1] = (-float(ends), END, True)
        self.end = next(i for i, r in enumerate(rows) if r[2])
        counts = np.array([-r[0] for r in rows])
        words = [i for i, r in enumerate(rows) if not r[2]]
        hashes = np.array([rows[i][1] for i in words], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], np.array(words, np.int64)[order]
        self.counts, self.size = counts, len(rows)
        self.classes = -(-self.size // PER_CLASS)
        cls = (hashes & U(TAILS - 1)).astype(np.int64)
        self.tail_tokens = tokens - np.bincount(cls, weights=counts[words], minlength=TAILS)
        self.tail_types = types - np.bincount(cls, minlength=TAILS)
        self.tail_norm = np.log10(self.tail_tokens + self.tail_types + 1)
        self.inputs = self.size + TAILS

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Head place, or size + tail class."""
        tail = self.size + (hashes & U(TAILS - 1)).astype(np.int64)
        if not len(self.hashes):
            return tail
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.places[at], tail)


def initial(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights that begin at unigram probabilities."""
    rng = np.random.default_rng(seed)
    within = np.full(v.classes * PER_CLASS, -30.0)
    within[: v.size] = np.log(v.counts + 1)
    mass = np.zeros(v.classes * PER_CLASS)
    mass[: v.size] = v.counts + 1
    classes = np.concatenate([mass.reshape(v.classes, -1).sum(axis=1), v.tail_tokens + v.tail_types + 1])
    w = {
        "e": rng.normal(size=(v.inputs, 3 * STATE)) * 0.2,
        "u": rng.normal(size=(STATE, 3 * STATE)) / np.sqrt(STATE),
        "b": np.zeros(STATE),
        "c": rng.normal(size=(STATE, v.classes + TAILS)) * 0.05,
        "cb": np.log(classes / classes.sum()),
        "w": rng.normal(size=(v.classes, STATE, PER_CLASS)) * 0.05,
        "wb": within.reshape(v.classes, PER_CLASS),
    }
    return {k: x.astype(f32) for k, x in w.items()}


def step(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    gates, pre = w["e"][x], h @ w["u"]
    zr = _sigmoid(gates[:, : 2 * STATE] + pre[:, : 2 * STATE])
    z, r = zr[:, :STATE], zr[:, STATE:]
    inner = pre[:, 2 * STATE :] + w["b"]
    n = np.tanh(gates[:, 2 * STATE :] + r * inner)
    return n + z * (h - n), z, r, inner, n


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def log_likelihood(w: dict[str, np.ndarray], v: Vocabulary, states: np.ndarray, targets: np.ndarray, gradients: dict | None = None):
    """Natural log p of each target: its class', and within a head class its own. With gradients, also d loss / d states."""
    n = len(targets)
    head = targets < v.size
    cls = np.where(head, targets // PER_CLASS, targets - v.size + v.classes)
    logs = _log_softmax(states @ w["c"] + w["cb"])
    out = logs[np.arange(n), cls].copy()
    d = None
    if gradients is not None:
        p = np.exp(logs)
        p[np.arange(n), cls] -= 1
        p /= n
        gradients["c"], gradients["cb"] = states.T @ p, p.sum(axis=0)
        gradients["w"], gradients["wb"] = np.zeros_like(w["w"]), np.zeros_like(w["wb"])
        d = p @ w["c"].T
    at = np.flatnonzero(head)
    at = at[np.argsort(cls[at], kind="stable")]
    cuts = np.searchsorted(cls[at], np.arange(v.classes + 1))
    for k in range(v.classes):
        rows = at[cuts[k] : cuts[k + 1]]
        if not len(rows):
            continue
        inside, h = targets[rows] % PER_CLASS, states[rows]
        logs = _log_softmax(h @ w["w"][k] + w["wb"][k])
        out[rows] += logs[np.arange(len(rows)), inside]
        if gradients is not None:
            p = np.exp(logs)
            p[np.arange(len(rows)), inside] -= 1
            p /= n
            gradients["w"][k], gradients["wb"][k] = h.T @ p, p.sum(axis=0)
            d[rows] += p @ w["w"][k].T
    return out, d


def window_gradients(w, v, x, y, keep, h):
    """Gradients of the mean loss over a window x, y (time, streams), the state before it and after it, and the loss."""
    states, saved = [], []
    for t in range(len(x)):
        h = h * keep[t][:, None]
        before = h
        h, z, r, inner, n = step(w, x[t], h)
        states.append(h)
        saved.append((before, z, r, inner, n))
    g: dict[str, np.ndarray] = {}
    logs, d = log_likelihood(w, v, np.concatenate(states), y.reshape(-1), g)
    d = d.reshape(len(x), -1, STATE)
    da = np.zeros((len(x), x.shape[1], 3 * STATE), f32)
    g["u"], g["b"] = np.zeros_like(w["u"]), np.zeros_like(w["b"])
    dh = np.zeros_like(h)
    for t in range(len(x) - 1, -1, -1):
        before, z, r, inner, n = saved[t]
        dh = dh + d[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        da[t] = np.concatenate([dz, dr, dn], axis=1)
        du = np.concatenate([dz, dr, dn * r], axis=1)
        g["u"] += before.T @ du
        g["b"] += (dn * r).sum(axis=0)
        dh = (dh * z + du @ w["u"].T) * keep[t][:, None]
    flat, rows = da.reshape(-1, 3 * STATE), x.reshape(-1)
    order = np.argsort(rows, kind="stable")
    used, first = np.unique(rows[order], return_index=True)
    g["e"] = np.zeros_like(w["e"])
    g["e"][used] = np.add.reduceat(flat[order], first, axis=0)
    return g, h, -float(logs.mean())


class Trainer:
    """Adam over windows of many streams of texts."""

    def __init__(self, w: dict[str, np.ndarray], v: Vocabulary, rate: float) -> None:
        self.w, self.v, self.rate, self.n = {k: x.copy() for k, x in w.items()}, v, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in w.items()}
        self.s = {k: np.zeros_like(x) for k, x in w.items()}

    def update(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = f32(min(1.0, 1.0 / max(norm, 1e-9)))
        rate = f32(self.rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n))
        for k, x in g.items():
            x = x * scale
            self.m[k] += f32(0.1) * (x - self.m[k])
            self.s[k] += f32(0.01) * (x * x - self.s[k])
            self.w[k] -= rate * self.m[k] / (np.sqrt(self.s[k]) + f32(1e-6))

    def learn(self, tokens: np.ndarray, starts: np.ndarray) -> list[float]:
        """tokens: texts one after another, each begun by END; starts marks those ENDs."""
        targets = len(tokens) - 1
        if targets < 1:
            return []
        # Streams overlap by a token at most, so that none is left over.
        length = -(-targets // STREAMS)
        at = np.arange(STREAMS) * (targets - length) // (STREAMS - 1)
        h, losses = np.zeros((STREAMS, STATE), f32), []
        for t in range(0, length, WINDOW):
            rows = np.arange(t, min(t + WINDOW, length))[:, None] + at[None, :]
            g, h, loss = window_gradients(self.w, self.v, tokens[rows], tokens[rows + 1], (~starts[rows]).astype(f32), h)
            self.update(g)
            losses.append(loss)
        return losses


def _streams(batch: pa.RecordBatch, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    words = Words(batch.column("text"), lower=True)
    ids = v.ids(coded(words))
    n = words.n_words
    tokens = np.full(len(ids) + len(n), v.end, np.int64)
    starts = np.zeros(len(tokens), bool)
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    starts[begin[:-1]] = True
    tokens[~starts] = ids
    return tokens, begin


def _train(model):
    @lean
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = model.value
        trainer, held, total = Trainer(w, v, RATE), [], 0

        def flush() -> None:
            nonlocal total
            if held:
                tokens = np.concatenate([t for t, _ in held] + [[v.end]])
                starts = np.zeros(len(tokens), bool)
                at = 0
                for t, begin in held:
                    starts[at + begin[:-1]] = True
                    at += len(t)
                trainer.learn(tokens, starts)
                total += len(tokens) - 1
                held.clear()

        for batch in batches:
            for piece in chunks(batch):
                held.append(_streams(piece, v))
                if sum(len(t) for t, _ in held) > SEGMENT:
                    flush()
        flush()
        if trainer.n:
            yield to_blocks({k: x.astype(float) * total for k, x in trainer.w.items()} | {"": np.array([float(total)])})

    return train


# Scoring


def score_documents(w: dict[str, np.ndarray], v: Vocabulary, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p of each document as far as the network says, and its head tokens' sum of log10(count + 1) without END."""
    lengths = np.diff(begin)
    order = np.argsort(-lengths, kind="stable")
    lengths, begins = lengths[order], begin[:-1][order]
    target = np.append(tokens, v.end)
    out = np.zeros(len(order))
    h = np.zeros((len(order), STATE), f32)
    for t in range(0, int(lengths.max(initial=0)), WINDOW):
        active = int(np.searchsorted(-lengths, -t, side="left"))
        h = h[:active]
        states, targets, docs = [], [], []
        for s in range(t, min(t + WINDOW, int(lengths[0]))):
            now = int(np.searchsorted(-lengths, -s, side="left"))
            if not now:
                break
            at = begins[:now] + s
            new = step(w, tokens[at], h[:now])[0]
            h[:now] = new
            follow = target[at + 1]
            follow[s == lengths[:now] - 1] = v.end
            states.append(new)
            targets.append(follow)
            docs.append(np.arange(now))
        logs, _ = log_likelihood(w, v, np.concatenate(states), np.concatenate(targets))
        out[:active] += np.bincount(np.concatenate(docs), weights=logs, minlength=active)
    scores = np.empty(len(out))
    scores[order] = out / np.log(10)
    head = tokens < v.size
    log_counts = np.where(head, np.log10(v.counts + 1.0)[np.minimum(tokens, v.size - 1)], 0.0)
    log_counts[begin[:-1]] = 0
    norm = np.where(head, 0.0, v.tail_norm[np.maximum(tokens - v.size, 0)])
    sums = np.concatenate([[0.0], np.cumsum(log_counts)]), np.concatenate([[0.0], np.cumsum(norm)])
    heads, norms = (s[begin[1:]] - s[begin[:-1]] for s in sums)
    return scores - norms, heads


def _score(model):
    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = model.value
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys = pa.concat_arrays([k for k, *_ in held])
                tokens = np.concatenate([t for _, t, _ in held])
                sizes = np.concatenate([np.diff(b) for *_, b in held])
                scores, heads = score_documents(w, v, tokens, np.concatenate([[0], np.cumsum(sizes)]))
                held.clear()
                yield pa.RecordBatch.from_arrays([keys, pa.array(sizes), pa.array(scores), pa.array(heads)], ["key", "n_tokens", "net", "heads"])

        for batch in batches:
            for piece in chunks(batch):
                held.append((piece.column("key"), *_streams(piece, v)))
                if sum(len(t) for _, t, _ in held) > 4 * SEGMENT:
                    yield from flush()
        yield from flush()

    return score


def score(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    docs: doc_id, text and the boolean held_out, whose rows teach nothing (null
    counts as false). Words are lower-cased in A-Z; each text ends with one more
    token, also a null or empty one. base_score is the add-one unigram
    log10 probability, score the model's; without any training row both know no
    word. Rows may repeat; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    parts = width_for(docs, 16)
    pairs = rows.select("key", (~F.col("held_out")).alias("train"), "text").mapInArrow(
        _pairs(parts), "part int, chunk long, pairs long, keys binary, train binary, docs binary, times binary, hashes binary"
    )
    counted = staged(pairs.groupBy("part").applyInArrow(lambda part: _count(part, parts), _COUNTS), "counts")
    ends = rows.where(~F.col("held_out")).count()
    total = counted.where(f"kind = {TOTAL}").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    n, distinct = int(total["s"] or 0) + ends, (total["n"] or 0) + (ends > 0)
    head = [(r["key"], r["s"]) for r in counted.where(f"kind = {TOKEN}").orderBy(F.desc("s"), "key").limit(HEAD - 1).collect()]
    classes = {r["key"]: (r["s"], r["n"]) for r in counted.where(f"kind = {CLASS}").groupBy("key").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    tokens, types = (np.array([classes.get(i, (0, 0))[j] for i in range(TAILS)], float) for j in range(2))
    v = Vocabulary(head, ends, tokens, types)
    w = initial(v)
    rounds = max(ROUNDS, math.isqrt(n // REPLICA))
    replicas = max(1, n // (rounds * REPLICA))
    taught = rows.where(~F.col("held_out")).select("text", "key", F.pmod(F.xxhash64("key"), F.lit(rounds)).alias("round"))
    # Sorted, so that a round reads its own pages only.
    taught = staged(taught.sortWithinPartitions("round"), "taught")
    for r in range(rounds):
        model = spark.sparkContext.broadcast((v, w))
        some = taught.where(F.col("round") == r).select("text", "key").repartition(replicas)
        sums = summed(some.select("text").mapInArrow(_train(model), SCHEMA))
        if "" in sums:
            w = {k: (sums[k] / sums[""][0]).reshape(x.shape).astype(f32) for k, x in w.items()}
    model = spark.sparkContext.broadcast((v, w))
    scored = staged(rows.select("key", "text").mapInArrow(_score(model), "key long, n_tokens long, net double, heads double"), "scored")
    scored = scored.groupBy("key").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_tokens", "net", "heads")))
    sent = counted.where(f"kind = {CHUNK}").groupBy("key").applyInArrow(_by_document, "key long, s double, known long")
    sums = sent.groupBy("key").agg(F.sum("s").alias("s"), F.sum("known").alias("known"))
    known = scored.join(sums, "key", "left").select(
        "key", "n_tokens", "net", "heads", (F.coalesce("s", F.lit(0.0)) / F.col("copies")).alias("logs"), (F.coalesce("known", F.lit(0)) / F.col("copies")).cast("long").alias("known"),
    )
    end = float(np.log10(ends + 1.0))
    base = F.col("logs") + end - F.col("n_tokens") * float(np.log10(n + distinct + 1.0))
    return rows.select("doc_id", "held_out", "key").join(known, "key").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("net") + F.col("logs") - F.col("heads")).alias("score"),
    )
