"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated.

Statistics of whole texts are standardised; cosines of random projections
approximate a Gaussian kernel over them. The normal equations are summed over
partitions, so the driver solves one system of a fixed size. An isotonic map,
fitted on a histogram of the training scores, turns scores to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.arraysum import SCHEMA, summed, to_blocks
from lintel.llm.common import arrow_rows, lean, staged
from lintel.llm.textkernel import U, Words, chunks, runs

FEATURES = 256
WIDTH = 2.5
RIDGE = 1e-3
BINS = 2000
NAMES = (
    "log_words", "word_length", "symbols", "exclaims", "upper", "digits", "dup_lines", "repeat_words",
    "distinct", "echo", "line_length", "stops", "non_ascii", "entropy", "white",
)


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return x / np.maximum(n, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES per text, by array operations over the whole batch."""
    w = Words(texts)
    n_docs = len(w.n_words)
    data, offsets = w.data, w.offsets
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n_docs), np.diff(offsets))

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n_docs).astype(float)

    kind = np.zeros(256, np.uint8)
    for code, chars in enumerate((b"#*$%&|<>", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:"), 1):
        kind[list(chars)] = code
    of = kind[data]
    symbols, exclaims, upper, digits, stops = (count(of == code) for code in range(1, 6))
    n = w.n_words.astype(float)
    doc = w.doc_of()
    hashes = w.hashes()
    lengths = np.bincount(doc, weights=w.ends - w.starts, minlength=n_docs)
    # Equal lines: hashes of lines as runs between line ends.
    line_begin = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    line_begin = line_begin[line_begin < len(data)]
    line_of_word = np.searchsorted(line_begin, w.starts, side="right") - 1
    powers = np.cumsum(hashes)
    first = np.flatnonzero(np.concatenate([[True], line_of_word[1:] != line_of_word[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(hashes))
    step = (np.arange(len(hashes)) - np.repeat(first, last - first)).astype(U) * U(2) + U(1)
    powers = np.concatenate([np.zeros(1, U), np.cumsum(hashes * step)])
    lines, line_doc = powers[last] - powers[first], doc[first]
    n_lines = np.bincount(line_doc, minlength=n_docs).astype(float)

    def distinct(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, d))
        x, d = x[order], d[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])]) if len(x) else np.zeros(0, bool)
        return np.bincount(d[new], minlength=n_docs).astype(float)

    thirds, at = runs(hashes, doc, 3)
    n_thirds = np.bincount(doc[at], minlength=n_docs).astype(float)
    echo = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n_docs) if len(hashes) else np.zeros(n_docs)
    cells = np.bincount(owner * 256 + data, minlength=256 * n_docs).reshape(n_docs, 256) if len(data) else np.zeros((n_docs, 256))
    p = cells / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)
    letters = np.maximum(lengths, 1)
    return np.stack([
        np.log1p(n), _share(lengths, n), np.sqrt(symbols / letters), np.sqrt(exclaims / letters), upper / letters, np.sqrt(digits / letters),
        _share(n_lines - distinct(lines, line_doc), n_lines), _share(n_thirds - distinct(thirds, doc[at]), n_thirds),
        _share(distinct(hashes, doc), n), _share(echo, n), np.log1p(_share(size, n_lines)), np.sqrt(_share(stops, n)), count(data > 127) / letters, entropy, _share(size - lengths, size),
    ], axis=1)


@lean
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in chunks(batch, most=1 << 20):
            x = statistics(piece.column("text")).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "x": lists})


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Features:
    """Random Fourier features of standardised statistics; the seed makes them the same everywhere."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int = FEATURES, width: float = WIDTH, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.n = mean, np.where(scale > 1e-9, scale, 1.0), n
        self.w, self.b = rng.normal(size=(len(mean), n)) / width, rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / self.n) * np.cos(z @ self.w + self.b)])


def isotonic(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing shares nearest to ones / total; bins without rows take their neighbours'."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total):
        blocks.append([i, ones[i], total[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, one, n = blocks.pop()
            blocks[-1][1] += one
            blocks[-1][2] += n
    if not blocks:
        return np.full(len(total), 0.5)
    begins = np.array([b[0] for b in blocks])
    shares = np.array([b[1] / b[2] for b in blocks])
    return shares[np.maximum(np.searchsorted(begins, np.arange(len(total)), side="right") - 1, 0)]


class Model:
    def __init__(self, features: Features, weights: np.ndarray, map_: np.ndarray) -> None:
        self.features, self.weights, self.map = features, weights, map_

    def bins(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights
        return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.map[self.bins(x)]


def _equations(features):
    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = features.value
        a, b = np.zeros((f.n + 1, f.n + 1)), np.zeros(f.n + 1)
        for batch in batches:
            if len(batch):
                z = f(_matrix(batch.column("x")))
                a += z.T @ z
                b += z.T @ batch.column("y").to_numpy().astype(float)
        yield to_blocks({"a": a, "b": b})

    return add


def _histogram(model):
    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ones, total = model.value, np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if len(batch):
                at = m.bins(_matrix(batch.column("x")))
                total += np.bincount(at, minlength=BINS)
                ones += np.bincount(at, weights=batch.column("y").to_numpy().astype(float), minlength=BINS)
        yield to_blocks({"ones": ones, "total": total})

    return add


def _score(model):
    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(_matrix(batch.column("x"))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s)})

    return score


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text; a null text is empty."""
    arrow_rows(docs.sparkSession)
    return staged(docs.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, x array<double>"), "statistics")


def fit(statistics_: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from labelled rows (doc_id, label 0 or 1); null labels teach nothing. Without any, all scores are 0.5."""
    spark = statistics_.sparkSession
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("y")).dropDuplicates(["doc_id"])
    train = statistics_.join(known, "doc_id").select("x", "y")
    n = len(NAMES)
    seen = train.agg(*(f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(n) for f in (F.avg, F.stddev_pop))).first()
    features = Features(*(np.array([seen[f"{f}{i}"] or 0.0 for i in range(n)]) for f in ("avg", "stddev_pop")))
    shared = spark.sparkContext.broadcast(features)
    sums = summed(train.mapInArrow(_equations(shared), SCHEMA))
    size = features.n + 1
    a = sums.get("a", np.zeros(size * size)).reshape(size, size)
    weights = np.linalg.solve(a + RIDGE * max(a[0, 0], 1.0) * np.eye(size) / size, sums.get("b", np.zeros(size)))
    model = Model(features, weights, np.full(BINS, 0.5))
    bins = summed(train.mapInArrow(_histogram(spark.sparkContext.broadcast(model)), SCHEMA))
    model.map = isotonic(bins.get("ones", np.zeros(BINS)), bins.get("total", np.zeros(BINS)))
    return model


def score(statistics_: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of statistics_."""
    shared = statistics_.sparkSession.sparkContext.broadcast(model)
    return statistics_.mapInArrow(_score(shared), "doc_id long, score double")
