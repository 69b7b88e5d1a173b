"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums one count vector per language over all training texts; the matrix
of log probabilities (65,536 buckets x languages) is broadcast in blocks of
languages, and texts are scored by gathering the rows of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.arraysum import SCHEMA, summed, to_blocks
from lintel.llm.common import arrow_rows, carried, lean
from lintel.llm.textkernel import U, chunks

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
LANGUAGES = 128
UNDETERMINED = "und"


def grams(texts: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, grouped by text, and where each text's begin."""
    lowered = [t.lower() for t in texts]
    n = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    doc = np.repeat(np.arange(len(n)), n)
    found, owner = [], []
    for order in orders:
        size = len(points) - order + 1
        if size <= 0:
            continue
        h = np.full(size, U(order))
        for j in range(order):
            h = (h + points[j : j + size]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        inside = doc[:size] == doc[order - 1 :]
        found.append((h >> U(20))[inside] & U(buckets - 1))
        owner.append(doc[:size][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64)
    owner = np.concatenate(owner)
    order_by = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order_by].astype(np.int64), np.searchsorted(owner[order_by], np.arange(len(n) + 1))


def _count(orders, buckets):
    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in chunks(batch):
                langs = piece.column("lang").to_pylist()
                at, begins = grams(piece.column("text").to_pylist(), orders, buckets)
                owner = np.array(langs, object)
                rows = np.repeat(np.arange(len(langs)), np.diff(begins))
                for lang in dict.fromkeys(langs):
                    x = totals.setdefault(lang, np.zeros(buckets + 1))
                    x[:buckets] += np.bincount(at[(owner == lang)[rows]], minlength=buckets)
                    x[buckets] += langs.count(lang)
        yield to_blocks(totals)

    return count


class Block:
    """Some languages' log probabilities, and the mean and deviation of a gram's in a language's own texts."""

    def __init__(self, languages: list[str], n: np.ndarray, texts: float, smoothing: float) -> None:
        self.languages = languages
        self.prior = np.log(n[:, -1] / texts)
        p = n[:, :-1] + smoothing
        p /= p.sum(axis=1, keepdims=True)
        logs = np.log(p)
        # Over the grams that the language's texts have, not over those that smoothing lends it.
        seen = n[:, :-1] / np.maximum(n[:, :-1].sum(axis=1, keepdims=True), 1)
        self.mean = (seen * logs).sum(axis=1)
        self.deviation = np.sqrt(np.maximum((seen * logs * logs).sum(axis=1) - self.mean**2, 1e-6))
        self.logs = np.ascontiguousarray(logs.T.astype(np.float32))


class Model:
    """Blocks of at most `LANGUAGES` languages: each is broadcast by itself, so its size is bounded."""

    def __init__(self, counts: dict[str, np.ndarray], orders=ORDERS, smoothing: float = 0.5) -> None:
        self.languages, self.orders = sorted(counts), orders
        texts = sum(x[-1] for x in counts.values())
        parts = [self.languages[i : i + LANGUAGES] for i in range(0, len(self.languages), LANGUAGES)]
        self.blocks = [Block(some, np.stack([counts[x] for x in some]), texts, smoothing) for some in parts]


def fit(docs: DataFrame, orders: tuple[int, ...] = ORDERS) -> Model:
    """Learn from text and lang of docs; rows where either is null teach nothing, rows that repeat teach again."""
    arrow_rows(docs.sparkSession)
    train = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return Model(summed(train.mapInArrow(_count(orders, BUCKETS), SCHEMA)), orders)


_RESULTS = ("lang_pred", "score", "likeness")
_STATE = "best string, top double, mass double, likeness double"


def _scan(block, orders: tuple[int, ...], others: list[str]):
    """The best language so far, its score, and the sum of all languages' probabilities relative to it."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            for piece in chunks(batch):
                n = len(piece)
                at, begins = grams([t or "" for t in piece.column("text").to_pylist()], orders, BUCKETS)
                rows = np.repeat(np.arange(n), np.diff(begins))
                sums = np.stack([np.bincount(rows, weights=b.logs[at, k], minlength=n) for k in range(len(b.languages))], axis=1)
                scores = sums + b.prior
                own = scores.argmax(axis=1)
                top = scores[np.arange(n), own]
                mass = np.exp(scores - top[:, None]).sum(axis=1)
                likeness = (sums[np.arange(n), own] / np.maximum(np.diff(begins), 1) - b.mean[own]) / b.deviation[own]
                best = np.array(b.languages, object)[own]
                if "top" in piece.schema.names:
                    top_before, mass_before, like_before = (piece.column(c).to_numpy() for c in ("top", "mass", "likeness"))
                    best_before = np.array(piece.column("best").to_pylist(), object)
                    higher = top > top_before
                    most = np.maximum(top, top_before)
                    mass = mass * np.exp(top - most) + mass_before * np.exp(top_before - most)
                    best, likeness, top = np.where(higher, best, best_before), np.where(higher, likeness, like_before), most
                columns = {c: piece.column(c) for c in (*others, "text")}
                yield pa.RecordBatch.from_pydict(columns | {
                    "best": pa.array(best, pa.string()), "top": pa.array(top), "mass": pa.array(mass), "likeness": pa.array(likeness)
                })

    return scan


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, a learned language, score, its posterior, and likeness: by how many of a gram's
    deviations the text's mean log probability differs from that of the language's own texts.

    lang_pred is und with score 0 and likeness null if the text is null or has no
    letter, or if nothing was learned. Only the text decides: rows that repeat get
    the same. An empty table gives an empty result. Columns of docs named like the
    results are replaced; other names can't clash.
    """
    arrow_rows(docs.sparkSession)
    there, back = carried(docs, _RESULTS)
    fields = [f.dataType.simpleString() for f in docs.schema.fields if f.name not in _RESULTS]
    others = [f"c{i}" for i in range(len(fields))]
    schema = ", ".join([*(f"{c} {t}" for c, t in zip(others, fields, strict=True)), "text string", _STATE])
    found = docs.select(*there, "text")
    for block in model.blocks:
        found = found.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), model.orders, others), schema)
    if not model.blocks:
        found = found.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _STATE.split(", "))))
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.col("best").isNotNull()
    return found.select(
        *back, F.when(known, F.col("best")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, 1 / F.col("mass")).otherwise(0.0).alias("score"), F.when(known, F.col("likeness")).alias("likeness"),
    )
