"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its runs of five words, weighted by how often they
occur. Darts fall as a Poisson process on (element, weight, rank); those inside
an element's weight and below a rank that suits the document's total weight are
hits. Each dart belongs to one coordinate; the earliest hit of each coordinate is
the signature, and two documents agree in a coordinate with a probability equal
to their weighted Jaccard similarity. The plane is cut in regions of doubling
size, so only regions that the document touches are thrown.

Bands of coordinates are joined in graph.classes_of, where a group of near copies
costs a multiple of its size. Every link is verified on whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import arrow_rows, blobs, carried, frees_stages, lean, staged
from lintel.llm.graph import bit_map_pairs, bit_maps, buckets, classes_of
from lintel.llm.textkernel import U, Words, chunks, mix, runs

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
BASE_RANK = 1 / 16


def elements(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of its distinct word runs; a text of fewer than k words is one run."""
    hashes, docs = words.hashes(), words.doc_of()
    found, at = runs(hashes, docs, k)
    doc = docs[at]
    n = words.n_words
    for size in range(1, k):
        some = np.flatnonzero(n == size)
        if len(some):
            first = words.ptr[some]
            short = sum(hashes[first + j] * U(pow(BASE_SHORT, j + 1, 1 << 64)) for j in range(size))
            found, doc = np.concatenate([found, mix(short + U(size))]), np.concatenate([doc, some])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]) if len(found) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return doc[first], found[first], np.diff(np.append(first, len(found)))


BASE_SHORT = 0xC2B2AE3D27D4EB4F


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Distribution function of the number of darts in a region."""
    most = int(mean + 12 * mean**0.5 + 24)
    logs = np.arange(most) * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(np.arange(1, most)))])
    return np.cumsum(np.exp(logs))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _throw(doc, element, weight, limit, k):
    """Hits (document x k + coordinate, rank, dart) below each document's rank limit."""
    hits = []
    low, high, level = 0.0, 1.0, 0
    while len(doc):
        rank_low, rank_high, step = 0.0, BASE_RANK, 0
        d, e, w, t = doc, element, weight, limit[doc]
        while len(d):
            seed = mix(e ^ U((level * 64 + step + 1) * 0x9FB21C651E98DF25 % (1 << 64)))
            cdf = _poisson((high - low) * (rank_high - rank_low))
            u = _unit(seed)
            some = np.flatnonzero(u > cdf[0])
            n = np.searchsorted(cdf, u[some])
            at = np.repeat(some, n)
            if len(at):
                j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(seed[at] + (j + 1).astype(U) * U(0xD6E8FEB86659FD93))
                inside = low + _unit(mix(dart ^ U(0x1B03738712FAD5C9))) * (high - low) < w[at]
                rank = rank_low + _unit(mix(dart ^ U(0x5851F42D4C957F2D))) * (rank_high - rank_low)
                ok = np.flatnonzero(inside & (rank < t[at]))
                dart = dart[ok]
                hits.append((d[at[ok]] * k + (mix(dart) % U(k)).astype(np.int64), rank[ok], dart))
            rank_low, rank_high, step = rank_high, 2 * rank_high, step + 1
            more = t > rank_low
            d, e, w, t = d[more], e[more], w[more], t[more]
        low, high, level = high, 2 * high, level + 1
        more = weight > low
        doc, element, weight = doc[more], element[more], weight[more]
    return [np.concatenate(x) for x in zip(*hits, strict=True)] if hits else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U)]


def signatures(doc, element, weight, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """n_docs x k earliest darts, and which documents have any element."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    out = np.zeros((n_docs, k), U)
    filled = np.zeros((n_docs, k), bool)
    darts = k * np.log(k) + 2 * k
    todo = total > 0
    while todo.any():
        limit = np.where(todo, darts / np.maximum(total, 1), 0)
        mine = todo[doc]
        cell, rank, dart = _throw(doc[mine], element[mine], weight[mine], limit, k)
        order = np.lexsort((dart, rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        out.reshape(-1)[cell[first]] = dart[first]
        filled.reshape(-1)[cell[first]] = True
        todo &= ~filled.all(axis=1)
        darts *= 2
    return out, total > 0


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), U)
    for b in range(bands):
        for r in range(rows):
            keys[:, b] = mix(keys[:, b] + signature[:, b * rows + r] + U(b * rows + r + 1))
    return keys


def _sketch(k: int, bands: int, rows: int):
    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                words = Words(piece.column("text"))
                doc, found, count = elements(words, k)
                signature, any_ = signatures(doc, found, count, len(piece), bands * rows)
                keys = bands_of(signature, bands, rows)
                digest = [hashlib.blake2b(b" ".join(words.text(i).split()), digest_size=16).digest() for i in range(len(piece))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "text_hash": piece.column("text_hash"), "digest": pa.array(digest, pa.binary()),
                    "keys": blobs(keys, np.arange(len(piece) + 1) * bands),
                }).filter(pa.array(any_))

    return sketch


def _sets(k: int):
    @lean
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                doc, found, count = elements(Words(piece.column("text")), k)
                cuts = np.searchsorted(doc, np.arange(len(piece) + 1))
                # An element for each time that a run counts.
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                every = mix(np.repeat(found, count) + nth.astype(U))
                n = np.bincount(doc, weights=count, minlength=len(piece)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "id": piece.column("id"), "items": blobs(found, cuts), "counts": blobs(count.astype(np.uint32), cuts),
                    "n": pa.array(n.astype(np.int32)), "bits": pa.array(bit_maps(np.repeat(doc, count), every, n), pa.binary()),
                })

    return collect


def weighted_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.minimum(x[i], y[j]).sum(dtype=np.int64)
    return both / (x.sum(dtype=np.int64) + y.sum(dtype=np.int64) - both)


def _similar(threshold: float):
    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, x, b, y in zip(*(batch.column(c) for c in ("items_a", "counts_a", "items_b", "counts_b")), strict=True):
                a, x, b, y = (np.frombuffer(v.as_buffer(), t) for v, t in ((a, U), (x, np.uint32), (b, U), (y, np.uint32)))
                ok.append(weighted_jaccard(a, x, b, y) >= threshold)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("a", "b")}).filter(pa.array(ok, pa.bool_()))

    return check


def verifier(
    docs: DataFrame, texts: DataFrame, k: int, threshold: float
) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """A function that keeps the pairs (a, b) of ids whose weighted Jaccard similarity reaches the threshold,
    and one that gives the sizes and bit maps of ids. texts (id, doc_id, text_hash) says where in docs the text of an id
    stands. The sets of the first call's ids serve the later calls."""
    held: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        if not held:
            ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            # The wanted rows grow with the input, so they are never broadcast.
            wanted = texts.select("id", "doc_id", "text_hash").join(ids.hint("merge"), "id").hint("merge")
            found = docs.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["id"]) if _repeat(docs) else docs.join(wanted, ["doc_id", "text_hash"])
            held.append(staged(found.select("id", "text").mapInArrow(_sets(k), "id long, items binary, counts binary, n int, bits binary"), "sets"))
        for side in "ab":
            sets = held[0].select(F.col("id").alias(side), F.col("items").alias(f"items_{side}"), F.col("counts").alias(f"counts_{side}"))
            pairs = pairs.join(sets, side)
        return pairs.mapInArrow(_similar(threshold), "a long, b long")

    def bits(ids: DataFrame) -> DataFrame:
        return held[0].select("id", "n", "bits").join(ids, "id")

    return verify, bits


def _repeat(docs: DataFrame) -> bool:
    """Whether some rows share doc_id and text."""
    return not docs.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()


@frees_stages
def _classes(docs: DataFrame, k: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, class_id, keeper) of the rows (doc_id, text_hash, text) with words: the least
    (doc_id, text_hash) of the class is its keeper."""
    schema = "doc_id long, text_hash long, digest binary, keys binary"
    sketch = staged(docs.mapInArrow(_sketch(k, bands, rows), schema), "sketch")
    row = F.struct("doc_id", "text_hash")
    texts = sketch.groupBy("digest").agg(F.min(row).alias("first"), F.first("keys").alias("keys"))
    texts = staged(texts.select("digest", "first.*", "keys").withColumn("id", F.monotonically_increasing_id()), "texts")
    verify, bits = verifier(docs, texts, k, threshold)
    found = classes_of(staged(buckets(texts.select("id", "keys")), "shared"), verify, bit_map_pairs(bits, threshold))
    classes = texts.join(found, texts["id"] == found["node"], "left").withColumn("component", F.coalesce("component", "id"))
    classes = staged(classes.select("digest", "component", row.alias("first")), "classes")
    firsts = classes.groupBy("component").agg(F.min("first").alias("keeper"))
    classes = classes.join(firsts, "component").select("digest", "keeper")
    united = sketch.select("doc_id", "text_hash", "digest").distinct().join(classes, "digest")
    return united.select("doc_id", "text_hash", F.col("keeper.doc_id").alias("class_id"), (row == F.col("keeper")).alias("keeper"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with class_id and kept: the classes of linked documents and the one kept of each.

    Linked are texts of equal words, and candidate texts whose runs of k words,
    counted, have a weighted Jaccard similarity of at least threshold; a text of
    fewer words is one run. class_id is the smallest doc_id of the class, kept
    tells its row. Texts that are null or without words link with nothing, nor do
    rows without doc_id (their class_id is null and they are kept). Rows that share
    a doc_id but not the text are documents of their own, of which the one with
    the smaller hash counts as the smaller; rows that share both count as one and
    stay or go together. An empty table gives an empty result. Columns of docs
    named like a result are replaced.
    """
    arrow_rows(docs.sparkSession)
    there, back = carried(docs, ("class_id", "kept"))
    text_hash = F.xxhash64("text").alias("text_hash")
    held = docs.select(*there, "doc_id", text_hash, F.col("text").isNotNull().alias("any"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", text_hash, "text")
    classes = _classes(known, k, threshold, bands, rows).withColumn("any", F.lit(True))
    return held.join(classes, ["doc_id", "text_hash", "any"], "left").select(
        *back, F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("keeper", F.lit(True)).alias("kept")
    )
