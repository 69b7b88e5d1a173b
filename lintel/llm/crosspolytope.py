"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the nearest of the signed axes, a key is `depth` of them.
Vectors are held, and look, under the keys of their next nearest axes too
(multiprobe on both sides), so few copies of a vector travel. Deeper keys, for
larger tables of vectors, take more of them; see `keys_for`.

The vectors travel rounded to 16 bits a component, with a bound of the error: it
decides nearly all pairs of a bucket, and those it leaves in doubt are compared
in double precision on the vectors themselves. Every link counts once, in the
least key that both vectors have. Buckets send back counts of links and a
spanning star, never their pairs. Equal vectors are one vector with a
multiplicity; a bucket larger than a block is dealt to block pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import arrow_rows, blobs, flat, frees_stages, lean, staged, width
from lintel.llm.graph import components
from lintel.llm.textkernel import U, mix

COSINE = 0.95
BLOCK = 8192
SQUARE = 1024
BITS = 32767
#: Of sums of products of single precision numbers, beside the error of rounding.
SLACK = 1e-5


def keys_for(n: int, size: int) -> tuple[int, int, int]:
    """Depth, tables and choices of an axis for n vectors in `size` dimensions, so that a bucket holds some thousand.

    A table has choices ** depth keys of a vector. The chance that vectors at
    cosine 0.95 in 64 dimensions meet is 0.998 at depth 1, 0.999 at depth 2 and
    0.998 at depth 3.
    """
    for depth in range(1, 8):
        tables, choices = (1, 4) if depth == 1 else (2, 3)
        if n * choices**depth <= BLOCK // 2 * (2 * size) ** depth:
            break
    return depth, tables, choices


@lru_cache(maxsize=8)
def _signs(tables: int, depth: int, size: int) -> np.ndarray:
    return np.random.default_rng(20).choice([-1.0, 1.0], size=(tables, depth, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def hashes(x: np.ndarray, tables: int, depth: int, choices: int) -> np.ndarray:
    """Keys (rows, tables * choices ** depth), ascending."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - d)))
    choices = min(choices, size)
    out = []
    for t, signs in enumerate(_signs(tables, depth, size)):
        axes = []
        for rounds in signs:
            r = x
            for s in rounds:
                r = hadamard(r * s)
            near = np.argpartition(-np.abs(r), choices - 1, axis=1)[:, :choices]
            axes.append((2 * near + (np.take_along_axis(r, near, 1) < 0)).astype(U))
        for some in product(range(choices), repeat=depth):
            key = np.full(n, U(t * 4096 + d % 4096))
            for k, a in zip(some, axes, strict=True):
                key = mix(key * U(0x9E3779B97F4A7C15) + a[:, k] + U(1))
            out.append(key)
    return np.sort(np.stack(out, axis=1).view(np.int64), axis=1)


def _units(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length and their vectors scaled to length 1, without rows that hold nothing to compare."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    some = column.is_valid().to_numpy(zero_copy_only=False) & (n > 0)
    for d in np.unique(n[some]):
        rows = np.flatnonzero(some & (n == d))
        x = values[offsets[rows][:, None] + np.arange(d)]
        top = np.abs(x).max(axis=1)
        ok = np.isfinite(x).all(axis=1) & (top > 0)
        rows, x, top = rows[ok], x[ok], top[ok]
        x = x / top[:, None]
        yield rows, x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0


_ROUNDED = "vec_id long, digest binary, step double, rounded binary"


def _round(exact: bool):
    """Digest of each row's vector, null if it has none, and its components rounded, or the vector itself."""

    @lean
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            digests, steps, data = [None] * n, np.zeros(n), [None] * n
            for rows, x in _units(batch.column("embedding")):
                step = np.abs(x).max(axis=1) / BITS
                q = np.rint(x / step[:, None]).astype(np.int16)
                steps[rows] = step
                for i, unit, rounded in zip(rows.tolist(), x, q, strict=True):
                    digests[i] = hashlib.blake2b(unit.tobytes(), digest_size=16).digest()
                    data[i] = unit.tobytes() if exact else rounded.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(steps), pa.array(data, pa.binary())], ["vec_id", "digest", "step", "rounded"]
            )

    return convert


def _keyed(tables: int, depth: int, choices: int, whole: bool):
    """A row for each key of each vector: (key), or with all that a bucket needs."""

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = flat(batch.column("rounded"), np.int16)
            begins = np.cumsum(n) - n
            for d in np.unique(n):
                rows = np.flatnonzero(n == d)
                found = hashes(values[begins[rows][:, None] + np.arange(d)].astype(np.float64), tables, depth, choices)
                # Distinct keys only.
                new = np.concatenate([np.ones((len(rows), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
                local, at = np.nonzero(new)
                key = pa.array(found[local, at])
                if not whole:
                    yield pa.RecordBatch.from_arrays([key], ["key"])
                    continue
                row = pa.array(rows[local])
                keys = blobs(found.reshape(-1), np.arange(len(rows) + 1) * found.shape[1]).take(pa.array(local))
                yield pa.RecordBatch.from_arrays(
                    [key, *(batch.column(c).take(row) for c in ("id", "copies", "step", "rounded")), keys], ["key", "id", "copies", "step", "rounded", "keys"]
                )

    return deal


_KEYED = "key long, id long, copies long, step double, rounded binary, keys binary"


def _least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that rows of a and b have in common."""
    most = np.int64(2**63 - 1)
    out = np.full(len(a), most)
    for j in range(a.shape[1]):
        same = (b == a[:, j : j + 1]).any(axis=1)
        out = np.where(same, np.minimum(out, a[:, j]), out)
    return out


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[p], root[q])
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
        root = root[root]
        if (root == before).all():
            return root


def _links(cosine: float):
    """Of a group of buckets: counts of links and a star for each linked vector, and the pairs in doubt."""

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("id", "ascending")]).combine_chunks()
        key, ids, copies, steps, side = (group[c].to_numpy() for c in ("key", "id", "copies", "step", "side"))
        crossed = group["i"][0].as_py() != group["j"][0].as_py()
        cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        node, n, star, doubt = [], [], [], []
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            size = end - begin
            if size < 2:
                continue
            rounded, some = flat(group["rounded"].slice(begin, size).combine_chunks(), np.int16)
            keys, each = flat(group["keys"].slice(begin, size).combine_chunks(), np.int64)
            own, copy, part = ids[begin:end], copies[begin:end], side[begin:end]
            x = (rounded.reshape(size, -1) * steps[begin:end, None]).astype(np.float32)
            keys = keys.reshape(size, -1)
            error = steps[begin:end].max() / 2 * math.sqrt(x.shape[1])
            bound = 2 * error + error * error + SLACK
            count, root = np.zeros(size), np.arange(size)
            for i in range(0, size, SQUARE):
                for j in range(i, size, SQUARE):
                    close = x[i : i + SQUARE] @ x[j : j + SQUARE].T
                    p, q = np.nonzero(close >= cosine - bound)
                    near = close[p, q]
                    p, q = p + i, q + j
                    ok = p < q
                    if crossed:
                        ok &= part[p] != part[q]
                    p, q, near = p[ok], q[ok], near[ok]
                    ok = _least_common(keys[p], keys[q]) == key[begin]
                    p, q, near = p[ok], q[ok], near[ok]
                    sure = near >= cosine + bound
                    doubt.append(np.stack([own[p[~sure]], own[q[~sure]]], axis=1))
                    p, q = p[sure], q[sure]
                    if len(p):
                        count += np.bincount(p, weights=copy[q], minlength=size) + np.bincount(q, weights=copy[p], minlength=size)
                        root = _roots(size, np.concatenate([p, np.arange(size)]), np.concatenate([q, root]))
            linked = np.flatnonzero(count)
            node.append(own[linked])
            n.append(count[linked].astype(np.int64))
            star.append(own[root[linked]])
        pairs = np.concatenate(doubt) if doubt else np.zeros((0, 2), np.int64)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({
            "id": np.concatenate([cat(node), pairs[:, 0]]), "n": np.concatenate([cat(n), np.zeros(len(pairs), np.int64)]),
            "other": np.concatenate([cat(star), pairs[:, 1]]), "doubt": np.repeat([False, True], [len(cat(node)), len(pairs)]),
        })

    return link


def _exact(cosine: float):
    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("vector_a", "vector_b"))
            ok = [float(np.frombuffer(x) @ np.frombuffer(y)) >= cosine for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("a", "b", "copies_a", "copies_b")}).filter(pa.array(ok, pa.bool_()))

    return check


def _settled(doubt: DataFrame, apart: DataFrame, known: DataFrame, cosine: float) -> DataFrame:
    """Links (a, b, copies_a, copies_b) among the pairs in doubt, by the vectors in double precision."""
    names = apart.select("id", "digest", "copies")
    wanted = names.join(doubt.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    vectors = known.mapInArrow(_round(exact=True), _ROUNDED).select("digest", F.col("rounded").alias("vector"))
    vectors = vectors.join(wanted, "digest").groupBy("id").agg(F.first("vector").alias("vector"), F.first("copies").alias("copies"))
    vectors = staged(vectors, "vectors")
    pairs = doubt
    for side in "ab":
        pairs = pairs.join(vectors.select(*(F.col(c).alias(f"{c}_{side}" if c != "id" else side) for c in ("id", "vector", "copies"))), side)
    return staged(pairs.mapInArrow(_exact(cosine), "a long, b long, copies_a long, copies_b long"), "settled")


@frees_stages
def _linked(vectors: DataFrame, cosine: float) -> DataFrame:
    spark = vectors.sparkSession
    units = vectors.mapInArrow(_round(exact=False), _ROUNDED)
    known = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    apart = units.where("vec_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest")
    apart = apart.agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("step").alias("step"), F.first("rounded").alias("rounded"))
    apart = staged(apart.withColumn("id", F.monotonically_increasing_id()), "apart")
    n, longest = apart.agg(F.count("*"), F.max(F.octet_length("rounded"))).first()
    depth, tables, choices = keys_for(n, 1 << max(1, ((longest or 4) // 2 - 1).bit_length()))
    sizes = apart.select("rounded").mapInArrow(_keyed(tables, depth, choices, whole=False), "key long").groupBy("key").count()
    hot = staged(sizes.where(f"count > {BLOCK}").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
    dealt = apart.select("id", "copies", "step", "rounded").mapInArrow(_keyed(tables, depth, choices, whole=True), _KEYED).join(hot, "key", "left")
    side = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = dealt.withColumn("side", side).withColumn("to", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    parts = max(width(spark), n * tables * choices**depth // BLOCK)
    part = F.when(F.col("blocks").isNotNull(), F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(parts)))
    dealt = dealt.select(
        "key", "id", "copies", "step", "rounded", "keys", "side", F.col("blocks").isNotNull().alias("large"), part.alias("part"),
        F.least("side", "to").alias("i"), F.greatest("side", "to").alias("j"),
    )
    links = dealt.groupBy("part", "large", "i", "j").applyInArrow(_links(cosine), "id long, n long, other long, doubt boolean")
    links = staged(links, "links")
    doubt = links.where("doubt").select(F.col("id").alias("a"), F.col("other").alias("b"))
    settled = _settled(doubt, apart, known, cosine)
    ends = [settled.select(F.col(x).alias("id"), F.col(f"copies_{y}").alias("n")) for x, y in ("ab", "ba")]
    counts = links.where("NOT doubt").select("id", "n").union(ends[0]).union(ends[1]).groupBy("id").agg(F.sum("n").alias("n"))
    edges = links.where("NOT doubt AND id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")).union(settled.select("a", "b"))
    found = components(edges)
    classes = apart.select("id", "vec_id", "copies", "digest").join(counts, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    classes = staged(classes.withColumn("component", F.coalesce("component", "id")), "classes")
    least = classes.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    classes = classes.join(least, "component").select("digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    rows = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    return rows.join(classes, "digest", "left").select("vec_id", "n_links", "component_id")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Two rows link if their cosine in double precision is at least `cosine` and
    they share a key. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths
    or rows without vec_id (their component_id is null and they are kept).
    n_links counts rows, so equal vectors count each, also those of rows that
    share a vec_id. An empty table gives an empty result. Other columns are ignored.
    """
    arrow_rows(vectors.sparkSession, "2000")
    linked = _linked(vectors.select("vec_id", "embedding"), cosine)
    component = F.coalesce("component_id", "vec_id")
    return linked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
