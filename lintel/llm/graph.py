"""Buckets of equal keys, the links inside them, and connected components as Spark joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import blobs, flat, frees_stages, lean, staged
from lintel.llm.textkernel import U, mix


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hangs its larger (large) or its smaller neighbours on the least node around it."""
    around = _both(edges)
    pairs = around.where("b > a") if large else around.where("b < a")
    least = around if large else pairs
    least = least.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        hung = hung.union(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


@frees_stages
def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in edges (a, b); component is the least node reachable.

    Null ends and loops are ignored. Every round is written to the shared folder,
    so lost executors cost one round; rounds grow with the logarithm of the size.
    """
    now = staged(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        # A star graph, each node on its least, no longer changes.
        now = staged(_stars(_stars(now, large=True), large=False), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# Buckets

ENTRIES = 1 << 19  # of a part, on average; also those a task holds before it deals them


def _dealt(part: np.ndarray, columns: list[np.ndarray], flags: int) -> pa.RecordBatch:
    """Entries as a row for each part, its columns as blobs c0, c1, ..."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    cuts = np.append(first, len(part))
    rows = {"part": pa.array(part[first].astype(np.int64)), "flags": pa.array(np.full(len(first), flags, np.int32))}
    return pa.RecordBatch.from_pydict(rows | {f"c{i}": blobs(c[order], cuts) for i, c in enumerate(columns)})


def _spot(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % U(parts)).astype(np.int64)


CONFIRMED, PLAIN, MANY = range(3)


def _deal(parts: int):
    """Entries (key, id) by part. Keys that a task sees twice are shared for certain: their entries are only
    passed on, spread evenly, and one entry tells the key's part; so a common key fills no part."""

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            k, i = np.concatenate(keys), np.concatenate(ids)
            keys.clear(), ids.clear()
            held = 0
            order = np.argsort(k, kind="stable")
            k, i = k[order], i[order]
            same = k[1:] == k[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            first = shared & ~np.concatenate([[False], same])
            # By task, not at random: a task that is repeated must deal the same.
            spread = np.arange(int(shared.sum()), dtype=np.int64) // 4096 + TaskContext.get().partitionId()
            for part, some, flags in ((parts + spread % parts, shared, CONFIRMED), (_spot(k[~shared], parts), ~shared, PLAIN), (_spot(k[first], parts), first, MANY)):
                if some.any():
                    yield _dealt(part, [k[some], i[some]], flags)

        for batch in batches:
            k, n = flat(batch.column("keys"), np.int64)
            keys.append(k)
            ids.append(np.repeat(batch.column("id").to_numpy(), n))
            held += len(k)
            if held >= ENTRIES:
                yield from flush()
        if held:
            yield from flush()

    return deal


def _gather(table: pa.Table) -> pa.Table:
    """(key, id) of a part's keys that several ids have, and of the entries passed on."""
    keys, ids, flags = [], [], []
    for batch in table.to_batches(max_chunksize=256):
        k, n = flat(batch.column("c0"), np.int64)
        keys.append(k)
        ids.append(flat(batch.column("c1"), np.int64)[0])
        flags.append(np.repeat(batch.column("flags").to_numpy(), n))
    keys, ids, flags = map(np.concatenate, (keys, ids, flags))
    if flags[0] != CONFIRMED:
        order = np.argsort(keys, kind="stable")
        keys, ids, flags = keys[order], ids[order], flags[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(first, len(keys)))
        shared = np.repeat((n > 1) | (np.maximum.reduceat(flags, first) == MANY), n) & (flags == PLAIN)
        keys, ids = keys[shared], ids[shared]
    return pa.table({"key": keys, "id": ids})


def buckets(sketches: DataFrame) -> DataFrame:
    """(key, id) of every key that several rows of sketches (id, keys) have; keys is a blob of distinct 64-bit numbers."""
    entries = sketches.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    parts = max(16, entries // 8 // ENTRIES)
    dealt = sketches.select("id", "keys").mapInArrow(_deal(parts), "part long, flags int, c0 binary, c1 binary")
    return dealt.groupBy("part").applyInArrow(_gather, "key long, id long")


# Bit maps of sets

BITS = 1 << 14


def bit_maps(row: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of sets given as (row, hash) of their elements: a bit map each, of about four bits an element and a power of two."""
    size = np.minimum(1 << np.ceil(np.log2(np.maximum(4 * n, 64))).astype(np.int64), BITS)
    begin = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(begin[-1], bool)
    bits[begin[row] + ((hashes & U(BITS - 1)).astype(np.int64) & (size[row] - 1))] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    """Bit maps as rows of bytes; longer ones fold onto themselves."""
    return np.bitwise_or.reduce(x.reshape(len(x), -1, size), axis=1)


def may_reach(n_a, x: np.ndarray, n_b, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets may reach the Jaccard threshold, by sizes and bit maps as rows of bytes: each bit that
    only one set has is an element that the other lacks."""
    size = min(x.shape[1], y.shape[1])
    x, y = _folded(x, size), _folded(y, size)
    least = threshold / (1 + threshold) * (n_a + n_b) - 1e-9
    only_a, only_b = (np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x)))
    return (n_a - only_a >= least) & (n_b - only_b >= least) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9)


# Links inside buckets

BLOCK = 8192


def _candidates(threshold: float):
    """Pairs of different components in a bucket that may be similar: of the rows outside the bucket's main component with all others."""

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        key, ids, component, main, side, n = (table[c].to_numpy() for c in ("key", "id", "component", "main", "side", "n"))
        bits = table["bits"].to_pylist()
        crossed = table["i"][0].as_py() != table["j"][0].as_py()
        sizes = np.fromiter(map(len, bits), np.int64, len(bits))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        found = []
        for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
            rest = np.flatnonzero(component[a:b] != main[a:b]) + a
            if not len(rest):
                continue
            at = [a + np.flatnonzero(sizes[a:b] == s) for s in np.unique(sizes[a:b])]
            maps = [np.frombuffer(b"".join([bits[i] for i in rows]), np.uint8).reshape(len(rows), -1) for rows in at]
            for r in rest.tolist():
                own = np.frombuffer(bits[r], np.uint8)[None, :]
                for rows, m in zip(at, maps, strict=True):
                    some = (component[rows] != component[r]) & ((component[rows] == main[r]) | (rows > r))
                    if crossed:
                        some &= side[rows] != side[r]
                    some = np.flatnonzero(some)
                    if len(some):
                        ok = may_reach(n[r], own, n[rows[some]], m[some], threshold)
                        others = ids[rows[some[ok]]]
                        found.append(np.stack([np.maximum(others, ids[r]), np.minimum(others, ids[r])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return find


def bit_map_pairs(sketches: Callable[[DataFrame], DataFrame], threshold: float) -> Callable[[DataFrame], DataFrame]:
    """Of rows (key, id, component, main, blocks) the pairs that may be similar, by bit maps sketches(ids) = (id, n, bits)."""

    def near(rows: DataFrame) -> DataFrame:
        parts = max(16, rows.count() // BLOCK)
        part = F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(parts)))
        rows = rows.join(sketches(rows.select("id").distinct()), "id")
        rows = rows.withColumn("side", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(
            "key", "id", "component", "main", "side", "n", "bits", part.alias("part"), (F.col("blocks") > 1).alias("large"),
            F.least("side", "to").alias("i"), F.greatest("side", "to").alias("j"),
        )
        return rows.groupBy("part", "large", "i", "j").applyInArrow(_candidates(threshold), "a long, b long").distinct()

    return near


@frees_stages
def classes_of(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) over the links that verify(pairs) confirms among ids that share a key in shared (key, id).

    Rows of a bucket meet its leader, not each other: the row that meets most
    others over all buckets, which in a group of copies with differing edits is
    the one they come from. Where a bucket holds several components after that,
    near pairs the rows outside its largest one with all others of the bucket that
    may be similar, and those pairs are verified. So no link inside a bucket is missed, and no bucket is paired
    out. pairs and links are (a, b) with a > b; the first pairs name every id that
    a later pair can name.
    """
    sizes = shared.groupBy("key").count()
    ranked = staged(shared.join(sizes, "key"), "ranked")
    met = ranked.groupBy("id").agg(F.sum("count").alias("met"))
    led = ranked.join(met, "id")
    leaders = led.groupBy("key").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("leader"))
    members = staged(ranked.join(leaders, "key"), "members")
    pairs = members.where("id <> leader").select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
    links = staged(verify(staged(pairs, "pairs")), "links")
    found = components(links)
    held = members.where("count > 2").join(found, members["id"] == found["node"], "left")
    held = staged(held.select("key", "id", F.coalesce("component", "id").alias("component")), "held")
    parts_of = held.groupBy("key", "component").count().groupBy("key")
    mixed = parts_of.agg(F.sum("count").alias("m"), F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("n"))
    mixed = mixed.where("n > 1").select("key", "main", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = staged(held.join(mixed, "key"), "mixed")
    if rows.isEmpty():
        return found
    late = staged(verify(staged(near(rows), "late_pairs")), "late")
    # The components found stand for the links they come from.
    return found if late.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late))
