"""Packing of token sequences: Martello-Toth reduction, then best fit.

A packing depends on the pieces' lengths alone, and there are at most `capacity`
of those. The driver packs the histogram of lengths, whatever the corpus' size:
the reduction fixes sets that dominate every other use of an item, with their
multiplicity, and best fit decreasing packs what remains. The plan says which
ranks of a length go to which sequences; every piece finds its place by its rank
among the pieces of its length. Ranks come from counts per task, so no task ever
holds all pieces of a common length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import arrow_rows, lean, staged

CAPACITY = 2048
END = 0
CACHED_BYTES = 128 << 20
_ENTRY = 160  # of two short byte strings in a dict
_STOP = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \n]|\Z)")

Pattern = tuple[tuple[int, int], ...]


class WordIds:
    """Token ids of byte words by a tokenizer that never joins across ASCII white space."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def learn(self, texts: list[list[bytes]]) -> None:
        if self.size > CACHED_BYTES:
            self.forget()
        new = list(set().union(*texts).difference(self.known))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        self.known.update((w, array("I", e.ids).tobytes()) for w, e in zip(new, found, strict=True))
        self.size += sum(_ENTRY + len(w) + len(self.known[w]) for w in new)

    def forget(self) -> None:
        self.known.clear()
        self.size = 0


def words_of(text: bytes) -> list[bytes]:
    """White-space words in a form that has the same ids but repeats more often.

    The tokenizer lower-cases after composing, so ASCII letters may be lowered
    first unless a combining mark could tell them apart; special tokens are
    written in lower case. A single stop after a letter or digit is a token.
    """
    if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
        text = text.lower()
    return _STOP.sub(rb" \1", text).split()


@lru_cache(maxsize=4)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    last = array("I", [end]).tobytes()
    size = 4 * capacity

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = _word_ids(path), uuid4().int >> 65
        ranks: Counter[int] = Counter()
        for batch in batches:
            texts = [words_of(t) if t else [] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            tokenizer.learn(texts)
            known = tokenizer.known
            rows = []
            for doc_id, words in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = b"".join([known[w] for w in words]) + last
                for piece, at in enumerate(range(0, len(ids), size)):
                    own = ids[at : at + size]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), task, ranks[n], own if with_ids else None))
                    ranks[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank", "ids"],
            )

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The token pieces of each document: its ids and the end id, cut every `capacity` ids.

    A null text is empty: one piece that is the end id. Every row is a document,
    also if doc_id is null or repeats.
    """
    arrow_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _cut(tokenizer_path, capacity, end, with_ids),
        "doc_id long, piece int, start long, length long, ids_crc32 long, task long, local_rank long, ids binary",
    )


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets that dominate all others holding their largest item, with multiplicities, and the items left.

    For an item j let k be how many of the smallest others fit beside it. None:
    j stands alone. The largest fitting item j* fills the rest exactly, or k is
    1: {j, j*}. k is 2: {j, j*} if j* is no smaller than the best pair, and the
    best pair if j* is in it and no other pair of items can do as well.
    """
    left = {w: n for w, n in counts.items() if n}
    sizes = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def fix(*items: int) -> None:
        need = Counter(items)
        times = min(left[w] // n for w, n in need.items())
        fixed.append((tuple(need.items()), times))
        for w, n in need.items():
            left[w] -= n * times
            if not left[w]:
                del left[w]
                sizes.remove(w)

    def smallest(skip: int, n: int) -> list[int]:
        out: list[int] = []
        for w in sizes:
            out += [w] * min(left[w] - (w == skip), n - len(out))
            if len(out) == n:
                break
        return out

    for j in sorted(sizes, reverse=True):
        while j in left:
            room = capacity - j
            low = smallest(j, 3)
            k = sum(sum(low[: i + 1]) <= room for i in range(len(low)))
            if k == 0:
                fix(j)
                continue
            at = bisect_left(sizes, room + 1) - 1
            while left[sizes[at]] - (sizes[at] == j) == 0:
                at -= 1
            star = sizes[at]
            if k == 1 or star == room:
                if star == j and left[j] < 2:
                    break
                fix(j, star)
                continue
            if k == 3:
                break
            a = b = best = 0
            lo, hi = 0, at
            while lo <= hi:
                x, y = sizes[lo], sizes[hi]
                if x + y > room:
                    hi -= 1
                    continue
                enough = left[x] - (x == j) >= 1 + (x == y) and left[y] - (y == j) >= 1
                if enough and x + y > best:
                    best, a, b = x + y, y, x
                lo += 1
            if star >= best:
                fix(j, star)
            elif star == a:
                between = [w for w in sizes[bisect_left(sizes, b + 1) : bisect_left(sizes, a)] for _ in range(min(3, left[w] - (w == j)))]
                if len(between) <= 1 or j + between[0] + between[1] > capacity:
                    fix(j, a, b)
                else:
                    break
            else:
                break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over a histogram: equal sequences are kept as one pattern with a multiplicity."""
    groups: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append((pattern, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            room = rooms[at] if at < len(rooms) else capacity
            pattern, times = groups[room].pop() if at < len(rooms) else ((), n)
            if at < len(rooms) and not groups[room]:
                rooms.pop(at)
            each = room // w
            full = min(times, n // each)
            if full:
                put(room - each * w, (*pattern, (w, each)), full)
                n -= full * each
            if pattern and times > full:
                some = n if n < each else 0
                if some:
                    put(room - some * w, (*pattern, (w, some)), 1)
                    n = 0
                if times - full - bool(some):
                    put(room, pattern, times - full - bool(some))
            elif not pattern and 0 < n < each:
                put(capacity - n * w, ((w, n),), 1)
                n = 0
    return [x for some in groups.values() for x in some]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces per sequence, offset), sorted, and the number of sequences."""
    fixed, left = reduce_dominated(counts, capacity)
    rows, used, sequence = [], Counter(), 0
    for pattern, times in fixed + best_fit(left, capacity):
        offset = 0
        for w, n in pattern:
            rows.append((w, used[w], sequence, n, offset))
            used[w] += n * times
            offset += n * w
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _place(rows: np.ndarray, most: int):
    keys = rows[:, 0] * most + rows[:, 1]

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            found = rows[np.searchsorted(keys, length * most + rank, side="right") - 1]
            nth = rank - found[:, 1]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            columns["sequence_id"] = pa.array(found[:, 2] + nth // found[:, 3])
            columns["offset"] = pa.array(found[:, 4] + nth % found[:, 3] * length)
            yield pa.RecordBatch.from_pydict(columns)

    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there, sequences gapless from 0.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids
    (little-endian 32-bit) if with_ids. Other columns of docs are ignored; an
    empty table gives an empty result.
    """
    cut = staged(pieces(docs, tokenizer_path, capacity, end, with_ids), "pieces")
    counts = cut.groupBy("task", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows, _ = plan(histogram, capacity)
    most = max(histogram.values(), default=0) + 1
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = cut.join(bases, ["task", "length"]).select(*columns, (F.col("base") + F.col("local_rank")).alias("rank"))
    schema = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(_place(rows, most), f"{schema}, sequence_id long, offset long")
