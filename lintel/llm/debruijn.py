"""Removal of word passages that repeat across documents, on a de Bruijn graph.

Every window of k words is an edge from its first k - 1 words to its last k - 1.
An edge belongs to its owner, the smallest doc_id whose text holds it, at the
owner's first place. Following one owner the graph does not branch, as a text is
a line: edges that stand side by side in a document and side by side in their
owner compact into one path. Paths are distinct (owner, place, length, digest)
rows; a Spark join brings each to its owner's text, where the words at those
source coordinates must give the same digest. Only then are the words covered by
the path removed.

The edges travel in blobs dealt by hash, so a passage that every document holds
costs one entry a document and no pair of documents is ever formed. Should edges
of different words share a hash, the check fails for the later one; then all
windows are dealt again by other hashes, and what either finds counts.

Paths compact per document, in numpy, not by joins over a table of nodes: the
nodes of all repeated windows as rows would cost more shuffled bytes than the
texts have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import arrow_rows, carried, frees_stages, lean, staged
from lintel.llm.textkernel import U, Words, chunks, runs

K = 13
CHUNK = 4 << 20
PART_BYTES = 8 << 20
LOW = 64  # parts are a multiple; the edge's six low bits are its part's


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, byte by byte over all numbers: the empty high bytes then compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :n].T).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :n] = rows.T
    return out.reshape(-1).view(np.uint64)


def _edges(k: int, parts: int, seed: int, mask: int, only=None):
    """Per chunk of documents and part: the edges' hashes, their places and the chunk's documents."""

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, most=CHUNK):
                words = Words(piece.column("text"))
                docs = words.doc_of()
                hashes = words.hashes()
                edges, at = runs(hashes, docs, k, seed)
                if only is not None:
                    some = np.isin(runs(hashes, docs, k)[0] & U(mask), only.value)
                    edges, at = edges[some], at[some]
                else:
                    edges &= U(mask)
                if not len(edges):
                    continue
                part = (edges % U(parts)).astype(np.uint32)
                order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                edges, at = edges[order] >> U(6), at[order].astype(np.uint32)
                ids = np.asarray(piece.column("doc_id").to_numpy(), np.int64)
                ids = _planes(np.diff(ids, prepend=0), 8) + np.asarray(piece.column("text_hash").to_numpy(), np.int64).tobytes()
                sizes = _planes(words.n_words.astype(np.uint32), 4)
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(some, pa.int32()),
                    "ids": pa.array([ids] * len(some), pa.binary()),
                    "sizes": pa.array([sizes] * len(some), pa.binary()),
                    "places": pa.array([_planes(np.diff(at[cuts[p] : cuts[p + 1]], prepend=np.uint32(0)), 4) for p in some], pa.binary()),
                    "edges": pa.array([_planes(edges[cuts[p] : cuts[p + 1]], 7) for p in some], pa.binary()),
                })

    return deal


_REPEATS = "doc_id long, text_hash long, repeats binary"


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[0] = True
    return np.flatnonzero(new)


def _owners(table: pa.Table) -> pa.Table:
    """The occurrences of a part's edges in documents with another doc_id than the owner."""
    edges, docs, places, ids, hashes = [], [], [], [], []
    base = 0
    for row in table.select(["ids", "sizes", "places", "edges"]).to_batches(max_chunksize=64):
        for names, sizes, at, found in zip(*(c.to_pylist() for c in row.columns), strict=True):
            ends = np.cumsum(_numbers(sizes, 4).astype(np.int64))
            at = np.cumsum(_numbers(at, 4).astype(np.int64))
            doc = np.searchsorted(ends, at, side="right")
            begins = np.concatenate([[0], ends])
            edges.append(_numbers(found, 7))
            docs.append((doc + base).astype(np.int32))
            places.append((at - begins[doc]).astype(np.int32))
            ids.append(np.cumsum(_numbers(names[: 8 * len(ends)], 8).view(np.int64)))
            hashes.append(np.frombuffer(names, np.int64, len(ends), 8 * len(ends)))
            base += len(ends)
    edges, docs, places, ids, hashes = map(np.concatenate, (edges, docs, places, ids, hashes))
    order = np.argsort(edges)
    edges, docs, places = edges[order], docs[order], places[order]
    first = _first_of(edges)
    size = np.diff(np.append(first, len(edges)))
    many = np.repeat(size > 1, size)
    edges, docs, places = edges[many], docs[many], places[many]
    group = np.cumsum(np.concatenate([[True], edges[1:] != edges[:-1]])) - 1 if len(edges) else np.zeros(0, np.int64)
    order = np.lexsort((places, hashes[docs], ids[docs], group))
    docs, places, group = docs[order], places[order], group[order]
    begin = _first_of(group)[group] if len(group) else group
    owner, owner_place = docs[begin], places[begin]
    other = ids[docs] != ids[owner]
    docs, places, owner, owner_place = docs[other], places[other], owner[other], owner_place[other]
    order = np.lexsort((places, owner, docs))
    docs, places, owner, owner_place = docs[order], places[order], owner[order], owner_place[order]
    first = _first_of(docs, owner)
    cuts = np.append(first, len(docs))
    blobs = []
    row = _first_of(docs[first])
    for a, b in zip(row, np.append(row, len(first))[1:], strict=True):
        own, n = owner[first[a:b]], np.diff(cuts[a : b + 1]).astype(np.int32)
        span = slice(cuts[a], cuts[b])
        blobs.append(b"".join(x.tobytes() for x in (np.int32([b - a]), ids[own], hashes[own], n, places[span], owner_place[span])))
    rows = docs[first[row]]
    return pa.table({"doc_id": ids[rows], "text_hash": hashes[rows], "repeats": pa.array(blobs, pa.binary())})


def _parts(docs: DataFrame) -> int:
    """A multiple of LOW, by the planner's estimate of the documents' size: what a part holds stays as it is."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return LOW * max(1, min(size, 1 << 50) // (LOW * PART_BYTES))


def repeated_edges(docs: DataFrame, k: int = K, seed: int = 1, mask: int = 2**64 - 1, only=None) -> DataFrame:
    """(doc_id, text_hash, repeats): the windows of docs (doc_id, text_hash, text) that an earlier document holds too, a row for each document and part.

    repeats holds the number of owners, their ids and hashes (64 bits), how many
    windows each has (32 bits), and the windows' places and owners' places (32 bits).
    """
    parts = _parts(docs)
    dealt = docs.mapInArrow(_edges(k, parts, seed, mask, only), "part int, ids binary, sizes binary, places binary, edges binary")
    return dealt.groupBy("part").applyInArrow(_owners, _REPEATS)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners' ids and hashes, places and owners' places of each window."""
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    ids, hashes = np.frombuffer(raw, np.int64, n, 4), np.frombuffer(raw, np.int64, n, 4 + 8 * n)
    each = np.frombuffer(raw, np.int32, n, 4 + 16 * n)
    total, begin = int(each.sum()), 4 + 20 * n
    places = np.frombuffer(raw, np.int32, total, begin)
    return np.repeat(ids, each), np.repeat(hashes, each), places, np.frombuffer(raw, np.int32, total, begin + 4 * total)


def _spans(place: np.ndarray, owner: np.ndarray, owner_hash: np.ndarray, owner_place: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Maximal runs (start, edges, owner, its hash, its start) that go on in the document and in the owner."""
    # Equal rows name each place twice.
    place, order = np.unique(place, return_index=True)
    owner, owner_hash, owner_place = owner[order], owner_hash[order], owner_place[order]
    cut = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1]) | (owner_hash[1:] != owner_hash[:-1]) | (owner_place[1:] != owner_place[:-1] + 1)])
    first = np.flatnonzero(cut)
    n = np.diff(np.append(first, len(place)))
    return list(zip(*(x.tolist() for x in (place[first], n, owner[first], owner_hash[first], owner_place[first])), strict=True))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


_PATHS = "doc_id long, text_hash long, start int, edges int, owner long, owner_hash long, owner_start int, digest binary"
_PATH_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
_KEY = ["owner", "owner_hash", "owner_start", "edges", "digest"]


def _paths(k: int):
    """The spans of each document with the digest of the words they cover."""

    @lean
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text_hash, text, r in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), batch.column("repeats"), strict=True):
                owner, owner_hash, place, owner_place = (np.concatenate(x) for x in zip(*map(_unpacked, r.as_py()), strict=True))
                words = text.as_buffer().to_pybytes().split()
                for start, n, *at in _spans(place, owner, owner_hash, owner_place):
                    out.append((doc_id, text_hash, start, n, *at, _digest(words[start : start + n + k - 1])))
            columns = zip(*out, strict=True) if out else [[]] * len(_PATH_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _PATH_TYPES, strict=True)], [c.split()[0] for c in _PATHS.split(", ")])

    return walk


def _verify(k: int):
    """Of the paths asked for at an owner, those whose words stand at the source coordinates."""

    @lean
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for owner, owner_hash, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "asked")), strict=True):
                words = text.encode().split()
                out += [
                    (owner, owner_hash, a["owner_start"], a["edges"], a["digest"]) for a in asked
                    if _digest(words[a["owner_start"] : a["owner_start"] + a["edges"] + k - 1]) == a["digest"]
                ]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], _KEY)

    return look


def repeated_spans(docs: DataFrame, k: int = K, seed: int = 1, mask: int = 2**64 - 1, only=None) -> DataFrame:
    """Spans (doc_id, text_hash, start, edges, owner, owner_hash, owner_start, digest): by their hashes, the words start .. start + edges + k - 2 repeat the owner's."""
    # Written first, so that the shuffled windows are gone before the texts are shuffled.
    found = staged(repeated_edges(docs, k, seed, mask, only), "repeats")
    repeats = found.groupBy("doc_id", "text_hash").agg(F.collect_list("repeats").alias("repeats"))
    return docs.join(repeats, ["doc_id", "text_hash"]).mapInArrow(_paths(k), _PATHS)


def verified(docs: DataFrame, spans: DataFrame, k: int = K) -> DataFrame:
    """The keys of the spans whose words the owner has at the coordinates they name."""
    named = [c for c in _KEY if c not in ("owner", "owner_hash")]
    # A path that many documents hold counts once: partial sums first, no task sees all its rows.
    asked = spans.groupBy(*_KEY).count().groupBy(F.col("owner").alias("doc_id"), F.col("owner_hash").alias("text_hash")).agg(F.collect_list(F.struct(*named)).alias("asked"))
    return docs.join(asked, ["doc_id", "text_hash"]).mapInArrow(_verify(k), "owner long, owner_hash long, owner_start int, edges int, digest binary").distinct()


RETRIED = 1 << 20


def _window_hashes(k: int, mask: int):
    """First hashes of the windows of the spans (start, edges) of each text."""

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece in (batch.slice(i, 1) for i in range(len(batch))):
                words = Words(piece.column("text"))
                hashes, _ = runs(words.hashes(), words.doc_of(), k)
                out += [hashes[s["start"] : s["start"] + s["edges"]] & U(mask) for s in piece.column("failed")[0].as_py()]
            yield pa.RecordBatch.from_pydict({"hash": pa.array(np.unique(np.concatenate(out)).view(np.int64)) if out else pa.array([], pa.int64())})

    return find


@frees_stages
def _spans_by_document(docs: DataFrame, k: int, mask: int) -> DataFrame:
    """(doc_id, text_hash, spans) of verified spans (start, edges).

    Where a path fails, windows with different words share a hash: all windows of
    such hashes are dealt again by other ones. Up to `RETRIED` hashes are told to
    the tasks; with more, every window is dealt again.
    """
    row = ["doc_id", "text_hash"]
    spans = staged(repeated_spans(docs, k, 1, mask), "spans")
    good = staged(verified(docs, spans, k), "verified")
    found = spans.join(good, _KEY, "left_semi").select(*row, "start", "edges")
    failed = staged(spans.join(good, _KEY, "left_anti").groupBy(*row).agg(F.collect_list(F.struct("start", "edges")).alias("failed")), "failed")
    if not failed.isEmpty():
        hashes = staged(docs.join(failed, row).mapInArrow(_window_hashes(k, mask), "hash long").distinct(), "hashes")
        only = None
        if hashes.count() <= RETRIED:
            only = docs.sparkSession.sparkContext.broadcast(np.array([r["hash"] for r in hashes.collect()], np.int64).view(np.uint64))
        again = staged(repeated_spans(docs, k, 77, mask if only else 2**64 - 1, only), "spans_again")
        good = staged(verified(docs, again, k), "verified_again")
        found = found.union(again.join(good, _KEY, "left_semi").select(*row, "start", "edges"))
    return found.groupBy(*row).agg(F.collect_list(F.struct("start", "edges")).alias("spans"))


_KEPT = "n_words long, n_removed long, kept_text string, kept_sha256 string"


def _kept(k: int, with_text: bool, others: list[str]):
    @lean
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts, digests = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n, kept = len(words), words
                if spans:
                    keep = np.ones(n, bool)
                    for s in spans:
                        keep[s["start"] : s["start"] + s["edges"] + k - 1] = False
                    kept = list(compress(words, keep.tolist()))
                joined = b" ".join(kept)
                n_words.append(n)
                n_removed.append(n - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append((joined.decode() if n > len(kept) else text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts if with_text else [None] * len(n_words), pa.string()), pa.array(digests, pa.string())],
                [*others, "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return remove


def remove_repeats(docs: DataFrame, k: int = K, with_text: bool = True, mask: int = 2**64 - 1) -> DataFrame:
    """docs' columns but text, with n_words, n_removed, kept_text and kept_sha256.

    A window is k consecutive words of one document; each word covered by a
    window that also starts in a document with a smaller doc_id goes. Windows are
    judged on the input. kept_text is the untouched text where nothing goes, else
    the kept words joined by one space. Null texts have no words and stay null;
    a row without doc_id neither owns nor loses a window. Rows that share a doc_id
    are documents of their own, none of which comes before the other; an empty
    table gives an empty result. Columns of docs that are named like a result are
    replaced by it; other names can't clash. mask is for tests: it leaves of the
    windows' first hashes only some bits.
    """
    arrow_rows(docs.sparkSession)
    text_hash = F.xxhash64("text").alias("text_hash")
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", text_hash, "text")
    spans = _spans_by_document(known, k, mask)
    results = ("n_words", "n_removed", "kept_text", "kept_sha256")
    there, back = carried(docs, ("text", *results))
    joined = docs.select(*there, "doc_id", text_hash, "text").join(spans, ["doc_id", "text_hash"], "left").drop("doc_id", "text_hash")
    schema = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(f for f in docs.schema.fields if f.name not in ("text", *results)))
    kept = joined.mapInArrow(_kept(k, with_text, [f"c{i}" for i in range(len(back))]), f"{schema}{_KEPT}")
    return kept.select(*back, *results)
