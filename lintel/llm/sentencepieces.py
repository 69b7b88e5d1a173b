"""SentencePiece encoding of merge-type vocabularies by an agenda of symbol pairs.

A text is a chain of symbols, at first its characters. All adjacent pairs whose
joint piece is in the vocabulary stand in an agenda ordered by score, ties from
the left; the best pair merges and its new neighbours enter, until none is left.
Symbols outside the vocabulary become bytes. Pieces hold the space mark only at
their front, so each run of marks with the characters up to the next mark is
encoded once and remembered. What an Arrow batch adds to the memory is compared
with the library's own encoding before it is used, or else every whole text is.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lintel.llm.common import arrow_rows, lean

MARK = "▁"
CACHED_BYTES = 128 << 20
_ENTRY = 160  # of two short strings in a dict
SHORT = 64  # up to so many characters a list is the faster agenda
_NONE = 1 << 62


class Encoder:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        inside = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in inside):
            raise ValueError("pieces with a space mark after other characters can't be cut at the marks")
        self.lone = "".join(c for c in "\n\r\t" if not any(c in p for p in inside))
        stop = re.escape(self.lone)
        self.cut = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + (f"|[{stop}]" if stop else ""))
        self.known: dict[str, bytes] = {}
        self.size = 0

    def merge(self, chunk: str) -> list[int]:
        """The ids of a chunk, by the agenda."""
        whole = self.ids.get(chunk)
        n = len(chunk)
        if n == 1:
            return [whole] if whole is not None else [self.bytes[b] for b in chunk.encode()]
        return self.spelled(self.short(list(chunk)) if n <= SHORT else self.long(list(chunk)))

    def short(self, symbols: list[str]) -> list[str]:
        """The symbols merged; the agenda is the list of the adjacent pairs' ranks, its first least entry the best pair."""
        get = self.rank.get
        agenda = [get(a + b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == _NONE:
                break
            i = agenda.index(best)
            joint = symbols[i] + symbols.pop(i + 1)
            symbols[i] = joint
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(joint + symbols[i + 1], _NONE)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + joint, _NONE)
        return symbols

    def long(self, symbols: list[str]) -> list[str]:
        """The symbols merged, those that were merged into another empty; the agenda is a heap of (rank, left, right)."""
        rank, n = self.rank, len(symbols)
        shift = n.bit_length()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        mask = (1 << shift) - 1
        agenda = []
        get = rank.get
        for i in range(n - 1):
            r = get(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append((r << shift | i) << shift | (i + 1))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            entry = pop(agenda)
            right, left = entry & mask, entry >> shift & mask
            if after[left] != right or not symbols[left]:
                continue
            joint = symbols[left] + symbols[right]
            if get(joint) != entry >> 2 * shift:
                continue
            symbols[left], symbols[right] = joint, ""
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                r = get(joint + symbols[follow])
                if r is not None:
                    push(agenda, (r << shift | left) << shift | follow)
            ahead = before[left]
            if ahead >= 0:
                r = get(symbols[ahead] + joint)
                if r is not None:
                    push(agenda, (r << shift | ahead) << shift | left)
        return symbols

    def spelled(self, symbols: list[str]) -> list[int]:
        """The symbols' ids; one outside the vocabulary is its bytes."""
        ids, out = self.ids, []
        for s in symbols:
            if s:
                i = ids.get(s)
                if i is None:
                    out += [self.bytes[b] for b in s.encode()]
                else:
                    out.append(i)
        return out

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, texts: list[list[str]], compare: bool = True) -> None:
        """Remember the chunks' ids; compare each with the library's, unless whole texts are compared afterwards."""
        if self.size > CACHED_BYTES:
            self.known.clear()
            self.size = 0
        new = list(set().union(*texts).difference(self.known))
        # One by one: lists that stay would set the garbage collector on the whole memory again and again.
        ids = map(self.merge, new)
        if compare:
            ids = list(ids)
            # A chunk with a mark in front is a text of its own, as the library puts one mark there.
            own = [(c[1:], i) for c, i in zip(new, ids, strict=True) if c[0] == MARK]
            for (text, mine), theirs in zip(own, self.library.encode([t for t, _ in own], num_threads=1), strict=True):
                if text and mine != theirs:
                    raise ValueError(f"the library encodes {text!r} as {theirs}, the agenda as {mine}")
        for c, i in zip(new, ids, strict=True):
            coded = self.known[c] = ",".join(map(str, i)).encode()
            self.size += _ENTRY + 2 * len(c) + len(coded)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, check: bool, with_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts = [e.chunks(t) for t in texts]
            e.learn(parts, compare=not check)
            known = e.known
            joined = [b",".join([known[c] for c in p]) for p in parts]
            ids = [list(map(int, j.split(b","))) if j else [] for j in joined]
            if check and ids != e.library.encode(texts, num_threads=1):
                raise ValueError("the library encodes a document of this batch otherwise")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([hashlib.sha256(j).hexdigest() for j in joined]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in map(e.library.decode, ids)]),
                    pa.array(ids if with_ids else [None] * len(ids), pa.list_(pa.int32())),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    return run


def encode(docs: DataFrame, model_path: str, check: bool = False, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids of every row.

    ids equal the sentencepiece library's without begin and end ids; the decoded
    text is the library's decode(ids). A null text is empty. Rows without doc_id
    and rows that repeat are encoded like any other; an empty table gives an empty
    result. check also compares every whole document of a batch with the library.
    Other columns are ignored.
    """
    arrow_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _encode(model_path, check, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    )
