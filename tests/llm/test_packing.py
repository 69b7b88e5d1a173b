import math
import random
from collections import Counter

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lintel.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            at = rooms.index(room)
            rooms[at] -= items[i]
            place(i + 1, rooms)
            rooms[at] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_keeps_the_optimum(case):
    capacity, items = case
    fixed, left = packing.reduce_dominated(dict(Counter(items)), capacity)
    rest = [w for w, n in left.items() for _ in range(n)]
    assert sum(t for _, t in fixed) + optimum(rest, capacity) == optimum(items, capacity)


def test_plan_places_everything_once():
    rng = random.Random(1)
    counts = dict(Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000)))
    packed = Counter()
    fixed, left = packing.reduce_dominated(counts, 2048)
    for pattern, times in fixed + packing.best_fit(left, 2048):
        assert sum(w * n for w, n in pattern) <= 2048
        packed.update({w: n * times for w, n in pattern})
    assert packed == Counter(counts)
    _, n = packing.plan(counts)
    assert n <= 1.002 * math.ceil(sum(w * c for w, c in counts.items()) / 2048)


def test_pack(spark, docs):
    texts = ["a b c", None, "", "word " * 5000, "J̌ A. b.. <|endoftext|> don't", "日本語 x", "a b c"]
    rows = packing.pack(docs([*texts, (None, "no id")]), PATH, with_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts):
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = b"".join(bytes(r["ids"]) for r in pieces)
        expected = whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == expected
        assert [r["start"] for r in pieces] == list(range(0, len(expected), 2048))
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    end = {}
    for sequence, offset, length in places:
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
    assert max(end.values()) <= 2048 and len(end) == math.ceil(sum(r["length"] for r in rows) / 2048)
    assert packing.pack(docs([]), PATH).count() == 0
