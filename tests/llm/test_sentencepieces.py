import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintel.llm import queries, sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab '▁\n\t.é<|>日 re"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_library(text):
    e = sentencepieces.encoder(PATH)
    chunks = e.chunks(text)
    e.learn([chunks])
    ids = [int(i) for c in chunks for i in e.known[c].split(b",")]
    assert ids == e.library.encode(text)


def test_encode(spark, docs):
    texts = ["", None, "a  b ▁ c\n", "x" * 3000, "<s> 日本"]
    rows = {r["doc_id"]: r for r in sentencepieces.encode(docs(texts), PATH, check=True, with_ids=True).collect()}
    e = sentencepieces.encoder(PATH)
    assert {i: list(r["ids"]) for i, r in rows.items()} == {i: e.library.encode(t or "") for i, t in enumerate(texts)}
    assert sentencepieces.encode(docs([]), PATH).count() == 0


def test_the_query_compares_whole_documents(spark, monkeypatch):
    seen, inner = [], sentencepieces._encode

    def watched(path, check, with_ids):
        seen.append(check)
        return inner(path, check, with_ids)

    monkeypatch.setattr(sentencepieces, "_encode", watched)
    assert queries.op3_sentencepiece(spark, "/root/testdata/sf0.001").count() == 200
    assert seen == [True]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdehilnorst▁.é日"), st.characters(exclude_categories=["Cs"])), min_size=2, max_size=90))
def test_both_agendas_merge_alike(chunk):
    e = sentencepieces.encoder(PATH)
    assert e.short(list(chunk)) == [s for s in e.long(list(chunk)) if s]


def test_a_wrong_id_is_found_with_either_comparison(monkeypatch):
    monkeypatch.setattr(sentencepieces.Encoder, "spelled", lambda self, symbols: [7] * len(symbols))
    for check in (True, False):
        sentencepieces.encoder.cache_clear()
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["unmergeable zzqqxx words"]})
        with pytest.raises(ValueError, match="library"):
            list(sentencepieces._encode(PATH, check, False)(iter([batch])))
    sentencepieces.encoder.cache_clear()
