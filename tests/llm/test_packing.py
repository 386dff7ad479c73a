from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import packing as pk
from lectern.llm.catalog import op2_packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DIRECT = Tokenizer.from_file(PATH)
WORDS = pk.WordIds(PATH)


def ids_of(text):
    return [*DIRECT.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZéÀß×ªµ'sS19.,!<|>Σςİıé \u0085\x1c \t\n你"), st.characters(codec="utf-8")), max_size=40))
def test_words_give_the_ids_of_the_whole_text(text):
    assert WORDS(text) == array("I", DIRECT.encode(text, add_special_tokens=False).ids).tobytes()


def test_special_tokens_and_contractions():
    for text in ("<|endoftext|>", "a<|startoftext|>b", "I'll can't 'S it's", "<|", "x" * 300):
        assert WORDS(text) == array("I", DIRECT.encode(text, add_special_tokens=False).ids).tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=300), st.integers(1, 40))
def test_differencing_deals_every_size_to_a_window_in_range(sizes, windows):
    dealt = pk.differencing(sizes, windows)
    assert len(dealt) == len(sizes) and all(0 <= w < windows for w in dealt)


def test_differencing_balances_and_the_count_rises_with_the_capacity():
    assert sorted(sum(s for s, w in zip([8, 7, 6, 5, 4], pk.differencing([8, 7, 6, 5, 4], 2)) if w == k) for k in (0, 1)) == [14, 16]
    dealt, count = pk.pack([6, 6, 6], 10)
    assert count == 3 and sorted(dealt) == [0, 1, 2]
    assert pk.pack([], 10) == ([], 0)


def check(rows, texts):
    """Pieces against the ids themselves: each id in exactly one piece, sequences gapless and within the capacity."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = ids_of(texts[doc]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(array("I", ids[at : at + p.length]).tobytes())
            at += p.length
        assert at == len(ids)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= pk.CAPACITY
    return sum(len(ids_of(t)) for t in texts.values()) / (pk.CAPACITY * len(by_seq))


def test_query_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in sf("documents").collect()}
    assert check(op2_packing(spark, SF).collect(), texts) > 0.95


def test_edges(docs_of):
    texts = {1: None, 2: "", 3: "hello " * 5000, 4: "x", None: "no id"}
    docs = docs_of(list(texts.items()))
    check(pk.pack_documents(docs, PATH, grain=100).collect(), texts)
    assert pk.pack_documents(docs_of([]), PATH).count() == 0
    twice = pk.pack_documents(docs_of([(1, "a b"), (1, "a b")]), PATH, keep_ids=True).collect()
    assert [r.ids for r in twice] == [ids_of("a b")] * 2
