from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import merkle as mk
from lectern.llm.catalog import op6_fingerprints

SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n!é", max_size=600))
def test_leaves_cover_the_text_and_the_string_round_trips(text):
    tree = mk.build(text)
    assert sum(mk._weight(s) for s in tree.sections) == len(text)
    again = mk.parse(str(tree))
    assert str(again) == str(tree) and mk.likeness(tree, again) == 1.0 and mk.edits(tree, again) == []


def test_an_edit_is_located_and_leaves_the_rest_alike():
    lines = [f"This is sentence number {i} of the text. It is followed by another one, {i * 7}." for i in range(60)]
    text = "\n".join(lines)
    edited = text.replace("sentence number 30", "sentence numero 30")
    a, b = mk.build(text), mk.build(edited)
    (start, end), = mk.edits(a, b)
    assert start <= text.index("sentence number 30") < end and end - start < 200
    assert 0.9 < mk.likeness(a, b) < 1 and a.root != b.root
    assert mk.likeness(a, mk.build("entirely other words")) == 0.0


def leaves_of(tree):
    return [leaf for _, paragraphs in tree.sections for _, leaves in paragraphs for leaf in leaves]


def test_long_texts_share_nothing_by_chance():
    """Two texts of a hundred thousand different leaves each: alike in the one line they share, by whole digests."""
    same = "The one line that both of these texts hold.\n"
    a, b = (mk.build("".join(f"{side} line {i} of a long text\n" for i in range(100_000)) + same) for side in ("left", "right"))
    n = [sum(size for _, size in leaves_of(t)) for t in (a, b)]
    assert len(leaves_of(a)) > 100_000 and mk.likeness(a, b) == 2 * len(same) / sum(n)
    assert sum(end - start for start, end in mk.edits(a, b)) == n[0] - len(same)
    again = mk.parse(str(a))
    assert again.digits > mk.SHORT and abs(mk.likeness(again, mk.parse(str(b))) - mk.likeness(a, b)) < 1e-4


def test_an_insertion_in_a_line_without_stops_moves_few_leaves():
    import random

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(3000)]
    plain = " ".join(words)
    assert mk.likeness(mk.build(plain), mk.build("x" + plain)) > 0.97
    assert mk.likeness(mk.build(plain), mk.build(plain[:7000] + "more " + plain[7000:])) > 0.97


def check(rows, texts):
    """texts: [(doc_id, text)] in order."""
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for k, (doc, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        trees = mk.build(text), mk.build(edited), mk.build(after)
        assert (r.fingerprint, r.edited_fingerprint) == (str(trees[0]), str(trees[1]))
        assert (r.near_edited, r.near_next) == (mk.likeness(trees[0], trees[1]), mk.likeness(trees[0], trees[2]))


def test_query_equals_brute_force(spark, sf):
    texts = sorted(((r.doc_id, r.text) for r in sf("documents").collect()), reverse=True)
    rows = op6_fingerprints(spark, SF).collect()
    check(rows, texts)
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert all((prints[a] == prints[b]) == (s == t) for a, s in texts for b, t in texts)
    assert sum(r.near_edited for r in rows) / len(rows) > 0.35


def test_edges(docs_of):
    texts = [(9, "x" * 70_000), (7, ""), (5, "𝒳é\n"), (1, "a. b")]
    check(mk.fingerprint_documents(docs_of(texts)).collect(), texts)
    check(mk.fingerprint_documents(docs_of([(3, "only")])).collect(), [(3, "only")])
    assert mk.fingerprint_documents(docs_of([])).count() == 0
    odd = mk.fingerprint_documents(docs_of([(1, None), (1, "same"), (1, "same"), (None, "z")])).collect()
    assert sorted(r.n_chars for r in odd) == [0, 1, 4, 4] and max(r.near_next for r in odd) == 1.0
