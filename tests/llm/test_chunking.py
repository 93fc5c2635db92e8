import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from terrafold.llm import chunking as ch
from terrafold.llm import tokenizers as tk


def joined(text, pieces):
    raw = text.encode("utf-8", "surrogatepass")
    return b"".join(raw[a + o : b] for a, b, o, _ in pieces) == raw


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab \n🙂é"), max_size=600), st.integers(54, 120), st.integers(0, 19))
def test_pieces_fit_overlap_and_join_to_the_text(text, limit, overlap):
    pieces = ch.split_text(text, [5, 50, 10_000, -1], limit=limit, overlap=overlap)
    raw = text.encode()
    assert joined(text, pieces)
    for i, (a, b, o, _) in enumerate(pieces):
        raw[a:b].decode()
        assert b - a <= limit and (o == 0 if i == 0 else overlap - 3 <= o <= overlap)


def lines(n, seed=1):
    r = random.Random(seed)
    return "".join(" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(100)) for _ in range(r.randrange(3, 12))) + ("\n\n" if r.random() < 0.1 else "\n") for _ in range(n))


def test_an_edit_alters_only_pieces_near_it():
    text = lines(4000)
    raw = text.encode()
    at = len(text) // 2
    other = text[:at] + "inserted words " + text[at:]
    a = {raw[p + o : q] for p, q, o, _ in ch.split_text(text, [], limit=8192, overlap=200)}
    b = {other.encode()[p + o : q] for p, q, o, _ in ch.split_text(other, [], limit=8192, overlap=200)}
    assert len(a) > 20 and len(a ^ b) <= 6


def test_cells_before_paragraphs_before_lines():
    text = lines(150)
    cell = text.index("\n", 3000)
    pieces = ch.split_text(text, [cell], limit=4000, overlap=100)
    assert pieces[0][1] == cell + 1 and pieces[0][3] == "cell"
    assert {k for *_, k in ch.split_text(lines(3000), [], limit=4096, overlap=0)} <= {"paragraph", "line", ""}
    blob = ch.split_text("x" * 30_000, [], limit=8192, overlap=10)
    assert {k for *_, k in blob} <= {"limit", "landmark", ""}


SCHEMA = "doc_id long, text string, cells array<struct<cell_no:int,cell_type:string,exec_count:int,char_start:int,char_len:int>>, piece_no int, limit string"


def test_documents_and_cells_over_the_limit(spark):
    big, wide = "a\n" * 5000, "é" * 4097
    df = spark.createDataFrame(
        [(1, big, [(1, "code", None, 0, 100), (2, "code", None, 100, 9000), None, (3, "code", None, None, 5)], 1, ""), (2, "x" * 8192, [(1, "code", None, 0, 8192)], 1, ""), (3, wide, None, 1, ""), (4, None, None, 1, ""), (5, "", [], 1, ""), (6, "🙂" * 2049, [(1, "code", 1, 0, 99_999), (2, "code", 1, 2040, 9)], 1, ""), (1, big, [], 1, "")],
        SCHEMA,
    )
    assert rows(ch.oversized_items(df)) == [(1, 0), (1, 0), (1, 2), (3, 0), (6, 0), (6, 1)]
    p = ch.oversized_pieces(df.where("doc_id = 3")).orderBy("piece_no").collect()
    assert "".join(r.text.encode()[r.n_overlap :].decode() for r in p) == wide and all(r.n_bytes <= 8192 for r in p)
    assert ch.oversized_pieces(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.exists(tk.vocabulary()), reason="no vocabulary file")
def test_limit_in_tokens_of_a_vocabulary():
    text = lines(400) + "🙂" * 300
    pieces = ch.split_text(text, [], limit=256, overlap=16, tokenizer=tk.vocabulary())
    assert joined(text, pieces) and len(pieces) > 5
    assert all(tk.count_tokens(tk.vocabulary(), text.encode()[a:b].decode()) <= 256 for a, b, _, _ in pieces)


@pytest.mark.skipif(not os.path.exists(tk.vocabulary()), reason="no vocabulary file")
def test_with_a_vocabulary_an_edit_alters_only_pieces_near_it():
    text = lines(3000)
    blob = "".join(random.Random(4).choice("abcdef0123456789+/") for _ in range(9000))
    at = text.index("\n", len(text) // 2) + 1
    base, other = text[:at] + blob + text[at:], text[:at] + "inserted words " + blob + text[at:]
    got = [{t.encode()[p + o : q] for p, q, o, _ in ch.split_text(t, [], limit=1024, overlap=64, tokenizer=tk.vocabulary())} for t in (base, other)]
    assert len(got[0]) > 25 and len(got[0] ^ got[1]) <= 8
    for t in (base, other):
        pieces = ch.split_text(t, [], limit=1024, overlap=64, tokenizer=tk.vocabulary())
        assert joined(t, pieces) and all(tk.count_tokens(tk.vocabulary(), t.encode()[a:b].decode()) <= 1024 for a, b, _, _ in pieces)


def test_limits_without_room_are_refused():
    with pytest.raises(ValueError):
        ch.split_text("a" * 99, [], limit=40, overlap=13)
    pieces = ch.split_text("🙂" * 99, [], limit=16, overlap=0)
    assert joined("🙂" * 99, pieces) and all(b - a <= 16 for a, b, _, _ in pieces)
