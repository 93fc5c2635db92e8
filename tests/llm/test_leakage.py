import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from terrafold.llm import leakage as lk

ITEM = "If each band costs 777 credits and the flooded delta needs twenty, derive the budget for cocoa that the analyst Smith must file before noon."


def frame(spark, texts, key="doc_id"):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], f"{key} long, text string, key string, pos int")


def test_exact_partial_template_and_nothing(spark):
    words = lk.words_of(ITEM)
    texts = [
        (1, "intro\n" + ITEM.upper() + " outro"),
        (2, "--- ".join(words[3:15])),
        (3, " ".join(words[3:14])),
        (4, ITEM.replace("777", "12").replace("twenty", "ninety")),
        (5, ITEM.replace("777", "twenty")),
        (6, ""),
        (7, None),
        (8, "word " * 50_000 + ITEM),
        (8, ITEM),
        (None, ITEM),
    ]
    items = frame(spark, [(10, ITEM), (11, "too short to leak"), (12, None), (13, ITEM), (14, "")], "item_id")
    got = {(r.doc_id, r.item_id): r.kind for r in lk.leaks(frame(spark, texts), items).collect()}
    assert got == {(d, i): k for d, k in ((1, "exact"), (2, "exact"), (4, "exact"), (5, "exact"), (8, "exact")) for i in (10, 13)}
    numbers = "Choose 5 of 7 plots and 9 of 11 fields then give 13 as the total of all 15 parts you saw"
    swapped = numbers.replace("5 of 7", "6 of 8").replace("9 of 11", "10 of 12").replace("13", "14").replace("15", "16")
    clash = numbers.replace("5 of 7", "7 of 7").replace("9 of 11", "9 of 7").replace("13", "7").replace("15", "7")
    got = rows(lk.leaks(frame(spark, [(1, swapped), (2, clash), (3, numbers)]), frame(spark, [(1, numbers)], "item_id")), "doc_id", "kind")
    assert got == [(1, "template"), (3, "exact")]


def test_hot_windows_and_empty_tables(spark):
    texts = frame(spark, [(1, ITEM), (2, "a b c")])
    items = frame(spark, [(1, ITEM), (2, ITEM[10:])], "item_id")
    want = rows(lk.leaks(texts, items))
    assert len(want) == 2
    many = frame(spark, [(i, ITEM) for i in range(9)])
    assert len(rows(lk.leaks(many, items, rows_per_salt=2))) == 18
    again = frame(spark, [(1, (ITEM + " ") * 30)])
    assert rows(lk.leaks(again, items, rows_per_salt=2)) == rows(lk.leaks(again, items))
    assert lk.leaks(texts.limit(0), items).collect() == [] == lk.leaks(texts, items.limit(0)).collect()


def test_windows_of_mere_numbers_need_equal_words(spark):
    a, b = " ".join(str(i) for i in range(14)), " ".join(str(i) for i in range(100, 114))
    got = rows(lk.leaks(frame(spark, [(1, a), (2, b)]), frame(spark, [(1, a)], "item_id")), "doc_id", "kind")
    assert got == [(1, "exact")]


def test_words_of_any_script():
    assert lk.words_of("Größe_42 日本語-Ελλάδα") == ["größe", "42", "日本語", "ελλάδα"]
    for text in ("The Delta of ann", "ΑΣ'ΒΓ ΣΑΣ İstanbul Ab", "straẞe ǅ ŒUVRE 5KM"):
        words, capital = lk.cased_words(text)
        assert [w.lower() for w in words] == lk.words_of(text) and (capital is None or len(capital) == len(words))
    assert lk.cased_words("Σ Ann of")[1].tolist() == [True, True, False]


def plain_keys(words, template, kind):
    """Ends and contents of all windows, word by word."""
    out = {}
    for i in range(len(words)):
        seen, literals = [], 0
        for j in range(i, len(words)):
            unit = j > i and kind[j - 1] == 2 and kind[j] != 2
            literals += kind[j] == 1 and not unit
            seen.append("unit" if unit else int(template[j]))
            if len(seen) >= lk.WINDOW and literals >= lk.LITERALS:
                out[i] = (j + 1, tuple(seen))
                break
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["5", "seven", "km", "Ann", "a", "b", "c", "d", "The"]), min_size=12, max_size=70), st.sampled_from([16, 1 << 16]))
def test_windows_are_those_of_a_walk_word_by_word(texts, chunk):
    literals = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in ("km", "a", "b", "c", "d", "the")], np.uint64))
    words = [w.lower() for w in texts]
    exact, template, kind, _ = lk.Templates(literals).hashes(words)
    before, lk._CHUNK = lk._CHUNK, chunk
    try:
        got = list(lk.text_keys(exact, template, kind, np.zeros(len(words), bool), 40, lk.Powers()))
    finally:
        lk._CHUNK = before
    want = {i: e for i, e in plain_keys(words, template, kind).items() if e[0] - i <= 40}
    starts = {int(a): (int(b), int(k)) for s, e, keys in got[0::2] for a, b, k in zip(s, e, keys)}
    assert {i: e for i, (e, _) in starts.items()} == {i: e for i, (e, _) in want.items()}
    for i in want:
        for j in want:
            assert (want[i][1] == want[j][1]) == (starts[i][1] == starts[j][1])
    few = {int(a) for s, _, _ in got[1::2] for a in s}
    assert few == {i for i in range(len(words) - 11) if i not in plain_keys(words, template, kind) or plain_keys(words, template, kind)[i][0] != i + 12}


def test_table_holds_all_its_keys(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    table = lk.key_table(spark.createDataFrame([(int(k),) for k in keys], "key long"), 5000)
    assert len(lk.table_hits(table, keys.view(np.uint64))) == 5000
    others = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 20_000).view(np.uint64)
    assert len(lk.table_hits(table, others)) < 200


def test_questions_with_many_slots_and_names_that_are_words_elsewhere(spark):
    slots = "Give 5 km 7 kg 9 m 11 s 13 ha to plot 15 then take 17 cm from the 19 pixels by hand at once"
    swapped = re.sub(r"\d+", lambda m: str(int(m[0]) + 40), slots)
    rose = "Three rows of beans beside the old mill Rose planted before the rain began at home"
    items = frame(spark, [(1, slots), (2, rose), (3, "the rose grew by the wall")], "item_id")
    texts = [(1, swapped), (2, rose.replace("Rose", "May")), (3, rose.replace("Rose", "grew")), (4, slots.upper()), (5, " ".join(slots.split()[1:13]))]
    got = rows(lk.leaks(frame(spark, texts), items), "doc_id", "item_id", "kind")
    assert got == [(1, 1, "template"), (2, 2, "template"), (4, 1, "exact"), (5, 1, "exact")]


def test_names_and_measures_the_documents_alone_have(spark):
    item = "The analyst Smith counts flooded rows at 10m before the gate and Smith then files them at 10m beside the dark cocoa mill of Smith"
    new = item.replace("Smith", "Jones")
    texts = [
        (1, new),
        (2, new.lower().replace("10m", "20m")),
        (3, item.replace("10m", "20m")),
        (4, new.replace("Jones then", "Brown then")),
        (5, item.replace("Smith", "42")),
        (6, item.replace("10m", "tenth")),
        (7, item),
    ]
    got = rows(lk.leaks(frame(spark, texts), frame(spark, [(1, item)], "item_id")), "doc_id", "kind")
    assert got == [(1, "template"), (2, "template"), (3, "template"), (7, "exact")]
