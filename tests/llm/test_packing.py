from __future__ import annotations

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import packing, queries

SF = "/root/testdata/sf0.001"
CAPACITY = 2048


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out.encode_special_tokens = True
    return out


CODER = None


def coder():
    global CODER
    CODER = CODER or packing.WordCoder(path())
    return CODER


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbZ019'.,!-<|>é́İΣσςŒıſÅŠ中‍  \x85\x1c\x0b\t\r\n  ")), max_size=60))
def test_chunks_encode_as_the_whole_text(text):
    assert np.frombuffer(coder().encode(text), dtype="<u4").tolist() == coder().tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from([*packing.LATIN, *"\u0130\u0301 \xa0\x85\n'stdmrelv"]), max_size=40))
def test_pre_tokens_of_latin_text(text):
    assert np.frombuffer(coder().encode(text), dtype="<u4").tolist() == coder().tokenizer.encode(text, add_special_tokens=False).ids


def test_latin_text_takes_the_merges_alone():
    text = "Costs: $$40,000 (it's 1A2b)... \u00e9T\u00e9\u00b2! a_b-c**\nwe'll,%% x&&&"
    fresh, want = packing.WordCoder(path()), tokenizer().encode(text, add_special_tokens=False).ids
    fresh.tokenizer = None
    assert np.frombuffer(fresh.encode(text), dtype="<u4").tolist() == want


def test_special_strings_are_text():
    ids = np.frombuffer(coder().encode("a <|endoftext|> b<|startoftext|>"), dtype="<u4").tolist()
    assert not {49406, 49407} & set(ids) and ids == tokenizer().encode("a <|endoftext|> b<|startoftext|>", add_special_tokens=False).ids


def sound(histogram, plan, capacity):
    """Every rank of every length has one place; no sequence holds more than it may, none is empty, none has a gap inside."""
    ranks, held = defaultdict(list), defaultdict(list)
    for length, first, count, base, each, offset in plan.rows:
        ranks[length] += range(first, first + count)
        for k in range(count):
            held[base + k // each].append((offset + k % each * length, length))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items() if n}
    assert sorted(held) == list(range(plan.sequences))
    for cells in held.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
def test_plans_are_sound_for_any_histogram(histogram):
    plan = packing.planned(histogram, 64)
    sound(histogram, plan, 64)
    assert plan.sequences >= -(-sum(s * n for s, n in histogram.items()) // 64)


def fewest(sizes, capacity):
    """The fewest sequences, by search over all assignments."""
    best = [len(sizes)]

    def place(i, loads):
        if len(loads) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(loads)
            return
        for k, load in enumerate(loads):
            if load + sizes[i] <= capacity and loads.index(load) == k:
                place(i + 1, [*loads[:k], load + sizes[i], *loads[k + 1 :]])
        place(i + 1, [*loads, sizes[i]])

    place(0, [])
    return best[0]


def test_plans_are_within_one_of_the_fewest():
    rnd = random.Random(5)
    for _ in range(40):
        sizes = sorted((rnd.randint(3, 20) for _ in range(rnd.randint(1, 9))), reverse=True)
        plan = packing.planned(Counter(sizes), 24)
        sound(Counter(sizes), plan, 24)
        assert plan.sequences <= fewest(sizes, 24) + 1


@pytest.mark.parametrize("low, high, within", [(1, 2047, 1.02), (500, 1100, 1.05), (20, 400, 1.001)])
def test_plans_of_many_pieces(low, high, within):
    rng = np.random.default_rng(2)
    histogram = Counter(rng.integers(low, high + 1, 20_000).tolist())
    plan = packing.planned(histogram, CAPACITY)
    sound(histogram, plan, CAPACITY)
    assert plan.sequences <= within * -(-sum(s * n for s, n in histogram.items()) // CAPACITY)
    by_best_fit = sum(c.count for c in packing._best_fit([], [(s, 0, n) for s, n in histogram.items()], CAPACITY))
    assert plan.sequences <= by_best_fit


def test_grouping_beats_best_fit_where_configurations_matter():
    # 6 + 7 + 11 fill a sequence; best fit begins with pairs of 11
    histogram = {11: 300, 7: 300, 6: 300}
    plan = packing.planned(histogram, 24)
    sound(histogram, plan, 24)
    assert plan.sequences == 300
    assert sum(c.count for c in packing._best_fit([], [(s, 0, n) for s, n in histogram.items()], 24)) > 300


def test_a_plan_grows_with_lengths_not_with_pieces():
    rng = np.random.default_rng(3)
    shape = Counter(rng.integers(1, 2048, 5000).tolist())
    few, many = (packing.planned({s: n * times for s, n in shape.items()}, CAPACITY) for times in (1, 1_000_000))
    assert len(many.rows) < 4 * len(few.rows) + 4 * CAPACITY


def laid(rows, capacity=CAPACITY):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for cells in held.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at and 1 <= length <= capacity
            at += length
        assert at <= capacity
    return len(held)


def test_query_against_the_library(spark):
    plain = tokenizer()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), CAPACITY)):
            part = ids[start : start + CAPACITY]
            want[r.doc_id, piece] = (start, len(part), crc32(part.tobytes()))
    rows = queries.op11_packing(spark, SF).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert laid(rows) <= -(-sum(r.length for r in rows) // CAPACITY) + 1


def test_sequences_hold_the_ids_again(docs, spark):
    long = " ".join(f"w{i} and x{i % 7}" for i in range(2000))
    texts = [long, None, "", "a b", "a b", long, "Ünï " * 300]
    data = docs(texts, [0, 1, 2, 3, 3, None, 6]).withColumnRenamed("n_words", "length").repartition(3)
    out = packing.packed(data, "text", ["doc_id", "length"], path(), capacity=512)
    rows = out.collect()
    assert "length_in" in out.columns and all(isinstance(r.length, int) for r in rows)
    laid(rows, 512)
    whole = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    assert sorted(whole) == sorted({r.sequence_id for r in rows})
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in rows)
    plain, back = tokenizer(), defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id in (0, None, 6):
            back[r.doc_id] += r.ids
    for doc_id, text in ((0, long), (None, long), (6, texts[6])):
        assert back[doc_id] == [*plain.encode(text, add_special_tokens=False).ids, 0]
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1] and sum(r.doc_id == 3 for r in rows) == 2
    assert packing.packed(docs([]), "text", ["doc_id"], path()).count() == 0


def test_one_length_for_a_third_of_all_rows(docs):
    data = docs(["a b c"] * 300 + ["so " * (i % 40) for i in range(600)]).repartition(7)
    rows = packing.packed(data, "text", ["doc_id"], path(), capacity=64, ids=False).collect()
    assert sum(r.length == 4 for r in rows) > len(rows) / 3
    assert laid(rows, 64) <= -(-sum(r.length for r in rows) // 64) + 2
