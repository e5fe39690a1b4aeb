from __future__ import annotations

import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken

from frameloom.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairCoder(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)


@pytest.fixture(scope="module")
def peer(coder):
    return tiktoken.Encoding("peer", pat_str=public.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def ids(packed: bytes) -> list[int]:
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@pytest.mark.parametrize("text", ["", " ", "aaaaaaa", "a\x1cb\x1d \x85 c", "don't'll 'S", "x" * 3000, "é" * 999, "ab" * 4000, "漢字かな😀 ​　", "\r\n\r\n  x"])
def test_as_the_peer(coder, peer, text):
    assert ids(coder.encode(text)) == peer.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()


def test_random_texts(coder, peer):
    rnd = random.Random(11)
    for _ in range(800):
        text = "".join(rnd.choice("ab é\n\t1.'s漢\x1f\x0b\xa0　😀QuickThe") for _ in range(rnd.randint(0, 80)))
        assert ids(coder.encode(text)) == peer.encode_ordinary(text)


def test_table(spark, docs, coder, peer):
    texts = [None, "", "Hello world", "Hello world", "a" * 50_000]
    out = {r.doc_id: r for r in bpe.encoded(docs(texts), "text", ["doc_id", "n_words"], coder.ranks, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = peer.encode_ordinary(t or "")
        assert list(out[i].token_ids) == want and out[i].n_tokens == len(want) and out[i].n_words == f"x{i}"
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decoded(spark.createDataFrame([(1, peer.encode_ordinary("Ça va")), (2, None)], "i int, ids array<int>"), "ids", ["i"], coder.ranks)
    assert {r.i: r.text for r in back.collect()} == {1: "Ça va", 2: ""}


def test_empty_table(docs, coder):
    assert bpe.encoded(docs([]), "text", ["doc_id"], coder.ranks, public.PATTERN).count() == 0
