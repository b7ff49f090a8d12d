"""Ids of stretches that are put together from parts."""

import random

import pytest

from akin.llm import packing


@pytest.fixture
def pieces():
    packing._learned.cache_clear()
    yield packing._learned(packing.public_tokenizer(), 1)
    packing._learned.cache_clear()


def as_before(pieces, word):
    ids = pieces.tokenizer.encode(word, add_special_tokens=False).ids
    return packing.np.array(ids, dtype=pieces.kind).tobytes()


def test_parts_give_the_ids_of_whole_stretches(pieces, monkeypatch):
    rng = random.Random(5)
    some = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA0, 0x180)), "'s", "'LL", "é", "İ", "ẞ", "<|endoftext|>", "\t", "中", "😀"]
    words = {"".join(rng.choices(some, k=rng.randint(1, 8))) for _ in range(3000)}
    words |= {"don't", "Oieuxé$$$", "''s", "x;y", ";", "", "AKIA0123", "à×b÷c"}
    monkeypatch.setattr(packing, "_CACHED_PARTS", 50)
    pieces.learn(words)
    assert {w for w in words if pieces[w] != as_before(pieces, w)} == set()


def test_stretches_of_known_parts_do_not_go_to_the_tokenizer_again(pieces):
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, []

        def encode_batch_fast(self, texts, **more):
            self.texts += texts
            return self.tokenizer.encode_batch_fast(texts, **more)

    pieces.tokenizer = Counting(pieces.tokenizer)
    pieces.learn({"Hello,", "hello***", "WORLD!", "été"})
    assert pieces.tokenizer.texts == [] and len(pieces) == 4
    assert set(pieces.parts) == {"hello", ",", "***", "world", "!", "été"}


def test_an_unknown_way_to_cut_goes_whole(pieces):
    from tokenizers import normalizers

    assert packing._cuts_as_known(pieces.tokenizer)
    pieces.tokenizer.normalizer = normalizers.NFC()
    assert not packing._cuts_as_known(pieces.tokenizer)


def test_whole_texts_give_the_ids_of_the_tokenizer(pieces, monkeypatch):
    rng = random.Random(7)
    plain = [*map(chr, range(0x21, 0x7F)), "é", "Ü", "'s", "'LL", " ", "  ", "\n", "\n \n", "The", "x;y"]
    texts = ["", " ", "\n", "don't\nSTOP 2024", *("".join(rng.choices(plain, k=rng.randint(1, 60))) for _ in range(500))]
    texts += [t + rng.choice(["\t", " ", "中", "<|endoftext|>", "é x", "İ"]) + "end" for t in texts[:200]]
    monkeypatch.setattr(packing, "_CACHED_PARTS", 50)
    assert [t for t, raw in zip(texts, pieces.ids(texts), strict=True) if raw != as_before(pieces, t)] == []


def test_plain_texts_are_not_cut_into_stretches(pieces):
    found = pieces.ids(["The cat's\nthe CAT é", "the\tcat"])
    assert set(pieces) == {"the\tcat"} and {"the", "cat", "'s", "é"} <= set(pieces.parts)
    assert found[0] == as_before(pieces, "The cat's\nthe CAT é")
