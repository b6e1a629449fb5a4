"""Ids a word at a time against the tokenizer's ids of whole texts."""

import random
from array import array

import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import word_ids

TRICKY = ["", " ", "\n", "a\nb", "a\n\nb", "a \nb", "a\n b", "\na b", "a b\n", "a\t\nb c", "don't it's\n's we'll", "x,\n\"y\" (z).", "İstanbul İ dİz,", "naïve éa 東京 ok\n東京", "<|endoftext|> a<|endoftext|>\nb", "a  b", "\nA", "w" * 90 + "\n" + "v" * 90 + " end", "12,5 a1b\n2", "\x00a \x00.\n\x00", "'s\n't", " a b\n c"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_ids_of_texts(name, spaced, limit, monkeypatch):
    ids = word_ids.WordIds(public_tokenizers.path(name), spaced, limit)
    rng = random.Random(5)
    mixed = ["".join(rng.choice(["ab", "Été", "\n", " ", " ", ".", "'s", "7", "ǅ", "İ", "<|endoftext|>", "\r\n"]) for _ in range(30)) for _ in range(300)]
    texts = TRICKY + mixed
    want = [array("I", ids.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    found = list(ids.many(pa.array(texts), rows=7))
    assert [t for t, a, b in zip(texts, want, found) if a != b] == []
    monkeypatch.setattr(word_ids, "BLOCK", 40)  # long texts go block by block
    assert [t for t, a in zip(texts, want) if ids.ids(t) != a] == []


def test_words_with_punctuation_take_no_room():
    ids = word_ids.WordIds(public_tokenizers.path("byte_bpe_50k.json"), True)
    text = "so tall, tall. tall! (tall) tall"
    assert ids.ids(text) == array("I", ids.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert not {"tall,", "tall.", "tall!"} & ids.words.keys() and "tall" in ids.words


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_latin_words_by_the_model_alone(name, spaced, monkeypatch):
    """Every Latin letter at either end and within a word, with and without punctuation, over several groups of texts."""
    ids = word_ids.WordIds(public_tokenizers.path(name), spaced)
    assert ids.direct
    monkeypatch.setattr(ids, "_runs", lambda *_: pytest.fail("the whole tokenizer isn't needed for these"))
    letters = [chr(c) for c in range(0x180) if word_ids._latin(chr(c))]
    assert len(letters) == 52 + 62 + 127
    words = [x for c in letters for x in (c, c + "a", "A" + c + "b,", "then" + c + "...")]
    texts = [" ".join(random.Random(i).sample(words, 90)) + "\nof " + "\n".join(random.Random(-i).sample(words, 30)) for i in range(40)]
    want = [array("I", ids.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    monkeypatch.setattr(word_ids, "GROUP", 3000)
    assert list(ids.many(pa.array(texts))) == want
