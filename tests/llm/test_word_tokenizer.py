"""Words of small letters are encoded by the tokenizer's model alone, to the library's ids."""

import json
import random

import public_tokenizers
from tokenizers import Tokenizer

from parcelyard.llm.packing import WordTokenizer


def test_letters_need_the_model_only():
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    mine, whole = WordTokenizer(definition), Tokenizer.from_str(definition)
    r = random.Random(11)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkqjxz", k=r.randint(1, 90))) for _ in range(3000)]
    asked = []
    mine.direct = lambda word: asked.append(word)
    for w in words:
        assert mine.encode(w) == b"".join(i.to_bytes(4, "little") for i in whole.encode(w, add_special_tokens=False).ids)
    assert not asked


def test_another_tokenizer_is_asked_itself():
    definition = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    definition["normalizer"] = {"type": "Replace", "pattern": {"String": "a"}, "content": "b"}
    text = json.dumps(definition)
    assert WordTokenizer(text).encode("banana") == b"".join(i.to_bytes(4, "little") for i in Tokenizer.from_str(text).encode("bbnbnb", add_special_tokens=False).ids)
