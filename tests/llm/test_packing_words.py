"""Token ids by words: equal to the whole tokenizer's, and one call of the BPE model a word."""

from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_a_word_goes_to_the_model_once(monkeypatch):
    tokens, met, word = packing.Tokens(PATH), Counter(), packing.Tokens._word
    monkeypatch.setattr(tokens, "_word", lambda w: met.update([w]) or word(tokens, w))
    texts = ["Thonerwhin thonerwhin, (THONERWHIN) thonerwhin.\nthonerwhin's", "thonerwhin; Thonerwhin-thonerwhin", "thonerwhin"]
    assert [tokens.encode(t).tolist() for t in texts] == [whole(t) for t in texts]
    assert met["thonerwhin"] == 1


def test_every_plain_character_splits_as_in_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, tokens = Tokenizer.from_file(PATH), packing.Tokens(PATH)
    for c in map(chr, [*range(32, 127), *range(160, 305)]):
        text = f"{c} {c}a b{c} B{c}C 1{c}2 it's{c} I'{c} d.{c} {c}{c} x{c},"
        assert tokens.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, c


def test_texts_of_all_kinds_in_one_array():
    texts = ["A null follows", None, "", "x <|endoftext|> y", "mark \x01 x", "Kelvin \u212a, H\u0331 h\u0331", " two  spaces \n\n", "tab\there, it's", "\u00c9t\u00e9,"]
    for type_ in (pa.string(), pa.large_string()):
        got = packing.Tokens(PATH).encode_all(pa.array(["cut off", *texts, "cut off"], type_).slice(1, len(texts)))
        assert [memoryview(ids).cast("I").tolist() for ids in got] == [whole(t) for t in texts]


def test_ids_hold_when_the_cache_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    tokens = packing.Tokens(PATH)
    for i in range(60):
        text = f"Turn {i % 7} over, caf\u00e9 \u65e5\u672c{i % 5} x{'ab' * (i % 11)}."
        assert tokens.encode(text).tolist() == whole(text)
        assert len(tokens.cache) + len(tokens.old) < 60
