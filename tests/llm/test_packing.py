"""Packing: exact token ids, gapless sequences, close to the plain best fit, edge cases."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello  World\n\n x", "İstanbul ΣΑΣ a b\tc é é", "don't  they'll 123 4,5;; <|endoftext|> mid <|im_end|>", "word " * 5000,
         "\x1c\x85 ﬁ 日本語 한국어 \U0001f600́ ́a", "a\r\nb\x0bc\x0cd", "mark \x01 x\x01y", "..\x02 \x00"]


def test_chunked_ids_equal_whole_ids():
    from tokenizers import Tokenizer

    whole, tokens = Tokenizer.from_file(PATH), packing.Tokens(PATH)
    rng = random.Random(3)
    made = ["".join(rng.choice(" \n\tab'stZéß.,|́ 1") for _ in range(200)) for _ in range(200)]
    for text in [t or "" for t in TEXTS] + made:
        assert tokens.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_plan_is_gapless_best_fit(counts):
    used, runs = defaultdict(list), sorted(packing.plan(counts, 20))
    for length, n in counts.items():
        mine = [r for r in runs if r[0] == length]
        for rank in range(n):
            _, low, per, first, offset = max((r for r in mine if r[1] <= rank), key=lambda r: r[1])
            used[first + (rank - low) // per].append((offset + (rank - low) % per * length, length))
    for places in used.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 20
    bins = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = [b for b in bins if b[0] >= length]
        if fit:
            min(fit)[0] -= length
        else:
            bins.append([20 - length])
    assert len(used) == len(bins)


def test_pack_documents(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0), (None, "no id", 1)] + [(100 + i, "tok " * (i % 300), 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = packing.pack_documents(docs, PATH).collect()
    assert all(r["length"] <= 2048 for r in got)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // 2048) + 1
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 6)
    assert long == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 905)]
    empty = [r for r in got if r["doc_id"] == 0]
    assert [(r["length"], r["ids_crc32"]) for r in empty] == [(1, zlib.crc32(np.array([0], "<u4").tobytes()))]
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
