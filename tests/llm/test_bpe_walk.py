"""Operator 10: the walk over the tokens' trie takes no trial merges per pair and gives the library's ids."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 40))) for _ in range(400)]
    made += ["".join(rng.choices("éàßñµªº¼²xaz9'’!?<|>_-\t\n ", k=rng.randint(1, 60))) for _ in range(400)]
    made += ["".join(rng.choices("中文кириллицаé ǅ٣x9", k=rng.randint(1, 30))) for _ in range(200)]
    return [*made, "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "hahahahahahaha", "x" * 5000, "<|endoftext|>a<|startoftext|>",
            "it's WE'RE I'd", "", None]


def test_ids_of_the_library_without_trial_merges(texts, monkeypatch):
    m = bpe.TrieBpe(PATH)
    assert m.ordered
    monkeypatch.setattr(m, "merge", None)  # before: one merge of two tokens' symbols for each new pair
    library = Tokenizer.from_file(PATH)
    for text, (n, ids, decoded) in zip(texts, m.encode_batch(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_pairs_by_last_merges_and_by_merging_agree(texts, monkeypatch):
    m = bpe.TrieBpe(PATH)
    list(m.encode_batch(texts))
    by_merges = dict(m.pairs)
    m.ordered = False  # as for a vocabulary whose merges come in another order
    assert len(by_merges) > 1000 and by_merges == {k: m._stays_apart(k >> 20, k & 0xFFFFF) for k in by_merges}


def test_step_memo_is_bounded(texts, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_STEPS", 10)
    m = bpe.TrieBpe(PATH)
    out = list(m.encode_batch(texts))
    assert len(m.goto) <= m.edges + 10
    assert out == list(bpe.TrieBpe(PATH).encode_batch(texts))
