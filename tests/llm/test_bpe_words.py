"""Byte-level BPE: words that a worker remembers over batches."""

import random

import public_tokenizers
import pytest
import tiktoken

from brookwatch.llm import bpe


@pytest.fixture
def codec():
    return bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, blank_starts=True)


def test_words_of_an_earlier_batch_are_not_split_again(codec, monkeypatch):
    looked_up = []
    find = codec.perfect.find
    monkeypatch.setattr(codec.perfect, "find", lambda keys: looked_up.extend(keys) or find(keys))
    first = codec.encode(["zz alpha qqxzv, alpha's", "zz qqxzv"])
    looked_up.clear()
    assert codec.encode(["zz alpha's qqxzv,"]) == [codec.encode(["zz"])[0] + codec.encode(["a alpha's qqxzv,"])[0][1:]]
    assert b" qqxzv" not in looked_up and b" alpha" not in looked_up
    assert first[1] == codec.encode(["zz qqxzv"])[0]


def test_words_equal_tiktoken_while_generations_turn(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    ranks = {token: i for i, token in enumerate(codec.vocabulary)}
    known = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    letters = "abts'é٣漢\U0001F600,.-19 \n\t\x1c  "
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(400)]
    texts += ["", " ", "a", "a  b", " a", "a ", "a\nb c", "'s 's it's", "ab" * 5000]
    for i in range(0, len(texts), 25):
        assert codec.encode(texts[i:i + 25]) == [known.encode_ordinary(t) for t in texts[i:i + 25]]
    assert len(codec.words) < 1000
