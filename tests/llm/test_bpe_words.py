"""Words of op6 are parsed once, whatever stands around them."""

import random

import pytest

from sieveline.llm import bpe


@pytest.fixture(scope="module")
def path():
    P = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tokenizers")
    return P.path("word_bpe_49k.json")


def test_a_word_with_other_punctuation_is_not_parsed_again(path):
    t, parsed = bpe.Tokenizer(path), []
    once = t.automaton.path
    t.automaton.path = lambda w: parsed.append(w) or once(w)
    t.encode("verschau verschau. verschau, (verschau) verschau*** Verschau")
    assert parsed.count("verschau") == 1


def test_remembered_words_give_the_library_s_tokens(path):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(path), bpe.Tokenizer(path)
    draw = random.Random(7)
    parts = ["the", "chtekeit", "öpf", "éeau", "***", "'ll", "'s", "42", "$$$", "ñas", "ß", "x", "_", "q" * 40, "日本", "İ", "ªb", "²", "​", "internationalization"]
    texts = [" ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(60)) for _ in range(60)]
    for x in texts:
        want = lib.encode(x, add_special_tokens=False).ids
        assert own.encode(x).tolist() == want
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)
