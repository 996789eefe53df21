"""The encoder asks the model once for a word, with marks after it or without, and gives the library's ids."""

import public_tokenizers
import pytest

from statewalk.llm.encoders import Encoder

TEXTS = [
    "word word, word. word!! of\nword, of\n\nWord *** x",
    "été été, señal... ª º1 ß\nété\n\nÉté, Łódź ¿qué?",
    "it's don't, rock'n'roll 12 a1 1a. x_y _x, -- -a a- (a) \x7f",
    "naïve\n-ab\n,\n12, é1 ,é é-é",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_the_librarys(name):
    coder = Encoder(public_tokenizers.path(name))
    for text in TEXTS + TEXTS:
        want = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == b"".join(i.to_bytes(int(coder.dtype[-1]), "little") for i in want), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_held_once(name):
    coder = Encoder(public_tokenizers.path(name))
    coder.encode("a thisword thisword, thisword. thisword")
    assert not [w for w in coder.known if "thisword" in w] and b"thisword" in coder.cache
