"""Rough cosines only choose examples: neighbours and cosines are the exact ones, also where single precision can't tell them apart."""

import random

import numpy as np

from statewalk.llm import toxicity


def test_neighbours_are_exact_among_near_ties(monkeypatch):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)]
    # Examples of nearly the same words: many cosines differ by less than single precision tells.
    texts = [" ".join(rng.choices(names, k=40)) for _ in range(300)] + [" ".join([n for n in names for _ in range(200 + i % 7)]) for i in range(300)]
    examples = [(i, i % 2, *toxicity.words_of(t)) for i, t in enumerate(texts)]
    frequency = {int(w): rng.randint(1, 600) for n in names for w in toxicity.words_of(n)[0]}
    index = toxicity.build_index(examples, frequency, 600, toxicity.Settings(neighbours=12))
    assert index.postings.blocks.dtype == np.float32
    dense = np.zeros((len(texts), len(index.vocabulary)))
    for i in range(len(texts)):
        words, weights = index.example(i)
        dense[i, words] = weights
    for query in texts[::50] + [" ".join(names * 3)]:
        words, weights = index.vector(query)
        exact = dense[:, words] @ weights
        got = index.postings.nearest([(words, weights)])[0]
        assert np.allclose([c for c, _ in got], np.sort(exact)[::-1][:12], atol=1e-12, rtol=0)
        assert all(abs(exact[i] - c) < 1e-12 for c, i in got)


def test_words_of_latin_texts():
    letters = "".join(map(chr, range(1, 384)))
    texts = [letters, letters[:255], "Été Straße ÀÉÎ ªº ²³ µ×÷ÿ Ÿ", "ÉÉé1é_é é"]
    for text in texts:
        want = " ".join(toxicity.WORDS.findall(text.lower())).encode().split()
        assert toxicity._split(text).split() == want, text
    assert toxicity.LATIN[0xC9] == 0xE9
