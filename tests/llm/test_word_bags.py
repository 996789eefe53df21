"""Words of a batch are hashed together, without an object per word; an index holds no posting twice."""

import re
from collections import Counter

import numpy as np

from statewalk.llm import toxicity

TEXTS = [
    None, "", "a", "Hello hello WORLD", "abcdefgh ABCDEFGHI abcdefghi x1y2", f"{'z' * 200} q {'z' * 200}{'y' * 64} " + "z" * 65,
    "é É ß straße_x İx ĲSSEL", "\x00tabs\tand\nlines ", "a�b" + "w" * 64,
]


def test_bags_are_the_words():
    words = {}
    for text, (hashes, counts) in zip(TEXTS, toxicity.bags(TEXTS), strict=True):
        found = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
        named = {w: int(toxicity.words_of(w)[0][0]) for w in found}
        assert dict(zip(hashes.tolist(), counts.tolist(), strict=True)) == {named[w]: n for w, n in found.items()}
        words |= named
    assert len(set(words.values())) == len(words) and toxicity.bags([]) == []


def test_frequent_postings_are_blocks_only():
    examples = [(i, i % 2, *toxicity.words_of(f"common word{chr(97 + i % 20)}x")) for i in range(200)]
    index = toxicity.build_index(examples, {}, 200)
    postings = index.postings
    assert len(postings.at) == len(postings.weights) == 200 and np.count_nonzero(postings.blocks) == 200
