"""Words that a worker keeps: of a matrix shard as Arrow data, of an encoder in two generations."""

import tracemalloc

import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from statewalk.llm import filter_audit
from statewalk.llm.encoders import Encoder


def _batch(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array(["en"] * n), pa.array([t.encode() for t in texts], pa.binary())], names=["id", "part", "text"]
    )


def test_words_of_a_shard_are_no_python_objects():
    batch = _batch([" ".join(f"word{i}" for i in range(k, k + 1000)) for k in range(0, 300_000, 1000)])
    tracemalloc.start()
    for _ in filter_audit._pieces(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_pieces_number_words_as_they_occur(monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE_BYTES", 8)
    texts = ["b a b", "", " \t", "a c\x0bb ", "\nd", "é d"]
    rows = pa.Table.from_batches(filter_audit._pieces(iter([_batch(texts)]))).to_pylist()
    words = []
    counted = []
    for row in rows:
        assert row["first"] == len(words)
        words += row["vocabulary"]
        for lo, hi in zip(row["indptr"], row["indptr"][1:]):
            counted.append({words[i].decode(): n for i, n in zip(row["indices"][lo:hi], row["counts"][lo:hi])})
    assert words == [b"b", b"a", b"c", b"d", "é".encode()]
    assert counted == [{"b": 2, "a": 1}, {}, {}, {"a": 1, "c": 1, "b": 1}, {"d": 1}, {"é": 1, "d": 1}]


def test_an_encoder_forgets_what_it_no_longer_meets():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, library = Encoder(path), Tokenizer.from_file(path)
    letters = str.maketrans("0123456789", "ghijklmnop")
    for k in range(0, 700_000, 1000):
        coder.encode(" ".join(f"{i:x}".translate(letters) for i in range(k, k + 1000)))
    assert sum(len(v) for v in vars(coder).values() if isinstance(v, dict)) <= 4 * (1 << 18) + 256
    for text in ("aq0 bq1 Straße it's DON'T x_y 12a", "plain words only", "a\x00b", "wörter, die"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == b"".join(i.to_bytes(2, "little") for i in ids)
