"""Encoders, packing and the token store against the tokenizers library and plain loops."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statewalk.llm import bpe, packing, queries, token_store
from statewalk.llm.encoders import PLAIN, Encoder

WORD, BYTE = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))
POOL = "abcdefgh   \n\nABC\t''.,!?0123456789éÉßüñΣσςİIıŁ中文あ한е́Ж \U0001F600<|>²½\x01\x1c\x85   "
TEXTS = [None, "", " ", "\n\n\n", "it's <|endoftext|> here", "a  b \n c\n\n d", "ΣΑΣ", "x" * 9000, "one two three " * 3000]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def strings(n=600):
    rng = random.Random(7)
    for k in range(n):
        s = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 40)))
        yield "".join(c for c in s if PLAIN.fullmatch(c)) if k % 2 else s
    yield from (t or "" for t in TEXTS)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_ids_are_the_library_s(path):
    coder, lib = Encoder(path), library(path)
    for s in strings():
        assert np.frombuffer(coder.encode(s), coder.dtype).tolist() == lib.encode(s, add_special_tokens=False).ids, repr(s)


def test_own_bpe_encodes_and_decodes_like_the_library():
    coder, lib = bpe.WordBpe(WORD), library(WORD)
    for s in strings():
        ids = lib.encode(s, add_special_tokens=False).ids
        data = coder.encode(s)
        assert np.frombuffer(data, "<u4").tolist() == ids, repr(s)
        assert coder.decode(data) == lib.decode(ids, skip_special_tokens=False)


def test_op7_digests(spark, sf_dir):
    lib = library(WORD)
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in queries.op7_bpe(spark, sf_dir).collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "Hi", "y")], "n_tokens long, text string, _source_text string").drop("_source_text")
    out = bpe.encode_decode(df, WORD).orderBy("text").collect()
    assert [r["n_tokens"] for r in out] == [0, 1] and out[1]["decoded"] == "hi</w>"
    assert bpe.encode_decode(df.limit(0), WORD).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_windows_hold_every_token_once(cut):
    rng = random.Random(3)
    for _ in range(150):
        cap = rng.choice([8, 16, 64])
        lengths = [rng.randint(1, 3 * cap if rng.random() < 0.2 else cap) for _ in range(rng.randint(0, 40))]
        seen = {}
        for window in packing.pack_group(lengths, cap, cut):
            total = sum(n for _, _, n in window)
            assert 0 < total <= cap and (not cut or total == cap or total & (total - 1) == 0)
            for doc, start, n in window:
                seen.setdefault(doc, []).append((start, n))
        for doc, n in enumerate(lengths):
            at = 0
            for start, k in sorted(seen[doc]):
                assert start == at
                at += k
            assert at == n


def test_differencing_finds_the_known_partition():
    where = packing.differencing([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, w in zip([8, 7, 6, 5, 4], where, strict=True) if w == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]
    assert packing.differencing([5, 5, 5, 5], 4) in ([0, 1, 2, 3], [3, 2, 1, 0]) or len(set(packing.differencing([5] * 4, 4))) == 4


def test_packed_pieces(spark):
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = packing.pack(df, WORD, 2).collect()
    lib = library(WORD)
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]
    docs, windows = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"] or 0, []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in enumerate(want):
        assert sum((x[1] for x in sorted(docs[i])), []) == ids and {x[2] for x in docs[i]} == {len(ids)}
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY and (at == packing.CAPACITY or at & (at - 1) == 0)
    assert packing.pack(df.limit(0), WORD, 2).count() == 0


def test_index_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 1000):
        h = rng.integers(-(2**62), 2**62, n)
        h[n // 2 :: 7] = h[0]
        f = (h.view(np.uint64) >> np.uint64(5)).astype(np.uint32)
        lengths = rng.integers(0, 9, n)
        offsets = np.cumsum(lengths) - lengths
        index = token_store.Index(token_store.build_index(h, f, offsets, lengths, 2))
        at, k = index.find(h, f, token_store.occurrences(h))
        assert index.n == n and at.tolist() == offsets.tolist() and k.tolist() == lengths.tolist()
        strange = rng.integers(2**62, 2**63 - 1, 50)
        assert (index.find(strange, np.full(50, 7, np.uint32), np.zeros(50, np.int64))[0] < 0).mean() > 0.9


def test_store_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null key"), (3, "again"), (3, "again"), (3, "\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_store.write_store(df, f"{tmp_path}/s", BYTE, 0)
    lib = library(BYTE)
    got = sorted(token_store.read_store(spark, f"{tmp_path}/s").collect(), key=lambda r: r["start"])
    assert [r["key"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted((str(r["key"]), r["ids_crc32"]) for r in got) == sorted((str(k), crc(t)) for k, t in rows)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = spark.createDataFrame([(3,), (4,), (77,), (None,)], "k long")
    found = token_store.lookup(spark, f"{tmp_path}/s", keys).collect()
    assert sorted(r["key"] for r in found) == [3, 3, 3, 3, 4]


def test_empty_store(spark, tmp_path):
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", BYTE, 0)
    assert token_store.read_store(spark, f"{tmp_path}/e").count() == 0
