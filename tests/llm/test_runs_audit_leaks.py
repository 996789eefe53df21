"""Filter audit, periodic runs and decontamination against plain Python, with their defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.llm import decontaminate, filter_audit, run_detection

# --- periodic runs


def plain_runs(words):
    best = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            if words[at] == words[at + q]:
                start = at
                while at + q < len(words) and words[at] == words[at + q]:
                    at += 1
                end = at + q
                if end - start >= max(6, 4 * q):
                    best[start, end] = min(q, best.get((start, end), q))
            at += 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_search(seed):
    rng, texts = random.Random(seed), []
    for _ in range(40):
        n, k = rng.choice([0, 1, 5, 30, 150, 600]), rng.choice([1, 2, 3, 40, 900])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 8 else 0):
            at = rng.randrange(n)
            period = rng.randint(1, max(1, (n - at) // 4))
            for i in range(at, min(n, at + rng.randint(1, 8) * period)):
                words[i] = words[at + (i - at) % period]
        if rng.random() < 0.3:
            words += (([0] * rng.randint(1, 7) + [1]) * rng.randint(1, 4) + [2]) * rng.randint(1, 9)
        texts.append(np.array(words, dtype=np.int64))
    assert run_detection.all_runs(texts) == [plain_runs(list(t)) for t in texts]


def test_colliding_hashes_start_again(monkeypatch):
    mixed, weak = run_detection._mixed, [True]

    def poor(a, b):
        out = mixed(a, b)
        return out % np.uint64(3) if weak[0] and weak.append(0) is None and len(weak) < 12 else out

    monkeypatch.setattr(run_detection, "_mixed", poor)
    words = np.array((list(range(20)) * 6) + list(range(100, 160)))
    assert run_detection.all_runs([words]) == [plain_runs(list(words))]


RUN_TEXTS = [None, "", " \n", "a b c", "x " * 6, "x " * 5, "a b " * 4, "t a b a b a b a b u", "é ü " * 30, "w " * 30000, "dup one " * 9, "dup one " * 9]


def test_run_columns(spark):
    rows = [(i % 5 if i else None, t, "own", i) for i, t in enumerate(RUN_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, _text int")
    out = {r["_text"]: r for r in run_detection.find_runs(df).collect()}
    assert len(out) == len(RUN_TEXTS)
    for i, text in enumerate(RUN_TEXTS):
        words, found = (text or "").split(), out[i]["runs"]
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert out[i]["text"] == text and found["n_runs"] == len(runs)
        assert found["runs"] == "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        drop = {j for s, n, q in runs for j in range(s + q, s + n)}
        kept = " ".join(w for j, w in enumerate(words) if j not in drop)
        assert found["collapsed"] == kept and found["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            assert (found["start"], found["length"], found["period"], found["exponent_milli"]) == (s, n, q, 1000 * n // q)
        else:
            assert found["start"] is found["exponent_milli"] is None
    assert run_detection.find_runs(df.limit(0)).count() == 0


def test_op12_equals_search(spark, sf_dir):
    from statewalk.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    looped = 0
    for r in queries.op12_periodic_runs(spark, sf_dir).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            looped += 1
        runs = plain_runs(words)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        drop = {j for s, m, q in runs for j in range(s + q, s + m)}
        kept = " ".join(w for j, w in enumerate(words) if j not in drop)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert looped


# --- filter audit

AUDIT = [
    (1, "a b", "en"), (2, "a b", "en"), (2, "a b", "en"), (None, "a b", "en"), (3, None, None), (4, "", None), (5, "A# " * 120, "fr"),
    (6, " ".join(f"w{i}" for i in range(120)), "fr"), (7, "é" * 9 + "A", "fr"), (8, " ".join(f"v{i % 90}" for i in range(20000)), "de"),
]
AUDIT_LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 0, 1), (None, 1, 1), (99, 1, 1)]


def plain_flags(rows):
    out = []
    for key, text, _ in rows:
        t = text or ""
        w = t.split()
        smaller = [k for k, u, _ in rows if (u or "") == t and k is not None and key is not None and k < key]
        out.append(
            {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": bool(smaller)}
        )
    return out


def plain_audit(rows, labels):
    good = {k for k, q, _ in labels if k is not None and q == 1}
    toxic = {k for k, _, t in labels if k is not None and t == 1}
    flags, out, lost = plain_flags(rows), {}, {}
    for part in {r[2] or "" for r in rows}:
        own = [(k, f) for (k, _, p), f in zip(rows, flags, strict=True) if (p or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = order[: step - 1]
                gone = [(k, x) for k, x in own if x[f] and not any(x[b] for b in before)]
                lost[part, f] = lost.get((part, f), 0) + len(gone)
                out[part, order, step] = (
                    sum(not any(x[b] for b in before + f) for _, x in own), len(gone),
                    sum(x[f] and any(x[b] for b in before) for _, x in own), sum(x[f] and sum(x.values()) == 1 for _, x in own),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                )
    return {(p, o, s): (*v, lost[p, o[s - 1]]) for (p, o, s), v in out.items()}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_audit(spark, monkeypatch, piece):
    monkeypatch.setattr(filter_audit, "PIECE_BYTES", piece)
    monkeypatch.setattr(filter_audit, "SLOT_ENTRIES", 16)
    docs = spark.createDataFrame([(*r, "x", 0) for r in AUDIT], "doc_id long, text string, lang string, shard string, n int")
    labels = spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in filter_audit.audit(docs, labels).collect()}
    assert got == plain_audit(AUDIT, AUDIT_LABELS)


def test_dictionary_is_global(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["a b a", "c a", "", "b\tb", None])], "doc_id long, text string, lang string")
    matrix = filter_audit.term_matrix(docs.repartition(3))
    words = {bytes(r["word"]): r["number"] for r in matrix.dictionary().collect()}
    assert set(words) == {b"a", b"b", b"c"} and len(set(words.values())) == 3
    rows = {}
    for r in matrix.shards.collect():
        for n, key in enumerate(r["ids"]):
            at = slice(r["indptr"][n], r["indptr"][n + 1])
            rows[key] = dict(zip(r["indices"][at], r["counts"][at], strict=True))
    a, b, c = words[b"a"], words[b"b"], words[b"c"]
    assert rows == {0: {a: 2, b: 1}, 1: {c: 1, a: 1}, 2: {}, 3: {b: 2}, 4: {}}


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0


# --- decontamination

ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven"), (2, "two three four five six seven eight nine ten eleven"),
    (3, "short item"), (4, None), (5, "... !!"), (None, "null key here"), (3, "Short, ITEM"), (20, "short item"),
]
LEAK_TEXTS = [
    None, "", "nothing here", "x ONE two, three four five six seven eight nine ten eleven y", "two three four five six seven eight nine ten",
    "a short item and a short\nitem.", "null key here", "é short item é", "pad " * 20000 + "short item", "short item", "short item", "shortitem short",
]


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_hits(text, items):
    words, hit, found = plain_words(text), set(), set()
    for key, item in items:
        w = plain_words(item)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found |= {key} - {None}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("limits", [{}, {"block_windows": 2}, {"block_chars": 40}])
def test_leaks(spark, limits):
    docs = spark.createDataFrame([(i % 4, t, "own", i) for i, t in enumerate(LEAK_TEXTS)], "doc_id long, text string, leaks string, _w int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = {r["_w"]: r for r in decontaminate.scan(docs, items, **limits).collect()}
    assert len(out) == len(LEAK_TEXTS)
    for i, text in enumerate(LEAK_TEXTS):
        found = out[i]["leaks"]
        assert (found["n_words"], found["n_hit"], found["items"]) == plain_hits(text, ITEMS), text
        assert out[i]["text"] == text and out[i]["doc_id"] == i % 4


def test_leaks_are_removed(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LEAK_TEXTS)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = {r["doc_id"] for r in decontaminate.without_documents(docs, items).collect()}
    assert kept == {i for i, t in enumerate(LEAK_TEXTS) if not plain_hits(t, ITEMS)[1]}
    clean = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs, items).collect()}
    assert clean[0] is None and clean[2] == "nothing here" and clean[5] == "a   and a \n." and clean[7] == "é   é"
    assert plain_words(clean[3]) == ["x", "y"] and clean[3].startswith("x  ")


def test_leaks_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "short item")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.scan(docs, items.limit(0)).first()["leaks"]["n_hit"] == 0
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    assert decontaminate.scan(docs, items.where(F.col("item_id") == 3)).first()["leaks"]["items"] == [3]


def test_leaks_run_without_python(spark, sf_dir):
    from statewalk.llm import queries

    plan = queries.op13_decontamination(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan
