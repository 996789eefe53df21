"""Jaccard join, vectors, toxicity, URL rules and the pipeline against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from statewalk.llm import near_vectors, queries, set_join, toxicity, url_rules


def plain_classes(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (k, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(keys) if keys and sets[i] else k))
    return out


def corpus(seed=5, n=160):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", "  ", "one", "one two", "ONE two", "a b c"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 or len(texts) < 20:
            texts.append(" ".join(word() for _ in range(rng.randint(5, 150))))
        elif kind < 0.5:
            texts.append(" ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(10))]))
        elif kind < 0.6:
            texts.append(rng.choice(texts))
        else:
            w = (rng.choice(texts[10:]) or "x").split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[8], (8, "another text with this key")]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_classes(spark, monkeypatch, n, percent):
    monkeypatch.setattr(set_join, "GROUP", 4)
    monkeypatch.setattr(set_join, "PARTNERS", 2)
    monkeypatch.setattr(set_join, "FREQUENT", 5)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    got = set_join.link_classes(df, join=set_join.SetJoin(n, percent)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["key"], r["n_shingles"], r["component"]) for r in got), key=key) == sorted(plain_classes(rows, n, percent), key=key)


def test_keep_one(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words here"), (3, "other words here"), (None, None), (4, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _node int")
    out = set_join.keep_one(df)
    assert out.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == ["1", "3", "4", "None"]
    assert set_join.keep_one(df.limit(0)).count() == 0


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=16) * 0.07], i % 2) for i in range(400)]
    odd = [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[0][1], None), (404, rows[0][1], 0),
           (405, rows[0][1], 0), (406, [1.0, None], 1), (407, [], 0), (408, [1.0, 0.0], 0), (409, [2.0, 0.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    settings = near_vectors.Settings(shard=64, beam=4, breadth=16, degree=6, recall=1.0)
    got = {r["key"]: r for r in near_vectors.near_duplicates(df, settings=settings).collect()}
    good = [r for r in rows + odd if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: set() for r in rows + odd}
    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    found = sum(got[k]["n_links"] for k in links)
    assert all(got[k]["n_links"] <= len(v) for k, v in links.items())
    assert found >= 0.9 * sum(map(len, links.values())) > 100
    for k, v in links.items():
        if not v:
            assert got[k]["component"] == k and got[k]["kept"]
    assert got[409]["component"] == 408 and not got[409]["kept"]
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(4)
    unit = near_vectors._unit(rng.normal(size=(3000, 24))).astype(np.float32)
    graph = near_vectors.Graph.build(unit, np.arange(3000), near_vectors.Settings())
    ids, _ = graph.search(unit[:200], 64)
    truth = np.argsort(-(unit[:200] @ unit.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, truth, strict=True)]) > 0.9


def toxic_docs(n=900):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.7)) % 3000:x}abc".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(60)]
        bad = rng.random() < 0.2
        if bad:
            for w in rng.sample(["vile", "scum", "trash", "moron"], 2):
                words[rng.randrange(60)] = w.upper()
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_docs()
    docs = spark.createDataFrame([*rows, (None, None, "x"), (5, "", "x")], "doc_id long, text string, toxicity string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, marks).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    held = [r for r in got if r["held"] and r["text"]]
    right = sum((r["toxicity"]["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held)
    assert len(held) > 100 and right >= 0.95 * len(held)
    assert all(r["toxicity"]["score"] < 0.3 and not r["toxicity"]["neighbours"] for r in got if not r["text"])
    assert toxicity.score_documents(docs.limit(0), marks).count() == 0
    assert {r["toxicity"]["score"] for r in toxicity.score_documents(docs, marks.limit(0)).collect()} == {0.0}


def plain_cosines(texts, text, examples):
    """TF-IDF cosines of a text with examples, from the texts alone."""
    split = lambda t: regex.findall(r"[^\W\d_]+", t.lower())
    seen = Counter(w for t in texts for w in set(split(t)))
    held = {w for t in examples for w in split(t)}

    def vector(t):
        raw = {
            w: math.sqrt(n) * (math.log((1 + len(texts)) / (1 + (seen[w] if w in held else 1))) + 1) for w, n in Counter(split(t)).items()
        }
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    q = vector(text)
    return [sum(x * q.get(w, 0) for w, x in vector(e).items()) for e in examples]


def test_block_max_search_is_exact(monkeypatch):
    # Topics with their own words, so that whole ranges can be skipped; unknown words count in a text's length.
    monkeypatch.setattr(toxicity, "RANGE", 8)
    monkeypatch.setattr(toxicity, "FIRST", 2)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrst"
    word = lambda topic: "w" + letters[topic] + letters[int(rng.paretovariate(0.8)) % 20]
    draw = lambda topic: " ".join(word(topic) for _ in range(rng.randint(1, 12)))
    texts = [draw(i % 12) for i in range(600)]
    examples = [(i, i % 2, *toxicity.words_of(t)) for i, t in enumerate(texts)]
    seen = Counter(w for _, _, h, _ in examples for w in h.tolist())
    index = toxicity.build_index(examples, seen, len(texts), toxicity.Settings(neighbours=5))
    skipped = 0
    for i in range(40):
        text = draw(i % 12) + (" unseen words" if i % 2 else "")
        want = sorted(plain_cosines(texts, text, texts), reverse=True)[:5]
        got = [s for s, _ in index.postings.nearest([index.vector(text)])[0]]
        assert np.allclose(got, [x for x in want if x > 0], atol=1e-9)
        skipped += index.postings.share_opened < 0.5
    assert skipped >= 30
    near = index.postings.nearest([index.example(7)], [7])[0]
    assert 7 not in [i for _, i in near]


def test_toxicity_bounds_and_long_texts(spark):
    rows = [(i, " ".join([f"{'vile' if i % 2 else 'calm'}", *["garden"] * 3])) for i in range(40)]
    docs = spark.createDataFrame([*rows, (100, "calm garden " * 50000), (101, "vile " + "garden " * 3), (102, "")], "key long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "key long, label int")
    # Two words an example: five examples a class hold the ten words that a class may have.
    index = toxicity.learn(docs, labels, toxicity.Settings(words=10))
    assert len(index.keys) == 10 and index.labels.sum() == 5
    out = {r["key"]: r["t"]["score"] for r in toxicity.score(docs.where("key >= 100").union(docs.where("key = 101")), index, into="t").collect()}
    assert out[101] > 0.5 > out[100] and out[102] == index.without
    again = toxicity.learn(docs, labels, toxicity.Settings(words=10))
    assert again.keys == index.keys and np.array_equal(again.steps, index.steps)


RULES = queries.URL_RULES
URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/x", "https://www.example.com/en/a?b=/fr/", "http://a.example.net/es/1#top",
    "http://net/fr/", "http://x.com", "http://x.com/", "http://x.com:80/", "http://notexample.com/en/", "ftp://u@example.com/en/",
    "http://example.com?q=://z/en/", "http://example.net/fr", "http://" + "a." * 500 + "com/en/", "http://example.com/en/" + "z" * 50000,
]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


@pytest.mark.parametrize("most", [url_rules.MAX_BYTES, 0])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(url_rules, "MAX_BYTES", most)
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, _keys int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df, RULES).collect()}
    assert got == {i: plain_url(u) for i, u in enumerate(URLS * 2)}
    assert url_rules.judge(df.limit(0), RULES).count() == 0
    assert url_rules.judge(df, []).where("rule IS NULL AND verdict = 'allow'").count() == len(URLS) * 2


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit("s")).alias("h2"), "id")
    cascade = url_rules.build_cascade(keys.where("id < 300").select("h1", "h2"), keys.where("id >= 300").select("h1", "h2"))
    rows = keys.orderBy("id").toPandas()
    assert cascade.holds(rows["h1"].to_numpy(), rows["h2"].to_numpy()).tolist() == [i < 300 for i in range(3000)]
    assert len(cascade.levels) > 1 and cascade.n_bytes < 3000


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r["text"] for r in docs.limit(3).collect()]
    extra = [(90001, None, "en", "s", 0), (90002, texts[0], "en", "s", 0), (90003, "", None, None, None)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        path = f"{queries.shared_dir(spark)}/test-{name.replace(' ', '-')}-{sizes[-1]}-{random.random()}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(ids) == sizes[-1] and not ids & {90001, 90003}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids
