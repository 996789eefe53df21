"""All words of the examples count, whatever their association."""

from pyspark.sql import functions as F

from statewalk.llm import toxicity


def test_rare_words_find_neighbours(spark):
    # Two toxic and two clean topics in few labelled rows: no word reaches a likelihood ratio of 20.
    texts = {0: ("quiet gardens bloom", 0), 1: ("quiet rivers flow", 0), 2: ("vile scum talk", 1), 3: ("nasty scum words", 1)}
    rows = [(i, texts[i % 4][0]) for i in range(12)] + [(100, "such scum"), (101, "gardens and rivers"), (102, "unseen")]
    labels = spark.createDataFrame([(i, texts[i % 4][1]) for i in range(12)], "key long, label int")
    docs = spark.createDataFrame(rows, "key long, text string")
    index = toxicity.learn(docs, labels)
    words = " ".join(t for t, _ in texts.values())
    assert set(index.vocabulary) == set(toxicity.words_of(words)[0]) and len(index.keys) == 12
    out = {r["key"]: r["t"] for r in toxicity.score(docs.where("key >= 100"), index, into="t").collect()}
    assert out[100]["score"] > 0.5 > out[101]["score"] and not out[102]["neighbours"]
    assert {int(k) % 4 for k in out[101]["neighbours"]} == {0, 1}
