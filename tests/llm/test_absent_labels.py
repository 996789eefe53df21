"""Labels of documents that aren't there."""

from statewalk.llm import toxicity


def test_labels_of_absent_documents_use_up_nothing(spark):
    docs = spark.createDataFrame([(i, "vile scum" if i % 2 else "quiet garden") for i in range(40)], "key long, text string")
    # 2,000 absent ids, most of them toxic.
    marks = [(i, i % 2) for i in range(40)] + [(1000 + i, int(i % 10 > 0)) for i in range(2000)]
    labels = spark.createDataFrame(marks, "key long, label int")
    index = toxicity.learn(docs, labels, toxicity.Settings(examples=20))
    assert len(index.keys) == 40 and index.labels.sum() == 20
    assert index.without == 0.5  # the prior of the labels that are there
