"""Tasks of the set join are bounded by the sizes of their sets."""

from statewalk.llm import set_join


def test_tasks_are_bounded_by_set_sizes(spark, monkeypatch):
    monkeypatch.setattr(set_join, "GROUP_TOKENS", 2000, raising=False)
    monkeypatch.setattr(set_join, "PARTNER_TOKENS", 4000, raising=False)
    text = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join([*text, f"own{i}"])) for i in range(60)]
    folder = spark.sparkContext.accumulator(0)
    plain = set_join._compare

    def watched(pdf, join):
        if pdf["tokens"].map(len).sum() > 14000:
            folder.add(1)
        return plain(pdf, join)

    monkeypatch.setattr(set_join, "_compare", watched)
    got = set_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component"] for r in got} == {0} and folder.value == 0
