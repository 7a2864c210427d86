"""Windows beyond the broadcast."""

from provenir.llm import decontaminate


def test_no_text_goes_through_the_join(spark, monkeypatch):
    d = spark.createDataFrame([(1, "x A b c d e f g h i j K l"), (2, None), (3, ""), (4, "short item"), (4, "short item"), (5, "a b c d")], "doc_id long, text string")
    b = spark.createDataFrame([("a", "a b c d e f g h i j k"), ("b", "short, ITEM"), ("c", None)], "item_id string, text string")
    key = lambda x: sorted(map(str, x.collect()))
    want = key(decontaminate.report(d, b))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert key(decontaminate.report(d, b)) == want

    def joins(node):
        if node.nodeName() == "Join":
            yield node.children().apply(0).output().mkString(" ")
        for i in range(node.children().size()):
            yield from joins(node.children().apply(i))

    sides = list(joins(decontaminate.hits(d, b)._jdf.queryExecution().optimizedPlan()))
    assert sides and all("text_hash#" in s and " t#" not in s and "ws#" not in s for s in sides)
