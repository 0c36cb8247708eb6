"""Empty tables and very long texts in the operators that score or scan single rows."""

import pytest
from mailquarry.llm import langid, pii, secretscan, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string"
LONG = [(1, "word ab12 " * 100_000, "en", "s"), (2, "x" * 1_000_000, "de", "s"), (3, "hello there my friend", "en", "s"), (4, None, None, None), (5, "", "en", None)]


@pytest.mark.parametrize("rows", [[], LONG])
def test_every_row_has_a_result(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.detect(docs, toxicity.train(docs, labels)).count() == len(rows)
    assert langid.identify(docs, langid.train(docs)).count() == len(rows)
    assert secretscan.find_secrets(docs).count() == len(rows)
    assert pii.mask_private(docs, b"k").count() == len(rows)


def test_urls(spark):
    judge = lambda rows, rules: urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), urlfilter.rules_frame(spark, rules)).collect()
    assert judge([], urlfilter.RULES) == []
    long = judge([(1, "http://a.com/" + "x/" * 500_000), (2, "http://" + "a." * 100_000 + "com/"), (3, None)], urlfilter.RULES)
    assert {(r.page_id, r.rule, r.verdict) for r in long} == {(1, "com/", "allow"), (2, "com/", "allow"), (3, None, "allow")}
    # of equally long rules the blocking one wins
    equal = [("allow", "a.test", "/b/"), ("block", "a.test", "/b/")]
    assert [(r.rule, r.verdict) for r in judge([(1, "http://x.a.test/b/c")], equal)] == [("a.test/b/", "block")]
