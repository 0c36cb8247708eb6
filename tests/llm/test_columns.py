"""Extra columns whose names clash with the operators' own, or with theirs but for case."""

import pytest
from mailquarry.llm import chat, convtrie, decontam, exact_dedup, langid, lexical, mixing, packing, pii, secretscan, simhash, toxicity, urlfilter

NAMES = ["TEXT", "kept", "text", "mark", "Doc_ID", "doc_id", "lang", "LANG", "c0", "gone_id", "fp", "root", "score", "item", "row_id", "wide", "c2", "source", "SOURCE", "size", "copy", "node", "n", "terms"]


@pytest.fixture(scope="module")
def docs(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    rows = []
    for i, t in enumerate([base, base, "  " + base.replace(" ", "\n"), base + " extra", None, "", "один два", "item words one two three four five six seven eight"]):
        rows.append(tuple({"text": t, "doc_id": i, "lang": "en" if t else None}.get(n, f"{n}{i}") for n in NAMES))
    rows.append(tuple(None for _ in NAMES))
    kinds = {"doc_id": "long"}
    frame = spark.createDataFrame(rows, ", ".join(f"x{i} {kinds.get(n, 'string')}" for i, n in enumerate(NAMES)))
    return frame.toDF(*NAMES)


def test_operators(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1, "a"), (2, 1, 0, "b")], "doc_id long, quality int, toxic int, TOXIC_ string")
    bench = spark.createDataFrame([(1, "one two three four five six", "x")], "item_id long, text string, mark string")
    assert simhash.group(docs).count() == 9
    assert exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, exact_dedup.new_path(spark, "clash"), 2)).count() == 9
    assert toxicity.detect(docs, toxicity.train(docs, labels)).count() == 9
    assert pii.mask_private(docs, b"k").count() == 9
    assert langid.identify(docs, langid.train(docs)).count() == 9
    assert packing.pack(docs).groupBy("doc_id").count().count() == 9
    assert [r.doc_id for r in decontam.contaminated(docs, bench).collect()] == [7]
    assert secretscan.find_secrets(docs).count() == 9
    talk = spark.createDataFrame([(1, 0, "user", "a", "b", "c")], "x0 long, x1 long, x2 string, x3 string, x4 string, x5 string").toDF("conv_id", "turn", "role", "text", "ROLE", "formatted")
    assert chat.format_conversations(talk).count() == 1
    assert [r.depth for r in convtrie.trie(talk).collect()] == [0]  # the first turns of 1 are those of 0, which isn't there
    plan = mixing.mix(docs)
    assert plan.count() == 9 and mixing.mixed(docs, plan).columns == NAMES
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexical.search(docs, bench).collect()] == [(1, 1, 7)]
    pages = spark.createDataFrame([(1, "http://a.com/", "b", "c")], "x0 long, x1 string, x2 string, x3 string").toDF("page_id", "url", "URL", "host")
    assert urlfilter.judge(pages, urlfilter.rules_frame(spark)).count() == 1


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = NAMES.index("doc_id")
    kept = lambda df: sorted((r[at] for r in df.collect()), key=str)
    out = exact_dedup.stage(spark, docs, "")
    assert out.columns == NAMES and kept(out) == [2, 3, 4, 6, 7]
    out = simhash.stage(spark, docs, "")
    assert out.columns == NAMES and set(kept(out)) <= {0, 3, 4, 6, 7}
    out = decontam.stage(spark, docs, str(tmp_path))
    assert out.columns == NAMES and kept(out) == [0, 1, 2, 3, 4, 5, 6, None]
    out = langid.stage(spark, docs, "")
    assert out.columns == NAMES and not {4, 5, None} & set(kept(out))
