"""Toxicity with few labels."""

from sluice.llm import toxicity


def test_few_labels_keep_their_cue_and_clean_documents(spark):
    docs = spark.createDataFrame([(i, f"plain word{chr(97 + i % 26)}{chr(97 + i // 26)} " + ("vile" if i < 20 else "kind")) for i in range(40)] + [(90, "plain kind text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.grade(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i] == (i < 20) for i in range(40)) and not got[90]
    none = spark.createDataFrame([(i, f"only{chr(97 + i)}") for i in range(10)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    assert not any(r.rejected for r in toxicity.grade(none, toxicity.train(none, marks)).collect())
