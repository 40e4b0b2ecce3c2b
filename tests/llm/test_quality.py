"""Rule ensemble: rules from trees, compiled scores, held-out accuracy."""

from pyspark.sql import functions as F

from nimboscale.llm import quality as q
from nimboscale.session import table

SF = "/root/testdata/sf0.01"


def test_rules_of_a_tree():
    text = """Model
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 <= 7.0)
      Predict: 0.0
     Else (feature 1 > 7.0)
      Predict: 1.0
    Else (feature 0 > 2.5)
     If (feature 0 <= 4.0)
      Predict: 1.0
     Else (feature 0 > 4.0)
      Predict: 0.0
"""
    a, b = q.STATISTICS[:2]
    want = {((a, None, 2.5),), ((a, None, 2.5), (b, None, 7.0)), ((a, None, 2.5), (b, 7.0, None)), ((a, 2.5, None),), ((a, 2.5, 4.0),), ((a, 4.0, None),)}
    assert {r.bounds for r in q.tree_rules(text)} == want


def test_statistics(spark):
    rows = [("One, two. THREE x1\nOne, two. THREE x1",), (None,), (" \n",), ("a" * 100000,)]
    df = spark.createDataFrame([(t, 9.0) for (t,) in rows], "text string, upper double")
    got = q.with_statistics(df).collect()
    r = got[0]
    assert (r.distinct_words, r.longest_word, r.closed_words, r.digits, r.distinct_lines) == (0.5, 5.0, 0.5, 2 / 37, 0.5)
    assert r.upper == 12 / 37 and r.symbols == 0.0 and r.short_words == 2 / 8
    assert all(x is not None for row in got for x in [row[s] for s in q.STATISTICS])


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out, model = q.score_quality(docs.select("doc_id", "text"), labels)
    both = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in both) >= 0.93 * len(both)
    assert out.count() == docs.count() and model.rules
    hidden = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id"), 5), 1 - F.col("quality")).otherwise(F.col("quality")))
    same, _ = q.score_quality(docs.select("doc_id", "text"), hidden)
    assert same.exceptAll(out).count() == 0
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("predicted = 1").count()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "x y"), (1, None), (1, ""), (2, "w " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out, model = q.score_quality(docs, none)
    assert not model.rules and [r.score for r in out.collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert len({r.score for r in q.score_quality(docs, one)[0].collect()}) == 1
    assert q.score_quality(docs.limit(0), one)[0].count() == 0
