"""Toxic spans: marginals against enumeration, spans, held-out accuracy, edge rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from nimboscale.llm import toxicity as tx
from nimboscale.session import table

SF = "/root/testdata/sf0.01"


def enumerate_marginals(emit, steps):
    total, ones = 0.0, np.zeros(len(emit))
    for tags in itertools.product((0, 1), repeat=len(emit)):
        w = np.exp(sum(e for e, y in zip(emit, tags) if y) + sum(steps[a, b] for a, b in zip(tags, tags[1:])))
        total, ones = total + w, ones + w * np.array(tags)
    return ones / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    docs = [rng.normal(0, 2, n) for n in (7, 1, 0, 3, 10, 3, 9)]
    steps = rng.normal(0, 1, (2, 2))
    for d, p in zip(docs, tx.marginals(docs, steps)):
        assert len(d) == len(p) and (not len(d) or np.allclose(p, enumerate_marginals(d, steps)))
    size = tx.PAD
    tx.PAD = 12  # several groups
    try:
        again = tx.marginals(docs, steps)
    finally:
        tx.PAD = size
    assert all(np.allclose(a, b) for a, b in zip(again, tx.marginals(docs, steps)))
    real = np.zeros((10, len(docs)), bool)
    emit = np.zeros((10, len(docs)))
    for k, d in enumerate(docs):
        real[: len(d), k], emit[: len(d), k] = True, d
    single, pair = tx._expect(emit, real, steps)
    for k, d in enumerate(docs):
        assert not len(d) or np.allclose(single[: len(d), k], enumerate_marginals(d, steps))
    assert np.isclose(pair.sum(), sum(max(0, len(d) - 1) for d in docs))


def made_up(n, word="vexatious"):
    rng = np.random.default_rng(1)
    calm = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        words = list(rng.choice(calm, 30))
        if i % 4 == 0:
            words[int(rng.integers(30))] = word.upper() + "!"
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_spans_point_at_tokens(spark):
    rows = made_up(400)
    docs = spark.createDataFrame([(i, "É " + t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    for r in tx.score_toxicity(docs, labels).collect():
        text = ("É " + rows[r.doc_id][1]).encode()
        assert r.predicted == rows[r.doc_id][2]
        assert [text[s.start : s.end] for s in r.spans] == [b"VEXATIOUS!"] * r.predicted


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = tx.score_toxicity(docs, labels)
    both = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in both) >= 0.9 * len(both)
    assert sum(r.predicted > r.toxic for r in both) <= 0.03 * len(both)
    hidden = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    cols = ["doc_id", "score"]
    assert tx.score_toxicity(docs, hidden).select(cols).exceptAll(out.select(cols)).count() == 0


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "x y"), (1, None), (1, ""), (2, "w " * 50000), (3, "w " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.score for r in tx.score_toxicity(docs, none).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    one = spark.createDataFrame([(1, 0), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = tx.score_toxicity(docs, one).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.7 for r in got)
    assert tx.score_toxicity(docs.limit(0), one).count() == 0
