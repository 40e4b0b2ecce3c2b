"""Every pipeline stage on its own input against brute force."""

import corpus_pipeline as cp
from nimboscale.llm import quality as q
from nimboscale.llm.pieces import MODEL, vocabulary
from nimboscale.session import stored, table
from tests.llm.test_native import brute_lines, water_fill
from tests.llm.test_simhash import brute_similar

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    made = {}
    for name, stage in cp.STAGES:
        made[name] = (docs, stored(stage(spark, docs, SF), "test"))
        docs = made[name][1]
        if name != names[-1]:
            assert docs.columns == columns
    before, after = made[names[0]]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    good = [i in kept for i, y in labels.items() if y == 1]
    bad = [i in kept for i, y in labels.items() if y == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert after.exceptAll(before).count() == 0
    score = q.score_quality(before, table(spark, SF, "labels"))[0].where("predicted = 1")
    assert score.count() == after.count()

    before, after = made[names[1]]
    want = brute_lines([(r.doc_id, r.text, None) for r in before.collect()])
    got = after.collect()
    assert sorted([(r.doc_id, r.text) for r in got]) == sorted((i, t) for i, _, t in want)
    assert all(r.n_chars == len(r.text) for r in got)

    before, after = made[names[2]]
    groups = brute_similar({r.doc_id: r.text for r in before.collect()})
    kept, every = {r.doc_id for r in after.collect()}, set(groups.values())
    assert kept == every and after.exceptAll(before).count() == 0

    before, after = made[names[3]]
    rows = before.collect()
    size = {r.doc_id: len((r.text or "").split()) for r in rows}
    of, largest = {}, {}
    for r in rows:
        of[r.source] = of.get(r.source, 0) + size[r.doc_id]
        largest[r.source] = max(largest.get(r.source, 0), size[r.doc_id])
    target, taken, times = water_fill(of, (3, 1, 2)), {}, {}
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    for s, n in target.items():
        assert abs(taken.get(s, 0) - n) <= largest[s]

    before, after = made[names[4]]
    known = vocabulary(MODEL)
    texts = {r.doc_id: r.text for r in before.collect()}
    got = after.collect()
    first = [r for r in got if r["sample"] == 1]
    assert len(first) == before.count() and all(known.decode(r.ids) == texts[r.doc_id] for r in got)
    # Two segmentations of every text that has more than one, never the same.
    ids = {r.doc_id: r.ids for r in first}
    second = {r.doc_id: r.ids for r in got if r["sample"] == 2}
    assert len(got) - len(first) == sum(r.doc_id in second for r in first)
    assert all(ids[i] != x for i, x in second.items()) and all(len(texts[i]) < 2 for i in set(ids) - set(second))


def test_run_equals_stages_and_empty(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else table(spark, SF, "documents").limit(0)
