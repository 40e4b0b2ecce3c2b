"""Suffix dedup against comparing every string of every pair of documents."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from nimboscale.llm import suffixes
from nimboscale.llm.suffixes import OP13_SQL, RunIndex, anchor_runs, drop_earlier_strings, op13_suffix_dedup


def brute(rows, length):
    """(n_bytes, n_removed, n_spans, kept) by row."""
    texts = [(t or "").encode() for _, t in rows]
    least: dict[bytes, object] = {}
    for (i, _), t in zip(rows, texts):
        for a in range(len(t) - length + 1 if i is not None else 0):
            s = t[a : a + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1 if i is not None else 0):
            if least[t[a : a + length]] < i:
                gone[a : a + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_matching_statistics_of_any_text():
    rng = random.Random(1)
    for alphabet, length in (("ab", 6), ("abcdé", 5), ("a", 9), ("abcdefgh", 20)):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(length, 60))).encode() for _ in range(20)]
        texts += texts[:4] + [texts[0][3:] + texts[1]]
        lanes = [t for t in texts] + ["".join(rng.choice(alphabet + "z") for _ in range(80)).encode() for _ in range(12)]
        index = RunIndex(texts, length)
        assert len(index.run_start) < sum(map(len, texts))
        for lane, place, long, row in index.stream(lanes):
            for i, a, n, r in zip(lane, place, long, row):
                rest = lanes[i][a : a + length]
                assert n == max(m for m in range(len(rest) + 1) if any(rest[:m] in t for t in texts))
                if n == length:
                    first = next(k for k, t in enumerate(texts) if rest in t)
                    assert index.text[index.sample[index.group[r]]] == first


def test_anchors_follow_content():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    twice = np.concatenate([data, data[500:900], data])
    ends = np.array([3000, 3400, 6400])
    by_string: dict[bytes, set] = {}
    seen = 0
    for anchor, text, start, strings in zip(*anchor_runs(twice, ends, 20)):
        assert start + strings + 19 <= ends[text]
        seen += strings
        for a in range(start, start + strings):
            by_string.setdefault(twice[a : a + 20].tobytes(), set()).add(int(anchor))
    assert seen == 2 * 2981 + 381 and all(len(x) == 1 for x in by_string.values())


@pytest.mark.parametrize("hot", [None, 300])
def test_against_all_strings(spark, monkeypatch, hot):
    if hot:
        # Everything is hot: keys are split by anchor, and anchors by string.
        monkeypatch.setattr(suffixes, "HOT_BYTES", hot)
        monkeypatch.setattr(suffixes, "BATCH_BYTES", 700)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        if i % 4 == 1:
            near = rows[rng.randrange(len(rows))][1]
            at = rng.randrange(len(near) + 1)
            text = near[:at] + rng.choice(["", "X", "yz"]) + near[at + 1 :]
        rows.append((rng.randrange(10_000), text))
    rows += [(20_000, None), (5, ""), (6, "short"), (None, passage), (None, passage), (7, "a" * 400), (8, "a" * 300 + "b" * 300), (9, "ab" * 200), (3, passage + passage), (10_001, rows[0][1]), (10_001, rows[0][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in drop_earlier_strings(df).collect()), key=str)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute(rows, 50))), key=str)
    assert got == want
    assert any(w[3] > 1 for w in want)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.sql(OP13_SQL).fetchall())
    got = sorted(tuple(r) for r in op13_suffix_dedup(spark, sf).collect())
    assert got == want and any(r[2] for r in got)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_earlier_strings(empty).count() == 0
    df = spark.createDataFrame([("b", "x" * 60), ("a", "y" + "x" * 60), (None, "x" * 60)], "doc_id string, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in drop_earlier_strings(df).collect()}
    assert got["b"] == (60, 1, hashlib.sha256(b"").hexdigest()) and got["a"][0] == 0 and got[None][0] == 0
