"""Sampled segmentations against enumerated lattices, and exact round trips."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimboscale.llm import pieces as P
from nimboscale.session import table


@pytest.fixture(scope="module")
def known():
    return P.vocabulary(P.MODEL)


def enumerate_text(known, text, alpha):
    """{ids: log p} of every segmentation of a short text."""
    s = " " + text
    memo = {len(s): [((), 0.0)]}
    for i in range(len(s) - 1, -1, -1):
        here = []
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in known.by_text:
                ids, w = (known.by_text[s[i:j]],), known.logp[known.by_text[s[i:j]]]
            elif j == i + 1:
                ids = tuple(known.byte[b] for b in s[i].encode())
                w = len(ids) * known.byte_logp
            else:
                continue
            here += [(ids + more, alpha * w + v) for more, v in memo[j]]
        memo[i] = here
    z = np.logaddexp.reduce([v for _, v in memo[0]])
    return {ids: v - z for ids, v in memo[0]}


def test_log_probabilities_and_distinctness(known):
    lat = P.Lattices(known, 0.3)
    texts = ["the cats.", "a\nb", "  two", "héé 漢", "x▁y", "a,b (c)", "Mr. X's e.g."]
    for text, samples in zip(texts, P.sample_texts(lat, texts, P.mixed(np.arange(len(texts), dtype=np.uint64)), 8)):
        every = enumerate_text(known, text, 0.3)
        assert len(samples) == min(8, len(every))
        seen = [tuple(s[0].tolist()) for s in samples]
        assert len(set(seen)) == len(seen)
        for ids, (_, logp, _, _) in zip(seen, samples):
            assert math.isclose(logp, every[ids], abs_tol=1e-7) and known.decode(ids) == text
        keys = [s[2] for s in samples]
        assert keys == sorted(keys, reverse=True)


def test_all_segmentations_of_a_small_lattice(known):
    lat = P.Lattices(known, 1.0)
    every = enumerate_text(known, "it", 1.0)
    (samples,) = P.sample_texts(lat, ["it"], np.array([5], np.uint64), 50)
    assert {tuple(s[0].tolist()) for s in samples} == set(every) and all(s[3] == 0.0 for s in samples)


def test_sampling_frequencies(known):
    """Firsts follow p; pairs follow draws without replacement; inclusion scores are unbiased."""
    lat = P.Lattices(known, 0.15)
    text, n = "it is", 12000
    every = enumerate_text(known, text, 0.15)
    got = P.sample_texts(lat, [text] * n, P.mixed(np.arange(n, dtype=np.uint64)), 2)
    first, second, weight = {}, {}, {}
    for (a, b) in got:
        ka, kb = tuple(a[0].tolist()), tuple(b[0].tolist())
        first[ka] = first.get(ka, 0) + 1
        second[kb] = second.get(kb, 0) + 1
        for k, s in ((ka, a), (kb, b)):
            weight[k] = weight.get(k, 0.0) + math.exp(s[1] - s[3])
    p = {k: math.exp(v) for k, v in every.items()}
    for k in every:
        want = sum(p[o] * p[k] / (1 - p[o]) for o in every if o != k)
        assert abs(first.get(k, 0) / n - p[k]) < 5 * math.sqrt(p[k] / n) + 1e-3
        assert abs(second.get(k, 0) / n - want) < 5 * math.sqrt(want / n) + 1e-3
    top = max(p, key=p.get)
    assert abs(weight[top] / n - p[top]) < 0.02 and abs(sum(weight.values()) / n - 1) < 0.05


def test_third_samples_follow_the_law(known):
    lat = P.Lattices(known, 0.1)
    n = 9000
    every = enumerate_text(known, "is", 0.1)
    p = {k: math.exp(v) for k, v in every.items()}
    third = {}
    for s in P.sample_texts(lat, ["is"] * n, P.mixed(np.arange(n, dtype=np.uint64)), 3):
        k = tuple(s[2][0].tolist())
        third[k] = third.get(k, 0) + 1
    for k in every:
        want = sum(p[a] * p[b] / (1 - p[a]) * p[k] / (1 - p[a] - p[b]) for a in p for b in p if len({a, b, k}) == 3)
        assert abs(third.get(k, 0) / n - want) < 5 * math.sqrt(want / n) + 1e-3


def test_table_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "no id"), (4, " \n\t x  y\r\n"), (5, "z" * 30000), (6, "long words " * 20000)]
    df = spark.createDataFrame([(i, t, "s", 2) for i, t in rows], "doc_id long, text string, ids string, sample int")
    out = P.sample_segmentations(df, k=2)
    got = [r for r in P.decode_ids(out).collect()]
    texts = dict(rows)
    assert all(r.decodes and r.decoded == (texts[r.doc_id] or "") for r in got)
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() and r.n_pieces == len(r.ids) for r in got)
    assert sorted((r.doc_id or 0, r["sample"]) for r in got) == [(0, 1), (0, 2), (1, 1), (2, 1), (3, 1), (3, 1), (3, 2), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2), (6, 1), (6, 2)]
    again = P.sample_segmentations(df.repartition(3), k=2)
    assert again.exceptAll(out).count() == 0
    assert P.sample_segmentations(df.limit(0)).count() == 0


def test_documents_decode(spark, sf):
    docs = table(spark, sf, "documents")
    out = P.op10_piece_samples(spark, sf)
    assert out.where(~F.col("decodes")).count() == 0 and out.count() == 2 * docs.count()


def test_one_endless_word_takes_bounded_memory():
    """A text of a million signs without a space or repetition, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from nimboscale.llm import pieces as P
v = P.vocabulary(P.MODEL)
lat = P.Lattices(v, 0.5)
text = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 1_000_000)))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
(a, b), = P.sample_texts(lat, [text], np.array([5], np.uint64), 2)
assert v.decode(a[0].tolist()) == text == v.decode(b[0].tolist()) and a[0].tolist() != b[0].tolist()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    root = str(__import__("pathlib").Path(P.__file__).parents[2])
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 300  # MB


@pytest.mark.parametrize("size", [4097, 8192, 20_000])
def test_long_words_across_seams(known, monkeypatch, size):
    """Segments with handed-over sums give the lattice, and the samples, of the word built whole."""
    rng = np.random.default_rng(size)
    letters = list("etaoinshrdlu漢é")
    word = "".join(letters[i] for i in rng.integers(0, len(letters), size))
    word = word[:4085] + "nationnationnation" + word[4103:]
    texts, seeds = [word, "beside it", word + " " + word], P.mixed(np.arange(3, dtype=np.uint64))
    cut = P.Lattices(known, 0.4)
    samples = P.sample_texts(cut, texts, seeds, 3)
    monkeypatch.setattr(P, "LONGEST", 60_000)
    whole = P.Lattices(known, 0.4)
    for a, b in zip(samples, P.sample_texts(whole, texts, seeds, 3)):
        assert len(a) == len(b) == 3
        for (ids, logp, key, inclusion), (ids_b, logp_b, key_b, inclusion_b) in zip(a, b):
            assert np.array_equal(ids, ids_b) and math.isclose(logp, logp_b, rel_tol=1e-9) and math.isclose(inclusion, inclusion_b, rel_tol=1e-6, abs_tol=1e-9)
    assert np.array_equal(cut.span, whole.span) and np.allclose(cut.logp, whole.logp, atol=1e-9) and np.allclose(cut.cum, whole.cum, atol=1e-9)
    # Pieces do span the seams.
    node = cut.source(np.arange(len(cut.span))) - cut.first_node[0]
    assert ((node < 4096) & (node + cut.span > 4096) & (node >= 0)).any()
