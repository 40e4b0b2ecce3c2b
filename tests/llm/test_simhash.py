"""SimHash groups against brute force, and the hierarchical index against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nimboscale.llm import simhash as sh
from nimboscale.session import table


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_groups_on_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = {r.doc_id: r for r in sh.simhash_groups(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(fps)
    for i, r in rows.items():
        assert int(r.fingerprint, 16) == fps[i] and len(r.fingerprint) == 16
        assert r.component_id == want[i]


def test_fingerprint_matches_builtin_hash(spark):
    text = "Älpha Beta gamma"
    h = spark.range(1).select(F.xxhash64(F.lit("Älpha beta gamma"))).first()[0]
    assert sh.fingerprint(text) == h


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (7, "alone here"), (7, "alone here"), (None, "alone here"), (None, "nobody else has this"), (11, "w " * 60000)]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, component_id int, _fp string")
    got = sorted([(r.doc_id, r.component_id) for r in sh.simhash_groups(df).collect()], key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (7, 7), (None, 7), (None, None), (11, 11)], key=str)
    kept = sh.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([3, 7, 11, None, None], key=str)
    assert sh.simhash_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [5, 40, 10**6])
def test_links_equal_all_pairs(spark, most):
    rng = np.random.default_rng(4)
    near = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(rng.integers(0, 2**64, 300, dtype=np.uint64).tolist())
    for centre in near.tolist():
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(1, 9)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in fps.items()], "_fp long, _rep long")
    links = [(r.src, r.dst) for r in sh.near_links(df, most=most).collect()]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 64 for a, b in links)
    want = brute_components(fps)
    got = {i: i for i in fps}
    from nimboscale.operators.graph import connected_components

    for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect():
        got[r.node] = r.component
    assert got == want


def test_deep_index_equals_all_pairs():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    flips = [rng.integers(0, 64, rng.integers(0, 12)) for _ in range(1500)]
    fps = np.unique(np.array([int(base) ^ int(sum({1 << int(b) for b in f})) for f in flips], np.uint64))
    forest = sh.Forest(len(fps))
    index = sh.GrayIndex(fps, sh.depth_for(len(fps)))
    assert len(index.every) > 2
    sh.search(index, index, 0, 3, forest)
    want = brute_components(dict(enumerate(fps.tolist())))
    assert [int(x) for x in forest.root] == [want[i] for i in range(len(fps))]
    # Two halves against each other, plus each half with itself, give the same.
    cut, other = len(fps) // 3, sh.Forest(len(fps))
    depth = sh.depth_for(len(fps))
    a, b = sh.GrayIndex(fps[:cut], depth), sh.GrayIndex(fps[cut:], depth)
    half = sh.Forest(len(fps) - cut)
    sh.search(b, b, 0, 3, half)
    sh.search(a, a, 0, 3, other)
    other.link(np.arange(cut, len(fps)), half.root + cut)
    sh.search(a, b, cut, 3, other)
    assert [int(x) for x in other.root] == [want[i] for i in range(len(fps))]


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_similar(texts, least=0.8):
    ids = sorted(texts)
    sets = {i: shingle_set(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for at in rng.integers(0, len(out), n):
        out[at] = f"edit{rng.integers(10**6)}"
    return " ".join(out)


def test_similar_groups_are_exact_inside_candidates(spark):
    rng = np.random.default_rng(8)
    texts, n = {}, 0
    for g in range(12):
        base = [f"w{rng.integers(3000)}" for _ in range(300)]
        for _ in range(6):
            texts[n] = edited(rng, base, int(rng.integers(0, 6)))
            n += 1
        texts[n] = edited(rng, base, 60)  # related, but far from alike
        n += 1
    for _ in range(40):
        texts[n] = " ".join(f"w{rng.integers(3000)}" for _ in range(200))
        n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.similar_groups(df).collect()}
    want = brute_similar(texts)
    assert got == want and len(set(want.values())) < n - 40


def test_chains_of_candidates_make_no_groups(spark, monkeypatch):
    """Fingerprints that lead from each text to the next join only what is alike."""
    rng = np.random.default_rng(31)
    base = [f"w{k}" for k in rng.integers(0, 3000, 200)]
    texts = {i: " ".join(f"w{k}" for k in rng.integers(0, 3000, 60)) for i in range(40)} | {50 + i: edited(rng, base, 2) for i in range(20)}

    def chained(hashes):
        return np.int64(int(hashes.min()) % 64 and (1 << (int(hashes.min()) % 60)) - 1)

    monkeypatch.setattr(sh, "majority", chained)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.similar_groups(df).collect()}
    assert got == {i: min(i, 50) if i >= 50 else i for i in texts}


def test_templated_texts(spark, monkeypatch):
    """Texts of the same sentences in any order: rows of the prefix join grow with the texts, not with their square."""
    rng = np.random.default_rng(32)
    sentences = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 15)) for _ in range(12)]
    rows = {}
    stored = sh.stored
    for n in (200, 800):
        texts = {i: " ".join(sentences[k] for k in rng.permutation(12)[:7]) for i in range(n)}
        sizes = {}

        def counted(df, tag, **more):
            out = stored(df, tag, **more)
            sizes[tag] = sizes.get(tag, 0) + (out.count() if tag == "prefix-rows" else 0)
            return out

        monkeypatch.setattr(sh, "stored", counted)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in sh.similar_groups(df).collect()}
        if n == 200:
            assert got == brute_similar(texts)
        rows[n] = sizes["prefix-rows"]
    assert rows[800] < 5 * rows[200]


def test_wide_links_reach_six_bits(spark):
    rng = np.random.default_rng(12)
    fps = set()
    for centre in rng.integers(0, 2**63, 40, dtype=np.uint64).tolist():
        for _ in range(6):
            x = centre
            for b in rng.choice(64, 6, replace=False):
                x ^= 1 << int(b)
            fps |= {centre, x}
    fps = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in fps.items()], "_fp long, _rep long")
    from nimboscale.operators.graph import connected_components

    got = {i: i for i in fps} | {r.node: r.component for r in connected_components(sh.wide_links(df, 6)).collect()}
    assert got == brute_components(fps, 6)


@pytest.mark.parametrize("share", [3, 400])
def test_similar_groups_beyond_the_reach_of_fingerprints(spark, share, monkeypatch):
    rng = np.random.default_rng(21)
    vocabulary = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    passage, texts = vocabulary(40), {}
    for g in range(60):
        base = vocabulary(300)
        # Likeness from 0.75 to 0.9, by a passage appended.
        texts[3 * g], texts[3 * g + 1] = " ".join(base), " ".join(base + vocabulary(int(rng.integers(33, 99))))
        texts[3 * g + 2] = " ".join(passage + vocabulary(100))
    base = " ".join(vocabulary(400))
    texts |= {1000: base, 1001: base + " -" * 500, 1002: " ".join(vocabulary(4)), 1003: "", 1004: " ", 1005: None}
    for i in range(8):  # few shingles: five of which four are shared, and pairs just short of that
        short = vocabulary(9)
        texts[1010 + 3 * i], texts[1011 + 3 * i], texts[1012 + 3 * i] = " ".join(short), " ".join(short[:8]), " ".join(short[:7])
    monkeypatch.setattr(sh.prefix_pairs, "__defaults__", (0.8, share))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.similar_groups(df).collect()}
    assert got == brute_similar(texts) and got[1001] == 1000


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    rng = np.random.default_rng(22)
    texts = {i: " ".join(f"w{k}" for k in rng.integers(0, 3000, 60)) for i in range(12)}
    texts |= {20: texts[3].upper().replace(" ", "\n"), 21: texts[7] + " end"}  # a copy but for case and space; a near copy of another
    monkeypatch.setattr(sh, "majority", lambda hashes: 5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.similar_groups(df).collect()}
    assert got == {i: {20: 3, 21: 7}.get(i, i) for i in texts}


def test_repeated_ids_with_different_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "another text of a few words only")
    rows = [(1, a), (1, b), (2, b), (3, a), (3, a), (4, c), (4, c), (None, a), (None, None), (5, None), (5, ""), (6, " ")]
    df = spark.createDataFrame([(i, t, "x", b"r") for i, t in rows], "doc_id long, text string, _own string, _raw binary")
    kept = sh.drop_near_copies(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str)
    assert [x for x in got if x != (5, None) and x != (5, "")] == sorted([(0, None), (0, a), (1, a), (1, b), (4, c)], key=str)
    assert sum(i == 5 for i, _ in got) == 1
    groups = {(r.doc_id, r.component_id) for r in sh.similar_groups(df).collect()}
    assert groups == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None), (5, 5), (6, 5)}


@pytest.mark.parametrize("bands,kept", [(4, 1), (5, 2), (6, 3)])
def test_longer_keys_find_the_same(spark, bands, kept):
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 2**63, 200, dtype=np.uint64).tolist())
    for centre in rng.integers(0, 2**63, 30, dtype=np.uint64).tolist():
        x = centre
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
        fps |= {centre, x}
    fps = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in fps.items()], "_fp long, _rep long")
    from nimboscale.operators.graph import connected_components

    for most in (6, 10**6):
        links = sh.band_links(df, 3, bands, kept, most)
        got = {i: i for i in fps} | {r.node: r.component for r in connected_components(links).collect()}
        assert got == brute_components(fps)


def test_keys_grow_with_the_table():
    plans = ((4, 1), (5, 2), (6, 3))
    assert [sh.key_bands(n, plans) for n in (10**6, 10**9, 10**12)] == [(4, 1), (5, 2), (6, 3)]
    # Random fingerprints a top node at 10**10, and rows a fingerprint: bounded without splitting.
    bands, kept = sh.key_bands(10**10, plans)
    assert 10**10 / 2 ** (64 * kept // bands) <= sh.NODE and len(list(sh.combinations(range(bands), kept))) == 10


def test_shingle_sets_tell_orders_and_lengths_apart():
    known = sh.WordHashes()
    of = lambda t: sh.shingle_set(sh.lowered_words(t), known, 5)
    assert len(of("a b c d e f g")) == 3 and len(of("")) == 0 and len(of("a b")) == 1
    assert len({int(of(t)[0]) for t in ("a b c d e", "b a c d e", "a b c d", "a b", "b a", "a", "a a", "A a a")}) == 7 + 1
