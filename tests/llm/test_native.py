"""Line dedup, URL rules, mixing and fingerprints against brute force and edge cases."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from nimboscale.llm import fingerprints as fp
from nimboscale.llm.lines import drop_repeated_lines
from nimboscale.llm.mixing import mix_sources, mixed_documents, op2_source_mix
from nimboscale.llm.url_rules import judge_urls

DOC = "doc_id long, text string, source string, _hash string, target string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOC)


def brute_lines(rows):
    held = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            k = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
            if i is not None and len(k) >= 10:
                held.setdefault(k, set()).add(i)
    out = []
    for i, t, _ in rows:
        keep = []
        for line in (t or "").split("\n"):
            k = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
            if not (i is not None and len(held.get(k, ())) > 1 and min(held[k]) != i):
                keep.append(line)
        out.append((i, len((t or "").split("\n")), "\n".join(keep)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    rows = [
        (1, "Shared line here\nown\n\tSHARED LINE HERE \nÉtat commun là\n", "a"),
        (2, "shared line here\n\nshort\nétat commun là\nÉtat commun là", "a"),
        (3, None, None), (4, "", "b"), (5, "Shared line here", "b"), (5, "Shared line here\nother stuff of five", "b"),
        (None, "shared line here", "b"), (6, " shared line here", "c"), (7, "x" * 50000 + "\nshared LINE here\nshort\nshort", None),
    ]
    got = drop_repeated_lines(docs_of(spark, rows))
    assert {"_hash", "target"} <= set(got.columns)
    got = sorted([(r.doc_id, r.n_lines, r.kept_text) for r in got.collect()], key=str)
    assert got == brute_lines(rows)
    assert drop_repeated_lines(docs_of(spark, [])).count() == 0


def test_lines_with_more_documents(spark):
    rows = [(i, "a line of two" if i < 2 else "a line of three docs", "s") for i in range(5)]
    got = {r.doc_id: r.n_dropped for r in drop_repeated_lines(docs_of(spark, rows), min_docs=3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.net/en/x?q", "http://example.net/de/", "http://net/", "http://x.net", "http://net-x/", "ftp://b.example.com/de/q#f",
            "http://example.com/en/", "http://z.org/fr/1", "http://org/frx", None, "no scheme net/", "http://", "http://x.net:80/", "http://notexample.com/de/", "http://q.net?/a"]
    df = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, label int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/", "net/", "block")
    assert got[2] == ("net", "/", "net/", "block")
    assert got[3] == ("x.net", "", None, "allow")
    assert got[4][2] is None and got[12][2] is None and got[13][2] is None and got[14][2] is None
    assert got[5] == ("b.example.com", "/de/q", "example.com/de/", "block")
    assert got[6][3] == "allow" and got[7][2] == "org/fr/" and got[8][2] is None
    assert got[9] == ("", "", None, "allow") and got[10][:2] == ("", "") and got[11][:2] == ("", "")
    assert len(got) == len(urls)
    assert judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in judge_urls(df, rules=()).collect()} == {"allow"}


def water_fill(sizes, weights, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free:
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if part[s] > most * sizes[s]}
        if not over:
            return target | part
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mix_targets_and_budgets(spark):
    rows = [(i, " ".join(["word"] * (1 + i * 7 % 23)), "abcd"[min(3, i // 40 // (1 + i % 2))]) for i in range(300)]
    rows += [(1000, None, "z"), (1001, " \t", None), (1002, "one two", None), (5, "repeated id", "a"), (None, "no id", "b")]
    got = mix_sources(docs_of(spark, rows), slices=2).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_fill(sizes, (3, 1, 2))
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    again = mix_sources(docs_of(spark, rows).repartition(7), slices=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_sources(docs_of(spark, [])).count() == 0
    whole = mixed_documents(docs_of(spark, rows))
    assert whole.columns == docs_of(spark, rows).columns and whole.count() > len(rows)


def test_mix_prefers_quality(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 8.0).otherwise(1.0).alias("q"))
    got = mix_sources(df, weight_col="q", share=0.25).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    n = {r.odd: r.n for r in got}
    assert n[0] + n[1] == 1000 and n[0] > 5 * n[1]


def test_mix_on_table(spark, sf):
    assert op2_source_mix(spark, sf).where("taken > 2 * size").count() == 0


def test_fingerprints_match_brute_force(spark):
    texts = {1: "a b c d e f g " * 30, 2: None, 3: "", 4: "one two", 7: "Ä é " * 40, 9: "one two", 20: "long " * 30000, 5000: "a b c d e f g " * 30}
    df = docs_of(spark, [(i, t, "s") for i, t in texts.items()])
    got = {r.doc_id: r for r in fp.fingerprint_edits(df).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[1].fingerprint == got[5000].fingerprint and got[4].fingerprint == got[9].fingerprint
    assert got[2].fingerprint == "" and got[2].near_next == 1.0 and got[3].near_next == 0.0
    assert fp.fingerprint_edits(df.limit(0)).count() == 0


def test_next_crosses_buckets_and_clusters(spark, monkeypatch):
    ids = [3, 5, 4000, 4001, 10**15, 10**15 + 1, None]
    df = docs_of(spark, [(i, f"t{i}", "s") for i in ids]).select("doc_id", "text")
    want = {None: "t3", 3: "t5", 5: "t4000", 4000: "t4001", 4001: f"t{10**15}", 10**15: f"t{10**15 + 1}", 10**15 + 1: "tNone"}
    assert {r.doc_id: r._next_text for r in fp.with_next(df, "doc_id", {}, ["text"]).collect()} == want
    monkeypatch.setattr(fp, "AIM_ROWS", 1)
    monkeypatch.setattr(fp, "CROWDED", 1)
    assert {r.doc_id: r._next_text for r in fp.with_next(df, "doc_id", {}, ["text"]).collect()} == want


def test_sketch_estimates(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = words[:2000], words[500:2500]
    df = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(words[:1002]), " ".join(words[998:2000]))], "a string, b string, p string, q string")
    s = df.select(*[fp.sketch(F.col(c)).alias(c) for c in df.columns])
    r = s.select(
        fp.resemblance(F.col("a"), F.col("b")).alias("j"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.distinct_shingles(F.col("a")).alias("n"),
        (fp.merged(F.col("p"), F.col("q")) == F.col("a")).alias("same"), (fp.from_text(fp.as_text(F.col("a"))) == F.col("a")).alias("back"),
    ).first()
    assert r.j == pytest.approx(1496 / 2496, abs=0.13) and r.c == pytest.approx(0.75, abs=0.16) and r.n == pytest.approx(1996, rel=0.3)
    assert r.same and r.back
    parts = s.select(F.lit(1).alias("g"), F.explode(F.array("p", "q")).alias("sketch"))
    assert fp.merge_sketches(parts, ["g"]).first().sketch == s.first().a


def test_next_of_far_apart_ids(spark, monkeypatch):
    ids = [-(2**63), -(2**63) + 1, -5, 0, 7, 7 + 2**40, 2**63 - 2, 2**63 - 1]
    df = docs_of(spark, [(i, f"t{i}", "s") for i in ids]).select("doc_id", "text")
    want = {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}
    for aim in (500, 2, 1):
        monkeypatch.setattr(fp, "AIM_ROWS", aim)
        monkeypatch.setattr(fp, "CROWDED", 1)
        assert {r.doc_id: r._next_text for r in fp.with_next(df, "doc_id", {}, ["text"]).collect()} == want


def test_clustered_ids_stay_in_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(fp, "AIM_ROWS", 50)
    df = spark.range(3000).unionByName(spark.range(2**62, 2**62 + 2000)).unionByName(spark.range(50).select((F.col("id") * 2**56).alias("id")))
    out, found = fp._buckets(df, "id")
    sizes = [r["count"] for r in out.groupBy("_bucket").count().collect()]
    assert sum(sizes) == 5050 and max(sizes) <= 200 and found.count() == len(sizes)


def test_low_weights_fill_no_slice(spark, monkeypatch):
    from nimboscale.llm import mixing

    monkeypatch.setattr(mixing, "SLICE_ROWS", 100)
    df = spark.range(20_000).select(F.col("id").alias("d"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"))
    slices = mixing.slices_for(20_000)
    for w in (1.0, 0.1, 0.0):
        rows = mixing.keyed(df, "d", F.lit(w), 3).withColumn("_s", F.floor(F.ln("_key") * slices))
        assert rows.groupBy("_s").count().agg(F.max("count")).first()[0] < 160


def brute_take(rows, targets):
    """The documents in the order of their keys, until the target is met to the word."""
    out = {}
    for s in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0]))
        size = sum(r[2] for r in own)
        epochs = int(targets[s] // size) if size else 0
        left = int(targets[s] - epochs * size)
        for i, _, n, _ in own:
            out[i] = epochs * n + min(n, left)
            left -= min(n, left)
    return out


def test_mix_takes_the_least_keys(spark):
    from nimboscale.llm import mixing

    rows = [(i, " ".join(["word"] * (1 + i * 7 % 23)), "abc"[i % 3 if i < 90 else 0]) for i in range(400)]
    df = docs_of(spark, rows)
    got = {r.doc_id: r.taken for r in mix_sources(df, slices=5).collect()}
    size = mixing.text_size(F.col("text"))
    keys = mixing.keyed(df.withColumn("size", size), "doc_id", mixing.text_weight(F.col("text"), F.col("size")), 17)
    keys = [(r.doc_id, r.source, r["size"], r._key) for r in keys.collect()]
    sizes = {s: sum(k[2] for k in keys if k[1] == s) for s in "abc"}
    assert got == brute_take(keys, water_fill(sizes, (3, 1, 2)))


def test_mix_rows_without_ids(spark):
    df = docs_of(spark, [(None, f"no id {i}", "a") for i in range(5)] + [(i, "some words here", "a") for i in range(20)])
    n = {r.doc_id is None: r["count"] for r in mixed_documents(df).groupBy("doc_id").count().collect() if r.doc_id is None}
    assert n.get(True, 0) in (0, 5, 10)


def brute_sketch(text, k=128, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_likeness_against_all_shingles(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(base), 2: " ".join(base[:40] + ["x"] * 3 + base[40:]), 3: " ".join(base[20:]), 4: "w1 w2", 5: "w1 w2"}
    df = docs_of(spark, [(i, t, "s") for i, t in texts.items()])
    got = {r.doc_id: r for r in fp.fingerprint_edits(df).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, nxt = texts[i], texts[j]
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        a, b, e = (brute_sketch(x) for x in (t, nxt, edited))  # fewer than k shingles: the estimates are exact
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b)) and got[i].near_edited == pytest.approx(len(a & e) / len(a | e))
        assert len(got[i].fingerprint) == 16 * len(a) and got[i].distinct_shingles == len(a)


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[2], max(fit)[3]) if fit else (None, "allow")))


def test_random_rules_and_urls(spark):
    import random

    r = random.Random(11)
    label = lambda: r.choice(["a", "b", "ab", "a-b", "net", "co", "x1"])
    host = lambda n: ".".join(label() for _ in range(r.randint(1, n)))
    path = lambda: "/" + "/".join(r.choice(["", "p", "pq", "q"]) for _ in range(r.randint(0, 2)))
    rules = list({(host(3), path()): r.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, a) for (h, p), a in rules]
    # Rules of equal text fit with the longer host; brute force goes by that too.
    urls = [r.choice(["http://", "https://", "", "x://"]) + r.choice([host(4), host(4).upper()]) + r.choice(["", path(), path() + "?a/b", "#" + label()]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for part_rows in (1, 7, 10**6):
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in judge_urls(df, rules=rules, part_rows=part_rows).collect()}
        assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}


def test_copies_of_boundaries_stay_below_the_urls(spark):
    """A hot label is dealt over many parts, rare ones are not, and boundaries are never more than URLs."""
    from nimboscale.llm import url_rules as u

    rules = [(f"h{i}.com", "/", "block") for i in range(20)] + [(f"r{i}", "/", "block") for i in range(300)]
    urls = [f"http://h{i % 40}.com/{i}" for i in range(3000)] + [f"http://x.r{i}/" for i in range(5)] + ["http://free.org/"] * 500 + [None, "no url"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    parts = {r.label: r.parts for r in u.label_parts(df, u.rule_boundaries(spark, rules), "url", 10).collect()}
    assert parts == {"com": 75}
    clash = df.selectExpr("page_id", "url", "'a' as _key", "'b' as label", "'c' as parts", "'d' as _label")
    out = u.judge_urls(clash, rules, part_rows=10)
    assert set(clash.columns) <= set(out.columns) and {r._key + r.label + r.parts + r._label for r in out.collect()} == {"abcd"}
    assert out.where("verdict = 'block'").count() == sum(int(x[8:].split(".")[0]) < 20 for x in urls[:3000]) + 5
