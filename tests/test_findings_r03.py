"""Cases that round 3's findings named: each failed before its mend."""

from __future__ import annotations

import random


def test_window_alerts_need_a_pixel_of_the_issue_in_the_windows(spark):
    from nimboscale.operators.products import window_alerts

    rng = random.Random(5)
    px = {(f, y, x): rng.random() for f in range(6) for y in range(9) for x in range(11)}
    px = {k: v for k, v in px.items() if not (k[0] == 3 and k[1] > 3)}  # a frame in part
    points = [("a b", 2, 2), ("a b", 8, 10), ("c", 8, 10), ("d", -1, 12), ("c2", 8, 10), ("e", 40, 40)]
    best = {}
    for (f, y, x), v in px.items():
        for place, py, px_ in points:
            if abs(py - y) <= 1 and abs(px_ - x) <= 1:
                best[f, place] = max(best.get((f, place), -1.0), v)
    want = {}
    for issue, place in best:
        for lead in (2, 1):
            if best.get((issue + lead, place), -1.0) >= 0.8:
                want[issue, place] = (lead * 30, best[issue + lead, place], f"t/{issue}/L{lead * 30}#{place.replace(' ', '-')}")
    rows = spark.createDataFrame([(*k, v) for k, v in px.items()], "frame int, y int, x int, p double")
    got = window_alerts(spark.createDataFrame(points, "place string, y int, x int"), rows, "p", 1, [1, 2], 0.8, "t").collect()
    assert want and {(r.issue, r.place): (r.lead_min, r.p_max, r.alert_id) for r in got} == want
    assert len(got) == len(want)


def embeddings(spark, folder, vectors: dict[int, list[float]]) -> str:
    rows = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    rows.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_cold_area_of_frames_in_part_and_after_gaps(spark, tmp_path):
    from nimboscale.plans.raster_queries import cold_area_argmax_frame

    # Frames 0, 1, 4 and 6 of one row each, with 2, 3, 5 and 1 cold pixels.
    at = {0: 2, 1: 3, 4: 5, 6: 1}
    sf_dir = embeddings(spark, tmp_path / "t", {f * 50: [-1.0] * n + [0.0] * (64 - n) for f, n in at.items()})
    got = {r.frame: r for r in cold_area_argmax_frame(spark, sf_dir).collect()}
    assert {f: round(r.cold_frac * 3200) for f, r in got.items()} == at
    assert {f: None if r.change is None else round(r.change * 3200) for f, r in got.items()} == {0: None, 1: None, 4: 3, 6: -2}
    assert [f for f, r in got.items() if r.largest] == [4]


def test_features_of_one_row_are_numbered_from_left_to_right(spark):
    from nimboscale.operators.regions import detect

    rng = random.Random(3)
    px = [(f, 46, x, -rng.random() - 0.1) for f in range(150) for part in (5, 25, 45) for x in range(part, part + 5)]
    found = detect(spark.createDataFrame(px, "frame int, y int, x int, v double").repartition(7), [-0.05], 4).collect()
    order = {}
    for r in sorted(found, key=lambda r: (r.frame, r.feature)):
        order.setdefault(r.frame, []).append(r.cx)
    assert len(order) == 150 and all(len(c) == 3 and c == sorted(c) for c in order.values())


def test_scattered_links_over_more_frames_than_rows_may_be_late(spark, tmp_path):
    from nimboscale.plans.kernel_queries import scattered_links

    # A tile of 8 columns has one pixel, so whole features come in the last batch only.
    cold = [-1.0 if x % 8 == 1 else 0.0 for x in range(64)]
    frames = (*range(4), *range(1600, 1604))
    got = scattered_links(spark, embeddings(spark, tmp_path / "t", {f * 50: cold for f in frames})).collect()
    assert sorted((r.event, r.frame, r.cell) for r in got) == sorted((f"e{f // 8}", f, cell) for f in frames for cell in range(1, 9))
    assert not any(r.late for r in got)


def test_bilinear_exchanges_the_raster_not_targets_times_frames(spark):
    from nimboscale.operators.raster import bilinear

    rng = random.Random(7)
    px = {(f, y, x): rng.choice([None, rng.random()]) for f in range(2) for y in range(4) for x in range(5)}
    targets = [(k, rng.uniform(-1.5, 4.5), rng.uniform(-1.5, 5.5)) for k in range(400)] + [(400, 1.0, 2.0), (401, 3.0, 4.0)]
    want = {}
    for f in range(2):
        for k, fy, fx in targets:
            y, x = int(fy // 1), int(fx // 1)
            w = {(a, b): ((fy - y) if a else 1 - (fy - y)) * ((fx - x) if b else 1 - (fx - x)) for a in (0, 1) for b in (0, 1)}
            met = [(w[a, b], px.get((f, y + a, x + b))) for a, b in w if w[a, b] > 0 and px.get((f, y + a, x + b)) is not None]
            if met:
                total = sum(m[0] for m in met)
                want[f, k] = round(sum(a * v for a, v in met) / total, 9) if total >= 0.5 else None
    rows = spark.createDataFrame([(*k, v) for k, v in px.items()], "frame int, y int, x int, v double")
    out = bilinear(rows, spark.createDataFrame(targets, "target int, fy double, fx double"))
    assert {(r.frame, r.target): r.v if r.v is None else round(r.v, 9) for r in out.collect()} == want
    # Nothing is grouped by target.
    assert "target" not in "".join(part for part in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in part)


def test_nearest_place_of_dense_places_at_shared_spots(spark, monkeypatch):
    from pyspark.sql import functions as F

    from nimboscale.functions.scalars import haversine_km
    from nimboscale.operators import products

    asked, search = [], products._nearest_within
    monkeypatch.setattr(products, "_nearest_within", lambda points, spots, by, km, sphere: (asked.append((spots.count(), km)), search(points, spots, by, km, sphere))[1])

    rng = random.Random(9)
    spots = [(rng.uniform(20, 21), rng.uniform(70, 71)) for _ in range(150)] + [(-60.0, 179.99), (-60.0, -179.99), (30.0, 100.0)]
    places = [(f"p{i}", i, *rng.choice(spots)) for i in range(900)] + [(f"s{i}", 1000 + i, *s) for i, s in enumerate(spots)]
    points = [(i, i % 7, rng.uniform(19.5, 21.5), rng.uniform(69.5, 71.5)) for i in range(300)] + [(400, 0, -60.0, 180.0), (401, 0, 30.3, 100.2), (402, 0, 30.6, 100.0), (403, 0, None, 1.0)]
    p, q = spark.createDataFrame(places, "place string, place_id int, lat double, lon double"), spark.createDataFrame(points, "cell int, frame int, lat double, lon double")
    every = q.crossJoin(p.selectExpr("place", "place_id", "lat AS a", "lon AS b")).withColumn("km", haversine_km(*[F.col(c) for c in ("lat", "lon", "a", "b")]))
    want = {}
    for r in every.where("km <= 50").collect():
        want[r.cell, r.frame] = min(want.get((r.cell, r.frame), (99.0, 0, "")), (r.km, r.place_id, r.place))
    got = products.nearest_place(q, p, ["cell", "frame"], 50.0, sphere=True).collect()
    assert {(r.cell, r.frame): (r.km, r.place) for r in got} == {k: (v[0], v[2]) for k, v in want.items()} and len(got) == len(want) > 100
    # Places at one spot are one candidate, and the first searches are narrower than the radius.
    assert {n for n, _ in asked} == {len(spots)} and [km for _, km in asked][-1] == 50.0 and len(asked) > 1


def test_predictors_pass_their_boxes_in_two_exchanges_a_table(spark):
    from nimboscale.operators.kernels import issue_features

    px = spark.range(0).selectExpr("1 AS frame", "1 AS y", "1 AS x", "0.5D AS v")
    moved = spark.range(0).selectExpr("1 AS issue", "1 AS lead", "1 AS y", "1 AS x", "0.5D AS forecast", "0.5D AS tendency", "0.5D AS speed")
    plan = issue_features(px, moved, -0.1)._jdf.queryExecution().analyzed().toString()
    assert sum(part.strip(" :+-").startswith("Window ") for part in plan.split("\n")) <= 4


def test_link_costs_find_subnets_once(spark, tmp_path, monkeypatch):
    from nimboscale.operators import kernels, regions
    from nimboscale.plans import region_queries

    cold = [-1.0 if x in (3, 4, 5, 6, 30, 31, 32, 33) else 0.0 for x in range(64)]
    sf_dir = embeddings(spark, tmp_path / "t", {f * 50 + f: cold for f in range(4)})
    calls = []
    for module in (kernels, regions, region_queries):
        if hasattr(module, "connected_components"):
            one = module.connected_components
            monkeypatch.setattr(module, "connected_components", lambda *a, one=one: (calls.append(1), one(*a))[1])
    got = {r.frame: (r.subnets, r.parents, r.cost) for r in region_queries.optimal_link_costs(spark, sf_dir).collect()}
    assert got == {f: (2, 2, 2.0) for f in range(3)}
    # One for the regions, one for the subnets.
    assert len(calls) == 2


def test_cell_bootstrap_returns_the_interval_of_as_many_draws_as_cells(spark):
    import hashlib

    from nimboscale.operators.resample import drawn_sums
    from nimboscale.plans import registry, score_queries  # noqa: F401

    units = [(k, float(k * k), 1.0) for k in range(7)]
    want = [sum(units[int(hashlib.md5(f"4:{rep * 7 + j}".encode()).hexdigest()[:12], 16) % 7][1] for j in range(7)) for rep in range(30)]
    got = drawn_sums(spark.createDataFrame(units, "unit long, a double, b double"), ["a", "b"], 30, 4).orderBy("rep").collect()
    assert [r.a for r in got] == want and {r.b for r in got} == {7.0}
    assert all(f"AS {c}" in registry.ORACLES["cell_bootstrap_ar1"] for c in ("low", "mid", "high"))


def test_piece_query_returns_the_segmentations_themselves(spark, sf):
    import hashlib

    import numpy as np

    from nimboscale.llm.pieces import op10_piece_samples
    from nimboscale.session import table

    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    known = __import__("sentencepiece").SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    got = op10_piece_samples(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        plain = b"".join(bytes([int(p[3:5], 16)]) if known.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, known.id_to_piece(i)) for i in r.ids))
        assert plain.decode()[1:] == texts[r.doc_id] and len(r.ids) == r.n_pieces
        assert hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() == r.ids_sha256


def test_shared_shingles_take_one_exchange(spark, monkeypatch):
    import nimboscale.llm.simhash as sh

    plans, real = {}, sh.stored

    def stored(df, tag, release=False):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, tag, release)

    monkeypatch.setattr(sh, "stored", stored)
    classes = spark.createDataFrame([(1, 4, [6, 5], [0] * 8), (2, 4, [6, 7], [0] * 8), (3, 9, [8], [0] * 8)], "_class long, _n long, _prefix array<long>, _odd array<long>")
    found = sh.prefix_pairs(classes, spark.createDataFrame([], "_class long, _group long"), 0.8).collect()
    assert [(r._a, r._b) for r in found] == [(1, 2)]
    assert plans["shared-shingles"].count("Exchange hashpartitioning(_h") == 1 and "hashpartitioning(_h#" in plans["shared-shingles"]
    assert "_group" not in plans["shared-shingles"].split("hashpartitioning(")[1].split(")")[0]


def test_components_of_chains_take_few_rounds(spark, monkeypatch):
    import nimboscale.operators.graph as graph

    tags, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, tag, release=False: (tags.append(tag), real(df, tag, release))[1])
    ids = list(range(2000))
    random.Random(3).shuffle(ids)
    pairs = [(a, b) for a, b in zip(ids, ids[1:]) if a % 5] + [(7000, 7000), (None, 5), (9000, 8000)]
    parent = {i: i for i in [*ids, 7000, 8000, 9000]}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    want = {i: top(i) for pair in pairs if None not in pair for i in pair}
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for held in (1 << 19, 1):  # chains within a task; hardly any
        monkeypatch.setattr(graph, "HELD_EDGES", held)
        tags.clear()
        got = graph.connected_components(edges).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want
        assert held == 1 or "components" not in tags
    named = edges.selectExpr("concat('n', lpad(cast(src AS string), 5, '0')) AS src", "concat('n', lpad(cast(dst AS string), 5, '0')) AS dst").where("src IS NOT NULL")
    assert {r.node: r.component for r in graph.connected_components(named).collect()} == {f"n{a:05}": f"n{b:05}" for a, b in want.items()}


def test_band_tables_share_one_expression(spark, monkeypatch):
    from itertools import combinations

    import nimboscale.llm.simhash as sh

    held = []
    monkeypatch.setattr(sh, "_indexed", lambda entries, width, radius, most: held.append((entries, width)))
    rng = random.Random(9)
    fps = [0, -1, 1, -(1 << 63), *(rng.getrandbits(64) - (1 << 63) for _ in range(20))]
    classes = spark.createDataFrame([(x, i) for i, x in enumerate(fps)], "_fp long, _rep long")
    for bands, kept in ((4, 1), (5, 2), (6, 3), (8, 2)):
        sh.band_links(classes, 3, bands, kept)
        entries, width = held.pop()
        cuts = [64 * i // bands for i in range(bands + 1)]
        want = {}
        for k, chosen in enumerate(combinations(range(bands), kept)):
            for i, x in enumerate(fps):
                bits = "".join(f"{(x >> cuts[b]) & ((1 << cuts[b + 1] - cuts[b]) - 1):0{cuts[b + 1] - cuts[b]}b}" for b in [*chosen, *(b for b in range(bands) if b not in chosen)])
                want[i, k] = int(bits, 2) - (1 << 64) * (bits[0] == "1")
        assert {(r._rep, r._band): r._rotated for r in entries.collect()} == want
        assert entries._jdf.queryExecution().optimizedPlan().toString().count("shiftleft") <= bands
