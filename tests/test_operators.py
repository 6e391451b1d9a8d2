"""Operators against plain Python on small inputs, with the edge cases the tables lack."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import geometry, hashing, scalars
from granary.operators import checks, detection, graph, leakage, pairs, sessions, splits
from granary.sources import readers, writers
from granary.streaming import sessions_by_gap


def boxes(spark, rows, name):
    kind = f"image int, {name} int, cls string, " + ("conf double, " if name == "det" else "") + "box struct<x1:double,y1:double,x2:double,y2:double>"
    return spark.createDataFrame(rows, kind)


def loop_matches(det, gt, overlap):
    """The sequential rule: falling confidence, best box of the class, no second choice."""

    def iou(a, b):
        w, h = max(min(a[2], b[2]) - max(a[0], b[0]), 0), max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    taken, out = set(), set()
    for image, d, cls, _, box in sorted(det, key=lambda x: (-x[3], x[1])):
        best = max(((iou(box, g[3]), -g[1]) for g in gt if g[0] == image and g[2] == cls), default=(0, 0))
        if best[0] >= overlap and -best[1] not in taken:
            taken.add(-best[1])
            out.add((d, -best[1]))
    return out


def test_matching_equals_loop(spark):
    rng = random.Random(3)
    box = lambda: (x := rng.randint(0, 6), y := rng.randint(0, 6), x + rng.randint(4, 8), y + rng.randint(4, 8))
    box = lambda f=box: tuple(float(v) for v in f())
    gt = [(rng.randint(0, 5), k, rng.choice("ab"), box()) for k in range(60)]
    det = [(rng.randint(0, 6), k, rng.choice("ab"), rng.choice([0.2, 0.5, 0.5, 0.9]), box()) for k in range(90)]
    got = detection.matches(boxes(spark, det, "det"), boxes(spark, gt, "gt"), [0.5])
    assert {(r["det"], r["gt"]) for r in got.collect()} == loop_matches(det, gt, 0.5)


def test_average_precision_edges(spark):
    one = (0.0, 0.0, 4.0, 4.0)
    gt = boxes(spark, [(1, 1, "a", one), (2, 2, "b", one)], "gt")
    det = boxes(spark, [(1, 1, "a", 0.9, one), (1, 2, "a", 0.9, one)], "det")
    ap = {r["cls"]: r["ap"] for r in detection.ap_by_class(det, gt, [0.5]).collect()}
    assert ap == {"a": 1.0, "b": 0.0}
    assert detection.ap_by_class(det.limit(0), gt, [0.5]).agg(F.max("ap")).first()[0] == 0


@pytest.mark.parametrize("rows_a_block", [3, 8192])
def test_weights_equal_repetition(spark, rows_a_block):
    rows = [(c, 10 * n + k, (k * 7 % 10) / 10, k % 3 == 0, k % 4) for n, c in enumerate("ab") for k in range(10)]
    scored = spark.createDataFrame([(c, d, f, int(t), g) for c, d, f, t, g in rows], "cls string, det int, conf double, tp0 int, cluster int")
    gt = spark.createDataFrame([("a", k % 4) for k in range(12)] + [("b", 1), ("c", 2)], "cls string, cluster int")
    drawn = detection.replicate_weights(gt, "cluster", 70)
    weights = {(r["replicate"], r["cluster"]): r["weight"] for r in drawn.collect()}
    for r in range(70):
        assert sum(w for (x, _), w in weights.items() if x == r) == 4
    got = {(x["replicate"], x["cls"]): x["ap"] for x in detection.bootstrap_ap(scored, gt, "cluster", detection.weights_of_draws(drawn, "cluster", 70), 70, rows_a_block).collect()}
    assert len(got) == 210
    for r in range(70):
        for cls, clusters in (("a", [k % 4 for k in range(12)]), ("b", [1]), ("c", [2])):
            repeated = sorted((-f, d, t) for c, d, f, t, g in rows if c == cls for _ in range(weights.get((r, g), 0)))
            n_gt = sum(weights.get((r, g), 0) for g in clusters)
            # Repeats of one row stand together, so the curve is read behind the last of them.
            ends, tp = [], 0
            for k, (f, d, t) in enumerate(repeated):
                tp += t
                if k + 1 == len(repeated) or repeated[k + 1][1] != d:
                    ends.append((tp / (k + 1), t, sum(1 for x in repeated if x[1] == d)))
            area = sum(max(p for p, *_ in ends[k:]) * t * n for k, (_, t, n) in enumerate(ends))
            assert got[r, cls] == pytest.approx(area / n_gt if n_gt else 0.0)


def test_items_are_drawn_with_replacement(spark):
    items = spark.createDataFrame([(k,) for k in range(500)] * 2 + [(None,)], "image long")
    for block in (64, 2048):
        rows = detection.resampled_weights(items, "image", 300, block=block).collect()
        w = np.stack([np.frombuffer(r["w"], np.uint8) for r in rows]).astype(int)
        assert w.shape == (500, 300) and len({r["image"] for r in rows}) == 500
        assert (w.sum(axis=0) == 500).all()
        # A draw falls to an item with chance 1 / 500: no weight 0.368, one 0.368, two 0.184; an item's mean is one.
        assert abs((w == 0).mean() - 0.368) < 0.01 and abs((w == 2).mean() - 0.184) < 0.01 and abs(w.mean(axis=1) - 1).max() < 0.3
        again = {r["image"]: r["w"] for r in detection.resampled_weights(items.repartition(5), "image", 300, block=block).collect()}
        assert again == {r["image"]: r["w"] for r in rows}


def test_components_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["item"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("most", [0, 3, 7, 12])
def test_hamming_join_equals_all_pairs(spark, most):
    rng = random.Random(most)
    codes = [rng.getrandbits(64) for _ in range(20)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 14))) for c in codes for _ in range(4)]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([*enumerate(signed), (999, None)], "id int, code bigint")
    want = [(i, j, (codes[i] ^ codes[j]).bit_count()) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (codes[i] ^ codes[j]).bit_count() <= most]
    for form in ({"block": 30}, {"block": 4000}, {"chunks": most // 3 + 1}):
        got = pairs.hamming_pairs(df, "id", "code", most, **form).collect()
        assert sorted((r["a"], r["b"], r["dist"]) for r in got) == sorted(want)
    assert pairs.hamming_pairs(df.limit(0), "id", "code", most).count() == 0


def test_form_of_a_hamming_join():
    assert pairs.best_chunks(2000, 18) is None and pairs.best_chunks(2315, 12, 8) is None
    assert pairs.best_chunks(10**9, 3) is not None


def test_nearest_across_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, v[k].tolist(), k % 3) for k in range(60)], "id bigint, vector array<float>, grp int")
    rows = pairs.nearest(df, "id", "vector", "grp", k=4, block=20).orderBy("query", "rank").collect()
    u = v.astype("f4").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(60):
        order = sorted((-round(float(u[q] @ u[c]), 9), c) for c in range(60) if c % 3 != q % 3)[:4]
        assert [r["candidate"] for r in rows if r["query"] == q] == [c for _, c in order]
    with pytest.raises(Exception, match="zero vector"):
        pairs.nearest(spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 2)], "id bigint, vector array<float>, grp int"), "id", "vector", "grp").collect()


def test_stratified_rounds_half_to_even(spark):
    items = spark.createDataFrame([(k, "x") for k in range(30)] + [(100, "y")], "id int, stratum string")
    got = {(r["stratum"], r["split"]): r["count"] for r in splits.stratified(items, "id", "stratum").groupBy("stratum", "split").count().collect()}
    assert got == {("x", "test"): 4, ("x", "val"): 4, ("x", "train"): 22, ("y", "test"): 1}


def test_group_search_keeps_forced_groups(spark):
    stats = spark.createDataFrame([(f"g{k}", float(1 + k % 5), k == 3) for k in range(40)], "grp string, items double, forced boolean")
    got = splits.search_groups(stats, "grp", ["items"], rounds=300).collect()
    assert len(got) == 40 and {r["split"] for r in got if r["grp"] == "g3"} == {"train"}
    assert got[0]["deviation"] <= 0.03
    assert splits.search_groups(stats.limit(0), "grp", ["items"], rounds=3).count() == 0


def test_rebalance_stops_within_tolerance(spark):
    parts = spark.createDataFrame([(k, "train", 10, True) for k in range(10)], "c int, split string, n int, movable boolean")
    got = splits.rebalance(parts, "c", "split", "n", "movable", tolerance=0.06).groupBy("new_split").count().collect()
    shares = {r["new_split"]: r["count"] for r in got}
    assert sum(shares.values()) == 10 and shares["train"] < 10
    fixed = splits.rebalance(parts.withColumn("movable", F.lit(False)), "c", "split", "n", "movable")
    assert fixed.filter("moved").count() == 0


def test_tiers_and_nulls(spark):
    rows = [(4, False, False), (5, False, False), (None, True, False), (None, True, True), (None, None, None), (9, False, False)]
    df = spark.createDataFrame(rows, "dist int, verified boolean, backdrop boolean")
    got = [r[0] for r in df.select(leakage.tier(F.col("dist"), F.col("verified"), F.col("backdrop"))).collect()]
    assert got == ["A", "B", "A", "B", "C", "C"]
    assert not spark.range(1).select(leakage.accepted(F.lit(None).cast("int"), F.lit(0.9))).first()[0]


def test_exclusion_orientation(spark):
    df = spark.createDataFrame([(1, 2, "test", "train"), (3, 4, "val", "test"), (5, 6, "test", "test")], "a int, b int, split_a string, split_b string")
    got = {r["item"]: (r["has_train_copy"], r["has_val_copy"]) for r in leakage.exclusions(df).collect()}
    assert got == {1: (True, False), 4: (False, True)}


def test_gap_of_exactly_the_threshold_stays(spark):
    df = spark.sql("SELECT 1 AS cam, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) AS t, m AS id FROM (SELECT explode(array(0, 5, 11)) AS m)")
    got = [r["session"] for r in sessions.by_gap(df, "cam", "t", "id", 5).orderBy("id").collect()]
    assert got == [0, 0, 1]


def test_streamed_sessions_equal_batch(spark, tmp_path):
    df = spark.sql("SELECT 1 AS cam, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) AS t, m AS id FROM (SELECT explode(array(0, 5, 11, 10000)) AS m)")
    df.write.parquet(str(tmp_path / "in"))
    stream = sessions_by_gap(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "cam", "t", 5, "1 minute")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("sessions").collect()) == [1, 2]


def test_scalars(spark):
    df = spark.createDataFrame([("FIELD_NEW_396",), ("plain",), (None,)], "stem string")
    got = df.select(scalars.stem_prefix(F.col("stem")), scalars.stem_number(F.col("stem"))).collect()
    assert [tuple(r) for r in got] == [("FIELD_NEW", 396), (None, None), (None, None)]
    for bad in (scalars.stem_strict(F.lit("plain")), scalars.remap(F.lit(9), {0: 0}, [2])):
        with pytest.raises(Exception, match="bad stem|unknown class"):
            spark.range(1).select(bad).collect()
    texts = spark.createDataFrame([("  a  b ", ), (" ",)], "t string").select(scalars.words(F.col("t"))).collect()
    assert [r[0] for r in texts] == [2, 0]


def test_checks_gather_then_stop(spark):
    metrics = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, value double")
    checked = checks.verdicts(metrics, {"a": 1, "b": 3, "c": 1})
    with pytest.raises(ValueError, match="b: 2.0.*c: None|c: None.*b: 2.0"):
        checks.enforce(checked)


polygon = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=9)


@settings(max_examples=60, deadline=None)
@given(polygon, polygon)
def test_intersection_is_within_both(p, q):
    a, b = geometry.convex_hull(np.array(p)), geometry.convex_hull(np.array(q))
    if min(geometry.polygon_area(a), geometry.polygon_area(b)) > 0:
        shared = geometry.polygon_area(geometry.convex_intersection(a, b))
        assert shared <= min(geometry.polygon_area(a), geometry.polygon_area(b)) + 1e-6
        assert shared == pytest.approx(geometry.polygon_area(geometry.convex_intersection(b, a)), abs=1e-6)
        assert geometry.polygon_area(geometry.convex_intersection(a, a)) == pytest.approx(geometry.polygon_area(a))


def test_ransac_finds_the_map():
    rng = np.random.default_rng(5)
    h = np.array([[1.1, 0.1, 5], [-0.05, 0.9, 3], [1e-4, 0, 1]])
    src = rng.uniform(0, 200, (60, 2))
    dst = geometry.project(h, src)
    dst[:20] += rng.uniform(30, 90, (20, 2))
    found, good = geometry.ransac(src, dst)
    assert good.sum() == 40 and np.allclose(geometry.project(found, src[20:]), dst[20:], atol=1e-3)
    assert geometry.ransac(src[:3], dst[:3])[0] is None
    assert geometry.fit_homography(np.ones((4, 2)), np.ones((4, 2))) is None


def test_image_hashes():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 255, (32, 32))
    hashes = hashing.dihedral_hashes(image)
    assert len(set(hashes)) == 8 and set(hashing.dihedral_hashes(np.rot90(image))) == set(hashes)
    assert hashing.dihedral_hashes(None) is None
    assert hashing.phash_median(image) == hashing.phash_median(image * 2)
    # Brighter to the right: no bit; brighter to the left: all; even: none.
    assert hashing.dhash(np.tile(np.arange(9), (8, 1))) == 0 and hashing.dhash(np.tile(np.arange(9)[::-1], (8, 1))) == -1
    assert hashing.dhash(np.full((80, 70), 9)) == 0
    wide = np.kron(image, np.ones((3, 5)))
    assert np.allclose(hashing.area_resize(wide, 32, 32), image) and hashing.phash_mean(wide) == hashing.phash_mean(image)
    assert hashing.phash_median_flipped(image) == hashing.phash_median(image[:, ::-1]) != hashing.phash_median(image)
    rgb = np.zeros((2, 2, 3), int)
    rgb[0, 0], rgb[1, 1] = (20, 200, 30), (250, 250, 250)
    assert hashing.foreground_mask(rgb, "FIELD", {"FIELD"}).tolist() == [[True, False], [False, False]]
    assert hashing.foreground_mask(rgb, "LAB", {"FIELD"}).tolist() == [[True, True], [True, False]]
    assert hashing.laplacian_variance(np.ones((5, 5))) == 0
    basis = hashing.cosine_basis(16)
    assert np.allclose(basis @ basis.T, np.eye(16))


def test_readers_and_writers(spark, tmp_path):
    labels = tmp_path / "labels" / "train"
    labels.mkdir(parents=True)
    (labels / "A_1.txt").write_text("0 .5 .5 .1 .1\n\n1 .2 .2 .1\n")
    (labels / "A_2.txt").write_text("")
    lines = readers.label_lines(spark, str(tmp_path / "labels"))
    assert lines.count() == 2
    assert [(r["stem"], r["cls"], r["cx"]) for r in readers.label_boxes(lines).collect()] == [("A_1", 0, 0.5)]
    assert readers.label_boxes(lines, strict=False).count() == 2
    with pytest.raises(Exception, match="unknown class"):
        readers.known_classes(readers.label_boxes(lines, strict=False), [0]).collect()
    listed = readers.files(spark, str(tmp_path / "labels"), "*.txt")
    assert {(r["split"], r["stem"]) for r in listed.collect()} == {("train", "A_1"), ("train", "A_2")}
    assert [r["stem"] for r in readers.empty_files(listed).collect()] == ["A_2"]
    assert readers.folder_size(listed).first()["files"] == 2
    (tmp_path / "log.csv").write_text(" epoch,  metrics/mAP50(B)\n 1,  0.5\n")
    log = readers.padded_csv(spark, str(tmp_path / "log.csv"))
    assert log.select(readers.find_column(log, "absent", "mAP50")).first()[0] == "0.5"
    (tmp_path / "m.json").write_text('{"a": {"b": [1, 2.5]}, "c": null}')
    assert {r["path"]: r["value"] for r in readers.json_leaves(spark, str(tmp_path / "m.json")).collect()} == {"a.b[0]": "1", "a.b[1]": "2.5", "c": None}
    assert readers.flat_yaml("path: /d\nnc: 3\nnames:\n  0: a\n  1: b\n") == {"path": "/d", "nc": 3, "names": {0: "a", 1: "b"}}
    items = spark.createDataFrame([("x/2.jpg", "val"), ("x/1.jpg", "val"), ("x/3.jpg", "test")], "path string, split string")
    writers.split_lists(items, str(tmp_path / "lists"), "path", "split")
    assert [r["line"] for r in readers.line_list(spark, str(tmp_path / "lists" / "split=val")).collect()] == ["x/1.jpg", "x/2.jpg"]
    assert writers.markdown(items.limit(1)).splitlines()[0] == "| path | split |"
    writers.merge_section(spark, str(tmp_path / "r.json"), "one", {"x": 1})
    writers.merge_section(spark, str(tmp_path / "r.json"), "two", 2)
    assert '"two": 2' in (tmp_path / "r.json").read_text()
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (5).to_bytes(2, "big") + (6).to_bytes(2, "big") + b"\x01" * 6
    assert readers.image_size(png) == (7, 9) and readers.image_size(jpeg) == (6, 5) and readers.image_size(b"no") is None
    sized = readers.image_sizes(spark.createDataFrame([("p", png), ("q", b"no")], "path string, content binary"))
    assert [tuple(r) for r in sized.orderBy("path").collect()] == [("p", 7, 9), ("q", None, None)]


def test_camera_metadata(spark):
    import struct

    text = b"2020:01:02 03:04:05\0"
    ifd = struct.pack("<H", 3) + struct.pack("<HHII", 0x010F, 2, 4, int.from_bytes(b"abc\0", "little")) + struct.pack("<HHII", 0x0132, 2, 20, 60) + struct.pack("<HHII", 0x8825, 4, 1, 0) + struct.pack("<I", 0)
    body = (b"II*\0" + struct.pack("<I", 8) + ifd).ljust(60, b"\0") + text
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body
    assert readers.camera_metadata(jpeg) == {"has_gps": True, "make": "abc", "time": "2020:01:02 03:04:05"}
    places = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, 200) + struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack("<HHII", 4, 5, 3, 224)
    placed = body.replace(struct.pack("<HHII", 0x8825, 4, 1, 0), struct.pack("<HHII", 0x8825, 4, 1, 100)).ljust(100, b"\0") + places
    placed = placed.ljust(200, b"\0") + struct.pack("<6I", 12, 1, 30, 1, 0, 1) + struct.pack("<6I", 77, 1, 0, 1, 36, 1)
    found = readers.camera_metadata(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(placed) + 8) + b"Exif\0\0" + placed)
    assert found["latitude"] == -12.5 and found["longitude"] == pytest.approx(77.01) and found["has_gps"]
    assert readers.camera_metadata(jpeg[:30])["has_gps"] is False and readers.camera_metadata(b"x") == {}
    got = readers.camera_files(spark.createDataFrame([("p", jpeg), ("q", b"")], "path string, content binary")).orderBy("path").collect()
    assert got[0]["make"] == "abc" and got[0]["has_gps"] and got[1]["make"] is None


def test_best_of_variants():
    rng = np.random.default_rng(8)
    points, target = rng.uniform(0, 100, (30, 2)), rng.normal(size=(30, 16))
    moved = points @ np.array([[0.0, 1.0], [-1.0, 0.0]]) + 5
    k, n, inliers = geometry.best_variant([rng.uniform(0, 100, (30, 2)), points], moved, [rng.normal(size=(30, 16)), target + rng.normal(size=(30, 16)) * 0.01], target)
    assert (k, n) == (1, 30) and len(inliers) == 30
    assert geometry.hull_coverage(inliers, 0, 1e4) == geometry.hull_coverage(inliers, 50, 1e4)


def test_edge_rules(spark):
    items = spark.createDataFrame([(k, "ab"[k % 2], k) for k in range(12)], "id int, prefix string, number int")
    crops = spark.createDataFrame([(3, 1), (4, None), (6, None), (8, None), (10, 0), (5, 5)], "crop int, parent int")
    edges = lambda df: sorted(tuple(r) for r in df.select("a", "b").collect())
    assert edges(graph.crop_parent_edges(crops, "crop", "parent")) == [(0, 10), (1, 3)]
    orphans = crops.filter("parent IS NULL").select(F.col("crop").alias("id"))
    assert edges(graph.orphan_edges(items, orphans, "id", "prefix", F.col("number"), 8)) == [(4, 6)]
    pairs_ = spark.createDataFrame([(0, 3), (1, 2), (8, 9)], "a int, b int")
    merged = graph.merge_groups(items.withColumn("grp", F.floor(F.col("number") / 4)), "id", "grp", pairs_)
    assert {r["id"]: r["component"] for r in merged.collect()} == {k: k // 4 * 4 for k in range(12)}
    tied = graph.merge_groups(items.withColumn("grp", F.floor(F.col("number") / 4)), "id", "grp", pairs_.unionByName(spark.createDataFrame([(2, 9)], "a int, b int")))
    assert {r["component"] for r in tied.filter("id < 4 OR id > 7").collect()} == {0}
    more = items.unionByName(spark.createDataFrame([(90, "c", 90)], items.schema))
    assert {r["prefix"]: r["component"] for r in graph.prefix_components(pairs_, more, "id", "prefix").collect()} == {"a": "a", "b": "a", "c": "c"}
    known = items.withColumns({"component": F.floor(F.col("number") / 4), "split": F.when(F.col("id") < 2, "train").otherwise("test")})
    got = graph.crossing_edges(pairs_, known, "id", "component", "split").collect()
    assert sorted(map(tuple, got)) == [(0, 2, 2), (2, 1, 0)]


def test_spans_deviations_and_deletions(spark):
    crops = spark.createDataFrame([(1, 2), (3, 4), (5, None), (6, 99)], "crop int, parent int")
    assigned = spark.createDataFrame([(1, "train"), (2, "train"), (3, "val"), (4, "test"), (5, "val"), (6, "val")], "id int, split string")
    assert tuple(checks.crop_parent_span(crops, assigned, "id", "split").first()) == (2, 1, "failed")
    assert checks.crop_parent_span(crops, assigned, "id", "split", True).first()["verdict"] == "known limitation"
    assert checks.crop_parent_span(crops.limit(1), assigned, "id", "split").first()["verdict"] == "ok"
    got = {r["measure"]: r for r in splits.class_deviation(assigned, "split", {"n": F.lit(1), "none": F.lit(0)}).collect()}
    assert got["n"]["val"] == 0.5 and got["n"]["deviation"] == pytest.approx(0.7 - 2 / 6) and not got["n"]["achievable"] and got["none"]["achievable"]
    assert checks.delete_one(assigned, F.col("id") == 3).count() == 5
    for bad in (F.col("id") == 9, F.col("split") == "val"):
        with pytest.raises(ValueError, match="rows match"):
            checks.delete_one(assigned, bad)


def test_search_fills_val_first(spark):
    sizes = np.array([[float(1 + k % 7)] for k in range(60)])
    order = np.random.default_rng(3).permutation(60)
    got, want, val, test = splits.fill(order, sizes, np.array([0.7, 0.15, 0.15])), [0] * 60, 0.0, 0.0
    for g in order:
        if val < 0.15 * sizes.sum():
            want[g], val = 1, val + sizes[g, 0]
        elif test < 0.15 * sizes.sum():
            want[g], test = 2, test + sizes[g, 0]
    assert got.tolist() == want
    stats = spark.createDataFrame([(f"g{k}", float(1 + k % 7), False) for k in range(60)], "grp string, items double, forced boolean")
    found = splits.search_groups(stats, "grp", ["items"], rounds=60, val_first=True, by_size=True, least_train=0.68, tolerance=0.03).collect()
    share = sum(int(r["grp"][1:]) % 7 + 1 for r in found if r["split"] == "train") / sizes.sum()
    assert share >= 0.68 and {r["valid"] for r in found} == {True}
    assert not splits.search_groups(stats, "grp", ["items"], rounds=9, val_first=True, least_train=0.99).first()["valid"]


def test_split_searches_equal_plain_loops(spark):
    """Every round again, in plain Python; the best deviation and its assignment are those of the search."""
    rows = [(f"g{k:02}", float(1 + k * k % 9), float(k % 3), k == 5) for k in range(30)]
    stats = spark.createDataFrame(rows, "grp string, items double, marks double, forced boolean")
    got = {r["grp"]: (r["split"], r["deviation"]) for r in splits.search_groups(stats, "grp", ["items", "marks"], rounds=40, by_size=True).collect()}
    best = None
    for r in range(40):
        order = np.random.default_rng([42, r]).permutation(30).tolist()
        if r % 3 == 0:
            order.sort(key=lambda g: -rows[g][1])
        whole, held, at = sum(x[1] for x in rows), [rows[5][1], 0.0, 0.0], {5: 0}
        for g in order:
            if g != 5:
                at[g] = max(range(3), key=lambda k: ((0.7, 0.15, 0.15)[k] * whole - held[k], -k))
                held[at[g]] += rows[g][1]
        far = max(abs(sum(x[m] for g, x in enumerate(rows) if at[g] == k) / sum(x[m] for x in rows) - 0.15) for m in (1, 2) for k in (1, 2))
        best = min(best, (far, r, at), key=lambda x: x[:2]) if best else (far, r, at)
    assert {g: s for g, (s, _) in got.items()} == {rows[g][0]: splits.SPLITS[k] for g, k in best[2].items()}
    assert {d for _, d in got.values()} == {round(best[0], 9)}


def test_rebalance_equals_a_plain_loop(spark):
    rng = random.Random(12)
    rows = [(k, rng.choice(["train", "train", "val", "test"]), rng.randint(1, 9), rng.random() < 0.8) for k in range(60)]
    got = {r["c"]: r["new_split"] for r in splits.rebalance(spark.createDataFrame(rows, "c int, split string, n int, movable boolean"), "c", "split", "n", "movable").collect()}
    at, whole, goal = {k: s for k, s, _, _ in rows}, sum(r[2] for r in rows), dict(zip(splits.SPLITS, splits.KEPT, strict=True))
    for _ in range(2):
        for k, _, n, movable in sorted(rows, key=lambda r: (r[2], r[0])):
            gap = {s: sum(r[2] for r in rows if at[r[0]] == s) / whole - goal[s] for s in splits.SPLITS}
            if max(map(abs, gap.values())) <= 0.02:
                break
            low, high = min(splits.SPLITS, key=gap.get), max(splits.SPLITS, key=gap.get)
            step = n / whole
            if movable and at[k] == high != low and abs(gap[high] - step) + abs(gap[low] + step) < abs(gap[high]) + abs(gap[low]):
                at[k] = low
    assert got == at


def test_names_paths_bands_and_picks(spark):
    df = spark.createDataFrame([("FIELD_NEW_396",), ("plain",)], "s string")
    assert [tuple(r[0]) for r in df.select(scalars.stem_flagged(F.col("s"))).collect()] == [("FIELD_NEW", 396), ("plain", -1)]
    paths = spark.createDataFrame([("d/images/train/images_1.jpg",), ("d\\images\\a.b.png",)], "p string")
    assert [r[0] for r in paths.select(scalars.label_path_inner(F.col("p"))).collect()] == ["d/labels/train/images_1.txt", "d/labels/a.b.txt"]
    assert paths.select(scalars.label_path_anywhere(F.col("p"))).first()[0] == "d/labels/train/labels_1.txt"
    times = spark.createDataFrame([(1, "2020:01:02 03:04:05"), (2, "2020-01-02"), (3, None)], "id int, t string")
    assert [tuple(r) for r in scalars.time_errors(times, "id", "t").collect()] == [(2, "2020-01-02")]
    scores = spark.createDataFrame([(k, k % 50) for k in range(100)] + [(900, None)], "id int, score int")
    got = pairs.heads(scores, "score", [("top", None, None, 3), ("middle", 15, 29, 2)], "id").collect()
    assert [(r["band"], r["rank"], r["id"]) for r in got] == [("top", 1, 49), ("top", 2, 99), ("top", 3, 48), ("middle", 1, 29), ("middle", 2, 79)]
    few = spark.createDataFrame([("a", k) for k in range(4)] + [("b", 1), ("b", 2)], "k string, v int")
    got = sorted((r["k"], r["v"]) for r in pairs.offset_pick(few, "k", 2, 1, F.col("v")).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_projected_containment():
    shift = np.array([[1.0, 0, 60], [0, 1, 0], [0, 0, 1]])
    assert geometry.projected_containment(shift, (50, 20), (100, 100)) == (pytest.approx(0.8), 10.0)
    assert geometry.projected_containment(np.zeros((3, 3)) + np.eye(3) * [0, 0, 1], (50, 20), (100, 100))[0] == 0.0


def test_npy_round_trip(spark):
    df = spark.createDataFrame([(1, [1.5, 2.0]), (2, []), (3, None)], "id int, v array<double>")
    got = readers.npy_values(writers.npy_bytes(df, "id", "v"), "id", "content").orderBy("id").collect()
    assert [(r["id"], r["shape"], r["values"]) for r in got] == [(1, [2], [1.5, 2.0]), (2, [0], [])]
