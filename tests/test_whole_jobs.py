"""Jobs over whole tables against plain Python."""

from __future__ import annotations

import inspect
import random

import pytest
from pyspark.sql import functions as F

from granary import catalog
from granary.operators import pairs, splits
from granary.plans import detection as plans
from granary.plans import splits as split_plans

FOLDER = "/root/testdata/sf0.001"


def test_dihedral_pairs_across_blocks(spark):
    rng = random.Random(4)
    codes = [[rng.getrandbits(63) for _ in range(3)] for _ in range(40)]
    codes += [[h ^ (1 << rng.randrange(63)) for h in reversed(c)] for c in codes[:20]] + [[-1, 0, 1]]
    df = spark.createDataFrame([*enumerate(codes), (999, None)], "id bigint, h array<bigint>")
    far = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    dist = lambda a, b: min(min(far(a[0], v) for v in b), min(far(b[0], v) for v in a))
    want = [(i, j, dist(codes[i], codes[j])) for i in range(len(codes)) for j in range(i + 1, len(codes)) if dist(codes[i], codes[j]) <= 24]
    for form in ({"block": 9}, {"block": 900}, {"chunks": 9}):
        got = pairs.dihedral_pairs(df, "id", "h", 24, **form)
        assert want and sorted(map(tuple, got.collect())) == want
    assert pairs.dihedral_pairs(df.limit(0), "id", "h", 24).count() == 0


@pytest.mark.parametrize("block", [9, 900])
def test_hamming_pairs_whatever_order_blocks_arrive_in(spark, monkeypatch, block):
    """A block is collected twice, once a side, and the lists may come in two orders: no pair is lost or doubled."""
    made, turned = pairs._blocks, lambda df: df.withColumns({c: F.reverse(c) for c in ("item_y", "h_y")})
    monkeypatch.setattr(pairs, "_blocks", lambda *args: turned(made(*args)))
    rng = random.Random(5)
    codes = [rng.getrandbits(63) - (1 << 62) for _ in range(60)]
    df = spark.createDataFrame([(7 * k % 61, c) for k, c in enumerate(codes)], "id bigint, code bigint")
    names = [7 * k % 61 for k in range(60)]
    far = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    near = [(*sorted((names[i], names[j])), far(codes[i], codes[j])) for i in range(60) for j in range(i) if far(codes[i], codes[j]) <= 26]
    assert len(near) > 50 and sorted(map(tuple, pairs.hamming_pairs(df, "id", "code", 26, block=block).collect())) == sorted(near)
    variants = df.select("id", F.array("code", F.col("code").bitwiseXOR(F.lit(255).cast("bigint"))).alias("h"))
    both = {(a, b) for a, b, _ in near} | {tuple(sorted((names[i], names[j]))) for i in range(60) for j in range(i) if far(codes[i], codes[j] ^ 255) <= 26}
    got = [(r["a"], r["b"]) for r in pairs.dihedral_pairs(variants, "id", "h", 26, block=block).collect()]
    assert len(got) == len(both) and set(got) == both


def test_parents_among_all_others(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("abcdefgh"), rng.randint(1, 60)) for k in range(300)] + [(300, None, 5), (310, "a", None)]
    crops, others = [r for r in rows if r[0] % 10 == 0], [r for r in rows if r[0] % 10]
    want = set()
    for item, family, size in crops:
        scored = [(99 < 100 - abs(size - s) or abs(size - s) == 1, f == family, -(100 - abs(size - s)), o) for o, f, s in others] if family and size else []
        for phase, same in (("family", True), ("all", False)):
            best = min((x[2:] for x in scored if x[0] and x[1] == same), default=None)
            if best:
                want.add((item, best[1], -best[0], phase))
                break
    frame = lambda r: spark.createDataFrame(r, "item bigint, family string, p_size int")
    score = 100 - F.abs(F.col("p_size_c") - F.col("p_size_o"))
    assert {x[3] for x in want} == {"family", "all"}
    for near in (None, ("p_size", 1)):
        got = pairs.parents_two_phase(frame(crops), frame(others), "family", score, 99, near).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_intervals_over_images(spark):
    """Draws repeated row by row in plain Python, for a few replicates of the registered form."""
    det, gt = plans.sides(spark, FOLDER)
    gt = gt.withColumn("cluster", F.col("image"))
    scored = plans.ops.outcomes(det, gt, [0.5]).withColumn("cluster", F.col("image"))
    weights = plans.ops.resampled_weights(gt, "cluster", 6)
    got = {(r["replicate"], r["cls"]): r["ap"] for r in plans.ops.bootstrap_ap(scored, gt, "cluster", weights, 6, rows=500).collect()}
    w = {r["cluster"]: r["w"] for r in weights.collect()}
    rows = scored.select("cls", "conf", "det", "tp0", "cluster").collect()
    boxes = gt.select("cls", "cluster").collect()
    for (r, cls), ap in got.items():
        tp = n = 0
        curve = []
        for x in sorted((x for x in rows if x["cls"] == cls and x["cluster"] in w and w[x["cluster"]][r]), key=lambda x: (-x["conf"], x["det"])):
            k = w[x["cluster"]][r]
            tp, n = tp + k * x["tp0"], n + k
            curve.append((tp / n, k * x["tp0"]))
        best = area = 0
        for p, k in reversed(curve):
            best = max(best, p)
            area += best * k
        assert ap == pytest.approx(area / sum(w[b["cluster"]][r] for b in boxes if b["cls"] == cls))
    assert len(got) == 18 and plans.REPLICATES == 2000


def test_intervals_over_images_store_no_weights(spark, monkeypatch):
    """The registered form again row by row; neither weights nor blocks of them are made as tables."""
    asked = []
    drawn = plans.ops.bootstrap_ap_drawn
    monkeypatch.setattr(plans.ops, "bootstrap_ap_drawn", lambda scored, gt, cluster, replicates: asked.append(replicates) or drawn(scored, gt, cluster, 4))
    for name in ("resampled_weights", "bootstrap_ap"):
        monkeypatch.setattr(plans.ops, name, lambda *args: pytest.fail("weights are stored"))
    assert catalog.QUERIES["bootstrap_ci_item"](spark, FOLDER).count() == 3 and asked == [2000]

    monkeypatch.setattr(plans.ops, "WEIGHED_AT_ONCE", 100)
    det, gt = plans.sides(spark, FOLDER)
    # Images without a true box draw nothing; a class without a detection has no precision.
    extra = det.limit(40).withColumns({"image": F.lit(-5).cast("bigint"), "conf": F.lit(2.0)})
    gt = gt.unionByName(gt.limit(3).withColumn("cls", F.lit("none"))).withColumn("cluster", F.col("image"))
    scored = plans.ops.outcomes(det.unionByName(extra), gt, [0.5]).withColumn("cluster", F.col("image"))
    got = {(r["replicate"], r["cls"]): r["ap"] for r in drawn(scored, gt, "cluster", 7, file_rows=500, task_replicates=3).collect()}
    images = sorted({r["image"] for r in gt.select("image").collect()})
    rows, boxes = scored.select("cls", "conf", "det", "tp0", "image").collect(), gt.select("cls", "image").collect()
    assert len(got) == 7 * 4 and len({got[r, "A"] for r in range(7)}) > 1
    for r in range(7):
        w = dict(zip(images, plans.ops.place_weights(len(images), [r], 42)[:, 0].tolist(), strict=True))
        assert sum(w.values()) == len(images)
        for cls in ("A", "N", "R", "none"):
            tp = n = best = area = 0
            curve = []
            for x in sorted((x for x in rows if x["cls"] == cls and w.get(x["image"])), key=lambda x: (-x["conf"], x["det"])):
                tp, n = tp + w[x["image"]] * x["tp0"], n + w[x["image"]]
                curve.append((tp / n, w[x["image"]] * x["tp0"]))
            for p, k in reversed(curve):
                best = max(best, p)
                area += best * k
            whole = sum(w[b["image"]] for b in boxes if b["cls"] == cls)
            assert got[r, cls] == pytest.approx(area / whole if whole else 0)


def test_ranks_cross_ranges(spark):
    rng = random.Random(9)
    values = [rng.randint(0, 40) for _ in range(500)] + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "v int")
    known = sorted(v for v in values if v is not None)
    for p in (0.0, 0.37, 0.9, 1.0):
        assert [r[0] for r in pairs.percentile_lower(df, "v", p).collect()] == [known[int(p * (len(known) - 1))]]
    assert pairs.percentile_lower(df.filter("v IS NULL"), "v", 0.9).count() == 0
    items, taken = spark.range(0, 300, 1, 7), spark.range(0, 300, 3)
    placed = splits.place_unassigned(items, taken, "id", 1000)
    want = [(i, "train", 1000 + k) for k, i in enumerate(i for i in range(300) if i % 3)]
    assert sorted(map(tuple, placed.collect())) == want


@pytest.mark.parametrize("name", ["randomised_group_split", "size_ordered_group_split", "session_group_split", "block_choice"])
def test_searches_run_all_rounds(spark, monkeypatch, name):
    search, asked = splits.search_groups, []

    def seen(*args, **given):
        bound = inspect.signature(search).bind(*args, **given)
        bound.apply_defaults()
        asked.append(bound.arguments["rounds"])
        return search(*args, **given | {"rounds": 3})

    monkeypatch.setattr(split_plans.ops, "search_groups", seen)
    catalog.QUERIES[name](spark, FOLDER)
    assert asked and set(asked) == {20_000}


def test_rules_tie_as_a_plain_union_does(spark):
    edges = [tuple(r) for r in catalog.QUERIES["edges_by_rule"](spark, FOLDER).select("rule", "a", "b").collect()]
    ids = [r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    got = {r["rules"]: (r["components"], r["largest"]) for r in catalog.QUERIES["ablation_by_rule"](spark, FOLDER).collect()}
    for rules in ("a", "a+b", "a+b+c"):
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for rule, a, b in edges:
            if rule in rules:
                root[find(a)] = find(b)
        sizes = {}
        for i in ids:
            sizes[find(i)] = sizes.get(find(i), 0) + 1
        assert got[rules] == (len(sizes), max(sizes.values()))


def test_hulls_by_wrapping(spark):
    """Each hull again by walking from corner to corner, every other point on one side."""
    got = {r["vec_id"]: r["coverage"] for r in catalog.QUERIES["hull_coverage"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").limit(40).collect()
    for r in rows:
        points = [(100.0 * x, 100.0 * y) for x, y in zip(r["embedding"][::2], r["embedding"][1::2], strict=True)]
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        at = start = min(points)
        hull = []
        while not hull or at != start:
            hull.append(at)
            best = next(p for p in points if p != at)
            for p in points:
                if p != at and turn(at, best, p) < 0:
                    best = p
            at = best
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) / 2
        assert got[r["vec_id"]] == pytest.approx(min(area / 40_000, 1.0))
    assert len(rows) == 40
