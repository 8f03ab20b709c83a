"""Golden values and edge cases of operators and functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import bitmaps, geometry, text, timebase, vectors
from framewright.operators import boxes, catalog, clustering, edits, faces, filters, intervals, jobs, keyframes, paging, quality, recipes, segments, settings, staleness, upserts
from framewright.operators.filters import Condition, Group


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


VIDEO = "id_videofile long, frame_count int"


# time base


def test_totals_of_two_slices(spark):
    items = spark.createDataFrame([(1, 0, 273, 1001, 24000), (1, 0, 300, 1001, 24000)], "recipe_id long, cut_first int, cut_last int, time_base_num int, time_base_den int")
    assert rows(recipes.totals(items)) == [(1, 2, 573, 23899)]


def test_reduction_and_rounding(spark):
    n = F.lit
    r = one(spark, a=timebase.reduced(n(24000), n(1001)), b=timebase.reduced(n(50), n(2)), c=timebase.reduced(n(0), n(0)), half=timebase.frame_of_nanos(n(20_000_000), n(1), n(25)), under=timebase.frame_of_nanos(n(19_999_999), n(1), n(25)), none=timebase.nanos_of_seconds(n("x")), some=timebase.nanos_of_seconds(n("1.5")))
    assert (r["a"]["num"], r["a"]["den"]) == (24000, 1001) and (r["b"]["num"], r["b"]["den"]) == (25, 1) and (r["c"]["num"], r["c"]["den"]) == (0, 0)
    assert (r["half"], r["under"], r["none"], r["some"]) == (1, 0, None, 1_500_000_000)


def test_progress_shares(spark):
    n = F.lit
    r = one(spark, a=timebase.percent(n(1), n(3)), b=timebase.percent(n(9), n(3)), c=timebase.percent(n(1), n(0)), d=timebase.fraction(n(1), n(0)))
    assert tuple(r) == (33, 100, None, 0.0)


# bitmaps and keyframes


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([(1, 20), (2, 8), (3, 1)], VIDEO)


def test_bitmap_round_trip(spark, sizes):
    frames = spark.createDataFrame([(1, 0), (1, 7), (1, 8), (1, 19), (1, 19), (2, 3)], "id_videofile long, frame_number int")
    maps = bitmaps.build(frames, sizes).join(sizes, "id_videofile")
    got = {r["id_videofile"]: r for r in maps.select("*", bitmaps.frames_in(F.col("keyframe_bitmap"), F.col("frame_count")).alias("f"), bitmaps.count_bits(F.col("keyframe_bitmap")).alias("n"), bitmaps.fits(F.col("keyframe_bitmap"), F.col("frame_count")).alias("fits"), bitmaps.has_bit(F.col("keyframe_bitmap"), F.lit(99)).alias("beyond")).collect()}
    assert bytes(got[1]["keyframe_bitmap"]) == bytes([0b10000001, 0b10000000, 0b00010000]) and got[1]["f"] == [0, 7, 8, 19]
    assert got[2]["f"] == [3] and got[3]["f"] == [] and [got[i]["n"] for i in (1, 2, 3)] == [4, 1, 0]
    assert all(r["fits"] and r["beyond"] is False for r in got.values())


def test_bitmap_refuses_frames_beyond(spark, sizes):
    with pytest.raises(Exception, match="beyond the frame count"):
        bitmaps.build(spark.createDataFrame([(2, 8)], "id_videofile long, frame_number int"), sizes).collect()


def test_cut_to_keyframes(spark):
    keys = spark.createDataFrame([(1, f) for f in range(0, 2000, 100)], "id_videofile long, frame_number int")
    ranges = spark.createDataFrame([(1, 1120, 1455), (1, 1100, 1500), (1, 1950, 1990), (2, 5, 9)], "id_videofile long, first_frame int, last_frame int")
    assert rows(keyframes.cut(ranges, keys)) == [(1, 1100, 1500, 1100, 1500), (1, 1120, 1455, 1100, 1500), (1, 1950, 1990, 1900, 1990), (2, 5, 9, 5, 9)]


# segments


def test_cover_of_six_hundred_frames(spark):
    files = spark.createDataFrame([(1, 600), (2, 1)], VIDEO)
    bounds = spark.createDataFrame([(1, "SHOT", f) for f in range(60, 600, 60)] + [(1, "SCENE", f) for f in (120, 240, 360, 480, 540)] + [(1, "SHOT", 60), (1, "SHOT", 600), (9, "SHOT", 5)], "id_videofile long, level string, frame_number int")
    made = segments.segments(bounds, files)
    audit = {(r["id_videofile"], r["level"]): r for r in segments.coverage(made, files).collect()}
    assert audit[1, "SHOT"]["segments"] == 10 and audit[1, "SCENE"]["segments"] == 6 and audit[2, "SHOT"]["segments"] == 1
    assert len(audit) == 4 and all(r["complete"] for r in audit.values())


def test_threshold_order_is_refused(spark):
    with pytest.raises(ValueError):
        segments.boundaries(spark.createDataFrame([], "id_videofile long, frame_number int, score double"), 5.0, 50.0)


def test_no_scores_no_boundaries(spark):
    empty = spark.createDataFrame([], "id_videofile long, frame_number int, score double")
    made = segments.segments(segments.boundaries(empty), spark.createDataFrame([(4, 3)], VIDEO))
    assert rows(made) == [(4, "SCENE", 0, 2), (4, "SHOT", 0, 2)]


def test_nearest_without_reference(spark):
    ours = spark.createDataFrame([(1, 5), (2, 7)], "id_videofile long, frame_number int")
    reference = spark.createDataFrame([(1, 2), (1, 9)], "id_videofile long, frame_number int")
    assert rows(segments.nearest(ours, reference).where("distance IS NOT NULL")) == [(1, 5, 3)]


def test_points_between_intervals_stay_unbound(spark):
    points = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (1, 10), (2, 1)], "id_videofile long, frame_number int")
    held = spark.createDataFrame([(1, 7, 0, 5), (1, 8, 10, 12)], "id_videofile long, shot_id long, first_frame int, last_frame int")
    got = {(r["id_videofile"], r["frame_number"]): r["shot_id"] for r in intervals.bind(points, held, "shot_id").collect()}
    assert got == {(1, 0): 7, (1, 5): 7, (1, 9): None, (1, 10): 8, (2, 1): None}


# edits

SHOT = "shot_id long, id_videofile long, first_frame int, last_frame int, size string, size_origin string, origin string, run_id long, is_stale boolean"


@pytest.fixture(scope="module")
def shots(spark):
    return spark.createDataFrame([(i + 1, 1, 10 * i, 10 * i + 9, "NONE", "AUTO", "AUTO", 5, False) for i in range(3)] + [(9, 2, 0, 9, "CU", "OPERATOR", "AUTO", 5, False)], SHOT)


@pytest.fixture(scope="module")
def scenes(spark):
    return spark.createDataFrame([(1, 1, 0, 19, False), (2, 1, 20, 29, False)], "scene_id long, id_videofile long, first_frame int, last_frame int, is_stale boolean")


@pytest.mark.parametrize(("to", "code"), [(12, None), (10, "BOUNDARY_CONFLICT"), (0, "BOUNDARY_CONFLICT"), (1, None), (19, None), (20, "BOUNDARY_CONFLICT")])
def test_move_shot(spark, shots, scenes, to, code):
    wanted = spark.createDataFrame([(1, 10, to)], "id_videofile long, from_frame int, to_frame int")
    plan = edits.plan_move(wanted, shots, "shot_id", scenes=scenes)
    assert plan.first()["error_code"] == code
    after = {r["shot_id"]: (r["first_frame"], r["last_frame"], r["origin"], r["run_id"]) for r in edits.apply_move(plan, shots, "shot_id").collect()}
    assert after[1] == ((0, to - 1, "OPERATOR", None) if code is None else (0, 9, "AUTO", 5)) and after[3] == (20, 29, "AUTO", 5)


def test_shot_must_not_swallow_a_scene_start(spark, shots, scenes):
    wanted = spark.createDataFrame([(1, 20, 22)], "id_videofile long, from_frame int, to_frame int")
    assert edits.plan_move(wanted, shots, "shot_id", scenes=scenes).first()["error_code"] == "BOUNDARY_CONFLICT"
    merge = spark.createDataFrame([(1, 20)], "id_videofile long, frame int")
    assert edits.plan_merge(merge, shots, "shot_id", scenes=scenes).first()["error_code"] == "BOUNDARY_CONFLICT"


def test_scene_moves_to_shot_boundaries_only(spark, shots, scenes):
    wanted = lambda to: spark.createDataFrame([(1, 20, to)], "id_videofile long, from_frame int, to_frame int")
    assert edits.plan_move(wanted(10), scenes, "scene_id", shots=shots).first()["error_code"] is None
    assert edits.plan_move(wanted(15), scenes, "scene_id", shots=shots).first()["error_code"] == "BOUNDARY_CONFLICT"


def test_several_edits_of_a_file_are_refused(spark, shots):
    wanted = spark.createDataFrame([(1, 5), (1, 15), (2, 4)], "id_videofile long, frame int")
    codes = {(r["id_videofile"], r["frame"]): r["error_code"] for r in edits.plan_split(wanted, shots, "shot_id").collect()}
    assert codes == {(1, 5): "SEVERAL_EDITS", (1, 15): "SEVERAL_EDITS", (2, 4): None}


def test_split_and_merge(spark, shots):
    wanted = spark.createDataFrame([(1, 14), (2, 0), (3, 1)], "id_videofile long, frame int")
    plan = edits.plan_split(wanted, shots, "shot_id")
    assert {r["id_videofile"]: r["error_code"] for r in plan.collect()} == {1: None, 2: "BOUNDARY_CONFLICT", 3: "NOT_FOUND"}
    after = edits.apply_split(plan, shots, "shot_id", lambda first: 1000 + first)
    assert rows(after.where("id_videofile = 1"), "shot_id", "first_frame", "last_frame", "is_stale") == [(1, 0, 9, False), (2, 10, 19, True), (3, 20, 29, False), (1010, 10, 13, False), (1014, 14, 19, False)]
    merge = edits.plan_merge(spark.createDataFrame([(1, 10), (2, 0)], "id_videofile long, frame int"), shots, "shot_id")
    joined = edits.apply_merge(merge, shots, "shot_id")
    assert rows(joined.where("id_videofile = 1"), "shot_id", "first_frame", "last_frame", "is_stale") == [(1, 0, 19, False), (2, 10, 19, True), (3, 20, 29, False)]


def test_settling_keeps_what_an_operator_chose(spark, shots):
    files = spark.createDataFrame([(1, 100, 100), (2, 100, 100)], "id_videofile long, width int, height int")
    faces = spark.createDataFrame([(1, 1, 3, 0, 0, 50, 50), (2, 2, 3, 0, 0, 100, 100)], "face_id long, id_videofile long, frame_number int, x1 int, y1 int, x2 int, y2 int")
    after, bound = edits.settle(shots, faces, files)
    assert dict(rows(after, "shot_id", "size")) == {1: "BCU", 2: "NONE", 3: "NONE", 9: "CU"} and dict(rows(bound, "face_id", "shot_id")) == {1: 1, 2: 9}


# geometry


def test_shot_sizes(spark):
    shares = spark.createDataFrame([(s,) for s in (0.9, 0.35, 0.34, 0.05, 0.03, 0.001, None)], "share double")
    assert [r[0] for r in shares.select(geometry.size_of_share(F.col("share"))).collect()] == ["ECU", "ECU", "BCU", "MS", "MLS", "XLS", "NONE"]
    with pytest.raises(ValueError):
        geometry.size_of_share(F.col("share"), (0.1, 0.1))


def test_preview_of_an_episode(spark):
    files = spark.createDataFrame([(1, 88643)], VIDEO)
    made = catalog.sheets(files)
    last = made.orderBy(F.desc("sheet")).first()
    assert made.count() == 347 and (last["first_frame"], last["last_frame"]) == (346 * 256, 88642) and last["object_key"].endswith("/000346")
    assert made.agg(F.sum(F.col("last_frame") - F.col("first_frame") + 1)).first()[0] == 88643


def test_crop_stays_inside(spark):
    n = F.lit
    r = one(spark, c=geometry.crop(n(0), n(0), n(50), n(100), n(60), n(80)))["c"]
    assert (r["x"], r["y"], r["width"], r["height"]) == (0, 0, 60, 80)


def test_suppression_and_regions(spark):
    b = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [30, 30, 40, 40], [0, 0, 10, 10]], dtype=float)
    assert boxes.suppressed(b, np.array([0.5, 0.9, 0.1, 0.5]), 0.4).tolist() == [False, True, True, False]
    assert boxes.suppressed(np.zeros((0, 4)), np.zeros(0), 0.4).tolist() == []
    df = spark.createDataFrame([(1, 1, i, *map(int, x), 0.5) for i, x in enumerate(b)], "id_videofile long, frame_number int, detection_id long, x1 int, y1 int, x2 int, y2 int, score double")
    assert rows(boxes.regions(df, 0.3), "region", "x1", "y1", "x2", "y2", "boxes") == [(0, 0, 0, 11, 11, 3), (1, 30, 30, 40, 40, 1)]


# clustering


def angles(spark, *pairs):
    return spark.createDataFrame([(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in pairs], "face_id long, vector array<float>")


@pytest.mark.parametrize(
    ("pairs", "k", "t", "wanted"),
    [
        (((1, 0), (2, 2), (3, -3), (4, 90)), 64, 0.9, [("cl-1", 3), ("cl-4", 1)]),
        (((1, 0), (2, 60), (3, 120)), 64, 0.99, [("cl-1", 1), ("cl-2", 1), ("cl-3", 1)]),
        (((8, 91), (7, 89), (6, 1), (5, 0)), 64, 0.9, [("cl-5", 2), ("cl-7", 2)]),
        (((31, 0), (17, 0), (99, 180)), 64, 0.9, [("cl-17", 2), ("cl-99", 1)]),
        ((), 64, 0.9, []),
    ],
)
def test_clusters(spark, pairs, k, t, wanted):
    assert rows(clustering.clusters(angles(spark, *pairs), k, t), "cluster_id", "size") == sorted(wanted)


def test_each_point_is_in_one_cluster(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, rng.normal(size=128).tolist()) for i in range(600)], "face_id long, vector array<double>")
    got = faces.members(clustering.grouped(points, 16, 0.9)).collect()
    assert sorted(r["face_id"] for r in got) == list(range(600))
    assert all(n == len([1 for r in got if r["cluster_id"] == k]) for k, n in {(r["cluster_id"], r["size"]) for r in got})


@pytest.mark.parametrize("rows_a_range", [7, 200_000])
def test_seeds_by_ranges(spark, rows_a_range):
    rng = np.random.default_rng(5)
    ids = sorted(int(i) for i in rng.choice(10**6, 103, replace=False))
    points = spark.createDataFrame([(i, [1.0]) for i in ids], "face_id long, vector array<double>")
    assert rows(clustering.seeds(points, 10, rows_a_range).select("seed", "face_id")) == [(s, ids[s * 10]) for s in range(10)]


def test_frames_over_several_pieces(spark):
    """Boxes of a frame meet however Arrow cuts the rows; null is a frame of its own."""
    made = [(d, f, n, 0.9 - n / 100, 10 * (n // 2), 0, 10 * (n // 2) + 8, 8) for d, f in [(1, 0), (1, 1), (1, 200), (2, 0), (None, 0)] for n in range(8)]
    frame = spark.createDataFrame([(v, f, (i, s, a, b, c, d)) for i, (v, f, _, s, a, b, c, d) in enumerate(made)], "id_videofile long, frame_number long, r struct<detection_id: long, score: double, x1: int, y1: int, x2: int, y2: int>").select("id_videofile", "frame_number", "r.*")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        kept = [r[0] for r in boxes.non_maximum(frame, 0.4).select("detection_id").collect()]
        found = boxes.regions(frame, 0.4).select("boxes").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(kept) == [i for i in range(40) if i % 2 == 0]
    assert [r[0] for r in found] == [2] * 20


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(spark, zero=vectors.cosine(a(0, 0), a(1, 0)), self=vectors.cosine(a(3, 4), a(3, 4)), unit=vectors.unit(a(3, 4)), none=vectors.is_zero(a(0, 0)))
    assert r["zero"] == 0 and abs(r["self"] - 1) < 1e-12 and r["unit"] == [0.6, 0.8] and r["none"]


# text


def test_canonical_text_round_trips(spark):
    import json

    values = ["plain", 'q"b\\s', "a\r\nb\rc", "tab\tbell\x07", "", "Ünï"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.canonical_text(F.col("v")).alias("c"))
    for r in df.collect():
        assert json.loads(r["c"]) == r["v"].replace("\r\n", "\n").replace("\r", "\n")


def test_canonical_forms(spark):
    d = lambda x: F.lit(x).cast("decimal(20,6)")
    r = one(spark, a=text.canonical_number(d("1.500")), b=text.canonical_number(d("100")), c=text.canonical_number(d("0")), o=text.canonical_object(("a", F.lit("1")), ("b", F.lit(None).cast("string"))), e=text.canonical_object(), m=text.canonical_map(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))))
    assert tuple(r) == ("1.5", "100", "0", '{\n  "a": 1\n}', "{\n}", '{"a": 1, "b": 2}')


def test_framed_hash(spark):
    import hashlib

    r = one(spark, a=text.framed_hash(F.lit("ab"), F.lit(None)), b=text.framed_hash(F.lit("a"), F.lit("b")))
    assert r["a"] == hashlib.sha256(b"ab\x1f\x1f").hexdigest() and r["b"] == hashlib.sha256(b"a\x1fb\x1f").hexdigest()


def test_small_texts(spark):
    r = one(spark, l=text.listed(F.lit(" a, b,,a ")), k=text.cluster_face(F.lit("cl-17")), n=text.cluster_face(F.lit("x-17")), s=text.stem(F.lit("a.b.mkv")), p=text.relative_path(F.lit("/m/p/x"), F.lit("/m/p")), q=text.relative_path(F.lit("/m/px"), F.lit("/m/p")), ok=text.safe_relative_path(F.lit("a/b")), bad=text.safe_relative_path(F.lit("a/../b")), t=text.tolerant_timestamp(F.lit(" ")), h=text.human_bytes(F.lit(2048)), d=text.human_duration(F.lit(3723000)), j=text.json_of_array(F.array(F.lit("a\rb"))))
    assert tuple(r) == (["a", "b"], 17, None, "a.b", "x", None, True, False, None, "2.0 KiB", "1:02:03", '["a\\nb"]')


# filters

FACTS = "shot_id long, scene_id long, first_frame int, last_frame int, origin string, size string, location_id int, scene_first int, scene_last int, scene_persons array<bigint>, shot_persons array<bigint>"


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(1, 1, 0, 9, "AUTO", "CU", None, 0, 19, [1, 2], [1]), (2, 1, 10, 19, "AUTO", "MS", None, 0, 19, [1, 2], [2]), (3, 2, 20, 29, "OPERATOR", "MS", 7, 20, 29, [], [])], FACTS)


@pytest.mark.parametrize(
    ("tree", "wanted"),
    [
        (Group("AND"), [1, 2, 3]),
        (Group("OR"), []),
        (Group("AND", (Condition("PERSON", "IN", [2]),)), [2]),
        (Group("AND", (Condition("PERSON", "IN", [2], subject="SCENE"),)), [1, 2]),
        (Group("AND", (Condition("LOCATION", "NOT_IN", [7]),)), [1, 2]),
        (Group("AND", (Condition("LOCATION", "IS_NULL", negated=True),)), [3]),
        (Group("OR", (Condition("SHOT_SIZE", "IN", ["CU"]), Group("AND", (Condition("FRAME_RANGE", "BETWEEN", [25, 40]), Condition("HAS_FACE", "IS_NULL"))))), [1, 3]),
    ],
)
def test_filters(facts, tree, wanted):
    assert rows(filters.passing_shots(facts, tree), "shot_id") == [(i,) for i in wanted]
    assert filters.described(tree)


def test_filters_refuse_what_they_don_t_know(facts):
    deep = Group("AND", (Group("AND", (Group("AND", (Group("AND"),)),)),))
    for bad in (Condition("COLOUR", "IN", [1]), Condition("LOCATION", "LIKE", 1), Condition("LOCATION", "IN", [1], subject="EVENT"), Group("XOR"), deep):
        with pytest.raises(ValueError):
            filters.compiled(bad)


def test_filter_tree_from_rows():
    groups = [{"group_id": 1, "parent_group_id": None, "ordinal": 0, "conjunction": "AND"}, {"group_id": 2, "parent_group_id": 1, "ordinal": 1, "conjunction": "OR"}]
    conditions = [{"group_id": 2, "ordinal": 0, "condition_type": "PERSON", "subject": "SHOT", "operator": "IN", "value": "[1]", "negated": False}]
    assert filters.tree(groups, conditions) == Group("AND", (Group("OR", (Condition("PERSON", "IN", [1]),)),))
    with pytest.raises(ValueError):
        filters.tree(groups[1:], conditions)


# tables


def test_paging_bounds(spark):
    df = spark.range(10)
    assert [r[0] for r in paging.page(df, ["id"], 4, 3).collect()] == [4, 5, 6]
    assert paging.page(df, ["id"], -5, 0).count() == 1 and paging.page(df, ["id"], 0, 10**6).count() == 10


def test_put_keeps_ordinals(spark):
    stored = spark.createDataFrame([("S", 1, "a", "x", 0), ("S", 1, "b", "y", 4)], "owner_kind string, owner_id long, property_key string, property_value string, ordinal int")
    new = spark.createDataFrame([("S", 1, "b", None), ("S", 1, "c", "z"), ("S", 2, "q", "w")], "owner_kind string, owner_id long, property_key string, property_value string")
    got = {(r["owner_id"], r["property_key"]): (r["property_value"], r["ordinal"]) for r in upserts.put(stored, new, ["owner_kind", "owner_id", "property_key"]).collect()}
    assert got == {(1, "a"): ("x", 0), (1, "b"): (None, 4), (1, "c"): ("z", 5), (2, "q"): ("w", 0)}


def test_changes_with_nulls(spark):
    a = spark.createDataFrame([(1, None, [1.0]), (2, "x", None)], "k long, v string, w array<double>")
    b = spark.createDataFrame([(1, None, [1.0]), (2, "y", None), (3, "z", None)], "k long, v string, w array<double>")
    assert rows(upserts.changes(a, b, ["k"], ["v", "w"])) == [(1, "UNCHANGED"), (2, "UPDATE"), (3, "INSERT")]


def test_compatibility_of_profiles(spark):
    base = ("h264", "yuv420p", 1001, 24000, "aac", 2, 48000)
    row = lambda o, profile, num: (1, o, o, 1920, 1080, base[0], profile, base[1], num, base[3], base[4], base[5], base[6])
    files = spark.createDataFrame([row(1, None, 1001), row(2, "", 1001), row(3, "Main", 1)], "recipe_id long, ordinal int, id_videofile long, width int, height int, video_codec string, video_profile string, pixel_format string, time_base_num int, time_base_den int, audio_codec string, audio_channels int, audio_sample_rate int")
    report = recipes.compatibility(files)
    assert rows(report, "ordinal", "differing") == [(1, []), (2, []), (3, ["videoProfile", "frameRateBase"])]
    assert rows(recipes.differing_attributes(report)) == [(1, False, ["frameRateBase", "videoProfile"])]


def test_settings(spark):
    updates = spark.createDataFrame([(1, k, v) for k, v in (("scene.threshold", "8.0"), ("scene.threshold", "-1"), ("shot.size.thresholds", "[0.5, 0.2]"), ("shot.size.thresholds", "[0.2, 0.5]"), ("shot.size.thresholds", "[]"), ("cluster.count", "1.5"), ("cluster.count", None), ("recipe.audio_track_count", "0"), ("face.detect_threshold", "1.0"), ("x", "1"))], "id_project long, key string, value string")
    got = {(r["key"], r["value"]): (r["problem"], r["normal"]) for r in settings.validate(updates).collect()}
    assert got["scene.threshold", "8.0"] == (None, "8") and got["scene.threshold", "-1"][0] == "OUT_OF_RANGE"
    assert got["shot.size.thresholds", "[0.5, 0.2]"] == (None, "[0.5,0.2]") and got["shot.size.thresholds", "[0.2, 0.5]"][0] == "NOT_FALLING" and got["shot.size.thresholds", "[]"][0] == "EMPTY_LIST"
    assert got["cluster.count", "1.5"][0] == got["cluster.count", None][0] == "NOT_AN_INTEGER" and got["recipe.audio_track_count", "0"] == (None, "0") and got["face.detect_threshold", "1.0"] == (None, "1") and got["x", "1"][0] == "UNKNOWN_KEY"
    projects = spark.createDataFrame([(1,), (2,)], "id_project long")
    assert settings.missing(projects, settings.defaults(projects).where("id_project = 1 OR key <> 'cluster.count'")).collect()[0]["missing"] == ["cluster.count"]


def test_quality_rules_are_valid_sql(spark):
    for relation, rules in quality.RULES.items():
        for r in rules:
            assert r.name and relation
            if isinstance(r, quality.Check):
                assert F.expr(r.predicate) is not None


def test_null_passes_checks(spark):
    df = spark.createDataFrame([(1, None), (2, -1), (3, 0)], "id_videofile long, frame_number int")
    found = quality.violations({"frames": df}, {"frames": ["id_videofile"]})
    assert rows(found) == [("frames", "number_nonnegative", "2")]


def test_unknown_values_raise(spark):
    df = spark.createDataFrame([("A",), ("Z",)], "kind string").select(quality.parsed("kind", "A"))
    with pytest.raises(Exception, match="unknown kind"):
        df.collect()


def test_transitions(spark):
    log = spark.createDataFrame([(1, i, s) for i, s in enumerate(["WAITING", "CREATING", "WORKING", "DONE", "ERROR"])] + [(2, 0, "WORKING")], "job_id long, seq long, state string")
    assert [r["allowed"] for r in jobs.check_log(log).orderBy("job_id", "seq").collect()] == [True, True, True, True, False, False]


def test_checksums_supersede(spark):
    df = spark.createDataFrame([(1, 1, "DONE", False), (2, 1, "DONE", False), (3, 1, "ERROR", False)], "checksum_id long, id_videofile long, state string, is_stale boolean")
    assert rows(staleness.supersede(df), "checksum_id", "is_stale") == [(1, True), (2, False), (3, False)]


def test_flags_and_frames_must_agree(spark):
    flags = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True)], "id_videofile long, frame_number int, is_key boolean")
    sizes = lambda n: spark.createDataFrame([(1, n)], "id_videofile long, frame_count int")
    assert bytes(bitmaps.from_flags(flags, sizes(3)).first()["keyframe_bitmap"]) == bytes([0b10100000])
    for broken in (bitmaps.from_flags(flags, sizes(4)), bitmaps.from_flags(flags.union(flags), sizes(3))):
        with pytest.raises(Exception, match="differ in number"):
            broken.collect()


def test_unknown_literals_are_errors(spark):
    df = spark.createDataFrame([("DONE",), (None,)], "state string")
    assert [r[0] for r in df.select(text.one_of(F.col("state"), ("DONE",), "state")).collect()] == ["DONE", None]
    with pytest.raises(Exception, match="unknown state: DONE"):
        df.select(text.one_of(F.col("state"), ("WAITING",), "state")).collect()


def test_utc_seconds_in_any_zone(spark):
    moment = F.to_timestamp(F.lit("2024-07-01T10:20:30.9+02:00"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert spark.range(1).select(text.utc_second(moment)).first()[0] == "2024-07-01T08:20:30Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_seals(spark):
    """Each way a recipe may fail to be sealed, nulls and a missing document included; only sealed ones have their files looked at."""
    signed = [(1, "d", "s", "k1"), (2, None, "s", "k1"), (3, "d", None, "k1"), (4, "d", "s", None), (5, "d", "s", "k2"), (6, "x", "s", "k1"), (7, "d", "s", "k1")]
    recipe = spark.createDataFrame(signed, "recipe_id long, content_sha256 string, signature string, signing_key_id string")
    documents = spark.createDataFrame([(i, "d") for i in range(1, 7)], "recipe_id long, content_sha256 string")
    keys = spark.createDataFrame([("k1",), ("k1",), (None,)], "signing_key_id string")
    found = recipes.seals(recipe, documents, keys)
    assert dict(rows(found)) == {1: "SEALED", 2: "UNSIGNED", 3: "UNSIGNED", 4: "UNSIGNED", 5: "UNKNOWN_KEY", 6: "ALTERED", 7: "ALTERED"}
    items = spark.createDataFrame([(1, "a", "h"), (1, "b", "h"), (6, "a", "h"), (9, "a", "h")], "recipe_id long, relative_path string, source_sha256 string")
    files = spark.createDataFrame([("a", "h")], "relative_path string, digest string")
    got = recipes.verify_sealed(items, files, found).select("recipe_id", "relative_path", "seal", "verdict")
    assert rows(got) == [(1, "a", "SEALED", "OK"), (1, "b", "SEALED", "MISSING"), (6, "a", "ALTERED", None), (9, "a", None, None)]
