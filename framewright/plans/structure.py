"""Queries on segments, intervals, keyframes and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bitmaps, geometry, timebase
from ..operators import edits, intervals, keyframes, paging, segments, upserts
from .registry import query
from .views import Views

BY_SHOT = ["id_videofile", "shot_id", "first_frame", "last_frame"]
BY_SCENE = ["id_videofile", "scene_id", "first_frame", "last_frame"]


@query("segments", "SELECT id_videofile, level, first_frame, last_frame FROM ranges")
def _(v: Views):
    return v.ranges


@query("coverage_audit", """
SELECT r.id_videofile, level, count(*) AS segments, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS overlaps, CAST(sum(last_frame - first_frame + 1) AS BIGINT) AS covered,
       sum(last_frame - first_frame + 1) = any_value(vf.frame_count) AS complete FROM ranges r JOIN vf ON r.id_videofile = vf.id_videofile GROUP BY 1, 2""")
def _(v: Views):
    return segments.coverage(v.ranges, v.videofiles)


@query("cover_with_holes", """
, live AS (SELECT * FROM scenes WHERE NOT is_stale),
step AS (SELECT l.*, coalesce(lag(last_frame) OVER (PARTITION BY id_videofile ORDER BY first_frame), -1) AS prev FROM live l)
SELECT s.id_videofile, 'SCENE' AS level, count(*) AS segments, CAST(sum(CASE WHEN first_frame > prev + 1 THEN 1 ELSE 0 END) + CASE WHEN max(last_frame) < any_value(vf.frame_count) - 1 THEN 1 ELSE 0 END AS BIGINT) AS gaps,
       CAST(sum(CASE WHEN first_frame <= prev THEN 1 ELSE 0 END) AS BIGINT) AS overlaps, CAST(sum(last_frame - first_frame + 1) AS BIGINT) AS covered,
       sum(last_frame - first_frame + 1) = any_value(vf.frame_count) AS complete FROM step s JOIN vf ON s.id_videofile = vf.id_videofile GROUP BY 1""")
def _(v: Views):
    return segments.coverage(v.scenes.where("NOT is_stale").withColumn("level", F.lit("SCENE")), v.videofiles)


@query("contiguous_segments", """
SELECT id_videofile, level, first_frame, last_frame, last_frame + 1 = lead(first_frame) OVER (PARTITION BY id_videofile, level ORDER BY first_frame) AS joins_next FROM ranges""")
def _(v: Views):
    return segments.contiguous(v.ranges)


@query("segment_stats", """
SELECT level, count(*) AS segments, min(last_frame - first_frame + 1) AS shortest, quantile_cont(last_frame - first_frame + 1, 0.5) AS median, max(last_frame - first_frame + 1) AS longest FROM ranges GROUP BY 1""")
def _(v: Views):
    return segments.lengths(v.ranges)


@query("boundaries_by_level", """
SELECT id_videofile, level, array_to_string(list_sort(list(DISTINCT frame_number)), ',') AS frames FROM bounds GROUP BY 1, 2""")
def _(v: Views):
    return segments.by_level(v.bounds).withColumn("frames", F.array_join("frames", ","))


@query("scene_subset_check", """
SELECT b.id_videofile, b.frame_number FROM (SELECT id_videofile, frame_number FROM scores WHERE score >= 100) b
WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.score >= 50 AND s.id_videofile = b.id_videofile AND s.frame_number = b.frame_number)""")
def _(v: Views):
    return segments.scene_starts_within_shots(v.bounds)


@query("threshold_sweep", """
, ref AS (SELECT id_videofile, first_frame AS f FROM ranges WHERE level = 'SCENE'), ts AS (SELECT unnest([50.0, 80.0, 100.0, 150.0]) AS threshold),
ours AS (SELECT CAST(threshold AS DOUBLE) AS threshold, id_videofile, frame_number FROM scores, ts WHERE score >= threshold),
d AS (SELECT o.threshold, o.id_videofile, o.frame_number, min(abs(o.frame_number - r.f)) AS distance FROM ours o LEFT JOIN ref r ON o.id_videofile = r.id_videofile GROUP BY 1, 2, 3),
n AS (SELECT threshold, count(*) AS boundaries, count_if(distance = 0) AS exact, count_if(distance <= 5) AS near FROM d GROUP BY 1)
SELECT threshold, boundaries, CAST(exact AS BIGINT) AS exact, CAST(near AS BIGINT) AS near, CAST((SELECT count(*) FROM ref) - exact AS BIGINT) AS missed, CAST(boundaries - exact AS BIGINT) AS extra FROM n""")
def _(v: Views):
    reference = v.ranges.where("level = 'SCENE'").select("id_videofile", F.col("first_frame").alias("frame_number"))
    return segments.sweep(v.scores, reference, [50.0, 80.0, 100.0, 150.0])


@query("nearest_boundary", """
, ours AS (SELECT id_videofile, frame_number FROM scores WHERE score >= 90), ref AS (SELECT id_videofile, frame_number AS f FROM scores WHERE score >= 120)
SELECT o.id_videofile, o.frame_number, min(abs(o.frame_number - r.f)) AS distance FROM ours o LEFT JOIN ref r ON o.id_videofile = r.id_videofile GROUP BY 1, 2""")
def _(v: Views):
    return segments.nearest(v.scores.where("score >= 90"), v.scores.where("score >= 120"))


@query("face_shot_binding", "SELECT face_id, shot_id FROM shot_faces")
def _(v: Views):
    return intervals.bind(v.faces, v.shots.select(*BY_SHOT), "shot_id").select("face_id", "shot_id")


@query("ambiguous_intervals", """
SELECT a.id_videofile, a.id, a.first_frame, a.last_frame FROM (SELECT id_videofile, shot_id AS id, first_frame, last_frame + first_frame % 3 AS last_frame FROM shots) a
WHERE EXISTS (SELECT 1 FROM (SELECT id_videofile, shot_id AS id, first_frame, last_frame + first_frame % 3 AS last_frame FROM shots) b WHERE b.id_videofile = a.id_videofile AND b.first_frame < a.first_frame AND b.last_frame >= a.first_frame)""")
def _(v: Views):
    wide = v.shots.select("id_videofile", F.col("shot_id").alias("id"), "first_frame", (F.col("last_frame") + F.col("first_frame") % 3).alias("last_frame"))
    return intervals.ambiguous(wide, "id")


@query("scene_shots", """
SELECT c.scene_id, s.shot_id FROM shots s JOIN scenes c ON s.id_videofile = c.id_videofile AND s.first_frame >= c.first_frame AND s.last_frame <= c.last_frame""")
def _(v: Views):
    return intervals.contained(v.shots.select(*BY_SHOT), v.scenes.select(*BY_SCENE), "scene_id").select("scene_id", "shot_id")


@query("overlap_shots", """
, moved AS (SELECT shot_id AS other_id, id_videofile, first_frame + 2 AS first_frame, last_frame + 5 AS last_frame FROM shots WHERE first_frame % 3 = 0)
SELECT s.id_videofile, s.shot_id, m.other_id FROM shots s JOIN moved m ON s.id_videofile = m.id_videofile AND s.last_frame >= m.first_frame AND s.first_frame <= m.last_frame""")
def _(v: Views):
    moved = v.shots.where("first_frame % 3 = 0").select(F.col("shot_id").alias("other_id"), "id_videofile", (F.col("first_frame") + 2).alias("first_frame"), (F.col("last_frame") + 5).alias("last_frame"))
    return intervals.overlapping(v.shots, moved, "shot_id", "other_id")


@query("scene_persons", """
SELECT c.scene_id, coalesce(array_to_string(list_sort(list(DISTINCT p.name) FILTER (p.name IS NOT NULL)), ','), '') AS person_names
FROM scenes c LEFT JOIN faces f ON f.id_videofile = c.id_videofile AND f.frame_number BETWEEN c.first_frame AND c.last_frame LEFT JOIN persons p ON p.person_id = f.person_id AND p.kind = 'PERSON' GROUP BY 1""")
def _(v: Views):
    return intervals.persons_in(v.scenes, v.faces, v.persons).select("scene_id", F.array_join("person_names", ",").alias("person_names"))


@query("largest_face_share", "SELECT shot_id, round(share, 9) AS share FROM shares")
def _(v: Views):
    return intervals.largest_share(v.shots.select(*BY_SHOT), v.faces, v.videofiles).select("shot_id", F.round("share", 9).alias("share"))


@query("shot_sizes", """
SELECT shot_id, CASE WHEN share IS NULL THEN 'NONE' WHEN share >= 0.35 THEN 'ECU' WHEN share >= 0.22 THEN 'BCU' WHEN share >= 0.13 THEN 'CU' WHEN share >= 0.075 THEN 'MCU' WHEN share >= 0.04 THEN 'MS'
    WHEN share >= 0.02 THEN 'MLS' WHEN share >= 0.009 THEN 'LS' WHEN share >= 0.003 THEN 'VLS' ELSE 'XLS' END AS size FROM shares""")
def _(v: Views):
    return intervals.largest_share(v.shots.select(*BY_SHOT), v.faces, v.videofiles).select("shot_id", geometry.size_of_share(F.col("share")).alias("size"))


@query("share_percentiles", "SELECT count(*) AS shots, count(share) AS with_face, round(quantile_cont(share, 0.25), 9) AS p25, round(quantile_cont(share, 0.5), 9) AS p50, round(quantile_cont(share, 0.95), 9) AS p95 FROM shares")
def _(v: Views):
    share = intervals.largest_share(v.shots.select(*BY_SHOT), v.faces, v.videofiles)
    return share.agg(F.count("*").alias("shots"), F.count("share").alias("with_face"), *[F.round(F.percentile("share", p), 9).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.95, "p95"))])


@query("structure_read", """
SELECT c.scene_id, c.id_videofile, c.first_frame, c.last_frame, c.title, l.name AS location_name, count(s.shot_id) AS shots, array_to_string(list_sort(list(s.first_frame) FILTER (s.first_frame IS NOT NULL)), ',') AS shot_starts
FROM scenes c LEFT JOIN shots s ON s.id_videofile = c.id_videofile AND s.first_frame >= c.first_frame AND s.last_frame <= c.last_frame LEFT JOIN locations l ON l.location_id = c.location_id
WHERE NOT c.is_stale GROUP BY 1, 2, 3, 4, 5, 6""")
def _(v: Views):
    return segments.structure(v.scenes, v.shots, v.locations).withColumn("shot_starts", F.array_join("shot_starts", ","))


@query("keyframe_cut", "SELECT scene_id, first_frame, last_frame, cut_first, cut_last FROM cuts")
def _(v: Views):
    return keyframes.cut(v.scenes.select("scene_id", "id_videofile", "first_frame", "last_frame"), v.keys).drop("id_videofile")


@query("keyframe_bitmap", """
, bytes AS (SELECT id_videofile, b, coalesce((SELECT bit_or(128 >> (k.frame_number % 8)) FROM keys k WHERE k.id_videofile = w.id_videofile AND k.frame_number // 8 = w.b), 0) AS m
    FROM (SELECT id_videofile, unnest(range((frame_count + 7) // 8)) AS b FROM vf) w)
SELECT b.id_videofile, string_agg(printf('%02X', CAST(m AS INT)), '' ORDER BY b) AS bitmap, true AS fits, (SELECT count(*) FROM keys k WHERE k.id_videofile = b.id_videofile) AS keyframes FROM bytes b GROUP BY b.id_videofile""")
def _(v: Views):
    maps = bitmaps.build(v.keys, v.videofiles).join(v.videofiles.select("id_videofile", "frame_count"), "id_videofile")
    return maps.select("id_videofile", F.hex("keyframe_bitmap").alias("bitmap"), bitmaps.fits(F.col("keyframe_bitmap"), F.col("frame_count")).alias("fits"), bitmaps.count_bits(F.col("keyframe_bitmap")).cast("long").alias("keyframes"))


@query("keyframes_of_bitmap", "SELECT id_videofile, frame_number FROM keys")
def _(v: Views):
    maps = bitmaps.build(v.keys, v.videofiles).join(v.videofiles.select("id_videofile", "frame_count"), "id_videofile")
    return maps.select("id_videofile", F.explode(bitmaps.frames_in(F.col("keyframe_bitmap"), F.col("frame_count"))).alias("frame_number"))


@query("frame_flags_read", """
SELECT s.id_videofile, s.frame_number, s.score >= 50 AS is_shot_boundary, (s.frame_number % 12 = 0 OR s.event_type = 'signup') AS is_keyframe FROM scores s WHERE s.frame_number BETWEEN 10 AND 40""")
def _(v: Views):
    frames = v.scores.select("id_videofile", "frame_number", (F.col("score") >= 50).alias("is_shot_boundary"))
    return keyframes.flags(frames, bitmaps.build(v.keys, v.videofiles), 10, 40)


@query("keyframe_sets", """
, ours AS (SELECT DISTINCT id_videofile, frame_number FROM keys), ref AS (SELECT id_videofile, frame_number FROM scores WHERE frame_number % 6 = 0)
SELECT coalesce(o.id_videofile, r.id_videofile) AS id_videofile, CAST(count_if(o.frame_number IS NOT NULL AND r.frame_number IS NOT NULL) AS BIGINT) AS "both", CAST(count_if(r.frame_number IS NULL) AS BIGINT) AS only_ours,
       CAST(count_if(o.frame_number IS NULL) AS BIGINT) AS only_reference, count_if(r.frame_number IS NULL) = 0 AND count_if(o.frame_number IS NULL) = 0 AS equal
FROM ours o FULL JOIN ref r ON o.id_videofile = r.id_videofile AND o.frame_number = r.frame_number GROUP BY 1""")
def _(v: Views):
    return keyframes.compare(v.keys, v.scores.where("frame_number % 6 = 0"))


@query("timecode", """
SELECT s.event_id, CAST((2 * (s.event_id * 12345678)::HUGEINT * v.time_base_den + v.time_base_num * 1000000000::HUGEINT) // (2 * v.time_base_num * 1000000000::HUGEINT) AS BIGINT) AS frame,
       round(s.frame_number * v.time_base_num / v.time_base_den::DOUBLE, 9) AS seconds, printf('%.3f', (s.frame_number + 0.5::DOUBLE) * v.time_base_num / v.time_base_den) AS seek,
       CAST(v.time_base_num * 1000 // v.time_base_den AS BIGINT) AS frame_ms, CAST(v.frame_count * v.time_base_num // gcd(v.frame_count * v.time_base_num, v.time_base_den) AS BIGINT) AS duration_num,
       CAST(v.time_base_den // gcd(v.frame_count * v.time_base_num, v.time_base_den) AS BIGINT) AS duration_den FROM scores s JOIN videofiles v ON s.id_videofile = v.id_videofile""")
def _(v: Views):
    num, den = F.col("time_base_num"), F.col("time_base_den")
    met = v.scores.join(v.videofiles, "id_videofile").withColumn("_d", timebase.duration(F.col("frame_count"), num, den))
    return met.select("event_id", timebase.frame_of_nanos(F.col("event_id") * 12345678, num, den).alias("frame"), F.round(timebase.seconds_of_frame(F.col("frame_number"), num, den), 9).alias("seconds"), timebase.seek_text(F.col("frame_number"), num, den).alias("seek"), timebase.frame_millis(num, den).alias("frame_ms"), F.col("_d.num").alias("duration_num"), F.col("_d.den").alias("duration_den"))


@query("significant_frames", """
SELECT id_videofile, frame_number FROM (SELECT s.id_videofile, s.frame_number, s.score, s.event_type FROM scores s) WHERE score >= 50 OR event_type IN ('click', 'purchase')""")
def _(v: Views):
    frames = v.scores.select("id_videofile", "frame_number", (F.col("score") >= 100).alias("is_scene_boundary"), (F.col("score") >= 50).alias("is_shot_boundary"), F.col("event_type").isin("click", "purchase").cast("int").alias("face_count"), F.lit(None).cast("string").alias("size_hint"))
    return segments.significant(frames).select("id_videofile", "frame_number")


@query("frame_flags_upsert", """
, a AS (SELECT id_videofile, frame_number, score >= 100 AS sc, score >= 50 AS sh, CAST(event_id % 3 AS INT) AS n, CASE WHEN event_id % 4 = 0 THEN 'CU' END AS hint, 0 AS new FROM scores WHERE frame_number % 2 = 0),
b AS (SELECT id_videofile, frame_number, score >= 120, score >= 30, CAST(event_id % 5 AS INT), CASE WHEN event_id % 8 = 0 THEN 'LS' END, 1 FROM scores WHERE frame_number % 3 = 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT id_videofile, frame_number, bool_or(sc) AS is_scene_boundary, bool_or(sh) AS is_shot_boundary, max(n) AS face_count, coalesce(max(CASE WHEN new = 1 THEN hint END), max(CASE WHEN new = 0 THEN hint END)) AS size_hint FROM u GROUP BY 1, 2""")
def _(v: Views):
    def part(keep, scene, shot, n, hint, text):
        e = F.col("event_id")
        return v.scores.where(keep).select("id_videofile", "frame_number", (F.col("score") >= scene).alias("is_scene_boundary"), (F.col("score") >= shot).alias("is_shot_boundary"), (e % n).cast("int").alias("face_count"), F.when(e % hint == 0, text).alias("size_hint"))

    return upserts.merge_flags(part("frame_number % 2 = 0", 100, 50, 3, 4, "CU"), part("frame_number % 3 = 0", 120, 30, 5, 8, "LS"))


@query("frames_page", "SELECT event_id, id_videofile, frame_number FROM scores ORDER BY id_videofile, frame_number LIMIT 50 OFFSET 120")
def _(v: Views):
    return paging.page(v.scores.select("event_id", "id_videofile", "frame_number"), ["id_videofile", "frame_number"], 120, 50)


@query("frames_page_after", "SELECT event_id, id_videofile, frame_number FROM scores WHERE event_id >= 300 ORDER BY event_id LIMIT 40")
def _(v: Views):
    return paging.page_after(v.scores.select("event_id", "id_videofile", "frame_number"), "event_id", 300, 40)


@query("frame_pages", "SELECT id_videofile, frame_count, page, page * 24 AS from_row, least(page * 24 + 24, frame_count) - 1 AS to_row FROM (SELECT *, unnest(range((frame_count + 23) // 24)) AS page FROM vf)")
def _(v: Views):
    return paging.page_ranges(v.videofiles.select("id_videofile", "frame_count"), "frame_count", 24)


# One edit a videofile, at its second segment.
def _edits(v: Views, level: str, to):
    second = v.ranges.where(f"level = '{level}' AND first_frame > 0").groupBy("id_videofile").agg(F.min("first_frame").alias("from_frame"))
    return second.select("id_videofile", "from_frame", to.cast("int").alias("to_frame"))


MOVES = """
, e AS (SELECT id_videofile, min(first_frame) AS f, min(first_frame) + CAST(id_videofile % 7 AS INT) - 3 AS t FROM ranges WHERE level = '{level}' AND first_frame > 0 GROUP BY id_videofile),
p AS (SELECT e.*, l.first_frame AS lf, r.last_frame AS rl FROM e JOIN {table} l ON l.id_videofile = e.id_videofile AND l.last_frame = e.f - 1 JOIN {table} r ON r.id_videofile = e.id_videofile AND r.first_frame = e.f),
j AS (SELECT p.*, CASE WHEN t = f OR t <= lf OR t > rl OR {guard} THEN 'BOUNDARY_CONFLICT' END AS error_code FROM p)
"""
SHOT_MOVES = MOVES.format(level="SHOT", table="shots", guard="EXISTS (SELECT 1 FROM scenes c WHERE NOT c.is_stale AND c.id_videofile = p.id_videofile AND ((c.first_frame > lf AND c.first_frame <= t - 1) OR (c.first_frame > t AND c.first_frame <= rl)))")
SCENE_MOVES = MOVES.format(level="SCENE", table="(SELECT * EXCLUDE (is_stale) FROM scenes)", guard="NOT EXISTS (SELECT 1 FROM shots s WHERE s.id_videofile = p.id_videofile AND s.first_frame = t) OR NOT EXISTS (SELECT 1 FROM shots s WHERE s.id_videofile = p.id_videofile AND s.last_frame = t - 1)")


@query("move_boundary", SHOT_MOVES + """
SELECT s.shot_id, CASE WHEN s.first_frame = j.f THEN j.t ELSE s.first_frame END AS first_frame, CASE WHEN s.last_frame = j.f - 1 THEN j.t - 1 ELSE s.last_frame END AS last_frame,
       CASE WHEN s.first_frame = j.f OR s.last_frame = j.f - 1 THEN 'OPERATOR' ELSE 'AUTO' END AS origin FROM shots s LEFT JOIN (SELECT * FROM j WHERE error_code IS NULL) j ON j.id_videofile = s.id_videofile""")
def _(v: Views):
    wanted = _edits(v, "SHOT", F.col("from_frame") + F.col("id_videofile") % 7 - 3)
    plan = edits.plan_move(wanted, v.shots, "shot_id", scenes=v.scenes)
    return edits.apply_move(plan, v.shots, "shot_id").select("shot_id", "first_frame", "last_frame", "origin")


@query("move_scene_verdicts", SCENE_MOVES + "SELECT id_videofile, f AS from_frame, t AS to_frame, error_code FROM j")
def _(v: Views):
    live = v.scenes.withColumn("is_stale", F.lit(False))
    wanted = _edits(v, "SCENE", F.col("from_frame") + F.col("id_videofile") % 7 - 3)
    return edits.plan_move(wanted, live, "scene_id", shots=v.shots).select("id_videofile", "from_frame", "to_frame", "error_code")


@query("split_shot", """
, e AS (SELECT id_videofile, CAST(frame_count // 2 AS INT) AS f FROM vf), hit AS (SELECT s.*, e.f FROM shots s JOIN e ON e.id_videofile = s.id_videofile AND e.f > s.first_frame AND e.f <= s.last_frame)
SELECT s.shot_id, s.first_frame, s.last_frame, h.shot_id IS NOT NULL AS is_stale FROM shots s LEFT JOIN hit h ON h.shot_id = s.shot_id
UNION ALL SELECT -(id_videofile * 100000 + first_frame), first_frame, f - 1, false FROM hit UNION ALL SELECT -(id_videofile * 100000 + f), f, last_frame, false FROM hit""")
def _(v: Views):
    wanted = v.videofiles.select("id_videofile", F.floor(F.col("frame_count") / 2).cast("int").alias("frame"))
    plan = edits.plan_split(wanted, v.shots, "shot_id")
    return edits.apply_split(plan, v.shots, "shot_id", lambda first: -(F.col("id_videofile") * 100000 + first)).select("shot_id", "first_frame", "last_frame", "is_stale")


@query("shots_to_align", """
, e AS (SELECT id_videofile, CAST(frame_count // 2 AS INT) AS f FROM vf)
SELECT e.id_videofile, e.f AS frame FROM e JOIN (SELECT * FROM scenes WHERE NOT is_stale) c ON c.id_videofile = e.id_videofile AND e.f > c.first_frame AND e.f <= c.last_frame JOIN shots s ON s.id_videofile = e.id_videofile AND s.first_frame < e.f AND e.f < s.last_frame""")
def _(v: Views):
    wanted = v.videofiles.select("id_videofile", F.floor(F.col("frame_count") / 2).cast("int").alias("frame"))
    return edits.shots_to_align(edits.plan_split(wanted, v.scenes, "scene_id"), v.shots)


@query("merge_shots", """
, e AS (SELECT id_videofile, min(first_frame) AS f FROM ranges WHERE level = 'SHOT' AND first_frame > 0 GROUP BY 1),
p AS (SELECT e.*, l.first_frame AS lf, r.last_frame AS rl FROM e JOIN shots l ON l.id_videofile = e.id_videofile AND l.last_frame = e.f - 1 JOIN shots r ON r.id_videofile = e.id_videofile AND r.first_frame = e.f),
j AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM scenes c WHERE NOT c.is_stale AND c.id_videofile = p.id_videofile AND c.first_frame > lf AND c.first_frame <= rl))
SELECT s.shot_id, s.first_frame, CASE WHEN s.last_frame = j.f - 1 THEN j.rl ELSE s.last_frame END AS last_frame, coalesce(s.first_frame = j.f, false) AS is_stale FROM shots s LEFT JOIN j ON j.id_videofile = s.id_videofile""")
def _(v: Views):
    wanted = _edits(v, "SHOT", F.col("from_frame")).select("id_videofile", F.col("from_frame").alias("frame"))
    plan = edits.plan_merge(wanted, v.shots, "shot_id", scenes=v.scenes)
    return edits.apply_merge(plan, v.shots, "shot_id").select("shot_id", "first_frame", "last_frame", "is_stale")


@query("settled_shots", """
SELECT s.shot_id, CASE WHEN s.size_origin = 'OPERATOR' OR share IS NULL THEN 'NONE' WHEN share >= 0.35 THEN 'ECU' WHEN share >= 0.22 THEN 'BCU' WHEN share >= 0.13 THEN 'CU' WHEN share >= 0.075 THEN 'MCU' WHEN share >= 0.04 THEN 'MS'
    WHEN share >= 0.02 THEN 'MLS' WHEN share >= 0.009 THEN 'LS' WHEN share >= 0.003 THEN 'VLS' ELSE 'XLS' END AS size FROM shots s JOIN shares USING (shot_id)""")
def _(v: Views):
    return edits.settle(v.shots, v.faces, v.videofiles)[0].select("shot_id", "size")


@query("preview_layout", """
SELECT s.event_id, CAST(frame_number // 256 AS INT) AS sheet, CAST(frame_number % 256 // 16 AS INT) AS "row", CAST(frame_number % 256 % 16 AS INT) AS col, CAST(frame_number % 256 % 16 * 135 AS INT) AS x, CAST(frame_number % 256 // 16 * 75 AS INT) AS y FROM scores s""")
def _(v: Views):
    return v.scores.select("event_id", geometry.sheet_place(F.col("frame_number")).alias("p")).select("event_id", "p.*")
