"""Queries on faces, detections and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, vectors
from ..operators import boxes, clustering, faces
from .registry import query
from .views import Views


def _box():
    return [F.col(c) for c in ("x1", "y1", "x2", "y2")]


@query("nonperson_faces", """
SELECT face_id, CASE WHEN greatest(x2 - x1, y2 - y1)::DOUBLE / least(x2 - x1, y2 - y1) > 4 AND person_id <> 1 THEN 1 ELSE person_id END AS person_id,
       greatest(x2 - x1, y2 - y1)::DOUBLE / least(x2 - x1, y2 - y1) > 4 AND person_id <> 1 AS changed FROM faces""")
def _(v: Views):
    return faces.reclassify(v.faces, nonperson=1).select("face_id", "person_id", "changed")


@query("classified_faces", "SELECT face_id, CAST(CASE WHEN greatest(x2 - x1, y2 - y1)::DOUBLE / least(x2 - x1, y2 - y1) <= 4 THEN 0 ELSE 1 END AS BIGINT) AS person_id FROM faces")
def _(v: Views):
    return faces.classify(v.faces, 0, 1).select("face_id", "person_id")


@query("faces_outside_frame", "SELECT f.face_id FROM faces f JOIN videofiles v ON f.id_videofile = v.id_videofile WHERE NOT (x1 >= 0 AND y1 >= 0 AND x1 < x2 AND y1 < y2 AND x2 <= width AND y2 <= height)")
def _(v: Views):
    return faces.outside_frame(v.faces, v.videofiles).select("face_id")


@query("person_faces", "SELECT f.person_id, any_value(p.name) AS name, count(*) AS faces, min(face_id) AS first_face FROM faces f JOIN persons p ON p.person_id = f.person_id GROUP BY 1")
def _(v: Views):
    return faces.by_person(v.faces, v.persons)


@query("faces_with_person", "SELECT face_id, coalesce(p.name, 'UNRECOGNIZED') AS person_name, coalesce(p.kind, 'UNRECOGNIZED') AS person_kind FROM faces f LEFT JOIN (SELECT * FROM persons WHERE person_id < 8) p ON p.person_id = f.person_id")
def _(v: Views):
    return faces.with_person(v.faces, v.persons.where("person_id < 8")).select("face_id", "person_name", "person_kind")


@query("deleted_person_faces", """
SELECT face_id, CASE WHEN person_id = 7 THEN 2 WHEN person_id = 8 THEN 3 ELSE person_id END AS person_id FROM faces""")
def _(v: Views):
    gone = v.persons.where("person_id IN (7, 8)").select("person_id", "id_project")
    unrecognized = v.persons.where("person_id < 5").select("person_id", "id_project")
    return faces.delete_person(v.faces, gone, unrecognized).select("face_id", "person_id")


@query("service_persons_missing", """
SELECT p.id_project, k.kind, k.kind AS name FROM projects p CROSS JOIN (SELECT unnest(['UNRECOGNIZED', 'NONPERSON']) AS kind) k WHERE NOT EXISTS (SELECT 1 FROM persons q WHERE q.id_project = p.id_project AND q.kind = k.kind)""")
def _(v: Views):
    return faces.service_persons(v.projects, v.persons)


@query("scan_summary", "SELECT count(*) AS frames, CAST(count_if(event_type IN ('click', 'purchase')) AS BIGINT) AS frames_with_faces, CAST(count_if(event_type IN ('click', 'purchase')) AS BIGINT) AS faces FROM scores")
def _(v: Views):
    return faces.scan_summary(v.scores.select(F.col("event_type").isin("click", "purchase").cast("int").alias("face_count")))


@query("face_crop", """
, a AS (SELECT f.face_id, x1, y1, x2 - x1 AS w0, y2 - y1 AS h0, v.width AS fw, v.height AS fh, greatest(1, CAST(trunc((x2 - x1) * 1.66::DOUBLE) AS INT)) AS w, greatest(1, CAST(trunc((y2 - y1) * 1.66::DOUBLE) AS INT)) AS h FROM faces f JOIN videofiles v ON f.id_videofile = v.id_videofile),
b AS (SELECT *, least(greatest(x1 - (w - w0) // 2, 0), greatest(fw - w, 0)) AS cx, least(greatest(y1 - (h - h0) // 2, 0), greatest(fh - h, 0)) AS cy FROM a)
SELECT face_id, CAST(least(cx, fw - least(w, fw)) AS INT) AS x, CAST(least(cy, fh - least(h, fh)) AS INT) AS y, CAST(least(w, fw) AS INT) AS width, CAST(least(h, fh) AS INT) AS height FROM b""")
def _(v: Views):
    met = v.faces.join(v.videofiles.select("id_videofile", "width", "height"), "id_videofile")
    return met.select("face_id", geometry.crop(*_box(), F.col("width"), F.col("height")).alias("c")).select("face_id", "c.*")


@query("iou_pairs", """
, m AS (SELECT a.detection_id AS a, b.detection_id AS b, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas
  FROM detections a JOIN detections b ON a.id_videofile = b.id_videofile AND a.frame_number = b.frame_number AND a.detection_id < b.detection_id)
SELECT a, b, round(w * h / (areas - w * h)::DOUBLE, 9) AS iou FROM m WHERE w > 0 AND h > 0""")
def _(v: Views):
    return boxes.overlaps(v.detections).withColumn("iou", F.round("iou", 9))


@query("top_detections", "SELECT detection_id FROM (SELECT detection_id, row_number() OVER (PARTITION BY id_videofile, frame_number ORDER BY score DESC, detection_id) AS r FROM detections) WHERE r <= 3")
def _(v: Views):
    return boxes.top(v.detections, 3).select("detection_id")


@query("nms", """
, d AS (SELECT *, row_number() OVER (PARTITION BY id_videofile, frame_number ORDER BY score DESC, detection_id) AS r FROM detections),
o AS (SELECT a.id_videofile, a.frame_number, a.r AS ra, b.r AS rb FROM d a JOIN d b ON a.id_videofile = b.id_videofile AND a.frame_number = b.frame_number AND a.r < b.r
   WHERE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))::DOUBLE > 0.4),
g AS (SELECT d.id_videofile, d.frame_number, d.r, d.detection_id, list(o.ra) FILTER (o.ra IS NOT NULL) AS over FROM d LEFT JOIN o ON o.id_videofile = d.id_videofile AND o.frame_number = d.frame_number AND o.rb = d.r GROUP BY ALL),
k AS (SELECT id_videofile, frame_number, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept FROM d WHERE d.r = 1),
loop AS (SELECT g.id_videofile, g.frame_number, list(struct_pack(r := r, over := coalesce(over, [])) ORDER BY r) AS steps FROM g GROUP BY ALL),
done AS (SELECT id_videofile, frame_number, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(steps, lambda x: list_prepend(x.r, x.over))), lambda acc, x: CASE WHEN len(list_intersect(acc, x[2:])) = 0 THEN list_append(acc, x[1]) ELSE acc END) AS kept FROM loop)
SELECT d.detection_id FROM d JOIN done ON done.id_videofile = d.id_videofile AND done.frame_number = d.frame_number AND list_contains(done.kept, d.r)""")
def _(v: Views):
    return boxes.non_maximum(v.detections, 0.4).select("detection_id")


def _iou(a: str, b: str) -> str:
    """Intersection over union of two boxes in SQL."""
    side = lambda c: f"greatest(0, least({a}.{c}2, {b}.{c}2) - greatest({a}.{c}1, {b}.{c}1))"
    area = lambda t: f"({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1)"
    inter, both = f"{side('x')} * {side('y')}", f"{area(a)} + {area(b)}"
    return f"coalesce({inter} / nullif({both} - {inter}, 0)::DOUBLE, 0)"


@query("detected_faces", f"""
, best AS (SELECT * FROM detections WHERE score > 0.2 QUALIFY row_number() OVER (PARTITION BY id_videofile, frame_number ORDER BY score DESC, detection_id) <= 5),
d AS (SELECT b.id_videofile, b.frame_number, b.detection_id, b.score, least(greatest(b.x1 * 2.0::DOUBLE, 0), v.width) AS x1, least(greatest(b.x2 * 2.0::DOUBLE, 0), v.width) AS x2, least(greatest(b.y1 * 1.5::DOUBLE, 0), v.height) AS y1, least(greatest(b.y2 * 1.5::DOUBLE, 0), v.height) AS y2,
    row_number() OVER (PARTITION BY b.id_videofile, b.frame_number ORDER BY b.score DESC, b.detection_id) AS r FROM best b JOIN videofiles v USING (id_videofile)),
over AS (SELECT b.detection_id, list(a.r) AS better FROM d a JOIN d b ON a.id_videofile = b.id_videofile AND a.frame_number = b.frame_number AND a.r < b.r AND {_iou("a", "b")} > 0.3 GROUP BY 1),
steps AS (SELECT id_videofile, frame_number, list({{'r': r, 'better': coalesce(better, [])}} ORDER BY r) AS steps FROM d LEFT JOIN over USING (detection_id) GROUP BY ALL),
stay AS (SELECT id_videofile, frame_number, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(steps, lambda x: list_prepend(x.r, x.better))), lambda kept, x: CASE WHEN len(list_intersect(kept, x[2:])) = 0 THEN list_append(kept, x[1]) ELSE kept END) AS kept FROM steps)
SELECT id_videofile, frame_number, detection_id, round_even(x1, 0)::INTEGER AS x1, round_even(y1, 0)::INTEGER AS y1, round_even(x2, 0)::INTEGER AS x2, round_even(y2, 0)::INTEGER AS y2, score
FROM d JOIN stay USING (id_videofile, frame_number) WHERE list_contains(kept, r) AND round_even(x2, 0) > round_even(x1, 0) AND round_even(y2, 0) > round_even(y1, 0)""")
def _(v: Views):
    candidates = v.detections.join(v.videofiles.select("id_videofile", "width", "height"), "id_videofile")
    return boxes.detect(candidates, 0.2, 0.3, 5, 2.0, 1.5).select("id_videofile", "frame_number", "detection_id", "x1", "y1", "x2", "y2", "score")


@query("box_regions", f"""
, links AS (SELECT a.detection_id AS a, b.detection_id AS b FROM detections a JOIN detections b ON a.id_videofile = b.id_videofile AND a.frame_number = b.frame_number AND {_iou("a", "b")} >= 0.3),
reached(a, b) AS (SELECT detection_id, detection_id FROM detections UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
heads AS (SELECT a AS detection_id, min(b) AS head FROM reached GROUP BY 1)
SELECT id_videofile, frame_number, CAST(dense_rank() OVER (PARTITION BY id_videofile, frame_number ORDER BY head) - 1 AS BIGINT) AS region, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS boxes
FROM detections JOIN heads USING (detection_id) GROUP BY id_videofile, frame_number, head""")
def _(v: Views):
    return boxes.regions(v.detections, 0.3)


@query("detector_quality", """
, f AS (SELECT id_videofile, frame_number, detection_id AS region, x1, y1, x2, y2 FROM detections WHERE detection_id % 4 = 0), u AS (SELECT id_videofile, frame_number, detection_id AS region, x1, y1, x1 + 12 AS x2, y1 + 40 AS y2 FROM detections WHERE detection_id % 4 = 1),
d AS (SELECT *, (x1 + x2) / 2.0 AS mx, (y1 + y2) / 2.0 AS my FROM detections), t AS (SELECT unnest([0.05, 0.2, 0.4, 0.6, 0.8, 0.9]) AS threshold),
h AS (SELECT d.detection_id, d.score, (SELECT count(*) FROM f WHERE f.id_videofile = d.id_videofile AND f.frame_number = d.frame_number AND mx BETWEEN f.x1 AND f.x2 AND my BETWEEN f.y1 AND f.y2) AS nf,
   (SELECT count(*) FROM u WHERE u.id_videofile = d.id_videofile AND u.frame_number = d.frame_number AND mx BETWEEN u.x1 AND u.x2 AND my BETWEEN u.y1 AND u.y2) AS nu FROM d),
b AS (SELECT f.id_videofile, f.frame_number, f.region, max(d.score) AS score FROM f JOIN d ON f.id_videofile = d.id_videofile AND f.frame_number = d.frame_number AND mx BETWEEN f.x1 AND f.x2 AND my BETWEEN f.y1 AND f.y2 GROUP BY ALL)
SELECT CAST(threshold AS DOUBLE) AS threshold, (SELECT count(*) FROM h WHERE score >= threshold) AS detections, (SELECT count(*) FROM b WHERE score >= threshold) AS found, (SELECT count(*) FROM f) AS total,
   (SELECT count(*) FROM h WHERE score >= threshold AND nf = 0 AND nu = 0) AS false_positives, (SELECT count(*) FROM h WHERE score >= threshold AND nf = 0 AND nu > 0) AS on_undecidable,
   round((SELECT count(*) FROM b WHERE score >= threshold) / (SELECT count(*) FROM f)::DOUBLE, 4) AS recall FROM t""")
def _(v: Views):
    region = v.detections.withColumnRenamed("detection_id", "region")
    unclear = region.where("region % 4 = 1").withColumn("x2", F.col("x1") + 12).withColumn("y2", F.col("y1") + 40)
    return boxes.quality(v.detections, region.where("region % 4 = 0"), unclear, [0.05, 0.2, 0.4, 0.6, 0.8, 0.9])


@query("cosine_to_first", "SELECT a.face_id, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 6) AS similarity FROM points a CROSS JOIN (SELECT vector FROM points ORDER BY face_id LIMIT 1) b")
def _(v: Views):
    first = v.points.orderBy("face_id").limit(1).select(F.col("vector").alias("_first"))
    return v.points.crossJoin(F.broadcast(first)).select("face_id", F.round(vectors.cosine(F.col("vector"), F.col("_first")), 6).alias("similarity"))  # one row


SEEDS = """
, n AS (SELECT count(*) AS n, least(16, count(*)) AS k FROM points), r AS (SELECT face_id, vector::DOUBLE[] AS vector, row_number() OVER (ORDER BY face_id) - 1 AS rn FROM points),
s AS (SELECT CAST(rn // (n // k) AS BIGINT) AS seed, face_id, vector FROM r, n WHERE rn % (n // k) = 0 AND rn < (n // k) * k)
"""


@query("cluster_seeds", SEEDS + "SELECT seed, face_id FROM s")
def _(v: Views):
    return clustering.seeds(v.points, 16).select("seed", "face_id")


@query("seed_assign", SEEDS + """
, m AS (SELECT p.face_id, s.seed, list_cosine_similarity(p.vector, s.vector) AS sim, row_number() OVER (PARTITION BY p.face_id ORDER BY list_cosine_similarity(p.vector, s.vector) DESC, s.seed) AS k FROM r p CROSS JOIN s)
SELECT face_id, seed AS centre, round(sim, 6) AS similarity FROM m WHERE k = 1""")
def _(v: Views):
    centres = [r["vector"] for r in clustering.seeds(v.points, 16).orderBy("seed").collect()]
    return clustering.assigned(v.points, centres).withColumn("similarity", F.round("similarity", 6))


@query("cluster_means", """
, e AS (SELECT id_videofile, unnest(vector::DOUBLE[]) AS x, generate_subscripts(vector, 1) AS i FROM points)
SELECT id_videofile, CAST(i - 1 AS INT) AS i, round(avg(x), 6) AS mean, count(*) AS size FROM e GROUP BY 1, 2""")
def _(v: Views):
    return vectors.mean_by(v.points, "id_videofile", "vector").select("id_videofile", F.posexplode("mean").alias("i", "mean"), "size").withColumn("mean", F.round("mean", 6))


@query("vector_checks", "SELECT count(DISTINCT len(vector)) AS sizes, count(DISTINCT len(vector)) <= 1 AS uniform FROM points")
def _(v: Views):
    return vectors.dimensions(v.points, "vector")


def _clusters_sql(count: int, threshold: float) -> str:
    """Assignment to seeds, greedy merging by recursion over lists, assignment again."""
    merging = """
, near AS (SELECT p.face_id, p.vector, arg_max(s.seed, {'sim': list_cosine_similarity(p.vector, s.vector), 'seed': -s.seed}) AS seed FROM r p CROSS JOIN s GROUP BY p.face_id, p.vector),
summed AS (SELECT seed, i, sum(vector[i]) AS x, count(*) AS n FROM near, range(1, (SELECT max(len(vector)) FROM r) + 1) t(i) GROUP BY seed, i),
first_ AS (SELECT list({'t': t, 's': n} ORDER BY seed) AS all_ FROM (SELECT seed, list(x ORDER BY i) AS t, max(n) AS n FROM summed GROUP BY seed)),
merging(step, all_, free, found) AS (
    SELECT 0, all_, range(1, len(all_) + 1), CAST([] AS BIGINT[][]) FROM first_
    UNION ALL
    SELECT step + 1,
        CASE WHEN len(free) > 0 THEN all_ ELSE list_transform(found, lambda g: list_reduce(list_transform(g, lambda k: all_[k]), lambda a, b: {'t': list_transform(list_zip(a.t, b.t), lambda z: z[1] + z[2]), 's': a.s + b.s})) END,
        CASE WHEN len(free) > 0 THEN list_filter(free, lambda k: NOT list_contains(took, k)) ELSE range(1, len(found) + 1) END,
        CASE WHEN len(free) > 0 THEN list_append(found, took) ELSE CAST([] AS BIGINT[][]) END
    FROM (SELECT *, CASE WHEN len(free) > 0 THEN list_reduce(list_transform(free, lambda k: {'g': list_transform(all_[k].t, lambda x: x / all_[k].s), 'took': [k]}),
            lambda a, b: CASE WHEN list_cosine_similarity(a.g, b.g) >= 0.65 THEN {'g': list_transform(list_zip(a.g, b.g), lambda z: z[1] + z[2]), 'took': list_concat(a.took, b.took)} ELSE a END).took END AS took FROM merging)
    WHERE len(free) > 0 OR len(found) < len(all_)),
centres AS (SELECT k, list_transform(all_[k].t, lambda x: x / all_[k].s) AS vector FROM (SELECT all_ FROM merging WHERE len(free) = 0 AND len(found) = len(all_) ORDER BY step DESC LIMIT 1), range(1, len(all_) + 1) t(k)),
placed AS (SELECT p.face_id, arg_max(c.k, {'sim': list_cosine_similarity(p.vector, c.vector), 'k': -c.k}) AS k FROM r p CROSS JOIN centres c GROUP BY p.face_id)
SELECT 'cl-' || min(face_id) OVER (PARTITION BY k) AS cluster_id, count(*) OVER (PARTITION BY k) AS size, face_id FROM placed"""
    return SEEDS.replace("16", str(count)) + merging.replace("0.65", str(threshold))


@query("clusters", _clusters_sql(64, 0.65))
def _(v: Views):
    return faces.members(clustering.grouped(v.points, 64, 0.65))


@query("clusters_coarse", _clusters_sql(48, 0.2))
def _(v: Views):
    """A threshold at which centres merge, over several rounds."""
    return faces.members(clustering.grouped(v.points, 48, 0.2))


LABELS = ", c AS (SELECT 'cl-' || min(face_id) AS cluster_id, count(*) AS size FROM points GROUP BY id_videofile), q AS (SELECT 'cl-' || face_id AS recognizer_key FROM points WHERE face_id % 2 = 0)\n"


def _groups(v: Views):
    return faces.keys_of(v.points.select(F.col("id_videofile").alias("group"), "face_id"))


def _named(v: Views):
    return v.points.where("face_id % 2 = 0").select(F.concat(F.lit("cl-"), "face_id").alias("recognizer_key"))


@query("unnamed_clusters", LABELS + "SELECT cluster_id, size FROM c WHERE cluster_id NOT IN (SELECT recognizer_key FROM q)")
def _(v: Views):
    return faces.unnamed_clusters(_groups(v), _named(v)).select("cluster_id", "size")


@query("named_faces", LABELS + "SELECT CAST(count_if(q.recognizer_key IS NULL) AS BIGINT) AS clusters_total, CAST(coalesce(sum(size) FILTER (q.recognizer_key IS NOT NULL), 0) AS BIGINT) AS faces_named FROM c LEFT JOIN q ON q.recognizer_key = c.cluster_id")
def _(v: Views):
    return faces.named_faces(_groups(v), _named(v))


@query("name_clusters", LABELS + "SELECT 99 + row_number() OVER (ORDER BY cluster_id) AS person_id, cluster_id, 'N' || cluster_id AS name, cluster_id AS recognizer_key, size AS faces FROM c")
def _(v: Views):
    groups = _groups(v)
    wanted = groups.select("cluster_id", F.concat(F.lit("N"), "cluster_id").alias("name"), F.lit(" ").alias("recognizer_key"))
    return faces.name_clusters(wanted, groups, 100).select("person_id", "cluster_id", "name", "recognizer_key", F.col("size").alias("faces"))
