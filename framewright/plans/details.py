"""Queries on applied scene edits, pages, lists, forms of text and numbers, and conditional rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bitmaps, text, timebase, vectors
from ..operators import catalog, clustering, edits, faces, jobs, quality, segments
from .registry import query
from .structure import SCENE_MOVES, _edits
from .views import Views


@query("moved_scenes", SCENE_MOVES + """
SELECT s.scene_id, CASE WHEN s.first_frame = j.f THEN j.t ELSE s.first_frame END AS first_frame, CASE WHEN s.last_frame = j.f - 1 THEN j.t - 1 ELSE s.last_frame END AS last_frame,
       CASE WHEN s.first_frame = j.f OR s.last_frame = j.f - 1 THEN 'OPERATOR' ELSE 'AUTO' END AS origin FROM scenes s LEFT JOIN (SELECT * FROM j WHERE error_code IS NULL) j ON j.id_videofile = s.id_videofile""")
def _(v: Views):
    live = v.scenes.withColumn("is_stale", F.lit(False))
    plan = edits.plan_move(_edits(v, "SCENE", F.col("from_frame") + F.col("id_videofile") % 7 - 3), live, "scene_id", shots=v.shots)
    return edits.apply_move(plan, live, "scene_id").select("scene_id", "first_frame", "last_frame", "origin")


@query("split_scenes", """
, e AS (SELECT id_videofile, CAST(frame_count // 2 AS INT) AS f FROM vf), hit AS (SELECT s.*, e.f FROM scenes s JOIN e ON e.id_videofile = s.id_videofile AND e.f > s.first_frame AND e.f <= s.last_frame WHERE NOT s.is_stale)
SELECT s.scene_id, s.first_frame, s.last_frame, s.is_stale OR h.scene_id IS NOT NULL AS is_stale, s.title, s.location_id FROM scenes s LEFT JOIN hit h ON h.scene_id = s.scene_id
UNION ALL SELECT -(id_videofile * 100000 + first_frame), first_frame, f - 1, false, title, location_id FROM hit UNION ALL SELECT -(id_videofile * 100000 + f), f, last_frame, false, NULL, NULL FROM hit""")
def _(v: Views):
    """The tail of a split scene loses title and location."""
    wanted = v.videofiles.select("id_videofile", F.floor(F.col("frame_count") / 2).cast("int").alias("frame"))
    out = edits.apply_split(edits.plan_split(wanted, v.scenes, "scene_id"), v.scenes, "scene_id", lambda first: -(F.col("id_videofile") * 100000 + first), ("title", "location_id"))
    return out.select("scene_id", "first_frame", "last_frame", "is_stale", "title", "location_id")


@query("merged_scenes", """
, e AS (SELECT id_videofile, min(first_frame) AS f FROM ranges WHERE level = 'SCENE' AND first_frame > 0 GROUP BY 1),
j AS (SELECT e.*, r.last_frame AS rl FROM e JOIN scenes l ON l.id_videofile = e.id_videofile AND l.last_frame = e.f - 1 AND NOT l.is_stale JOIN scenes r ON r.id_videofile = e.id_videofile AND r.first_frame = e.f AND NOT r.is_stale)
SELECT s.scene_id, s.first_frame, CASE WHEN s.last_frame = j.f - 1 THEN j.rl ELSE s.last_frame END AS last_frame, s.title, s.is_stale OR coalesce(s.first_frame = j.f, false) AS is_stale FROM scenes s LEFT JOIN j ON j.id_videofile = s.id_videofile""")
def _(v: Views):
    wanted = _edits(v, "SCENE", F.col("from_frame")).select("id_videofile", F.col("from_frame").alias("frame"))
    return edits.apply_merge(edits.plan_merge(wanted, v.scenes, "scene_id"), v.scenes, "scene_id").select("scene_id", "first_frame", "last_frame", "title", "is_stale")


@query("structure_pages", """
, c AS (SELECT *, row_number() OVER (PARTITION BY id_videofile ORDER BY first_frame) - 1 AS nth, count(*) OVER (PARTITION BY id_videofile) AS scenes_total FROM scenes WHERE NOT is_stale)
SELECT c.id_videofile, CAST(c.nth AS INT) AS nth, c.scenes_total, c.scene_id, c.first_frame, c.last_frame, l.name AS location_name, (SELECT count(*) FROM shots s WHERE s.id_videofile = c.id_videofile AND s.first_frame >= c.first_frame AND s.last_frame <= c.last_frame) AS shots,
       CASE WHEN c.id_videofile % 3 = 0 THEN 'STALE' WHEN c.id_videofile % 3 = 1 THEN 'FRESH' END AS state
FROM c LEFT JOIN locations l ON l.location_id = c.location_id WHERE nth BETWEEN 2 AND 3""")
def _(v: Views):
    states = v.videofiles.where("id_videofile % 3 < 2").select("id_videofile", F.when(F.col("id_videofile") % 3 == 0, "STALE").otherwise("FRESH").alias("state"))
    return segments.structure_page(v.scenes, v.shots, v.locations, states, 1, 2)


@query("indicator_states", """
SELECT id_videofile, 'unknown' AS "PW", CASE WHEN frame_count > 0 THEN 'yes' ELSE 'no' END AS "AF", CASE WHEN EXISTS (SELECT 1 FROM scenes c WHERE NOT c.is_stale AND c.id_videofile = v.id_videofile) THEN 'yes' ELSE 'no' END AS "CS",
       CASE WHEN EXISTS (SELECT 1 FROM faces f WHERE f.id_videofile = v.id_videofile) THEN 'yes' ELSE 'no' END AS "DF", 'unknown' AS "RF", 'absent' AS "SU" FROM vf v""")
def _(v: Views):
    return catalog.indicators(v.videofiles, None, v.scenes, v.faces, None, absent=("SU",))


@query("catalog_lists", """
SELECT 'project' AS list, id_project AS id, CAST(row_number() OVER (ORDER BY length(name), id_project) AS INT) AS place FROM projects
UNION ALL SELECT 'videofile', id_videofile, CAST(row_number() OVER (PARTITION BY id_project ORDER BY ordinal, id_videofile) AS INT) FROM videofiles
UNION ALL SELECT 'track', l_orderkey * 10 + l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INT) FROM lineitem""")
def _(v: Views):
    """Projects by age (here: length of the name) and id, videofiles by ordinal, tracks by index."""
    lists = {
        "project": catalog.in_order(v.projects.withColumn("id", F.col("id_project")), [F.length("name"), "id"]),
        "videofile": catalog.in_order(v.videofiles.withColumn("id", F.col("id_videofile")), ["ordinal", "id"], ["id_project"]),
        "track": catalog.in_order(v.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_linenumber"), ["l_linenumber"], ["l_orderkey"]),
    }
    one, two, three = (df.select(F.lit(name).alias("list"), F.col("id").cast("long").alias("id"), "place") for name, df in lists.items())
    return one.union(two).union(three)


@query("flag_bitmaps", """
, b AS (SELECT v.id_videofile, t.b AS i, v.frame_count FROM vf v, unnest(range((v.frame_count + 7) // 8)) t(b)),
m AS (SELECT b.id_videofile, b.i, coalesce(sum(128 >> CAST(s.frame_number % 8 AS INT)), 0) AS mask FROM b LEFT JOIN (SELECT * FROM scores WHERE score >= 100) s ON s.id_videofile = b.id_videofile AND s.frame_number // 8 = b.i GROUP BY 1, 2)
SELECT id_videofile, string_agg(printf('%02X', CAST(mask AS INT)), '' ORDER BY i) AS bitmap FROM m GROUP BY 1""")
def _(v: Views):
    flags = v.scores.select("id_videofile", "frame_number", (F.col("score") >= 100).alias("is_key"))
    return bitmaps.from_flags(flags, v.videofiles).select("id_videofile", F.hex("keyframe_bitmap").alias("bitmap"))


@query("enqueued_jobs", """
, w AS (SELECT id_videofile AS subject_id, row_number() OVER (ORDER BY id_videofile) AS n FROM vf WHERE id_videofile % 10 = 0)
SELECT job_id, kind, state, subject_id FROM jobs UNION ALL SELECT (SELECT max(job_id) FROM jobs) + n, 'HASH', 'WAITING', subject_id FROM w""")
def _(v: Views):
    wanted = v.videofiles.where("id_videofile % 10 = 0").select(F.lit("HASH").alias("kind"), F.col("id_videofile").alias("subject_id"), F.lit("h").alias("params_hash"))
    return jobs.enqueue(v.jobs, wanted, F.lit("2024-01-01 00:00:00").cast(v.jobs.schema["created_at"].dataType)).select("job_id", "kind", "state", "subject_id")


@query("paired_vectors", """
SELECT face_id, face_index, vector[1] AS head FROM (SELECT label AS frame, face_id, CAST(row_number() OVER (PARTITION BY label ORDER BY face_id) - 1 AS INT) AS face_index, vector FROM (SELECT vec_id AS face_id, label, embedding AS vector FROM embeddings)) WHERE len(list_filter(vector, lambda x: x <> 0)) > 0""")
def _(v: Views):
    """Detections of a frame as one array, met again with the stored faces by place."""
    numbered = catalog.in_order(v.points.withColumn("frame_number", F.col("id_videofile")), ["face_id"], ["id_videofile"]).withColumn("face_index", F.col("place") - 1)
    found = numbered.groupBy("id_videofile", "frame_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("face_index", "vector"))), lambda x: x["vector"]).alias("vectors"))
    return faces.pair_by_index(found, numbered.select("id_videofile", "frame_number", "face_index", "face_id")).select("face_id", "face_index", F.col("vector")[0].alias("head"))


@query("clusters_in_order", "SELECT 'cl-' || min(face_id) AS cluster_id, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, 'cl-' || min(face_id)) AS INT) AS place FROM points GROUP BY id_videofile")
def _(v: Views):
    found = faces.keys_of(v.points.select(F.col("id_videofile").alias("group"), "face_id"))
    return catalog.in_order(clustering.listed(found), [-F.col("size"), "cluster_id"]).select("cluster_id", "size", "place")


@query("forms_of_numbers", r"""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 1920 * 3 AS frame_bytes, CASE WHEN d LIKE '%.%' THEN rtrim(rtrim(d, '0'), '.') ELSE d END AS plain,
       CASE WHEN q % 10 = 1 AND q % 100 <> 11 THEN 'file' WHEN q % 10 BETWEEN 2 AND 4 AND q % 100 NOT BETWEEN 12 AND 14 THEN 'files' ELSE 'of files' END AS word,
       CASE WHEN q < 512 THEN (q * 2 + 1) || ' B' WHEN q < 524288 THEN printf('%.1f KiB', (q * 2 + 1) / 1024.0) ELSE printf('%.1f MiB', (q * 2 + 1) / 1048576.0) END AS size, printf('%d:%02d:%02d', q // 3600, q // 60 % 60, q % 60) AS length, round(CAST(q * 0.299 + l_linenumber * 0.587 + 7 * 0.114 AS DOUBLE), 6) AS grey
FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey * l_linenumber AS q, CAST(CAST(l_discount AS DECIMAL(12,4)) AS VARCHAR) AS d FROM lineitem)""")
def _(v: Views):
    q = (F.col("l_partkey") * F.col("l_linenumber")).cast("long")
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", timebase.frame_bytes(F.col("l_quantity"), F.lit(1920), F.lit(3)).alias("frame_bytes"), text.canonical_number(F.col("l_discount").cast("decimal(12,4)")).alias("plain"),
        text.plural(q, "file", "files", "of files").alias("word"), text.human_bytes(q * 2 + 1).alias("size"), text.human_duration(q * 1000).alias("length"), F.round(vectors.grey(q, F.col("l_linenumber"), F.lit(7)), 6).alias("grey"),
    )


@query("forms_of_text", r"""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS face_id, event_id % 5 <> 2 OR event_id % 10 = 7 AS other,
       '["' || event_type || '","' || event_id || '"]' AS listed, event_type AS first_word, CASE event_id % 5 WHEN 0 THEN 'waiting' WHEN 1 THEN 'starting' WHEN 2 THEN 'running' WHEN 3 THEN 'finished' ELSE 'failed' END AS title,
       '-----BEGIN PUBLIC KEY-----' || chr(10) || base64(encode(event_type)) || chr(10) || '-----END PUBLIC KEY-----' || chr(10) AS pem FROM events""")
def _(v: Views):
    n = F.col("event_id")
    moment = F.when(n % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(n % 3 == 1, F.lit("  ")).otherwise(F.lit("no time"))
    words = text.json_of_array(F.array("event_type", n.cast("string")))
    state = F.get(F.array(*[F.lit(s) for s in jobs.STATES]), (n % 5).cast("int"))
    return v.table("events").select(
        "event_id", F.date_format(text.tolerant_timestamp(moment), "yyyy-MM-dd HH:mm:ss").alias("moment"), text.cluster_face(F.when(n % 4 == 0, F.lit("cl-x")).otherwise(text.cluster_key(n))).alias("face_id"),
        text.other_than(n % 5, F.when(n % 10 != 7, F.lit(2))).alias("other"), words.alias("listed"), text.text_array(words)[0].alias("first_word"), text.titled(text.one_of(state, jobs.STATES, "state"), jobs.TITLES).alias("title"),
        text.pem(F.col("event_type").cast("binary")).alias("pem"),
    )


RULE_ROWS = "SELECT event_id AS job_id, ['WAITING', 'DONE', 'ERROR', 'LOST'][event_id % 4 + 1] AS state, CASE WHEN event_id % 3 = 0 THEN 'broken' END AS error_text, CASE WHEN event_id % 5 > 0 THEN 'k' END AS artifact_key FROM events"


@query("conditional_rules", f"""
, q AS ({RULE_ROWS})
SELECT 'runs' AS relation, 'error_only_on_error' AS rule, job_id::VARCHAR AS row_key FROM q WHERE NOT (state = 'ERROR' OR error_text IS NULL)
UNION ALL SELECT 'runs', 'state_known', job_id::VARCHAR FROM q WHERE state NOT IN ('CREATING', 'WORKING', 'DONE', 'ERROR')
UNION ALL SELECT 'model_versions', 'artifact_when_done', job_id::VARCHAR FROM q WHERE NOT (state <> 'DONE' OR artifact_key IS NOT NULL)
UNION ALL SELECT 'model_versions', 'state_known', job_id::VARCHAR FROM q WHERE state NOT IN ('CREATING', 'WORKING', 'DONE', 'ERROR')
UNION ALL SELECT 'recipe_items', 'persons_array', job_id::VARCHAR FROM q WHERE job_id % 6 < 2""")
def _(v: Views):
    n = F.col("event_id")
    state = F.get(F.array(*[F.lit(s) for s in ("WAITING", "DONE", "ERROR", "LOST")]), (n % 4).cast("int"))
    rows = v.table("events").select(n.alias("job_id"), state.alias("state"), F.when(n % 3 == 0, "broken").alias("error_text"), F.when(n % 5 > 0, "k").alias("artifact_key"))
    names = F.when(n % 6 == 0, "{}").when(n % 6 == 1, "[broken").when(n % 6 == 2, None).otherwise('["a", "b"]')
    items = v.table("events").select(n.alias("job_id"), names.alias("person_names"))
    tables = {"runs": rows.drop("artifact_key"), "model_versions": rows.drop("error_text"), "recipe_items": items}
    return quality.violations(tables, dict.fromkeys(tables, ["job_id"]))
