"""Queries on runs, checksums, jobs, properties, catalogue, settings and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, intervals, jobs, paging, quality, settings, staleness, upserts
from .registry import query
from .views import Views


def _current(v: Views):
    return v.spark.createDataFrame([("STRUCTURE", "h1"), ("FACES", "h2")], "kind string, current_hash string")


CURRENT = ", cur AS (SELECT * FROM (VALUES ('STRUCTURE', 'h1'), ('FACES', 'h2')) t(kind, current_hash))\n"


@query("latest_run", "SELECT id_videofile, kind, max(run_id) AS run_id, arg_max(params_hash, run_id) AS params_hash FROM runs GROUP BY 1, 2")
def _(v: Views):
    return staleness.latest(v.runs, ["id_videofile", "kind"], "run_id").select("id_videofile", "kind", "run_id", "params_hash")


@query("stale_runs", CURRENT + "SELECT run_id, is_stale OR params_hash <> current_hash AS is_stale FROM runs JOIN cur USING (kind)")
def _(v: Views):
    return staleness.mark_runs(v.runs, _current(v)).select("run_id", "is_stale")


@query("stale_propagation", """
SELECT scene_id, c.is_stale OR coalesce(r.is_stale, false) AS is_stale FROM scenes c LEFT JOIN runs r ON r.run_id = c.id_videofile""")
def _(v: Views):
    return staleness.propagate(v.scenes, v.runs).select("scene_id", "is_stale")


@query("stale_summary", """
, w AS (SELECT id_videofile, 'run' AS what FROM runs WHERE is_stale UNION ALL SELECT id_videofile, 'scene' FROM scenes WHERE is_stale)
SELECT id_videofile, CAST(count_if(what = 'run') AS BIGINT) AS stale_runs, CAST(count_if(what = 'scene') AS BIGINT) AS stale_scenes, CAST(0 AS BIGINT) AS stale_shots FROM w GROUP BY 1""")
def _(v: Views):
    return staleness.summary(v.runs, v.scenes, v.shots)


@query("staleness_status", CURRENT + """
, l AS (SELECT id_videofile, kind, max(run_id) AS run_id, arg_max(params_hash, run_id) AS params_hash, arg_max(is_stale, run_id) AS is_stale FROM runs GROUP BY 1, 2)
SELECT v.id_videofile, cur.kind, l.run_id, l.run_id IS NULL AS is_absent, coalesce(l.params_hash <> current_hash OR l.is_stale, false) AS is_stale, CASE WHEN l.params_hash <> current_hash THEN 'OTHER_INPUTS' WHEN l.is_stale THEN 'MARKED' END AS reason
FROM vf v CROSS JOIN cur LEFT JOIN l ON l.id_videofile = v.id_videofile AND l.kind = cur.kind""")
def _(v: Views):
    return staleness.status(v.videofiles, v.runs, _current(v))


@query("checksum_current", "SELECT id_videofile, max(checksum_id) AS checksum_id, arg_max(digest, checksum_id) AS digest FROM checksums WHERE state = 'DONE' AND NOT is_stale GROUP BY 1")
def _(v: Views):
    return staleness.current_checksums(v.checksums).select("id_videofile", "checksum_id", "digest")


@query("checksum_changed", "SELECT checksum_id, c.is_stale OR coalesce(c.state = 'DONE' AND c.byte_size <> v.file_size, false) AS is_stale FROM checksums c LEFT JOIN videofiles v ON v.id_videofile = c.id_videofile")
def _(v: Views):
    same = F.timestamp_seconds(F.lit(0))
    return staleness.mark_changed_sources(v.checksums.withColumn("file_mtime", same), v.videofiles.withColumn("file_mtime", same)).select("checksum_id", "is_stale")


@query("checksum_superseded", """
SELECT checksum_id, is_stale OR coalesce(state = 'DONE' AND checksum_id < max(CASE WHEN state = 'DONE' THEN checksum_id END) OVER (PARTITION BY id_videofile), false) AS is_stale FROM checksums""")
def _(v: Views):
    return staleness.supersede(v.checksums).select("checksum_id", F.coalesce("is_stale", F.lit(False)).alias("is_stale"))


@query("running_twice", "SELECT subject_id, count(*) AS running FROM jobs WHERE kind = 'HASH' AND state IN ('WAITING', 'CREATING', 'WORKING') GROUP BY 1 HAVING count(*) > 1")
def _(v: Views):
    return staleness.running_twice(v.jobs)


@query("queue_state", "SELECT CAST(count_if(state IN ('CREATING', 'WORKING')) AS BIGINT) AS working, CAST(count_if(state = 'WAITING') AS BIGINT) AS waiting, CAST(count_if(state = 'ERROR') AS BIGINT) AS failed, CAST(count_if(state = 'DONE') AS BIGINT) AS done FROM jobs")
def _(v: Views):
    return jobs.queue_state(v.jobs)


CLAIMABLE = """SELECT {what} FROM jobs j WHERE state = 'WAITING' AND NOT (kind = 'FACES' AND EXISTS (SELECT 1 FROM jobs a WHERE a.kind = 'ANALYZE' AND a.state IN ('WAITING', 'CREATING', 'WORKING') AND a.subject_id = j.subject_id))"""


@query("claimable_jobs", CLAIMABLE.format(what="job_id, kind"))
def _(v: Views):
    return jobs.claimable(v.jobs).select("job_id", "kind")


@query("next_jobs", CLAIMABLE.format(what="job_id") + " AND kind IN ('FACES', 'HASH') ORDER BY created_at, job_id LIMIT 8")
def _(v: Views):
    return jobs.next_jobs(v.jobs, 8, ["FACES", "HASH"]).select("job_id")


@query("job_view", """
SELECT job_id, kind, state, CASE state WHEN 'WAITING' THEN 'waiting' WHEN 'CREATING' THEN 'starting' WHEN 'WORKING' THEN 'running' WHEN 'DONE' THEN 'finished' ELSE 'failed' END AS title,
       CASE WHEN progress_total > 0 THEN CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, progress_done / progress_total::DOUBLE)) * 100) AS INT) END AS percent, state IN ('DONE', 'ERROR') AS is_final FROM jobs""")
def _(v: Views):
    return jobs.view(v.jobs)


@query("job_transitions", """
, p AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS from_state FROM job_log)
SELECT job_id, seq, state, from_state, CASE WHEN from_state IS NULL THEN state = 'WAITING' ELSE (from_state, state) IN (('WAITING', 'CREATING'), ('WAITING', 'ERROR'), ('CREATING', 'WORKING'), ('CREATING', 'ERROR'), ('WORKING', 'DONE'), ('WORKING', 'ERROR')) END AS allowed FROM p""")
def _(v: Views):
    return jobs.check_log(v.job_log.select("job_id", "seq", "state"))


@query("applied_transitions", """
, w AS (SELECT job_id, CASE job_id % 3 WHEN 0 THEN 'CREATING' WHEN 1 THEN 'DONE' ELSE 'ERROR' END AS to_state FROM jobs WHERE job_id % 7 < 3)
SELECT j.job_id, CASE WHEN (j.state, to_state) IN (('WAITING', 'CREATING'), ('WAITING', 'ERROR'), ('CREATING', 'WORKING'), ('CREATING', 'ERROR'), ('WORKING', 'DONE'), ('WORKING', 'ERROR')) THEN to_state ELSE state END AS state,
       CASE WHEN (j.state, to_state) IN (('WAITING', 'ERROR'), ('CREATING', 'ERROR'), ('WORKING', 'DONE'), ('WORKING', 'ERROR')) THEN true ELSE false END AS finished FROM jobs j LEFT JOIN w USING (job_id)""")
def _(v: Views):
    some = F.col("job_id") % 3
    wanted = v.jobs.where("job_id % 7 < 3").select("job_id", F.when(some == 0, "CREATING").when(some == 1, "DONE").otherwise("ERROR").alias("to_state"), F.col("created_at").alias("at"))
    whole = v.jobs.withColumn("started_at", F.lit(None).cast("timestamp")).withColumn("finished_at", F.lit(None).cast("timestamp"))
    after, _ = jobs.apply_transitions(whole, wanted)
    return after.select("job_id", "state", F.col("finished_at").isNotNull().alias("finished"))


@query("progress_monotone", """
SELECT job_id, seq, max(done) OVER (PARTITION BY job_id ORDER BY seq) AS peak, done >= coalesce(max(done) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM job_log""")
def _(v: Views):
    return jobs.monotone(v.job_log.withColumn("total", F.lit(0).cast("long"))).select("job_id", "seq", "peak", "accepted")


@query("cancelled_jobs", "SELECT job_id, CASE WHEN job_id % 4 = 0 AND state IN ('WAITING', 'CREATING', 'WORKING') THEN 'ERROR' ELSE state END AS state FROM jobs")
def _(v: Views):
    whole = v.jobs.withColumn("finished_at", F.lit(None).cast("timestamp")).withColumn("error_text", F.lit(None).cast("string"))
    return jobs.cancel(whole, v.jobs.where("job_id % 4 = 0"), F.current_timestamp()).select("job_id", "state")


@query("requeued_jobs", "SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 'WAITING' ELSE state END AS state FROM jobs")
def _(v: Views):
    return jobs.requeue(v.jobs, v.jobs.where("job_id % 4 = 0")).select("job_id", "state")


@query("recovered_jobs", "SELECT job_id, CASE WHEN state IN ('CREATING', 'WORKING') THEN 'WAITING' ELSE state END AS state FROM jobs")
def _(v: Views):
    return jobs.recover_orphans(v.jobs).select("job_id", "state")


@query("memoised_jobs", """
, w AS (SELECT DISTINCT kind, params_hash FROM jobs WHERE job_id % 10 = 0), d AS (SELECT kind, params_hash, max(job_id) AS job_id FROM jobs WHERE state = 'DONE' AND job_id % 3 = 0 GROUP BY 1, 2)
SELECT w.kind, w.params_hash, d.job_id FROM w LEFT JOIN d ON d.kind = w.kind AND d.params_hash = w.params_hash""")
def _(v: Views):
    wanted = v.jobs.where("job_id % 10 = 0").select("kind", "params_hash").distinct()
    artifacts = v.jobs.where("job_id % 3 = 0").select("job_id", F.lit("READY").alias("state"))
    return jobs.memoised(wanted, v.jobs, artifacts)


@query("incomplete_scans", """
SELECT v.id_videofile, v.frame_count::BIGINT AS expected, count(DISTINCT s.frame_number) AS seen FROM vf v LEFT JOIN (SELECT * FROM scores WHERE event_id % 50 <> 0) s ON s.id_videofile = v.id_videofile GROUP BY v.id_videofile, v.frame_count HAVING count(DISTINCT s.frame_number) <> v.frame_count""")
def _(v: Views):
    return jobs.complete_scan(v.scores.where("event_id % 50 <> 0"), v.videofiles)


@query("record_hash", "SELECT doc_id, sha256(concat(doc_id::VARCHAR, chr(31), coalesce(lang, ''), chr(31), coalesce(source, ''), chr(31), coalesce(n_chars::VARCHAR, ''), chr(31))) AS record_hash FROM documents")
def _(v: Views):
    docs = v.table("documents").select("doc_id", "lang", "source", "n_chars")
    return docs.select("doc_id", text.record_hash(docs, "doc_id", "lang", "source", "n_chars").alias("record_hash"))


@query("text_checksums", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def _(v: Views):
    return v.table("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("change_detect", """
, a AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE doc_id % 11 <> 0)
SELECT b.doc_id, CASE WHEN a.doc_id IS NULL THEN 'INSERT' WHEN a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source THEN 'UNCHANGED' ELSE 'UPDATE' END AS change FROM b LEFT JOIN a USING (doc_id)""")
def _(v: Views):
    docs = v.table("documents").select("doc_id", "lang", "source")
    new = docs.where("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return upserts.changes(docs.where("doc_id % 10 <> 0"), new, ["doc_id"], ["lang", "source"])


@query("property_upsert", """
, n AS (SELECT owner_kind, owner_id, property_key, upper(property_value) AS v FROM properties WHERE property_key = 'source' AND owner_id % 3 = 0 UNION ALL SELECT DISTINCT owner_kind, owner_id, 'added', 'yes' FROM properties WHERE owner_id % 5 = 0)
SELECT coalesce(p.owner_kind, n.owner_kind) AS owner_kind, coalesce(p.owner_id, n.owner_id) AS owner_id, coalesce(p.property_key, n.property_key) AS property_key, CASE WHEN n.owner_id IS NOT NULL THEN n.v ELSE p.property_value END AS property_value, CAST(coalesce(p.ordinal, 2) AS INT) AS ordinal
FROM properties p FULL JOIN n ON p.owner_kind = n.owner_kind AND p.owner_id = n.owner_id AND p.property_key = n.property_key""")
def _(v: Views):
    changed = v.properties.where("property_key = 'source' AND owner_id % 3 = 0").select("owner_kind", "owner_id", "property_key", F.upper("property_value").alias("property_value"))
    added = v.table("documents").where("doc_id % 5 = 0").select(F.lit("VIDEOFILE").alias("owner_kind"), F.col("doc_id").alias("owner_id"), F.lit("added").alias("property_key"), F.lit("yes").alias("property_value"))
    return upserts.put(v.properties, changed.unionByName(added), ["owner_kind", "owner_id", "property_key"])


@query("property_maps", "SELECT owner_id, count(*) AS properties, max(CASE WHEN property_key = 'lang' THEN property_value END) AS lang FROM properties GROUP BY 1")
def _(v: Views):
    return catalog.as_maps(v.properties).select("owner_id", F.size("properties").cast("long").alias("properties"), F.col("properties")["lang"].alias("lang"))


@query("owned_properties", "SELECT owner_id, property_key FROM properties WHERE owner_id IN (SELECT id_videofile FROM vf)")
def _(v: Views):
    return catalog.owned(v.properties, {"VIDEOFILE": v.videofiles.select(F.col("id_videofile").alias("id"))}).select("owner_id", "property_key")


@query("replace_auto_faces", """
, new AS (SELECT face_id + 1000000 AS face_id, id_videofile, frame_number FROM faces WHERE frame_number % 4 = 0)
SELECT face_id FROM faces f WHERE origin <> 'AUTO' OR NOT EXISTS (SELECT 1 FROM new n WHERE n.id_videofile = f.id_videofile AND n.frame_number = f.frame_number) UNION ALL SELECT face_id FROM new""")
def _(v: Views):
    new = v.faces.where("frame_number % 4 = 0").withColumn("face_id", F.col("face_id") + 1000000)
    return upserts.replace_auto(v.faces, new).select("face_id")


@query("flag_upsert", """
SELECT coalesce(a.id_videofile, b.id_videofile) AS id_videofile, coalesce(a.frame_number, b.frame_number) AS frame_number, coalesce(a.sc, false) AS is_scene_boundary, b.frame_number IS NOT NULL OR coalesce(a.sh, false) AS is_shot_boundary
FROM (SELECT id_videofile, frame_number, score >= 100 AS sc, score >= 50 AS sh FROM scores WHERE score >= 50) a FULL JOIN (SELECT id_videofile, frame_number FROM keys) b ON a.id_videofile = b.id_videofile AND a.frame_number = b.frame_number""")
def _(v: Views):
    stored = v.scores.where("score >= 50").select("id_videofile", "frame_number", (F.col("score") >= 100).alias("is_scene_boundary"), F.lit(True).alias("is_shot_boundary"), F.lit(0).alias("face_count"), F.lit(None).cast("string").alias("size_hint"))
    return upserts.mark_flag(stored, v.keys, "is_shot_boundary").select("id_videofile", "frame_number", "is_scene_boundary", "is_shot_boundary")


@query("keyed_changes", """
, stored AS (SELECT c_custkey AS k, c_acctbal AS b, c_mktsegment AS s FROM customer WHERE c_custkey % 3 > 0), new AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS b, c_mktsegment AS s FROM customer WHERE c_custkey % 4 > 0),
ins AS (SELECT * FROM stored UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM stored)),
upd AS (SELECT i.k, coalesce(n.b, i.b) AS b, i.s FROM ins i LEFT JOIN new n ON n.k = i.k)
SELECT k, b, s FROM upd WHERE k % 10 <> 7""")
def _(v: Views):
    rows = v.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b"), F.col("c_mktsegment").alias("s"))
    new = rows.where("k % 4 > 0").withColumn("b", F.when(F.col("k") % 2 == 0, F.col("b") + 1))
    whole = upserts.update(upserts.insert_absent(rows.where("k % 3 > 0"), new, ["k"]), new, ["k"])
    return upserts.delete(whole, rows.where("k % 10 = 7"), ["k"])


@query("replaced_tracks", "SELECT l_orderkey AS id_videofile, l_linenumber + 100 AS n FROM lineitem WHERE l_orderkey % 5 = 0 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 <> 0")
def _(v: Views):
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("id_videofile"), F.col("l_linenumber").alias("n"))
    return upserts.replace_groups(rows, rows.where("id_videofile % 5 = 0").withColumn("n", F.col("n") + 100), ["id_videofile"])


@query("set_differences", """
, a AS (SELECT l_partkey AS p, l_returnflag AS f FROM lineitem WHERE l_linenumber < 4), b AS (SELECT l_partkey AS p, l_returnflag AS f FROM lineitem WHERE l_linenumber > 2)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)) AS "both" """)
def _(v: Views):
    rows = v.table("lineitem").select(F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"), "l_linenumber")
    return upserts.differences(rows.where("l_linenumber < 4").drop("l_linenumber"), rows.where("l_linenumber > 2").drop("l_linenumber"))


@query("set_ops", """
, a AS (SELECT DISTINCT shot_id FROM shot_faces WHERE person_id = 2 AND shot_id IS NOT NULL), b AS (SELECT shot_id FROM shots WHERE first_frame % 2 = 0)
SELECT shot_id, 'AND' AS what FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT shot_id, 'OR' FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def _(v: Views):
    bound = intervals.bind(v.faces.where("person_id = 2").select("id_videofile", "frame_number"), v.shots, "shot_id")
    a, b = bound.where("shot_id IS NOT NULL").select("shot_id"), v.shots.where("first_frame % 2 = 0").select("shot_id")
    return a.intersect(b).withColumn("what", F.lit("AND")).unionByName(a.union(b).distinct().withColumn("what", F.lit("OR")))


@query("project_counts", "SELECT p.id_project, any_value(p.name) AS name, count(v.id_videofile) AS videofiles, CAST(coalesce(sum(v.frame_count), 0) AS BIGINT) AS frames FROM projects p LEFT JOIN videofiles v ON v.id_project = p.id_project GROUP BY 1")
def _(v: Views):
    return catalog.counts(v.projects, v.videofiles)


@query("next_ordinals", "SELECT p.id_project, CAST(coalesce(max(v.ordinal), -1) + 1 AS INT) AS next_ordinal FROM projects p LEFT JOIN videofiles v ON v.id_project = p.id_project GROUP BY 1")
def _(v: Views):
    return catalog.next_ordinals(v.projects, v.videofiles)


@query("registration", """
, new AS (SELECT o_orderkey % 7 AS id_project, CASE WHEN o_orderkey % 9 = 0 THEN '/elsewhere/f' || o_orderkey || '.mkv' ELSE '/media/p' || (o_orderkey % 7) || '/ep' || o_orderkey || '.tail.mkv' END AS source_path FROM orders),
m AS (SELECT new.*, p.source_root, CASE WHEN starts_with(new.source_path, p.source_root || '/') THEN substr(new.source_path, length(p.source_root) + 2) END AS relative_path, (SELECT max(ordinal) + 1 FROM videofiles v WHERE v.id_project = new.id_project) AS nx FROM new LEFT JOIN projects p ON p.id_project = new.id_project),
e AS (SELECT *, CASE WHEN source_root IS NULL THEN 'NO_PROJECT' WHEN relative_path IS NULL THEN 'OUTSIDE_ROOT' END AS error_code FROM m)
SELECT id_project, source_path, regexp_replace(regexp_extract(source_path, '[^/]*$'), '\\.[^.]*$', '') AS name, relative_path, CASE WHEN error_code IS NULL THEN CAST(coalesce(nx, 0) + row_number() OVER (PARTITION BY id_project, error_code IS NULL ORDER BY source_path) - 1 AS INT) END AS ordinal, error_code FROM e""")
def _(v: Views):
    new = v.table("orders").selectExpr("o_orderkey % 7 AS id_project", "CASE WHEN o_orderkey % 9 = 0 THEN concat('/elsewhere/f', o_orderkey, '.mkv') ELSE concat('/media/p', o_orderkey % 7, '/ep', o_orderkey, '.tail.mkv') END AS source_path")
    return catalog.register(new, v.projects, v.videofiles)


@query("track_ordinals", "SELECT l_orderkey AS id_videofile, l_partkey AS track_index, l_returnflag AS codec_type, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) - 1 AS INT) AS ordinal FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem)")
def _(v: Views):
    return catalog.track_ordinals(v.table("lineitem").select(F.col("l_orderkey").alias("id_videofile"), F.col("l_partkey").alias("track_index"), F.col("l_returnflag").alias("codec_type")).distinct())


@query("model_active", "SELECT o_custkey AS id_project, max(o_orderkey) AS model_version_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 GROUP BY 1")
def _(v: Views):
    versions = v.table("orders").select(F.col("o_custkey").alias("id_project"), F.col("o_orderkey").alias("model_version_id"), (F.col("o_orderkey") % 2 == 0).alias("is_active"), F.when(F.col("o_orderstatus") == "O", "DONE").otherwise("ERROR").alias("state"))
    return catalog.active_versions(versions)


@query("preview_sheets", "SELECT id_videofile, CAST(s AS INT) AS sheet, CAST(s * 256 AS INT) AS first_frame, CAST(least(s * 256 + 256, frame_count) - 1 AS INT) AS last_frame, printf('videofile/%d/preview-sheets/v1/%06d', id_videofile, s) AS object_key FROM (SELECT *, unnest(range((frame_count + 255) // 256)) AS s FROM vf)")
def _(v: Views):
    return catalog.sheets(v.videofiles)


@query("pending_sheets", "SELECT id_videofile, CAST(s AS INT) AS sheet FROM (SELECT *, unnest(range((frame_count + 255) // 256)) AS s FROM vf) WHERE id_videofile % 3 <> 0")
def _(v: Views):
    ready = catalog.sheets(v.videofiles.where("id_videofile % 3 = 0")).select("object_key", F.lit("PREVIEW_SHEET").alias("kind"), F.lit("READY").alias("state"))
    return catalog.pending_sheets(v.videofiles, ready).select("id_videofile", "sheet")


@query("artifact_fallback", "SELECT 'new/k' || o_orderkey AS object_key, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 0 THEN -o_orderkey END AS artifact_id FROM orders")
def _(v: Views):
    keys = v.table("orders").select("o_orderkey", F.concat(F.lit("new/k"), "o_orderkey").alias("object_key"))
    new = keys.where("o_orderkey % 2 = 0").select("object_key", F.lit("READY").alias("state"), F.col("o_orderkey").alias("artifact_id"))
    old = keys.where("o_orderkey % 3 = 0").select(F.concat(F.lit("old/k"), "o_orderkey").alias("object_key"), F.lit("READY").alias("state"), (-F.col("o_orderkey")).alias("artifact_id"))
    return catalog.find_artifacts(keys.select("object_key"), new.unionByName(old), "old/", "new/")


@query("pipeline_indicators", """
SELECT v.id_videofile, CASE WHEN v.id_videofile % 3 = 0 THEN 'yes' ELSE 'no' END AS "PW", CASE WHEN frame_count > 0 THEN 'yes' ELSE 'no' END AS "AF", CASE WHEN EXISTS (SELECT 1 FROM scenes c WHERE NOT c.is_stale AND c.id_videofile = v.id_videofile) THEN 'yes' ELSE 'no' END AS "CS",
       CASE WHEN EXISTS (SELECT 1 FROM faces f WHERE f.id_videofile = v.id_videofile) THEN 'yes' ELSE 'no' END AS "DF", CASE WHEN EXISTS (SELECT 1 FROM faces f JOIN persons p ON p.person_id = f.person_id AND p.kind = 'PERSON' WHERE f.id_videofile = v.id_videofile) THEN 'yes' ELSE 'no' END AS "RF" FROM vf v""")
def _(v: Views):
    return catalog.indicators(v.videofiles, catalog.sheets(v.videofiles.where("id_videofile % 3 = 0")), v.scenes, v.faces, v.persons)


@query("event_shots", """
, sel AS (SELECT id_videofile * 10 + first_frame // 10 AS event_id, shot_id, id_videofile, first_frame, last_frame FROM shots WHERE first_frame % 5 <> 0),
g AS (SELECT *, coalesce(lag(last_frame) OVER (PARTITION BY event_id ORDER BY first_frame) + 1 <> first_frame OR lag(id_videofile) OVER (PARTITION BY event_id ORDER BY first_frame) <> id_videofile, false) AS gap FROM sel)
SELECT event_id, min(first_frame) AS first_frame, max(last_frame) AS last_frame, NOT bool_or(gap) AS contiguous FROM g GROUP BY 1""")
def _(v: Views):
    sel = v.shots.where("first_frame % 5 <> 0").select((F.col("id_videofile") * 10 + F.floor(F.col("first_frame") / 10)).alias("event_id"), "shot_id")
    return catalog.events_from_shots(sel, v.shots)


@query("settings_complete", """
, s AS (SELECT unnest(['scene.threshold', 'shot.threshold', 'shot.size.thresholds', 'face.not_person_aspect', 'face.detect_threshold', 'cluster.count', 'cluster.merge_threshold', 'preview.sheet.cols', 'preview.sheet.rows', 'recipe.schema_version', 'recipe.audio_track_count']) AS key)
SELECT p.id_project, array_to_string(list_sort(list(s.key)), ',') AS missing FROM projects p CROSS JOIN s WHERE (p.id_project * 7 + length(s.key)) % 3 = 0 GROUP BY 1""")
def _(v: Views):
    stored = settings.defaults(v.projects).where((F.col("id_project") * 7 + F.length("key")) % 3 != 0)
    return settings.missing(v.projects, stored).withColumn("missing", F.array_join("missing", ","))


@query("settings_from_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS number FROM events")
def _(v: Views):
    return v.table("events").select("event_id", F.from_json("props", "k long")["k"].alias("number"))


@query("settings_validated", """
, u AS (SELECT l_orderkey AS id_project, CASE l_linenumber % 4 WHEN 0 THEN 'scene.threshold' WHEN 1 THEN 'cluster.count' WHEN 2 THEN 'cluster.merge_threshold' ELSE 'nothing' END AS key, CAST(l_quantity - 20 AS VARCHAR) AS value, l_quantity - 20 AS x FROM lineitem)
SELECT id_project, key, value, CASE WHEN key = 'nothing' THEN 'UNKNOWN_KEY' WHEN key = 'cluster.count' THEN 'NOT_AN_INTEGER' WHEN x <= 0 OR (key = 'cluster.merge_threshold' AND x > 1) THEN 'OUT_OF_RANGE' END AS problem,
       CASE WHEN key = 'nothing' OR key = 'cluster.count' OR x <= 0 OR (key = 'cluster.merge_threshold' AND x > 1) THEN NULL ELSE CAST(CAST(x AS BIGINT) AS VARCHAR) END AS normal FROM u""")
def _(v: Views):
    kind = F.col("l_linenumber") % 4
    updates = v.table("lineitem").select(F.col("l_orderkey").alias("id_project"), F.when(kind == 0, "scene.threshold").when(kind == 1, "cluster.count").when(kind == 2, "cluster.merge_threshold").otherwise("nothing").alias("key"), (F.col("l_quantity") - 20).cast("string").alias("value"))
    return settings.validate(updates)


@query("persons_in_order", "SELECT person_id, name FROM persons")
def _(v: Views):
    return paging.service_first(v.persons).select("person_id", "name")


@query("safe_paths", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) END AS relative_path, coalesce(len(list_filter(string_split(substr(url, 9), '/'), lambda x: x IN ('', '.', '..'))) = 0, false) AS safe FROM pages")
def _(v: Views):
    path = text.relative_path(F.col("url"), F.lit("https:/"))
    return v.table("pages").select("page_id", path.alias("relative_path"), F.coalesce(text.safe_relative_path(F.substr("url", F.lit(9))), F.lit(False)).alias("safe"))


DQ_FACES = "SELECT face_id, x1, y1, CASE WHEN face_id % 40 = 0 THEN x1 ELSE x2 END AS x2, y2, CASE WHEN face_id % 30 = 0 THEN 'GUESS' ELSE origin END AS origin, CASE WHEN face_id % 50 = 0 THEN NULL WHEN face_id % 25 = 0 THEN 1.5 ELSE 0.5 END AS detect_confidence, frame_number % 20 AS frame_number, id_videofile, 0 AS face_index, person_id FROM faces"


@query("dq_violations", f"""
, q AS ({DQ_FACES})
SELECT 'faces' AS relation, 'box_order' AS rule, face_id::VARCHAR AS row_key FROM q WHERE NOT (x1 < x2 AND y1 < y2) UNION ALL SELECT 'faces', 'origin_known', face_id::VARCHAR FROM q WHERE origin NOT IN ('AUTO', 'OPERATOR')
UNION ALL SELECT 'faces', 'confidence_range', face_id::VARCHAR FROM q WHERE NOT (detect_confidence BETWEEN 0 AND 1)
UNION ALL SELECT 'faces', 'natural_key_unique', id_videofile || '|' || frame_number || '|' || face_index FROM q GROUP BY id_videofile, frame_number, face_index HAVING count(*) > 1
UNION ALL SELECT 'persons', 'service_row_unique', id_project || '|' || kind FROM persons WHERE person_id < 9 AND kind <> 'PERSON' GROUP BY id_project, kind HAVING count(*) > 1
UNION ALL SELECT 'faces', 'person_exists', face_id::VARCHAR FROM q WHERE person_id NOT IN (SELECT person_id FROM persons WHERE person_id < 9)""")
def _(v: Views):
    f = F.col("face_id")
    rows = v.faces.withColumn("x2", F.when(f % 40 == 0, F.col("x1")).otherwise(F.col("x2"))).withColumn("origin", F.when(f % 30 == 0, "GUESS").otherwise(F.col("origin"))).withColumn("detect_confidence", F.when(f % 50 == 0, None).when(f % 25 == 0, 1.5).otherwise(0.5)).withColumn("frame_number", F.col("frame_number") % 20)
    tables = {"faces": rows, "persons": v.persons.where("person_id < 9")}
    return quality.violations(tables, {"faces": ["face_id"], "persons": ["person_id"]})


@query("fk_orphans", "SELECT 'lineitem' AS relation, 'orders_exists' AS rule, l_orderkey || '|' || l_linenumber || '|' || l_partkey AS row_key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
def _(v: Views):
    rule = quality.Reference("orders", "l_orderkey", "orders", "o_orderkey")
    return quality.orphans(v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), v.table("orders").where("o_orderkey % 10 <> 0"), "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], rule)


@query("cascade_delete", """
SELECT shot_id, NULL::BIGINT AS face_id FROM shots WHERE id_videofile % 4 <> 0 UNION ALL SELECT shot_id, face_id FROM shot_faces WHERE id_videofile % 4 <> 0 AND shot_id IS NOT NULL""")
def _(v: Views):
    gone = v.videofiles.where("id_videofile % 4 = 0")
    shots = quality.deleted_with(v.shots, "id_videofile", gone, "id_videofile")
    bound = intervals.bind(v.faces, v.shots.select("id_videofile", "shot_id", "first_frame", "last_frame"), "shot_id").where("shot_id IS NOT NULL")
    left = quality.deleted_with(bound, "shot_id", v.shots.join(shots.select("shot_id"), "shot_id", "left_anti"), "shot_id")
    return shots.select("shot_id", F.lit(None).cast("long").alias("face_id")).unionByName(left.select("shot_id", "face_id"))


@query("migration_ledger", """
, f AS (SELECT 'm' || r_regionkey AS name, md5(r_name) AS checksum FROM region WHERE r_regionkey < 4), a AS (SELECT 'm' || r_regionkey AS name, md5(CASE WHEN r_regionkey = 2 THEN 'x' ELSE r_name END) AS checksum FROM region WHERE r_regionkey <> 3)
SELECT coalesce(f.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'PENDING' WHEN f.name IS NULL THEN 'MISSING' WHEN f.checksum = a.checksum THEN 'APPLIED' ELSE 'CHANGED' END AS verdict FROM f FULL JOIN a ON f.name = a.name""")
def _(v: Views):
    r = v.table("region")
    name = F.concat(F.lit("m"), "r_regionkey").alias("name")
    files = r.where("r_regionkey < 4").select(name, F.md5("r_name").alias("checksum"))
    applied = r.where("r_regionkey <> 3").select(name, F.md5(F.when(F.col("r_regionkey") == 2, "x").otherwise(F.col("r_name"))).alias("checksum"))
    return quality.ledger(applied, files)
