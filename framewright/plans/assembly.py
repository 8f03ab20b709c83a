"""Queries on filters and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, intervals, keyframes, recipes, staleness
from ..operators.filters import Condition, Group
from .registry import query
from .views import Views

#: (size share small or has person 2) and in frames 5 .. 60 and not in locations 1, 2.
FILTER = Group("AND", (
    Group("OR", (Condition("PERSON", "IN", [2, 3]), Condition("SHOT_TYPE", "IN", ["OPERATOR"]), Condition("HAS_FACE", "IS_NULL"))),
    Condition("FRAME_RANGE", "BETWEEN", [5, 60]),
    Condition("LOCATION", "NOT_IN", [1, 2], subject="SCENE"),
    Condition("PERSON", "IN", [5], subject="SCENE", negated=True),
))

FACTS = """
, live AS (SELECT s.shot_id, s.id_videofile, s.first_frame, s.last_frame, c.scene_id, c.location_id FROM shots s JOIN scenes c ON s.id_videofile = c.id_videofile AND s.first_frame >= c.first_frame AND s.last_frame <= c.last_frame WHERE NOT c.is_stale),
pf AS (SELECT l.*, (SELECT count(*) FROM shot_faces f WHERE f.shot_id = l.shot_id) AS n, (SELECT count(*) FROM shot_faces f WHERE f.shot_id = l.shot_id AND f.person_id IN (2, 3)) AS n23,
   (SELECT count(*) FROM shot_faces f JOIN live o ON o.shot_id = f.shot_id WHERE o.scene_id = l.scene_id AND f.person_id = 5) AS n5 FROM live l),
ok AS (SELECT *, (n23 > 0 OR n = 0) AND last_frame >= 5 AND first_frame <= 60 AND coalesce(location_id NOT IN (1, 2), true) AND n5 = 0 AS passes FROM pf)
"""


def _facts(v: Views):
    return filters.facts(v.shots, v.scenes, v.faces)


@query("filter_shots", FACTS + "SELECT shot_id FROM ok WHERE passes")
def _(v: Views):
    return filters.passing_shots(_facts(v), FILTER).select("shot_id")


@query("filter_scenes", FACTS + "SELECT scene_id, count(*) AS shots, CAST(count_if(passes) AS BIGINT) AS passed FROM ok GROUP BY 1 HAVING count_if(passes) > 0")
def _(v: Views):
    return filters.passing_scenes(_facts(v), FILTER)


@query("filter_diagnosis", FACTS + """
SELECT count(*) AS shots, CAST(count_if(n23 > 0 OR n = 0) AS BIGINT) AS part_0, CAST(count_if(last_frame >= 5 AND first_frame <= 60) AS BIGINT) AS part_1, CAST(count_if(coalesce(location_id NOT IN (1, 2), true)) AS BIGINT) AS part_2,
       CAST(count_if(n5 = 0) AS BIGINT) AS part_3, CAST(count_if(passes) AS BIGINT) AS passed FROM ok""")
def _(v: Views):
    return filters.diagnosed(_facts(v), FILTER)


DIFF = """array_to_string(list_filter([CASE WHEN v.width <> f.width THEN 'width' END, CASE WHEN v.height <> f.height THEN 'height' END, CASE WHEN coalesce(v.video_profile, '') <> coalesce(f.video_profile, '') THEN 'videoProfile' END,
  CASE WHEN v.pixel_format <> f.pixel_format THEN 'pixelFormat' END, CASE WHEN v.time_base_num <> f.time_base_num OR v.time_base_den <> f.time_base_den THEN 'frameRateBase' END,
  CASE WHEN v.audio_channels IS DISTINCT FROM f.audio_channels THEN 'audioChannels' END], lambda x: x IS NOT NULL), ',')"""


@query("compatibility", f"""
, m AS (SELECT id_videofile // 3 AS recipe_id, * FROM videofiles), first_of AS (SELECT recipe_id, min(id_videofile) AS id FROM m GROUP BY 1)
SELECT CAST(v.recipe_id AS BIGINT) AS recipe_id, v.id_videofile, {DIFF} AS differing FROM m v JOIN first_of o ON o.recipe_id = v.recipe_id JOIN m f ON f.id_videofile = o.id""")
def _(v: Views):
    files = v.videofiles.withColumn("recipe_id", F.floor(F.col("id_videofile") / 3).cast("long")).withColumn("ordinal", F.col("id_videofile"))
    return recipes.compatibility(files).select("recipe_id", "id_videofile", F.array_join("differing", ",").alias("differing"))


@query("compatibility_summary", f"""
, m AS (SELECT id_videofile // 3 AS recipe_id, * FROM videofiles), first_of AS (SELECT recipe_id, min(id_videofile) AS id FROM m GROUP BY 1),
d AS (SELECT v.recipe_id, {DIFF} AS differing FROM m v JOIN first_of o ON o.recipe_id = v.recipe_id JOIN m f ON f.id_videofile = o.id),
e AS (SELECT recipe_id, unnest(string_split(differing, ',')) AS a FROM d)
SELECT CAST(recipe_id AS BIGINT) AS recipe_id, count(*) FILTER (a <> '') = 0 AS compatible, coalesce(array_to_string(list_sort(list(DISTINCT a) FILTER (a <> '')), ','), '') AS differing FROM e GROUP BY 1""")
def _(v: Views):
    files = v.videofiles.withColumn("recipe_id", F.floor(F.col("id_videofile") / 3).cast("long")).withColumn("ordinal", F.col("id_videofile"))
    return recipes.differing_attributes(recipes.compatibility(files)).withColumn("differing", F.array_join("differing", ","))


@query("recipe_totals", """
SELECT sel.recipe_id, count(*) AS items, CAST(sum(cut_last - cut_first) AS BIGINT) AS frames, CAST((sum((cut_last - cut_first)::BIGINT * (v.time_base_num * 1000000000::BIGINT // v.time_base_den)) + 500000) // 1000000 AS BIGINT) AS duration_ms
FROM selection sel JOIN cuts c ON c.scene_id = sel.scene_id JOIN videofiles v ON v.id_videofile = c.id_videofile GROUP BY 1""")
def _(v: Views):
    cut = keyframes.cut(v.scenes.select("scene_id", "id_videofile", "first_frame", "last_frame"), v.keys)
    items = v.selection.join(cut, "scene_id").join(v.videofiles.select("id_videofile", "time_base_num", "time_base_den"), "id_videofile")
    return recipes.totals(items)


ITEMS = """
, named AS (SELECT c.scene_id, list_sort(list(DISTINCT p.name) FILTER (p.name IS NOT NULL)) AS persons FROM scenes c LEFT JOIN faces f ON f.id_videofile = c.id_videofile AND f.frame_number BETWEEN c.first_frame AND c.last_frame
   LEFT JOIN persons p ON p.person_id = f.person_id AND p.kind = 'PERSON' GROUP BY 1),
dig AS (SELECT id_videofile, arg_max(digest, checksum_id) AS digest FROM checksums WHERE state = 'DONE' AND NOT is_stale GROUP BY 1),
items AS (SELECT sel.recipe_id, sel.ordinal, sel.scene_id, c.title, l.name AS location_name, n.persons, c.id_videofile, v.name AS videofile_name, CASE WHEN starts_with(v.source_path, p.source_root || '/') THEN substr(v.source_path, length(p.source_root) + 2) END AS relative_path,
   d.digest AS source_sha256, c.first_frame, c.last_frame, k.cut_first, k.cut_last, v.time_base_num, v.time_base_den FROM selection sel JOIN scenes c ON c.scene_id = sel.scene_id AND NOT c.is_stale JOIN cuts k ON k.scene_id = c.scene_id JOIN named n ON n.scene_id = c.scene_id
   JOIN videofiles v ON v.id_videofile = c.id_videofile JOIN projects p ON p.id_project = v.id_project LEFT JOIN dig d ON d.id_videofile = c.id_videofile LEFT JOIN locations l ON l.location_id = c.location_id)
"""


def _items(v: Views):
    return recipes.items(v.selection, v.scenes, v.videofiles, v.keys, v.checksums, v.projects, v.locations, v.faces, v.persons)


@query("recipe_items", ITEMS + "SELECT recipe_id, ordinal, scene_id, title, location_name, coalesce(array_to_string(persons, ','), '') AS person_names, videofile_name, relative_path, source_sha256, first_frame, last_frame, cut_first, cut_last FROM items")
def _(v: Views):
    return _items(v).withColumn("person_names", F.array_join("person_names", ",")).withColumn("ordinal", F.col("ordinal").cast("long")).drop("id_videofile", "time_base_num", "time_base_den")


ITEM_JSON = r"""
'{' || chr(10) || concat_ws(',' || chr(10), '  "ordinal": ' || ordinal, '  "sceneId": ' || scene_id, '  "sceneTitle": "' || title || '"', '  "tbl_locations": "' || location_name || '"',
  CASE WHEN len(persons) > 0 THEN '  "persons": [' || array_to_string(list_transform(persons, lambda x: '"' || x || '"'), ', ') || ']' END, '  "videofileId": ' || id_videofile, '  "videofileName": "' || videofile_name || '"',
  '  "relativePath": "' || relative_path || '"', '  "sourceSha256": "' || source_sha256 || '"', '  "firstFrame": ' || first_frame, '  "lastFrame": ' || last_frame, '  "cutFirstFrame": ' || cut_first, '  "cutLastFrame": ' || cut_last) || chr(10) || '}'
"""


@query("canonical_item", ITEMS + f"SELECT recipe_id, ordinal, sha256({ITEM_JSON}) AS item_sha256 FROM items")
def _(v: Views):
    return _items(v).select("recipe_id", F.col("ordinal").cast("long").alias("ordinal"), F.sha2(recipes.item_document(), 256).alias("item_sha256"))


DOCUMENTS = ITEMS + f"""
, body AS (SELECT recipe_id, '[' || string_agg({ITEM_JSON}, ', ' ORDER BY ordinal) || ']' AS items, CAST(sum(cut_last - cut_first) AS BIGINT) AS frames, CAST((sum((cut_last - cut_first)::BIGINT * (time_base_num * 1000000000::BIGINT // time_base_den)) + 500000) // 1000000 AS BIGINT) AS ms FROM items GROUP BY 1),
documents AS (SELECT recipe_id, sha256('{{' || chr(10) || concat_ws(',' || chr(10), '  "schemaVersion": 2', '  "projectId": ' || (recipe_id % 5), '  "projectName": "Project"', '  "recipeId": ' || recipe_id, '  "recipeName": "Recipe \\"' || recipe_id || '\\""', '  "signingKeyId": "k1"',
  '  "createdAt": "2024-05-06T07:08:09Z"', '  "rootLayout": "MOVIE_TREE"', '  "audioTrackCount": 1', '  "expectedDurationMs": ' || ms, '  "expectedFrameCount": ' || frames, '  "items": ' || items) || chr(10) || '}}') AS content_sha256 FROM body)
"""


def _found_files(v: Views):
    """What lies at the user's: some files are missing, others changed."""
    n = F.col("id_videofile")
    digests = staleness.current_checksums(v.checksums).where(n % 3 != 0)
    return digests.select(F.when(n % 17 != 0, F.concat(F.lit("ep"), n, F.lit(".mkv"))).alias("relative_path"), F.when(n % 2 == 0, F.col("digest")).otherwise("changed").alias("digest"))


def _documents(v: Views):
    recipe = F.col("recipe_id")
    heads = v.selection.select("recipe_id").distinct().select(
        "recipe_id", (recipe % 5).alias("project_id"), F.lit("Project").alias("project_name"), F.concat(F.lit('Recipe "'), recipe, F.lit('"')).alias("recipe_name"), F.lit("k1").alias("signing_key_id"),
        F.lit("2024-05-06 07:08:09.9").cast("timestamp").alias("created_at"), F.lit(1).alias("audio_track_count"),
    )
    return recipes.documents(_items(v), heads).select("recipe_id", "content_sha256")


@query("recipe_documents", DOCUMENTS + "SELECT recipe_id, content_sha256 FROM documents")
def _(v: Views):
    return _documents(v)


@query("recipe_seals", DOCUMENTS + """
, files AS (SELECT CASE WHEN id_videofile % 17 <> 0 THEN 'ep' || id_videofile || '.mkv' END AS path, CASE WHEN id_videofile % 2 = 0 THEN digest ELSE 'changed' END AS digest FROM dig WHERE id_videofile % 3 <> 0),
sealed AS (SELECT recipe_id, CASE WHEN recipe_id % 7 = 0 OR recipe_id % 11 = 0 THEN 'UNSIGNED' WHEN recipe_id % 5 = 0 THEN 'UNKNOWN_KEY' WHEN recipe_id % 4 = 1 THEN 'ALTERED' ELSE 'SEALED' END AS seal FROM documents)
SELECT i.recipe_id, i.ordinal, s.seal, CASE WHEN s.seal <> 'SEALED' THEN NULL WHEN f.path IS NULL THEN 'MISSING' WHEN f.digest = i.source_sha256 THEN 'OK' ELSE 'CHANGED' END AS verdict FROM items i JOIN sealed s USING (recipe_id) LEFT JOIN files f ON f.path = i.relative_path""")
def _(v: Views):
    """Recipes of which some are unsigned, signed by a stranger, or were changed after signing; then the files of the others."""
    recipe = F.col("recipe_id")
    signed = _documents(v).select(
        "recipe_id", F.when(recipe % 4 == 1, F.sha2(F.lit("another"), 256)).otherwise(F.col("content_sha256")).alias("content_sha256"),
        F.when(recipe % 7 > 0, "QUJD").alias("signature"), F.when(recipe % 11 > 0, F.when(recipe % 5 == 0, "k9").otherwise("k1")).alias("signing_key_id"),
    )
    sealed = recipes.seals(signed, _documents(v), v.spark.createDataFrame([("k1",)], "signing_key_id string"))
    return recipes.verify_sealed(_items(v), _found_files(v), sealed).select("recipe_id", F.col("ordinal").cast("long").alias("ordinal"), "seal", "verdict")


@query("recipe_refusals", f"""
, m AS (SELECT sel.recipe_id, sel.ordinal, sel.scene_id, c.id_videofile, c.is_stale, v.* EXCLUDE (id_videofile, ordinal, id_project), v.id_project, p.source_root,
   EXISTS (SELECT 1 FROM scenes x WHERE x.id_videofile = c.id_videofile AND NOT x.is_stale) AS analyzed, EXISTS (SELECT 1 FROM checksums k WHERE k.id_videofile = c.id_videofile AND k.state = 'DONE' AND NOT k.is_stale) AS ready
   FROM selection sel JOIN scenes c ON c.scene_id = sel.scene_id JOIN videofiles v ON v.id_videofile = c.id_videofile JOIN projects p ON p.id_project = v.id_project WHERE sel.recipe_id % 4 <> 1 OR sel.ordinal > 0),
fo AS (SELECT recipe_id, arg_min(m, ordinal) AS f FROM m GROUP BY 1),
a AS (SELECT v.recipe_id, count_if(is_stale) AS stale, count(DISTINCT id_project) AS projects, count_if(NOT analyzed) AS un, count_if(NOT ready) AS nr, count_if(NOT starts_with(v.source_path, v.source_root || '/')) AS outside,
   count_if({DIFF.replace('f.', 'fo.f.')} <> '') AS inc FROM m v JOIN fo ON fo.recipe_id = v.recipe_id GROUP BY 1)
SELECT recipe_id, CASE WHEN stale > 0 THEN 'STALE_RESULT' WHEN projects > 1 THEN 'SEVERAL_PROJECTS' WHEN un > 0 THEN 'EPISODE_NOT_ANALYZED' WHEN inc > 0 THEN 'INCOMPATIBLE_EPISODE' WHEN nr > 0 THEN 'CHECKSUM_NOT_READY' WHEN outside > 0 THEN 'SOURCE_UNREADABLE' END AS error_code FROM a""")
def _(v: Views):
    return recipes.refusals(v.selection, v.scenes, v.videofiles.drop("ordinal").withColumn("keyframe_count", F.lit(1)), v.checksums, v.projects)


@query("recipe_order", """
SELECT recipe_id, scene_id, row_number() OVER (PARTITION BY recipe_id ORDER BY position, scene_id) AS ordinal FROM (SELECT recipe_id, scene_id, scene_id % 7 AS position FROM selection)""")
def _(v: Views):
    return recipes.in_order(v.selection.select("recipe_id", "scene_id", (F.col("scene_id") % 7).alias("position"))).select("recipe_id", "scene_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("broken_orders", "SELECT recipe_id, ordinal, expected FROM (SELECT recipe_id, ordinal, row_number() OVER (PARTITION BY recipe_id ORDER BY ordinal) AS expected FROM selection WHERE scene_id % 4 <> 0) WHERE ordinal <> expected")
def _(v: Views):
    return recipes.broken_order(v.selection.where("scene_id % 4 <> 0")).select("recipe_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("expected").cast("long").alias("expected"))


@query("recipe_freshness", "SELECT o_orderkey AS recipe_id, o_orderkey % 3 = 2 AND NOT o_orderstatus = 'F' AS is_fresh FROM orders")
def _(v: Views):
    rows = v.table("orders").select(F.col("o_orderkey").alias("recipe_id"), (F.col("o_orderkey") % 3).alias("schema_version"), (F.col("o_orderstatus") == "F").alias("is_stale"))
    return recipes.fresh(rows).select("recipe_id", "is_fresh")


@query("recipe_verification", ITEMS + """
, files AS (SELECT CASE WHEN id_videofile % 17 <> 0 THEN 'ep' || id_videofile || '.mkv' END AS path, CASE WHEN id_videofile % 2 = 0 THEN digest ELSE 'changed' END AS digest FROM dig WHERE id_videofile % 3 <> 0)
SELECT i.recipe_id, i.ordinal, CASE WHEN f.path IS NULL THEN 'MISSING' WHEN f.digest = i.source_sha256 THEN 'OK' ELSE 'CHANGED' END AS verdict FROM items i LEFT JOIN files f ON f.path = i.relative_path""")
def _(v: Views):
    return recipes.verify(_items(v), _found_files(v)).select("recipe_id", F.col("ordinal").cast("long").alias("ordinal"), "verdict")


@query("canonical_texts", r"""
SELECT doc_id, sha256('"' || replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '"') AS canonical_sha256 FROM documents
WHERE NOT regexp_matches(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]')""")
def _(v: Views):
    docs = v.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = docs.where(~F.col("text").rlike("[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return plain.select("doc_id", F.sha2(text.canonical_text(F.col("text")), 256).alias("canonical_sha256"))


@query("scene_persons_of_recipes", ITEMS + "SELECT recipe_id, count(DISTINCT p) AS persons FROM (SELECT recipe_id, unnest(persons) AS p FROM items) GROUP BY 1")
def _(v: Views):
    scenes = v.scenes.where("NOT is_stale")
    named = intervals.persons_in(scenes, v.faces, v.persons)
    return v.selection.join(named, "scene_id").select("recipe_id", F.explode("person_names").alias("p")).groupBy("recipe_id").agg(F.count_distinct("p").alias("persons"))
