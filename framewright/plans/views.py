"""The verification tables in the roles of the annotation data model: as DataFrames, and as SQL for DuckDB.

events are score series and detections of videofiles (one a user); orders are analysis runs and checksums; regions and
nations are projects and locations; conversations are logs of jobs; documents are files and owners of properties.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import segments

SCENE_T, SHOT_T = 100.0, 50.0
# States and kinds by number.
JOB_STATES = ("WAITING", "CREATING", "WORKING", "DONE", "ERROR")
JOB_KINDS = {"view": "ANALYZE", "click": "FACES", "signup": "TRAIN", "purchase": "HASH", "error": "ANALYZE"}


class Views:
    """Each view reads only the columns it needs; nothing is computed until a query asks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def scores(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.col("user_id").alias("id_videofile"), (F.row_number().over(w) - 1).alias("frame_number"), F.col("value").alias("score"), "event_id", "event_type")

    @cached_property
    def videofiles(self) -> DataFrame:
        counts = self.table("events").groupBy(F.col("user_id").alias("id_videofile")).agg(F.count("*").cast("int").alias("frame_count"))
        return counts.selectExpr(
            "id_videofile",
            "frame_count",
            "id_videofile % 5 AS id_project",
            "cast(id_videofile div 5 AS int) AS ordinal",
            "concat('ep', id_videofile) AS name",
            "CASE WHEN id_videofile % 17 = 0 THEN concat('/other/ep', id_videofile, '.mkv') ELSE concat('/media/p', id_videofile % 5, '/ep', id_videofile, '.mkv') END AS source_path",
            "CASE WHEN id_videofile % 10 = 0 THEN 1280 ELSE 1920 END AS width",
            "CASE WHEN id_videofile % 10 = 0 THEN 720 ELSE 1080 END AS height",
            "'h264' AS video_codec",
            "CASE WHEN id_videofile % 4 <> 0 THEN 'High' END AS video_profile",
            "CASE WHEN id_videofile % 9 = 0 THEN 'yuv420p10le' ELSE 'yuv420p' END AS pixel_format",
            "CASE WHEN id_videofile % 11 = 0 THEN 1 ELSE 1001 END AS time_base_num",
            "CASE WHEN id_videofile % 11 = 0 THEN 25 ELSE 24000 END AS time_base_den",
            "'aac' AS audio_codec",
            "CASE WHEN id_videofile % 8 <> 0 THEN 2 END AS audio_channels",
            "48000 AS audio_sample_rate",
            "1000 + id_videofile AS file_size",
        )

    @cached_property
    def bounds(self) -> DataFrame:
        return segments.boundaries(self.scores, SCENE_T, SHOT_T)

    @cached_property
    def ranges(self) -> DataFrame:
        return segments.segments(self.bounds, self.videofiles)

    @cached_property
    def shots(self) -> DataFrame:
        return self.ranges.where("level = 'SHOT'").selectExpr(
            "id_videofile * 100000 + first_frame AS shot_id", "id_videofile", "first_frame", "last_frame", "'NONE' AS size",
            "CASE WHEN first_frame % 7 = 0 THEN 'OPERATOR' ELSE 'AUTO' END AS size_origin", "'AUTO' AS origin", "id_videofile AS run_id", "false AS is_stale",
        )

    @cached_property
    def scenes(self) -> DataFrame:
        return self.ranges.where("level = 'SCENE'").selectExpr(
            "id_videofile * 100000 + first_frame AS scene_id", "id_videofile", "first_frame", "last_frame", "CASE WHEN first_frame % 3 <> 0 THEN concat('Scene ', first_frame) END AS title",
            "CASE WHEN first_frame % 4 <> 0 THEN first_frame % 25 END AS location_id", "'AUTO' AS origin", "id_videofile AS run_id", "first_frame % 10 = 3 AS is_stale",
        )

    @cached_property
    def faces(self) -> DataFrame:
        return self.scores.where("event_type IN ('click', 'purchase')").selectExpr(
            "event_id AS face_id", "id_videofile", "frame_number", "0 AS face_index", "cast(event_id % 1800 AS int) AS x1", "cast((event_id * 7) % 1000 AS int) AS y1",
            "cast(event_id % 1800 + 1 + event_id % 97 AS int) AS x2", "cast((event_id * 7) % 1000 + 1 + (event_id * 3) % 61 AS int) AS y2", "event_id % 11 AS person_id",
            "CASE WHEN event_id % 6 = 0 THEN 'OPERATOR' ELSE 'AUTO' END AS origin", "(event_id * 13) % 100 / 100.0D AS score",
        )

    @cached_property
    def detections(self) -> DataFrame:
        """Boxes by groups of ten frames, so that they overlap."""
        return self.scores.selectExpr(
            "event_id AS detection_id", "id_videofile", "cast(frame_number div 10 AS int) AS frame_number", "cast((event_id * 31) % 60 AS int) AS x1", "cast((event_id * 17) % 40 AS int) AS y1",
            "cast((event_id * 31) % 60 + 30 + event_id % 20 AS int) AS x2", "cast((event_id * 17) % 40 + 30 + event_id % 30 AS int) AS y2", "(event_id * 13) % 100 / 100.0D AS score",
        )

    @cached_property
    def keys(self) -> DataFrame:
        return self.scores.where("frame_number % 12 = 0 OR event_type = 'signup'").select("id_videofile", "frame_number")

    @cached_property
    def persons(self) -> DataFrame:
        return self.spark.range(11).selectExpr(
            "id AS person_id", "id % 5 AS id_project", "concat('P', lpad(cast(id AS string), 3, '0')) AS name", "CASE id % 5 WHEN 0 THEN 'UNRECOGNIZED' WHEN 1 THEN 'NONPERSON' ELSE 'PERSON' END AS kind",
            "CASE WHEN id % 5 > 1 THEN concat('cl-', id) END AS recognizer_key",
        )

    @cached_property
    def projects(self) -> DataFrame:
        return self.table("region").selectExpr("cast(r_regionkey AS bigint) AS id_project", "r_name AS name", "concat('/media/p', r_regionkey) AS source_root")

    @cached_property
    def locations(self) -> DataFrame:
        return self.table("nation").selectExpr("n_nationkey AS location_id", "n_name AS name", "cast(n_regionkey AS bigint) AS id_project")

    @cached_property
    def jobs(self) -> DataFrame:
        states = F.array(*[F.lit(s) for s in JOB_STATES])
        kinds = F.create_map(*[F.lit(x) for kv in JOB_KINDS.items() for x in kv])
        return self.table("events").select(
            F.col("event_id").alias("job_id"), kinds[F.col("event_type")].alias("kind"), F.get(states, (F.col("event_id") % 5).cast("int")).alias("state"), F.col("user_id").alias("subject_id"),
            F.floor("value").cast("long").alias("progress_done"), F.when(F.col("event_id") % 3 > 0, 100).otherwise(0).cast("long").alias("progress_total"), F.concat(F.lit("h"), F.col("event_id") % 50).alias("params_hash"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def job_log(self) -> DataFrame:
        states = F.array(*[F.lit(s) for s in JOB_STATES])
        return self.table("conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.get(states, ((F.col("turn") + (F.col("role") == "system").cast("long")) % 5).cast("int")).alias("state"), F.char_length("text").cast("long").alias("done"))

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey AS run_id", "o_custkey % 150 AS id_videofile", "CASE WHEN o_orderkey % 3 = 0 THEN 'FACES' ELSE 'STRUCTURE' END AS kind", "concat('h', o_orderkey % 4) AS params_hash", "o_orderstatus = 'F' AS is_stale")

    @cached_property
    def checksums(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS checksum_id", "o_custkey % 150 AS id_videofile", "sha2(cast(o_orderkey AS string), 256) AS digest", "1000 + o_custkey % 150 + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS byte_size",
            "CASE o_orderstatus WHEN 'O' THEN 'DONE' WHEN 'F' THEN 'WORKING' ELSE 'ERROR' END AS state", "o_orderkey % 2 = 0 AS is_stale",
        )

    @cached_property
    def points(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("face_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("id_videofile"))

    @cached_property
    def properties(self) -> DataFrame:
        each = F.array(F.struct(F.lit("lang").alias("k"), F.col("lang").alias("v"), F.lit(0).alias("o")), F.struct(F.lit("source").alias("k"), F.col("source").alias("v"), F.lit(1).alias("o")))
        return self.table("documents").select("doc_id", F.explode(each).alias("p")).select(F.lit("VIDEOFILE").alias("owner_kind"), F.col("doc_id").alias("owner_id"), F.col("p.k").alias("property_key"), F.col("p.v").alias("property_value"), F.col("p.o").alias("ordinal"))

    @cached_property
    def selection(self) -> DataFrame:
        """Recipes: all live and some stale scenes of three neighbouring videofiles."""
        place = F.row_number().over(Window.partitionBy("recipe_id").orderBy("scene_id"))
        return self.scenes.where("first_frame % 20 < 5 OR first_frame = 0").select(F.floor(F.col("id_videofile") / 3).cast("long").alias("recipe_id"), "scene_id").withColumn("ordinal", place)


PRELUDE = """
WITH scores AS (SELECT user_id AS id_videofile, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_number, value AS score, event_id, event_type FROM events),
vf AS (SELECT user_id AS id_videofile, CAST(count(*) AS INT) AS frame_count FROM events GROUP BY user_id),
videofiles AS (SELECT id_videofile, frame_count, id_videofile % 5 AS id_project, CAST(id_videofile // 5 AS INT) AS ordinal, 'ep' || id_videofile AS name,
    CASE WHEN id_videofile % 17 = 0 THEN '/other/ep' || id_videofile || '.mkv' ELSE '/media/p' || (id_videofile % 5) || '/ep' || id_videofile || '.mkv' END AS source_path,
    CASE WHEN id_videofile % 10 = 0 THEN 1280 ELSE 1920 END AS width, CASE WHEN id_videofile % 10 = 0 THEN 720 ELSE 1080 END AS height, 'h264' AS video_codec,
    CASE WHEN id_videofile % 4 <> 0 THEN 'High' END AS video_profile, CASE WHEN id_videofile % 9 = 0 THEN 'yuv420p10le' ELSE 'yuv420p' END AS pixel_format,
    CASE WHEN id_videofile % 11 = 0 THEN 1 ELSE 1001 END AS time_base_num, CASE WHEN id_videofile % 11 = 0 THEN 25 ELSE 24000 END AS time_base_den,
    'aac' AS audio_codec, CASE WHEN id_videofile % 8 <> 0 THEN 2 END AS audio_channels, 48000 AS audio_sample_rate, 1000 + id_videofile AS file_size FROM vf),
bounds AS (SELECT id_videofile, 'SCENE' AS level, frame_number FROM scores WHERE score >= 100 UNION ALL SELECT id_videofile, 'SHOT', frame_number FROM scores WHERE score >= 50),
starts AS (SELECT id_videofile, level, frame_number FROM bounds WHERE frame_number > 0
    UNION SELECT id_videofile, lv.level, 0 FROM vf CROSS JOIN (SELECT 'SCENE' AS level UNION ALL SELECT 'SHOT') lv),
ranges AS (SELECT s.id_videofile, level, frame_number AS first_frame,
    CAST(coalesce(lead(frame_number) OVER (PARTITION BY s.id_videofile, level ORDER BY frame_number), vf.frame_count) - 1 AS INT) AS last_frame FROM starts s JOIN vf ON s.id_videofile = vf.id_videofile),
shots AS (SELECT id_videofile * 100000 + first_frame AS shot_id, id_videofile, first_frame, last_frame, CASE WHEN first_frame % 7 = 0 THEN 'OPERATOR' ELSE 'AUTO' END AS size_origin FROM ranges WHERE level = 'SHOT'),
scenes AS (SELECT id_videofile * 100000 + first_frame AS scene_id, id_videofile, first_frame, last_frame, CASE WHEN first_frame % 3 <> 0 THEN 'Scene ' || first_frame END AS title,
    CASE WHEN first_frame % 4 <> 0 THEN first_frame % 25 END AS location_id, first_frame % 10 = 3 AS is_stale FROM ranges WHERE level = 'SCENE'),
faces AS (SELECT event_id AS face_id, id_videofile, frame_number, CAST(event_id % 1800 AS INT) AS x1, CAST((event_id * 7) % 1000 AS INT) AS y1,
    CAST(event_id % 1800 + 1 + event_id % 97 AS INT) AS x2, CAST((event_id * 7) % 1000 + 1 + (event_id * 3) % 61 AS INT) AS y2, event_id % 11 AS person_id,
    CASE WHEN event_id % 6 = 0 THEN 'OPERATOR' ELSE 'AUTO' END AS origin FROM scores WHERE event_type IN ('click', 'purchase')),
detections AS (SELECT event_id AS detection_id, id_videofile, CAST(frame_number // 10 AS INT) AS frame_number, CAST((event_id * 31) % 60 AS INT) AS x1, CAST((event_id * 17) % 40 AS INT) AS y1,
    CAST((event_id * 31) % 60 + 30 + event_id % 20 AS INT) AS x2, CAST((event_id * 17) % 40 + 30 + event_id % 30 AS INT) AS y2, CAST((event_id * 13) % 100 AS DOUBLE) / 100.0 AS score FROM scores),
keys AS (SELECT id_videofile, frame_number FROM scores WHERE frame_number % 12 = 0 OR event_type = 'signup'),
persons AS (SELECT id AS person_id, id % 5 AS id_project, 'P' || lpad(CAST(id AS VARCHAR), 3, '0') AS name, CASE id % 5 WHEN 0 THEN 'UNRECOGNIZED' WHEN 1 THEN 'NONPERSON' ELSE 'PERSON' END AS kind,
    CASE WHEN id % 5 > 1 THEN 'cl-' || id END AS recognizer_key FROM range(11) t(id)),
projects AS (SELECT CAST(r_regionkey AS BIGINT) AS id_project, r_name AS name, '/media/p' || r_regionkey AS source_root FROM region),
locations AS (SELECT n_nationkey AS location_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS id_project FROM nation),
jobs AS (SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'FACES' WHEN 'signup' THEN 'TRAIN' WHEN 'purchase' THEN 'HASH' WHEN 'view' THEN 'ANALYZE' WHEN 'error' THEN 'ANALYZE' END AS kind,
    CASE event_id % 5 WHEN 0 THEN 'WAITING' WHEN 1 THEN 'CREATING' WHEN 2 THEN 'WORKING' WHEN 3 THEN 'DONE' ELSE 'ERROR' END AS state, user_id AS subject_id, CAST(floor(value) AS BIGINT) AS progress_done,
    CASE WHEN event_id % 3 > 0 THEN 100 ELSE 0 END AS progress_total, 'h' || (event_id % 50) AS params_hash, ts AS created_at FROM events),
job_log AS (SELECT conv_id AS job_id, turn AS seq, CASE (turn + CASE WHEN role = 'system' THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'WAITING' WHEN 1 THEN 'CREATING' WHEN 2 THEN 'WORKING' WHEN 3 THEN 'DONE' ELSE 'ERROR' END AS state,
    length(text) AS done FROM conversations),
runs AS (SELECT o_orderkey AS run_id, o_custkey % 150 AS id_videofile, CASE WHEN o_orderkey % 3 = 0 THEN 'FACES' ELSE 'STRUCTURE' END AS kind, 'h' || (o_orderkey % 4) AS params_hash, o_orderstatus = 'F' AS is_stale FROM orders),
checksums AS (SELECT o_orderkey AS checksum_id, o_custkey % 150 AS id_videofile, sha256(CAST(o_orderkey AS VARCHAR)) AS digest, 1000 + o_custkey % 150 + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS byte_size,
    CASE o_orderstatus WHEN 'O' THEN 'DONE' WHEN 'F' THEN 'WORKING' ELSE 'ERROR' END AS state, o_orderkey % 2 = 0 AS is_stale FROM orders),
points AS (SELECT vec_id AS face_id, embedding AS vector, CAST(label AS BIGINT) AS id_videofile FROM embeddings),
properties AS (SELECT 'VIDEOFILE' AS owner_kind, doc_id AS owner_id, k AS property_key, v AS property_value, o AS ordinal FROM (SELECT doc_id, 'lang' AS k, lang AS v, 0 AS o FROM documents UNION ALL SELECT doc_id, 'source', source, 1 FROM documents)),
selection AS (SELECT CAST(floor(id_videofile / 3) AS BIGINT) AS recipe_id, scene_id, row_number() OVER (PARTITION BY id_videofile // 3 ORDER BY scene_id) AS ordinal FROM scenes WHERE first_frame % 20 < 5 OR first_frame = 0),
shot_faces AS (SELECT f.*, s.shot_id FROM faces f LEFT JOIN shots s ON f.id_videofile = s.id_videofile AND f.frame_number BETWEEN s.first_frame AND s.last_frame),
shares AS (SELECT s.shot_id, s.id_videofile, max(CAST(f.x2 - f.x1 AS DOUBLE) * (f.y2 - f.y1)) / any_value(CAST(v.width AS DOUBLE) * v.height) AS share
    FROM shots s JOIN videofiles v ON s.id_videofile = v.id_videofile LEFT JOIN shot_faces f ON f.shot_id = s.shot_id GROUP BY s.shot_id, s.id_videofile),
cuts AS (SELECT s.scene_id, s.id_videofile, s.first_frame, s.last_frame, coalesce(max(CASE WHEN k.frame_number <= s.first_frame THEN k.frame_number END), s.first_frame) AS cut_first,
    coalesce(min(CASE WHEN k.frame_number >= s.last_frame THEN k.frame_number END), s.last_frame) AS cut_last FROM scenes s LEFT JOIN keys k ON k.id_videofile = s.id_videofile GROUP BY s.scene_id, s.id_videofile, s.first_frame, s.last_frame)
"""
