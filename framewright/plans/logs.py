"""Queries on text that tools print: the verification tables written as such text, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import boxes
from ..sources import logs
from .registry import query
from .views import Views


def _seconds(v: Views, rows):
    """rows with the time of their frame, in seconds with six decimals, as text."""
    met = rows.join(v.videofiles.select("id_videofile", "time_base_num", "time_base_den"), "id_videofile")
    return met.withColumn("seconds", F.format_string("%.6f", F.col("frame_number").cast("double") * F.col("time_base_num") / F.col("time_base_den")))


@query("score_log", "SELECT id_videofile, frame_number, score FROM scores")
def _(v: Views):
    lines = _seconds(v, v.scores).select("id_videofile", F.concat(F.lit("[info] lavfi.scd.score: "), F.col("score").cast("string"), F.lit(", lavfi.scd.time: "), "seconds").alias("value"))
    noise = v.videofiles.select("id_videofile", F.lit("frame dropped").alias("value"))
    return logs.scores(lines.unionByName(noise), v.videofiles)


@query("keyframe_log", "SELECT id_videofile, frame_number FROM keys")
def _(v: Views):
    lines = _seconds(v, v.keys).select("id_videofile", F.concat("seconds", F.lit(",K__")).alias("value"))
    return logs.keyframes(lines, v.videofiles)


@query("progress_log", "SELECT event_id, CAST(floor(value) AS BIGINT) AS done, CAST(500 AS BIGINT) AS total, CASE WHEN event_id % 2 = 0 THEN 'speed 1.5x' ELSE '' END AS note FROM events WHERE event_id % 7 <> 0")
def _(v: Views):
    n = F.col("event_id")
    line = F.concat(F.lit("frame= "), F.floor("value").cast("string"), F.lit(" / 500 fps=25"), F.when(n % 2 == 0, " speed=1.5x").otherwise(""))
    return logs.progress(v.table("events").select("event_id", F.when(n % 7 == 0, "bitrate=5").otherwise(line).alias("value"))).select("event_id", "done", "total", "note")


@query("probe_sections", """
SELECT 'f' || p_size AS path, CAST(p_partkey AS INT) AS track_index, p_brand AS codec_type, p_type AS codec_name FROM part""")
def _(v: Views):
    """Files are parts of one size; every part is a stream with a nested section that mustn't leak into it."""
    inner = F.array(F.lit("[STREAM]"), F.concat(F.lit("index="), "p_partkey"), F.concat(F.lit("codec_type = "), "p_brand"), F.lit("[TAGS]"), F.lit("codec_type=none"), F.lit("[/TAGS]"), F.concat(F.lit("codec_name="), "p_type"), F.lit("[/STREAM]"))
    lines = v.table("part").select(F.concat(F.lit("f"), "p_size").alias("path"), "p_partkey", F.posexplode(inner).alias("at", "value"))
    return logs.streams(logs.sections(lines.withColumn("line", F.col("p_partkey") * 10 + F.col("at")))).select("path", "track_index", "codec_type", "codec_name")


@query("packet_counts", "SELECT 'f' || id_videofile AS path, frame_count::BIGINT AS frame_count FROM vf")
def _(v: Views):
    path = F.concat(F.lit("f"), "id_videofile").alias("path")
    lines = v.videofiles.select(path, F.concat(F.lit(" "), F.col("frame_count").cast("string")).alias("value")).unionByName(v.videofiles.select(path, F.lit("N/A").alias("value")))
    return logs.packet_counts(lines)


@query("detector_throughput", "SELECT l_returnflag AS model, CAST(sum(l_linenumber) AS BIGINT) AS frames, round(sum(l_linenumber) / sum(l_partkey)::DOUBLE, 9) AS fps, round(sum(l_partkey) * 1000 / sum(l_linenumber)::DOUBLE, 6) AS ms_per_frame FROM lineitem GROUP BY 1")
def _(v: Views):
    runs = v.table("lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("long").alias("frames"), F.col("l_partkey").alias("seconds"))
    return boxes.throughput(runs).withColumn("fps", F.round("fps", 9)).withColumn("ms_per_frame", F.round("ms_per_frame", 6))


@query("predicates", r"""
SELECT doc_id, lang IS NOT DISTINCT FROM 'en' AS is_english, coalesce(source LIKE '%1%', false) AS has_one, coalesce(regexp_matches(source, '^[a-z]+[-_ ]?[0-9]*$'), false) AS plain_source, coalesce(NOT source LIKE 's%', false) AS other,
       sha256(coalesce(text, '')) SIMILAR TO '[0-9a-f]{64}' AS hex FROM documents""")
def _(v: Views):
    no = F.lit(False)
    return v.table("documents").select(
        "doc_id", F.col("lang").eqNullSafe("en").alias("is_english"), F.coalesce(F.col("source").like("%1%"), no).alias("has_one"), F.coalesce(F.col("source").rlike("^[a-z]+[-_ ]?[0-9]*$"), no).alias("plain_source"),
        F.coalesce(~F.col("source").like("s%"), no).alias("other"), F.sha2(F.coalesce("text", F.lit("")), 256).rlike("^[0-9a-f]{64}$").alias("hex"),
    )


@query("listed_words", "SELECT page_id, array_to_string(list_filter([trim(x) FOR x IN string_split(url, '/')], lambda x: x <> ''), '|') AS parts FROM (SELECT page_id, url FROM pages WHERE len(list_distinct(string_split(url, '/'))) >= len(string_split(url, '/')))")
def _(v: Views):
    pages = v.table("pages").where("size(array_distinct(split(url, '/'))) >= size(split(url, '/'))")
    return pages.select("page_id", F.array_join(text.listed(F.replace("url", F.lit("/"), F.lit(","))), "|").alias("parts"))
