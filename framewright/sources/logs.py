"""Text that tools print, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tolerant_timestamp
from ..functions.timebase import frame_of_nanos, nanos_of_seconds

# The forms of the lines.
SCORE = r"lavfi\.scd\.score: *([0-9.]+(?:[eE][-+]?[0-9]+)?), *lavfi\.scd\.time: *([0-9.]+)"
PROGRESS = r"frame=\s*(\d+)\s*/\s*(\d+)(?:[^\n]*?speed=\s*([\d.]+x))?"
CHECKSUM = r"^([0-9a-f]{64}) [ *](.+)$"


def scores(lines: DataFrame, videofiles: DataFrame) -> DataFrame:
    """id_videofile, frame_number, score from lines (id_videofile, value) of a scene-change log.

    Times become frames by the file's time base, halves up. Other lines, and frames outside the file, are left out; of
    several scores of a frame the largest counts.
    """
    found = lines.select("id_videofile", F.regexp_extract("value", SCORE, 1).try_cast("double").alias("score"), nanos_of_seconds(F.regexp_extract("value", SCORE, 2)).alias("_ns"))
    met = found.where("score IS NOT NULL AND _ns IS NOT NULL").join(videofiles.select("id_videofile", "frame_count", "time_base_num", "time_base_den"), "id_videofile")
    frame = frame_of_nanos(F.col("_ns"), F.col("time_base_num"), F.col("time_base_den")).cast("int")
    out = met.select("id_videofile", frame.alias("frame_number"), "score", "frame_count").where("frame_number >= 0 AND frame_number < frame_count")
    return out.groupBy("id_videofile", "frame_number").agg(F.max("score").alias("score"))


def progress(lines: DataFrame) -> DataFrame:
    """lines with done, total, note of the progress they tell; lines that tell none are left out."""
    part = lambda i: F.regexp_extract("value", PROGRESS, i)
    out = lines.withColumn("done", part(1).try_cast("long")).withColumn("total", part(2).try_cast("long"))
    speed = part(3)
    return out.withColumn("note", F.when(speed != "", F.concat(F.lit("speed "), speed)).otherwise(F.lit(""))).where("done IS NOT NULL AND total IS NOT NULL")


def sections(lines: DataFrame, by: str = "path", at: str = "line") -> DataFrame:
    """by, section, section_name, fields: key = value lines by the innermost [NAME] ... [/NAME] section they stand in.

    Sections may nest; lines after a nested one belong to the outer again. Lines outside of all sections are left out.
    A key given twice in a section keeps its last value. Sections are numbered by their openings.
    """
    text = F.trim("value")
    opens = text.rlike(r"^\[[^/].*\]$")
    closes = text.startswith("[/")
    w = Window.partitionBy(by).orderBy(at)
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    number = F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.select(by, at, text.alias("_text"), opens.alias("_opens"), depth.alias("_depth"), number.alias("_number"))
    # a line's section is the last to open at the line's own depth
    own = Window.partitionBy(by, "_depth").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    opening = F.when(F.col("_opens"), F.struct("_number", F.regexp_extract("_text", r"^\[(.*)\]$", 1).alias("_name")))
    met = marked.withColumn("_section", F.last(opening, ignorenulls=True).over(own))
    pairs = met.where(~F.col("_opens") & F.col("_text").contains("=") & (F.col("_depth") > 0))
    key = F.trim(F.substring_index("_text", "=", 1))
    value = F.trim(F.expr("substring(_text, instr(_text, '=') + 1)"))
    one = pairs.groupBy(by, "_section", key.alias("_key")).agg(F.max_by(value, at).alias("_value"))
    return one.groupBy(by, "_section").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("fields")).select(by, F.col("_section._number").alias("section"), F.col("_section._name").alias("section_name"), "fields")


def streams(parsed: DataFrame) -> DataFrame:
    """path, track_index, codec_type, codec_name, fields of the STREAM sections."""
    f = F.col("fields")
    return parsed.where("section_name = 'STREAM'").select("path", f["index"].try_cast("int").alias("track_index"), f["codec_type"].alias("codec_type"), f["codec_name"].alias("codec_name"), "fields")


def keyframes(lines: DataFrame, videofiles: DataFrame) -> DataFrame:
    """id_videofile, frame_number from lines (id_videofile, value) whose first comma-separated part is a time in seconds."""
    ns = nanos_of_seconds(F.trim(F.substring_index("value", ",", 1)))
    met = lines.select("id_videofile", ns.alias("_ns")).where("_ns IS NOT NULL").join(videofiles.select("id_videofile", "frame_count", "time_base_num", "time_base_den"), "id_videofile")
    out = met.select("id_videofile", frame_of_nanos(F.col("_ns"), F.col("time_base_num"), F.col("time_base_den")).cast("int").alias("frame_number"), "frame_count")
    return out.where("frame_number BETWEEN 0 AND frame_count - 1").select("id_videofile", "frame_number").distinct()


def packet_counts(lines: DataFrame) -> DataFrame:
    """path, frame_count from lines that hold a whole number; files without a positive one are an error when read."""
    n = F.max(F.trim("value").try_cast("long"))
    counted = lines.groupBy("path").agg(n.alias("_n"))
    return counted.select("path", F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.raise_error(F.concat(F.lit("no frames in "), F.col("path")))).alias("frame_count"))


def legacy_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Semicolon-separated UTF-8 files with a header line, with or without a byte order mark."""
    return spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).schema(schema).csv(path)


def checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """digest, relative_path from lines "<sha256>  <path>"; other lines are left out."""
    part = lambda i: F.regexp_extract("value", CHECKSUM, i)
    return spark.read.text(path).where(F.col("value").rlike(CHECKSUM)).select(part(1).alias("digest"), part(2).alias("relative_path"))


def timestamps(lines: DataFrame, column: str) -> DataFrame:
    """lines with a text column read as a timestamp; blank or broken: null."""
    return lines.withColumn(column, tolerant_timestamp(F.col(column)))
