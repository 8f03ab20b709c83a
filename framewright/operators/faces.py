"""Faces and persons: classification, naming of clusters, service persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import aspect, in_frame
from ..functions.text import cluster_key

SERVICE_KINDS = ("UNRECOGNIZED", "NONPERSON")
MAX_ASPECT = 4.0


def _aspect():
    return aspect(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))


def classify(faces: DataFrame, unrecognized: int, nonperson: int, max_aspect: float = MAX_ASPECT) -> DataFrame:
    """New faces with person_id: the NONPERSON row for boxes drawn out further than max_aspect or empty, else UNRECOGNIZED."""
    return faces.withColumn("person_id", F.when(_aspect() <= max_aspect, F.lit(unrecognized)).otherwise(F.lit(nonperson)).cast("long"))


def reclassify(faces: DataFrame, nonperson: int, max_aspect: float = MAX_ASPECT) -> DataFrame:
    """Stored faces with drawn-out boxes moved to the NONPERSON row; changed tells which moved."""
    moves = (F.coalesce(_aspect() > max_aspect, F.lit(False))) & (F.col("person_id") != nonperson)
    return faces.withColumn("changed", moves).withColumn("person_id", F.when(F.col("changed"), F.lit(nonperson).cast("long")).otherwise(F.col("person_id")))


def outside_frame(faces: DataFrame, videofiles: DataFrame) -> DataFrame:
    """Faces whose box isn't inside their videofile's frame."""
    met = faces.join(videofiles.select("id_videofile", "width", "height"), "id_videofile")
    return met.where(~in_frame(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")])).select(*faces.columns)


def service_persons(projects: DataFrame, persons: DataFrame) -> DataFrame:
    """Service persons that projects lack: one row for each of the two kinds."""
    wanted = projects.select("id_project", F.explode(F.array(*[F.lit(k) for k in SERVICE_KINDS])).alias("kind"))
    return wanted.join(persons.select("id_project", "kind"), ["id_project", "kind"], "left_anti").select("id_project", "kind", F.col("kind").alias("name"))


def delete_person(faces: DataFrame, deleted: DataFrame, unrecognized: DataFrame) -> DataFrame:
    """faces after persons were deleted (person_id, id_project): theirs go to the project's UNRECOGNIZED person."""
    to = deleted.join(unrecognized.select("id_project", F.col("person_id").alias("_to")), "id_project").select("person_id", "_to")
    met = faces.join(to, "person_id", "left")
    return met.select(*[F.coalesce("_to", "person_id").alias(c) if c == "person_id" else F.col(c) for c in faces.columns])


def by_person(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """person_id, name, faces, first_face of every person seen; unknown persons get the service name. Largest first."""
    n = faces.groupBy("person_id").agg(F.count("*").alias("faces"), F.min("face_id").alias("first_face"))
    out = n.join(persons.select("person_id", "name"), "person_id", "left").select("person_id", F.coalesce("name", F.lit("UNRECOGNIZED")).alias("name"), "faces", "first_face")
    return out.orderBy(F.desc("faces"), "person_id")


def with_person(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """faces with person_name and person_kind; the service name and kind where the person is missing."""
    met = faces.join(persons.select("person_id", F.col("name").alias("_n"), F.col("kind").alias("_k")), "person_id", "left")
    return met.select(*faces.columns, F.coalesce("_n", F.lit("UNRECOGNIZED")).alias("person_name"), F.coalesce("_k", F.lit("UNRECOGNIZED")).alias("person_kind"))


def name_clusters(requests: DataFrame, clusters: DataFrame, first_person: int) -> DataFrame:
    """person_id, name, recognizer_key, size of requests (cluster_id, name, recognizer_key): the persons they make.

    clusters: cluster_id, size. The key is the cluster's unless the request has a non-blank one. Requests for clusters
    that don't exist have a null size. Faces follow by joining ``members`` on cluster_id.
    """
    met = requests.join(clusters.select("cluster_id", "size"), "cluster_id", "left")
    key = F.when(F.trim("recognizer_key") != "", F.col("recognizer_key")).otherwise(F.col("cluster_id"))
    number = F.row_number().over(Window.orderBy("cluster_id")) - 1 + first_person
    return met.select(number.cast("long").alias("person_id"), "cluster_id", "name", key.alias("recognizer_key"), "size")


def unnamed_clusters(clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """Clusters whose key no person has."""
    return clusters.join(persons.where("recognizer_key IS NOT NULL").select(F.col("recognizer_key").alias("cluster_id")), "cluster_id", "left_anti")


def named_faces(clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """One row: unnamed clusters, and faces in named ones."""
    keys = persons.where("recognizer_key IS NOT NULL").select(F.col("recognizer_key").alias("cluster_id")).distinct().withColumn("_named", F.lit(True))
    met = clusters.join(keys, "cluster_id", "left")
    return met.agg(F.count_if(F.col("_named").isNull()).alias("clusters_total"), F.coalesce(F.sum(F.when(F.col("_named"), F.col("size"))), F.lit(0)).cast("long").alias("faces_named"))


def keys_of(groups: DataFrame) -> DataFrame:
    """cluster_id, size of groups (group, face_id): a cluster's key comes from its least face."""
    return _keyed(groups).select("cluster_id", "size")


def _keyed(groups: DataFrame) -> DataFrame:
    out = groups.groupBy("group").agg(F.min("face_id").alias("_least"), F.count("*").alias("size"))
    return out.select("group", cluster_key(F.col("_least")).alias("cluster_id"), "size")


def members(groups: DataFrame) -> DataFrame:
    """cluster_id, size, face_id: a row a face, so a cluster of any size is spread. Few groups are broadcast by Spark at run time."""
    return groups.join(_keyed(groups), "group").select("cluster_id", "size", "face_id")


def scan_summary(frames: DataFrame) -> DataFrame:
    """One row: frames, frames_with_faces, faces."""
    return frames.agg(F.count("*").alias("frames"), F.count_if(F.col("face_count") > 0).alias("frames_with_faces"), F.coalesce(F.sum("face_count"), F.lit(0)).cast("long").alias("faces"))


def pair_by_index(detections: DataFrame, faces: DataFrame) -> DataFrame:
    """Stored faces with the vectors detected for them: arrays of a frame are unrolled and met by place.

    detections: id_videofile, frame_number, vectors array<array<float>>. Zero vectors are left out.
    """
    each = detections.select("id_videofile", "frame_number", F.posexplode("vectors").alias("face_index", "vector"))
    good = each.where(~F.forall("vector", lambda x: x == 0))
    return faces.join(good, ["id_videofile", "frame_number", "face_index"])
