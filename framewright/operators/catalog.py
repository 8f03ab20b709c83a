"""The catalogue: registration, tracks, properties, counts, model versions, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import relative_path, stem
from .ordinals import numbered


def register(new: DataFrame, projects: DataFrame, videofiles: DataFrame) -> DataFrame:
    """new (id_project, source_path) with name, relative_path, ordinal and error_code.

    Names come from the path's last part without its ending; ordinals go on from the project's largest, in order of
    paths. OUTSIDE_ROOT, ALREADY_THERE and NO_PROJECT are refused and take no ordinal.
    """
    last = videofiles.groupBy("id_project").agg((F.max("ordinal") + 1).alias("_next"))
    known = videofiles.select("source_path", F.lit(True).alias("_known")).distinct()
    met = new.join(projects.select("id_project", "source_root"), "id_project", "left").join(last, "id_project", "left").join(known, "source_path", "left")
    met = met.withColumn("relative_path", relative_path(F.col("source_path"), F.col("source_root")))
    code = F.when(F.col("source_root").isNull(), "NO_PROJECT").when(F.col("relative_path").isNull(), "OUTSIDE_ROOT").when(F.col("_known"), "ALREADY_THERE")
    met = met.withColumn("error_code", code)
    place = F.row_number().over(Window.partitionBy("id_project", F.col("error_code").isNull()).orderBy("source_path")) - 1
    ordinal = F.when(F.col("error_code").isNull(), F.coalesce("_next", F.lit(0)) + place).cast("int")
    return met.select("id_project", "source_path", stem(F.element_at(F.split("source_path", "/"), -1)).alias("name"), "relative_path", ordinal.alias("ordinal"), "error_code")


def next_ordinals(projects: DataFrame, videofiles: DataFrame) -> DataFrame:
    """id_project, next_ordinal: one more than the largest, 0 without any."""
    top = videofiles.groupBy("id_project").agg(F.max("ordinal").alias("_top"))
    return projects.select("id_project").join(top, "id_project", "left").select("id_project", (F.coalesce("_top", F.lit(-1)) + 1).cast("int").alias("next_ordinal"))


def counts(projects: DataFrame, videofiles: DataFrame) -> DataFrame:
    """id_project, name, videofiles, frames; 0 for projects without any."""
    n = videofiles.groupBy("id_project").agg(F.count("*").alias("_n"), F.sum("frame_count").cast("long").alias("_f"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return projects.select("id_project", "name").join(n, "id_project", "left").select("id_project", "name", zero("_n").alias("videofiles"), zero("_f").alias("frames"))


def track_ordinals(tracks: DataFrame) -> DataFrame:
    """tracks with their place among the tracks of one type of a videofile, from 0."""
    return tracks.withColumn("ordinal", F.row_number().over(Window.partitionBy("id_videofile", "codec_type").orderBy("track_index")) - 1)


def owned(properties: DataFrame, owners: dict[str, DataFrame]) -> DataFrame:
    """Properties whose owner exists. owners: kind to a table with the column id."""
    every = None
    for kind, df in owners.items():
        part = df.select(F.lit(kind).alias("owner_kind"), F.col("id").cast("long").alias("owner_id"))
        every = part if every is None else every.unionByName(part)
    return properties.join(every.distinct(), ["owner_kind", "owner_id"], "left_semi")


def as_maps(properties: DataFrame) -> DataFrame:
    """owner_kind, owner_id, properties: map of each owner's properties in their order."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "property_key", "property_value"))), lambda x: F.struct(x["property_key"], x["property_value"]))
    return properties.groupBy("owner_kind", "owner_id").agg(F.map_from_entries(entries).alias("properties"))


def active_versions(versions: DataFrame) -> DataFrame:
    """The active model version of each project; of several the latest."""
    return versions.where("is_active AND state = 'DONE'").groupBy("id_project").agg(F.max("model_version_id").alias("model_version_id"))


def activate(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """versions with the chosen one (id_project, model_version_id) active and the project's others not."""
    met = versions.join(chosen.select("id_project", F.col("model_version_id").alias("_chosen")), "id_project", "left")
    flag = F.when(F.col("_chosen").isNull(), F.col("is_active")).otherwise(F.col("model_version_id") == F.col("_chosen"))
    return met.select(*[flag.alias(c) if c == "is_active" else F.col(c) for c in versions.columns])


def sheets(videofiles: DataFrame, columns: int = 16, rows: int = 16) -> DataFrame:
    """id_videofile, sheet, first_frame, last_frame, object_key of all preview sheets."""
    each = columns * rows
    out = videofiles.select("id_videofile", "frame_count", F.explode(F.sequence(F.lit(0), geometry.sheet_count(F.col("frame_count"), columns, rows) - 1)).alias("sheet"))
    first = F.col("sheet") * each
    return out.select("id_videofile", "sheet", first.alias("first_frame"), (F.least(first + each, F.col("frame_count")) - 1).alias("last_frame"), geometry.sheet_key(F.col("id_videofile"), F.col("sheet")).alias("object_key"))


def pending_sheets(videofiles: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Sheets without a READY artifact."""
    ready = artifacts.where("kind = 'PREVIEW_SHEET' AND state = 'READY'").select("object_key")
    return sheets(videofiles).join(ready, "object_key", "left_anti").select("id_videofile", "sheet", "first_frame", "last_frame", "object_key")


def find_artifacts(keys: DataFrame, artifacts: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    """keys (object_key) with the READY artifact of that key, or of the key under the old prefix."""
    ready = artifacts.where("state = 'READY'").select("object_key", "artifact_id")
    old = F.when(F.col("object_key").startswith(new_prefix), F.concat(F.lit(old_prefix), F.col("object_key").substr(F.lit(len(new_prefix) + 1), F.char_length("object_key"))))
    met = keys.withColumn("_old", old).join(ready, "object_key", "left").join(ready.select(F.col("object_key").alias("_old"), F.col("artifact_id").alias("_old_id")), "_old", "left")
    return met.select("object_key", F.coalesce("artifact_id", "_old_id").alias("artifact_id"))


def indicators(videofiles: DataFrame, sheets_ready: DataFrame | None, scenes: DataFrame | None, faces: DataFrame | None, persons: DataFrame | None, absent: tuple[str, ...] = ()) -> DataFrame:
    """id_videofile and yes or no for PW (previews complete), AF (frames), CS (scenes), DF (faces), RF (named faces).

    Where a table is None its answers are unknown; ``absent`` names indicators that no subsystem stands behind.
    """
    n = lambda df, name: df.groupBy("id_videofile").agg(F.count("*").alias(name))
    met = videofiles.select("id_videofile", "frame_count", geometry.sheet_count(F.col("frame_count")).alias("_want"))
    known = {"AF": F.col("frame_count") > 0}
    if sheets_ready is not None:
        met, known["PW"] = met.join(n(sheets_ready, "_pw"), "id_videofile", "left"), F.col("_pw") >= F.col("_want")
    if scenes is not None:
        met, known["CS"] = met.join(n(scenes.where("NOT is_stale"), "_cs"), "id_videofile", "left"), F.col("_cs") > 0
    if faces is not None:
        met, known["DF"] = met.join(n(faces, "_df"), "id_videofile", "left"), F.col("_df") > 0
    if faces is not None and persons is not None:
        real = persons.where("kind = 'PERSON'").select("person_id")
        met, known["RF"] = met.join(n(faces.join(real, "person_id", "left_semi"), "_rf"), "id_videofile", "left"), F.col("_rf") > 0
    state = lambda c: F.when(F.coalesce(known[c], F.lit(False)), "yes").otherwise("no") if c in known else F.lit("unknown")
    return met.select("id_videofile", *[state(c).alias(c) for c in ("PW", "AF", "CS", "DF", "RF")], *[F.lit("absent").alias(c) for c in absent])


def in_order(df: DataFrame, order: list, within: list[str] | None = None) -> DataFrame:
    """df with place: the rank of each row in a list, of the whole table or within rows that share columns.

    A list of the whole table is numbered by ranges (see ordinals), so its order is of columns, ascending.
    """
    if not within:
        return numbered(df, order, "place").withColumn("place", F.col("place").cast("int"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def events_from_shots(selection: DataFrame, shots: DataFrame) -> DataFrame:
    """event_id, first_frame, last_frame, contiguous of selections (event_id, shot_id): an event needs neighbouring shots."""
    met = selection.join(shots.select("shot_id", "id_videofile", "first_frame", "last_frame"), "shot_id")
    w = Window.partitionBy("event_id").orderBy("first_frame")
    step = met.withColumn("_gap", F.coalesce((F.lag("last_frame").over(w) + 1 != F.col("first_frame")) | (F.lag("id_videofile").over(w) != F.col("id_videofile")), F.lit(False)))
    return step.groupBy("event_id").agg(F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), (~F.bool_or("_gap")).alias("contiguous"))
