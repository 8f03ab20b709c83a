"""Assembly recipes: compatibility, totals, items, refusals, canonical documents, freshness and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timebase
from ..functions.text import canonical_list, canonical_object, canonical_text, relative_path, safe_relative_path, utc_second
from . import keyframes
from .intervals import persons_in

# Attribute names in the order in which they are compared, and refusals in the order in which they are checked.
ATTRIBUTES = ("width", "height", "videoCodec", "videoProfile", "pixelFormat", "frameRateBase", "audioCodec", "audioChannels", "audioSampleRate")
REFUSALS = ("EMPTY_SELECTION", "NOT_FOUND", "STALE_RESULT", "SEVERAL_PROJECTS", "EPISODE_NOT_ANALYZED", "INCOMPATIBLE_EPISODE", "CHECKSUM_NOT_READY", "SOURCE_UNREADABLE", "BAD_PATH")
SCHEMA_VERSION = 2
ROOT_LAYOUT = "MOVIE_TREE"

_COLUMNS = {
    "width": ("width",),
    "height": ("height",),
    "videoCodec": ("video_codec",),
    "videoProfile": ("video_profile",),
    "pixelFormat": ("pixel_format",),
    "frameRateBase": ("time_base_num", "time_base_den"),
    "audioCodec": ("audio_codec",),
    "audioChannels": ("audio_channels",),
    "audioSampleRate": ("audio_sample_rate",),
}


def compatibility(files: DataFrame, group: str = "recipe_id", order: str = "ordinal") -> DataFrame:
    """group, order, id_videofile, differing: how each file differs from its group's first, by attribute name.

    A null profile equals an empty one; other nulls equal nulls only. The first file itself differs in nothing.
    """
    return _compared(files, group, order).select(group, order, "id_videofile", "differing")


def _compared(files: DataFrame, group: str, order: str) -> DataFrame:
    """files with differing. Rows without a videofile are never the first."""
    needed = [c for cs in _COLUMNS.values() for c in cs]
    value = lambda c: F.coalesce(F.col(c), F.lit("")) if c == "video_profile" else F.col(c)
    # the first of each group is one small row; its attributes come back by the window's own partitioning
    w = Window.partitionBy(group).orderBy(F.col("id_videofile").isNull(), order, "id_videofile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = files.withColumn("_first", F.first(F.struct(*[value(c).alias(c) for c in needed])).over(w))
    differs = lambda cs: ~F.expr("true") if not cs else _any([~value(c).eqNullSafe(F.col(f"_first.{c}")) for c in cs])
    found = F.array_compact(F.array(*[F.when(differs(_COLUMNS[a]), F.lit(a)) for a in ATTRIBUTES]))
    return met.withColumn("differing", found).drop("_first")


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def differing_attributes(report: DataFrame, group: str = "recipe_id") -> DataFrame:
    """group, compatible, differing: all attributes in which any file of the group differs, by alphabet."""
    return report.groupBy(group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("differing")))).alias("differing")).select(group, (F.size("differing") == 0).alias("compatible"), "differing")


def totals(items: DataFrame, group: str = "recipe_id") -> DataFrame:
    """group, items, frames, duration_ms: frames are cut_last - cut_first; a frame lasts whole nanoseconds."""
    return items.groupBy(group).agg(*_totals())


def _totals():
    frames = (F.col("cut_last") - F.col("cut_first")).cast("long")
    nanos = F.sum(frames * timebase.frame_nanos(F.col("time_base_num"), F.col("time_base_den")))
    return F.count("*").alias("items"), F.sum(frames).alias("frames"), timebase.millis_of_nanos(nanos).alias("duration_ms")


def refusals(selection: DataFrame, scenes: DataFrame, videofiles: DataFrame, checksums: DataFrame, projects: DataFrame, recipes: DataFrame | None = None) -> DataFrame:
    """recipe_id, error_code: the first reason, in the order of REFUSALS, for which a recipe can't be issued; null if none.

    selection: recipe_id, ordinal, scene_id. ``recipes`` lists recipes that may have no selection at all.
    """
    live = scenes.where("NOT is_stale").select("id_videofile").distinct().withColumn("_analyzed", F.lit(True))
    ready = checksums.where("state = 'DONE' AND NOT is_stale AND digest IS NOT NULL").select("id_videofile").distinct().withColumn("_digest", F.lit(True))
    own = scenes.select("scene_id", "id_videofile", "is_stale")
    # selection and scenes meet by a shuffle; what is joined next is a row a videofile or a project
    met = selection.join(own, "scene_id", "left").join(live, "id_videofile", "left").join(ready, "id_videofile", "left").join(videofiles, "id_videofile", "left").join(projects.select("id_project", "source_root"), "id_project", "left")
    path = relative_path(F.col("source_path"), F.col("source_root"))
    # comparison and checks share one shuffle on the recipe
    both = _compared(met.withColumn("_path", path), "recipe_id", "ordinal").groupBy("recipe_id").agg(
        F.count_if(F.col("id_videofile").isNull()).alias("NOT_FOUND"),
        F.count_if("is_stale").alias("STALE_RESULT"),
        (F.count_distinct("id_project") - 1).alias("SEVERAL_PROJECTS"),
        F.count_if(F.col("id_videofile").isNotNull() & F.col("_analyzed").isNull()).alias("EPISODE_NOT_ANALYZED"),
        F.count_if(F.col("id_videofile").isNotNull() & F.col("_digest").isNull()).alias("CHECKSUM_NOT_READY"),
        F.count_if(F.col("id_videofile").isNotNull() & (F.col("_path").isNull() | F.col("keyframe_count").isNull())).alias("SOURCE_UNREADABLE"),
        F.count_if(~safe_relative_path(F.col("_path"))).alias("BAD_PATH"),
        F.count_if(F.col("id_videofile").isNotNull() & (F.size("differing") > 0)).alias("INCOMPATIBLE_EPISODE"),
    ).withColumn("EMPTY_SELECTION", F.lit(0))
    if recipes is not None:
        both = recipes.select("recipe_id").join(both, "recipe_id", "left").withColumn("EMPTY_SELECTION", F.col("NOT_FOUND").isNull().cast("int"))
    code = F.coalesce(*[F.when(F.col(c) > 0, F.lit(c)) for c in REFUSALS])
    return both.select("recipe_id", code.alias("error_code"))


def items(selection: DataFrame, scenes: DataFrame, videofiles: DataFrame, keys: DataFrame, checksums: DataFrame, projects: DataFrame, locations: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """recipe_id, ordinal and what an item carries: names as they are now, the source's digest, cut boundaries.

    Scenes selected several times are repeated; scenes that aren't found or are stale give no item.
    """
    asked = selection.select("scene_id").distinct()
    # each scene is worked out once, however often it is selected
    own = scenes.where("NOT is_stale").join(asked, "scene_id", "left_semi")
    cuts = keyframes.cut(own, keys)
    named = persons_in(own, faces, persons)
    digest = checksums.where("state = 'DONE' AND NOT is_stale").groupBy("id_videofile").agg(F.max_by("digest", "checksum_id").alias("source_sha256"))
    files = videofiles.join(projects.select("id_project", "source_root"), "id_project").select("id_videofile", F.col("name").alias("videofile_name"), relative_path(F.col("source_path"), F.col("source_root")).alias("relative_path"), "time_base_num", "time_base_den")
    whole = cuts.join(named, "scene_id").join(files, "id_videofile").join(digest, "id_videofile", "left").join(locations.select("location_id", F.col("name").alias("location_name")), "location_id", "left")
    out = selection.join(whole, "scene_id")
    return out.select("recipe_id", "ordinal", "scene_id", "title", "location_name", "person_names", "id_videofile", "videofile_name", "relative_path", "source_sha256", "first_frame", "last_frame", "cut_first", "cut_last", "time_base_num", "time_base_den")


def in_order(selection: DataFrame) -> DataFrame:
    """selection with ordinals 1, 2, ... in the order of ``position``."""
    return selection.withColumn("ordinal", F.row_number().over(Window.partitionBy("recipe_id").orderBy("position", "scene_id")))


def broken_order(items_: DataFrame) -> DataFrame:
    """Items whose ordinal isn't their place, counted from 1."""
    place = F.row_number().over(Window.partitionBy("recipe_id").orderBy("ordinal"))
    return items_.withColumn("expected", place).where("ordinal <> expected").select("recipe_id", "ordinal", "expected")


def item_document(i=None):
    """The canonical text of an item, from its columns. The location's key is tbl_locations: part of the signed form."""
    n = F.col
    number = lambda c: n(c).cast("string")
    persons = F.when(F.size("person_names") > 0, canonical_list(F.transform("person_names", canonical_text)))
    return canonical_object(
        ("ordinal", number("ordinal")),
        ("sceneId", number("scene_id")),
        ("sceneTitle", canonical_text(n("title"))),
        ("tbl_locations", canonical_text(n("location_name"))),
        ("persons", persons),
        ("videofileId", number("id_videofile")),
        ("videofileName", canonical_text(n("videofile_name"))),
        ("relativePath", canonical_text(n("relative_path"))),
        ("sourceSha256", canonical_text(n("source_sha256"))),
        ("firstFrame", number("first_frame")),
        ("lastFrame", number("last_frame")),
        ("cutFirstFrame", number("cut_first")),
        ("cutLastFrame", number("cut_last")),
    )


def documents(items_: DataFrame, recipes: DataFrame) -> DataFrame:
    """recipe_id, document, content_sha256: the canonical bytes that are signed, and their digest.

    recipes: recipe_id, project_id, project_name, recipe_name, signing_key_id, created_at, audio_track_count. A recipe's
    items meet in one row, as they do in its file. Recipes without items give no document.
    """
    each = F.collect_list(F.struct("ordinal", item_document().alias("_doc")))
    listed = items_.groupBy("recipe_id").agg(canonical_list(F.transform(F.array_sort(each), lambda x: x["_doc"])).alias("_items"), *_totals())
    met = listed.join(recipes, "recipe_id")
    number = lambda c: F.col(c).cast("string")
    document = canonical_object(
        ("schemaVersion", F.lit(str(SCHEMA_VERSION))),
        ("projectId", number("project_id")),
        ("projectName", canonical_text(F.col("project_name"))),
        ("recipeId", number("recipe_id")),
        ("recipeName", canonical_text(F.col("recipe_name"))),
        ("signingKeyId", canonical_text(F.col("signing_key_id"))),
        ("createdAt", canonical_text(utc_second(F.col("created_at")))),
        ("rootLayout", canonical_text(F.lit(ROOT_LAYOUT))),
        ("audioTrackCount", number("audio_track_count")),
        ("expectedDurationMs", number("duration_ms")),
        ("expectedFrameCount", number("frames")),
        ("items", F.col("_items")),
    )
    return met.select("recipe_id", document.alias("document"), F.sha2(document, 256).alias("content_sha256"))


def fresh(recipes: DataFrame, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """recipes with is_fresh: of this schema version and not marked stale."""
    return recipes.withColumn("is_fresh", (F.col("schema_version") == schema_version) & ~F.col("is_stale"))


def verify(items_: DataFrame, files: DataFrame) -> DataFrame:
    """items with verdict: MISSING, CHANGED or OK, by the digests of files (relative_path, digest) found at the user's."""
    met = items_.join(files.select("relative_path", F.col("digest").alias("_found")), "relative_path", "left")
    verdict = F.when(F.col("_found").isNull(), "MISSING").when(F.col("_found") == F.col("source_sha256"), "OK").otherwise("CHANGED")
    return met.select(*items_.columns, verdict.alias("verdict"))


def seals(recipes: DataFrame, documents_: DataFrame, keys: DataFrame) -> DataFrame:
    """recipe_id, seal of recipes (recipe_id, content_sha256, signature, signing_key_id), told before their items are looked at.

    UNSIGNED: a part of the signature is missing; UNKNOWN_KEY: keys (signing_key_id) doesn't have its key; ALTERED: the
    document (recipe_id, content_sha256 as computed from what it holds now) is none or another one; else SEALED. Whether
    the signature belongs to digest and key is for whoever holds the key's material.
    """
    known = keys.select("signing_key_id", F.lit(True).alias("_known")).distinct()
    met = recipes.join(documents_.select("recipe_id", F.col("content_sha256").alias("_now")), "recipe_id", "left").join(known, "signing_key_id", "left")
    missing = F.col("signature").isNull() | F.col("signing_key_id").isNull() | F.col("content_sha256").isNull()
    seal = F.when(missing, "UNSIGNED").when(F.col("_known").isNull(), "UNKNOWN_KEY").when(F.col("_now").eqNullSafe(F.col("content_sha256")), "SEALED").otherwise("ALTERED")
    return met.select("recipe_id", seal.alias("seal"))


def verify_sealed(items_: DataFrame, files: DataFrame, seals_: DataFrame) -> DataFrame:
    """items with seal and verdict; of recipes that aren't SEALED no file is compared, so the verdict is null."""
    met = verify(items_, files).join(seals_, "recipe_id", "left")
    return met.withColumn("verdict", F.when(F.col("seal") == "SEALED", F.col("verdict")))


def cached_digests(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (relative_path, size, mtime) with the cached digest of the same path, size and time; null: to be read anew."""
    return files.join(cache, ["relative_path", "size", "mtime"], "left")
