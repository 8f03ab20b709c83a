"""Data quality: checks of rows, keys, references and covers, as tables of violations (relation, rule, row_key).

A check is violated where it is false; null passes, as in SQL. Unique keys with a null part never clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    name: str
    predicate: str


@dataclass(frozen=True)
class Unique:
    name: str
    columns: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Reference:
    name: str
    column: str
    target: str
    target_column: str


def _known(column: str, *values: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _filled(column: str) -> str:
    return f"trim({column}) <> ''"


_RUN = ("CREATING", "WORKING", "DONE", "ERROR")
_HEX = "^[0-9a-f]{64}$"

# The rules of each relation.
RULES: dict[str, tuple[Check | Unique | Reference, ...]] = {
    "projects": (
        Check("name_not_blank", _filled("name")),
        Check("source_root_not_blank", _filled("source_root")),
        Check("source_root_absolute", "source_root LIKE '/%'"),
        Check("source_root_no_trailing_slash", "NOT source_root LIKE '%/'"),
        Unique("name_unique", ("name",)),
    ),
    "locations": (Check("name_not_blank", _filled("name")), Unique("name_unique_in_project", ("id_project", "name")), Reference("project", "id_project", "projects", "id_project")),
    "videofiles": (
        Check("ordinal_positive", "ordinal >= 0"),
        Check("source_path_absolute", "source_path LIKE '/%'"),
        Check("name_not_blank", _filled("name")),
        Check("frame_count_positive", "frame_count > 0"),
        Check("time_base_num_positive", "time_base_num > 0"),
        Check("time_base_den_positive", "time_base_den > 0"),
        Check("width_positive", "width > 0"),
        Check("height_positive", "height > 0"),
        Check("duration_num_positive", "duration_num > 0"),
        Check("duration_den_positive", "duration_den > 0"),
        Check("pixel_format_not_blank", _filled("pixel_format")),
        Check("video_codec_not_blank", _filled("video_codec")),
        Check("audio_channels_nonnegative", "audio_channels >= 0"),
        Check("audio_rate_nonnegative", "audio_sample_rate >= 0"),
        Check("sheet_count_nonnegative", "preview_sheet_count >= 0"),
        Check("keyframe_bitmap_length", "octet_length(keyframe_bitmap) = (frame_count + 7) div 8"),
        Check("season_positive", "season_number > 0"),
        Check("episode_ordinal_nonnegative", "episode_ordinal >= 0"),
        Unique("ordinal_unique", ("id_project", "ordinal")),
        Unique("source_path_unique", ("source_path",)),
        Reference("project", "id_project", "projects", "id_project"),
    ),
    "tracks": (Unique("track_unique", ("id_videofile", "track_index")), Check("ordinal_nonnegative", "ordinal >= 0")),
    "runs": (
        Check("kind_known", _known("kind", "STRUCTURE", "FACES")),
        Check("state_known", _known("state", *_RUN)),
        Check("version_not_blank", _filled("algorithm_version")),
        Check("params_not_blank", _filled("params_hash")),
        Check("error_only_on_error", "state = 'ERROR' OR error_text IS NULL"),
        Check("time_order", "finished_at >= started_at"),
    ),
    "raw_boundaries": (Check("level_known", _known("level", "SCENE", "SHOT")), Check("range", "first_frame >= 0 AND last_frame >= first_frame")),
    "frames": (Check("number_nonnegative", "frame_number >= 0"), Check("face_count_nonnegative", "face_count >= 0"), Unique("number_unique", ("id_videofile", "frame_number"))),
    "scenes": (Check("range", "first_frame >= 0 AND last_frame >= first_frame"), Check("origin_known", _known("origin", "AUTO", "OPERATOR", "CANCELLED")), Reference("location", "location_id", "locations", "location_id")),
    "shots": (
        Check("range", "first_frame >= 0 AND last_frame >= first_frame"),
        Check("size_known", _known("size", "NONE", "ECU", "BCU", "CU", "MCU", "MS", "MLS", "LS", "VLS", "XLS")),
        Check("size_origin", _known("size_origin", "AUTO", "OPERATOR")),
        Check("origin", _known("origin", "AUTO", "OPERATOR", "CANCELLED")),
    ),
    "persons": (
        Check("name_not_blank", _filled("name")),
        Check("kind_known", _known("kind", "PERSON", "UNRECOGNIZED", "NONPERSON")),
        Check("key_required", "(kind = 'PERSON' AND recognizer_key IS NOT NULL AND trim(recognizer_key) <> '') OR (kind <> 'PERSON' AND recognizer_key IS NULL)"),
        Unique("name_unique", ("id_project", "name")),
        Unique("key_unique", ("id_project", "recognizer_key")),
        Unique("service_row_unique", ("id_project", "kind"), "kind <> 'PERSON'"),
    ),
    "model_versions": (
        Check("algorithm_not_blank", _filled("algorithm_version")),
        Check("params_not_blank", _filled("params_hash")),
        Check("classes_not_blank", _filled("classes")),
        Check("example_count_nonnegative", "example_count >= 0"),
        Check("threshold_range", "threshold > 0 AND threshold <= 1"),
        Check("state_known", _known("state", *_RUN)),
        Check("artifact_when_done", "state <> 'DONE' OR artifact_key IS NOT NULL"),
        Unique("one_active", ("id_project",), "is_active"),
    ),
    "faces": (
        Check("frame_number_nonnegative", "frame_number >= 0"),
        Check("index_nonnegative", "face_index >= 0"),
        Check("box_order", "x1 < x2 AND y1 < y2"),
        Check("origin_known", _known("origin", "AUTO", "OPERATOR")),
        Check("probability_range", "recognize_probability BETWEEN 0 AND 1"),
        Check("confidence_range", "detect_confidence BETWEEN 0 AND 1"),
        Check("recognition_pair", "recognized_by_model_version_id IS NOT NULL OR recognized_name IS NULL"),
        Unique("natural_key_unique", ("id_videofile", "frame_number", "face_index")),
        Reference("person", "person_id", "persons", "person_id"),
    ),
    "embeddings": (Check("model_not_blank", _filled("embedding_model_key")), Check("vector_not_empty", "size(vector) > 0")),
    "filters": (Check("name_not_blank", _filled("name")), Unique("name_unique", ("id_project", "name"))),
    "filter_groups": (Check("ordinal_nonnegative", "ordinal >= 0"), Check("conjunction_known", _known("conjunction", "AND", "OR")), Check("not_self_parent", "NOT parent_group_id <=> group_id")),
    "filter_conditions": (
        Check("ordinal_nonnegative", "ordinal >= 0"),
        Check("type_known", _known("condition_type", "PERSON", "LOCATION", "SHOT_TYPE", "SHOT_SIZE", "FRAME_RANGE", "HAS_FACE")),
        Check("subject_known", _known("subject", "SCENE", "SHOT")),
        Check("operator_known", _known("operator", "IN", "NOT_IN", "BETWEEN", "IS_NULL", "IS_NOT_NULL")),
        Check("value_needed", "operator IN ('IS_NULL', 'IS_NOT_NULL') OR coalesce(value, 'null') <> 'null'"),
    ),
    "jobs": (
        Check("kind_known", _known("kind", "ANALYZE", "FACES", "TRAIN", "HASH")),
        Check("state_known", _known("state", "WAITING", *_RUN)),
        Check("subject_type_known", _known("subject_type", "EPISODE", "MODEL_VERSION")),
        Check("params_given", "params IS NOT NULL"),
        Check("hash_not_blank", _filled("params_hash")),
        Check("progress_nonnegative", "progress_done >= 0 AND progress_total >= 0"),
        Check("done_total_set", "state <> 'DONE' OR progress_total > 0"),
        Check("error_text_on_error", "state <> 'ERROR' OR error_text IS NOT NULL"),
        Check("time_order", "finished_at >= created_at"),
    ),
    "artifacts": (
        Check("kind_known", _known("kind", "PREVIEW_SHEET", "MODEL", "RECIPE")),
        Check("placement_known", "placement = 'SSD'"),
        Check("state_known", _known("state", "WRITING", "READY", "FAILED")),
        Check("key_not_blank", _filled("object_key")),
        Check("size_nonnegative", "byte_size >= 0"),
        Check("ready_has_size", "state <> 'READY' OR byte_size IS NOT NULL"),
        Check("checksum_hex", f"checksum RLIKE '{_HEX}'"),
        Unique("kind_key_unique", ("kind", "object_key")),
    ),
    "checksums": (
        Check("algorithm_known", "algorithm = 'SHA-256'"),
        Check("digest_hex", f"digest RLIKE '{_HEX}'"),
        Check("size_positive", "byte_size > 0"),
        Check("state_known", _known("state", *_RUN)),
        Check("done_when_stamped", "state <> 'DONE' OR computed_at IS NOT NULL"),
        Check("error_text_on_error", "state <> 'ERROR' OR error_text IS NOT NULL"),
        Check("no_error_when_done", "state <> 'DONE' OR error_text IS NULL"),
        Unique("one_current", ("id_videofile",), "state = 'DONE' AND NOT is_stale"),
    ),
    "recipes": (
        Check("name_not_blank", _filled("name")),
        Check("schema_version_positive", "schema_version > 0"),
        Check("state_known", _known("state", *_RUN)),
        Check("item_count_nonnegative", "item_count >= 0"),
        Check("expected_nonnegative", "coalesce(expected_duration_ms, 0) >= 0 AND coalesce(expected_frame_count, 0) >= 0"),
        Check("done_signed", "state <> 'DONE' OR (artifact_id IS NOT NULL AND content_sha256 IS NOT NULL AND signature IS NOT NULL AND signing_key_id IS NOT NULL AND item_count > 0)"),
        Check("content_sha256_hex", f"content_sha256 RLIKE '{_HEX}'"),
        Check("signature_base64", "signature RLIKE '^[A-Za-z0-9+/]+={0,2}$'"),
        Check("error_text_on_error", "state <> 'ERROR' OR error_text IS NOT NULL"),
        Check("signature_together", "(signature IS NULL) = (signing_key_id IS NULL) AND (signature IS NULL) = (content_sha256 IS NULL)"),
        Check("time_order", "finished_at >= created_at"),
    ),
    "recipe_items": (
        Check("ordinal_nonnegative", "ordinal >= 0"),
        Check("name_not_blank", _filled("videofile_name")),
        Check("path_not_blank", _filled("relative_path")),
        Check("path_relative", "relative_path NOT LIKE '/%' AND relative_path NOT LIKE '../%' AND relative_path NOT LIKE '%/../%' AND relative_path NOT LIKE '%/..'"),
        Check("digest_hex", f"source_sha256 RLIKE '{_HEX}'"),
        Check("range", "first_frame >= 0 AND last_frame >= first_frame"),
        Check("cut_range", "cut_first_frame >= 0 AND cut_last_frame >= cut_first_frame AND cut_first_frame <= first_frame AND cut_last_frame >= last_frame"),
        Check("persons_array", "person_names IS NULL OR (left(trim(person_names), 1) = '[' AND json_array_length(person_names) IS NOT NULL)"),
        Unique("ordinal_unique", ("recipe_id", "ordinal")),
    ),
    "settings": (Check("key_not_blank", _filled("key")), Unique("key_unique", ("id_project", "key"))),
    "properties": (
        Check("key_not_blank", _filled("property_key")),
        Check("key_length", "length(property_key) <= 120"),
        Check("value_length", "length(property_value) <= 4000"),
        Check("ordinal_nonnegative", "ordinal >= 0"),
        Unique("owner_unique", ("owner_kind", "owner_id", "property_key")),
    ),
}


def _row_key(key: list[str]):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in key])


def checked(df: DataFrame, relation: str, key: list[str], checks: list[Check]) -> DataFrame:
    """Violations of all checks in one pass over the rows."""
    names = F.array_compact(F.array(*[F.when(~F.expr(c.predicate), F.lit(c.name)) for c in checks]))
    return df.select(F.lit(relation).alias("relation"), F.explode(names).alias("rule"), _row_key(key).alias("row_key"))


def clashes(df: DataFrame, relation: str, rule: Unique) -> DataFrame:
    """One row for each key that several rows hold."""
    some = df.where(rule.where).dropna(subset=list(rule.columns))
    n = some.groupBy(*rule.columns).agg(F.count("*").alias("_n")).where("_n > 1")
    return n.select(F.lit(relation).alias("relation"), F.lit(rule.name).alias("rule"), _row_key(list(rule.columns)).alias("row_key"))


def orphans(df: DataFrame, target: DataFrame, relation: str, key: list[str], rule: Reference) -> DataFrame:
    """Rows whose non-null reference meets nothing."""
    lost = df.where(F.col(rule.column).isNotNull()).join(target.select(F.col(rule.target_column).alias(rule.column)).distinct(), rule.column, "left_anti")
    return lost.select(F.lit(relation).alias("relation"), F.lit(f"{rule.name}_exists").alias("rule"), _row_key(key).alias("row_key"))


def violations(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Violations of all rules that the tables given have the columns for."""
    out = []
    for relation, df in tables.items():
        rules, own = RULES.get(relation, ()), set(df.columns)
        checks = [r for r in rules if isinstance(r, Check) and _has(df, r.predicate)]
        if checks:
            out.append(checked(df, relation, keys[relation], checks))
        out += [clashes(df, relation, r) for r in rules if isinstance(r, Unique) and own >= set(r.columns) and _has(df, r.where)]
        out += [orphans(df, tables[r.target], relation, keys[relation], r) for r in rules if isinstance(r, Reference) and r.column in own and r.target in tables]
    return reduce(DataFrame.unionByName, out)


def _has(df: DataFrame, predicate: str) -> bool:
    """Whether the columns that a predicate names are all there."""
    import re

    words = set(re.findall(r"[a-z_][a-z_0-9]*", re.sub(r"'[^']*'", "", predicate)))
    functions = {"trim", "length", "size", "coalesce", "octet_length", "div", "true", "false", "left", "json_array_length"}
    return words - functions <= set(df.columns)


def deleted_with(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """df without rows that refer to rows gone: a cascade's next step."""
    return df.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def unlinked_from(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """df with references to rows gone set to null."""
    met = df.join(gone.select(F.col(key).alias(column), F.lit(True).alias("_gone")).distinct(), column, "left")
    return met.select(*[F.when(F.col("_gone").isNull(), F.col(column)).alias(column) if c == column else F.col(c) for c in df.columns])


def blocking(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Rows that refer to rows about to go, where that is forbidden."""
    return df.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def ledger(applied: DataFrame, files: DataFrame) -> DataFrame:
    """name, verdict of each migration: APPLIED, CHANGED, PENDING or MISSING, by checksums."""
    met = files.select("name", F.col("checksum").alias("_now")).join(applied.select("name", F.col("checksum").alias("_then")), "name", "full_outer")
    verdict = F.when(F.col("_then").isNull(), "PENDING").when(F.col("_now").isNull(), "MISSING").when(F.col("_now") == F.col("_then"), "APPLIED").otherwise("CHANGED")
    return met.select("name", verdict.alias("verdict"))


def parsed(column: str, *values: str):
    """A column that must hold one of the values: anything else is an error when it is read."""
    c = F.col(column)
    return F.when(c.isin(*values) | c.isNull(), c).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), c)))
