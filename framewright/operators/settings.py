"""Project settings: typed values, completeness, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timebase import whole_or_double

# Keys, their kinds and defaults.
SETTINGS = {
    "scene.threshold": ("NUMBER", "8"),
    "shot.threshold": ("NUMBER", "4"),
    "shot.size.thresholds": ("NUMBER_LIST", "[0.35,0.22,0.13,0.075,0.04,0.02,0.009,0.003]"),
    "face.not_person_aspect": ("NUMBER", "4"),
    "face.detect_threshold": ("NUMBER", "0.5"),
    "cluster.count": ("INTEGER", "256"),
    "cluster.merge_threshold": ("NUMBER", "0.65"),
    "preview.sheet.cols": ("INTEGER", "16"),
    "preview.sheet.rows": ("INTEGER", "16"),
    "recipe.schema_version": ("INTEGER", "2"),
    "recipe.audio_track_count": ("INTEGER", "1"),
}


def _kinds(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, kind, default) for k, (kind, default) in SETTINGS.items()], "key string, kind string, default_value string"))  # eleven rows


def defaults(projects: DataFrame) -> DataFrame:
    """id_project, key, value of every setting for every project."""
    return projects.select("id_project").crossJoin(_kinds(projects.sparkSession)).select("id_project", "key", F.col("default_value").alias("value"))


def missing(projects: DataFrame, stored: DataFrame) -> DataFrame:
    """id_project, missing: the settings a project lacks, sorted; projects that lack none aren't listed."""
    lost = defaults(projects).select("id_project", "key").join(stored.select("id_project", "key"), ["id_project", "key"], "left_anti")
    return lost.groupBy("id_project").agg(F.array_sort(F.collect_list("key")).alias("missing"))


def validate(updates: DataFrame) -> DataFrame:
    """updates (id_project, key, value as JSON) with normal, the value as it is kept, and problem (null: fine).

    Problems: UNKNOWN_KEY, NOT_A_NUMBER, NOT_AN_INTEGER, NOT_A_LIST, EMPTY_LIST, OUT_OF_RANGE, NOT_FALLING.
    """
    met = updates.join(_kinds(updates.sparkSession), "key", "left")
    key, kind, text = F.col("key"), F.col("kind"), F.trim("value")
    is_number = F.coalesce(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), F.lit(False))
    number = F.when(is_number, text.try_cast("double"))
    is_integer = F.coalesce(text.rlike(r"^-?[0-9]+$"), F.lit(False))
    parts = F.transform(F.filter(F.split(F.regexp_replace(text, r"^\[|\]$", ""), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("double"))
    is_list = F.coalesce(text.rlike(r"^\[.*\]$"), F.lit(False))
    falling = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: (F.size(parts) < 2) | (F.get(parts, i - 1) > F.get(parts, i)))
    low = (
        F.when(key.isin("scene.threshold", "shot.threshold"), number <= 0)
        .when(key == "face.not_person_aspect", number <= 1)
        .when(key.isin("face.detect_threshold", "cluster.merge_threshold"), (number <= 0) | (number > 1))
        .when(key == "recipe.audio_track_count", number < 0)
        .otherwise((kind == "INTEGER") & (number <= 0))
    )
    problem = (
        F.when(kind.isNull(), "UNKNOWN_KEY")
        .when((kind == "NUMBER") & ~is_number, "NOT_A_NUMBER")
        .when((kind == "INTEGER") & ~is_integer, "NOT_AN_INTEGER")
        .when((kind == "NUMBER_LIST") & ~is_list, "NOT_A_LIST")
        .when((kind == "NUMBER_LIST") & (F.size(parts) == 0), "EMPTY_LIST")
        .when((kind == "NUMBER_LIST") & F.exists(parts, lambda x: x.isNull()), "NOT_A_NUMBER")
        .when((kind == "NUMBER_LIST") & F.exists(parts, lambda x: x <= 0), "OUT_OF_RANGE")
        .when((kind == "NUMBER_LIST") & ~falling, "NOT_FALLING")
        .when((kind != "NUMBER_LIST") & low, "OUT_OF_RANGE")
    )
    kept = F.when(kind == "NUMBER_LIST", F.concat(F.lit("["), F.array_join(F.transform(parts, whole_or_double), ","), F.lit("]"))).otherwise(whole_or_double(number))
    return met.select("id_project", "key", "value", problem.alias("problem"), F.when(problem.isNull(), kept).alias("normal"))


def typed(stored: DataFrame) -> DataFrame:
    """id_project, key, kind, number, numbers: values read by their kind."""
    met = stored.join(_kinds(stored.sparkSession), "key")
    return met.select("id_project", "key", "kind", F.when(F.col("kind") != "NUMBER_LIST", F.col("value").try_cast("double")).alias("number"), F.when(F.col("kind") == "NUMBER_LIST", F.from_json("value", "array<double>")).alias("numbers"))
