"""Filter trees over shots.

A tree is rows: groups (group_id, parent_group_id, ordinal, conjunction, negated) and conditions (group_id, ordinal,
condition_type, subject, operator, value, negated). It is compiled into one boolean column over shots, so a filter of
any size is one pass. Facts that a condition needs (persons in a shot, the scene's location) are columns of the facts
table, made once.

Rules: AND holds if all parts do, OR if any does; an empty AND holds, an empty OR doesn't. A null attribute is in no
list, so NOT_IN holds for it. Conditions on SCENE are decided by the scene's attributes and hold for all of its shots.
Unknown types, operators or subjects and trees deeper than three are errors, never empty results.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import bind, contained

MAX_DEPTH = 3
SUBJECTS = ("SCENE", "SHOT")


@dataclass(frozen=True)
class Condition:
    type: str
    operator: str
    value: Any = None
    subject: str = "SHOT"
    negated: bool = False


@dataclass(frozen=True)
class Group:
    conjunction: str = "AND"
    parts: tuple = field(default_factory=tuple)
    negated: bool = False


def _one(column: Column, c: Condition) -> Column:
    """A condition on a single value."""
    if c.operator == "IN":
        return F.coalesce(column.isin(*c.value), F.lit(False)) if c.value else F.lit(False)
    if c.operator == "NOT_IN":
        return ~F.coalesce(column.isin(*c.value), F.lit(False)) if c.value else F.lit(True)
    if c.operator == "BETWEEN":
        return F.coalesce(column.between(*c.value), F.lit(False))
    if c.operator in ("IS_NULL", "IS_NOT_NULL"):
        return column.isNull() if c.operator == "IS_NULL" else column.isNotNull()
    raise ValueError(f"unknown operator: {c.operator}")


def _many(column: Column, c: Condition) -> Column:
    """A condition on a set of values: IN holds if any is listed."""
    if c.operator in ("IN", "NOT_IN"):
        hit = F.arrays_overlap(column, F.array(*[F.lit(v) for v in c.value])) if c.value else F.lit(False)
        return hit if c.operator == "IN" else ~hit
    if c.operator in ("IS_NULL", "IS_NOT_NULL"):
        return (F.size(column) == 0) if c.operator == "IS_NULL" else (F.size(column) > 0)
    raise ValueError(f"unknown operator for {c.type}: {c.operator}")


def _range(first: Column, last: Column, c: Condition) -> Column:
    if c.operator != "BETWEEN":
        raise ValueError(f"unknown operator for {c.type}: {c.operator}")
    low, high = c.value
    return (last >= low) & (first <= high)


#: type -> (condition -> column over the facts).
HANDLERS: dict[str, Callable[[Condition], Column]] = {
    "PERSON": lambda c: _many(F.col("scene_persons" if c.subject == "SCENE" else "shot_persons"), c),
    "LOCATION": lambda c: _one(F.col("location_id"), c),
    "SHOT_TYPE": lambda c: _one(F.col("origin"), c),
    "SHOT_SIZE": lambda c: _one(F.col("size"), c),
    "FRAME_RANGE": lambda c: _range(F.col("scene_first" if c.subject == "SCENE" else "first_frame"), F.col("scene_last" if c.subject == "SCENE" else "last_frame"), c),
    "HAS_FACE": lambda c: _many(F.col("scene_persons" if c.subject == "SCENE" else "shot_persons"), c),
}


def compiled(part: Group | Condition, depth: int = 1) -> Column:
    """The tree as one boolean column."""
    if isinstance(part, Condition):
        if part.type not in HANDLERS:
            raise ValueError(f"unknown condition type: {part.type}")
        if part.subject not in SUBJECTS:
            raise ValueError(f"unknown subject: {part.subject}")
        out = HANDLERS[part.type](part)
    else:
        if depth > MAX_DEPTH:
            raise ValueError(f"filter groups nest deeper than {MAX_DEPTH}")
        if part.conjunction not in ("AND", "OR"):
            raise ValueError(f"unknown conjunction: {part.conjunction}")
        own = [compiled(p, depth + (1 if isinstance(p, Group) else 0)) for p in part.parts]
        join = (lambda a, b: a & b) if part.conjunction == "AND" else (lambda a, b: a | b)
        out = reduce(join, own) if own else F.lit(part.conjunction == "AND")
    return ~out if part.negated else out


def tree(groups: list[dict], conditions: list[dict]) -> Group:
    """The tree of one filter from its rows. Values are JSON. Rows whose parent is missing are an error."""
    ids = {g["group_id"] for g in groups}
    roots = [g for g in groups if g["parent_group_id"] is None]
    if len(roots) != 1 or any(g["parent_group_id"] not in ids for g in groups if g not in roots) or any(c["group_id"] not in ids for c in conditions):
        raise ValueError("a filter has one root, and parents that exist")

    def build(g: dict, depth: int) -> Group:
        if depth > MAX_DEPTH:
            raise ValueError(f"filter groups nest deeper than {MAX_DEPTH}")
        below = [(x["ordinal"], build(x, depth + 1)) for x in groups if x["parent_group_id"] == g["group_id"]]
        own = [(c["ordinal"], Condition(c["condition_type"], c["operator"], json.loads(c["value"] or "null"), c["subject"], bool(c["negated"]))) for c in conditions if c["group_id"] == g["group_id"]]
        return Group(g["conjunction"], tuple(p for _, p in sorted(own + below, key=lambda x: x[0])), bool(g.get("negated")))

    return build(roots[0], 1)


def facts(shots: DataFrame, scenes: DataFrame, faces: DataFrame) -> DataFrame:
    """One row for each live shot inside a live scene: its own attributes, its scene's, and the persons seen in both."""
    live = scenes.where("NOT is_stale")
    own = contained(shots.where("NOT is_stale"), live.select("id_videofile", "scene_id", "first_frame", "last_frame"), "scene_id")
    extra = live.select("scene_id", "location_id", F.col("first_frame").alias("scene_first"), F.col("last_frame").alias("scene_last"))
    seen = bind(faces.select("id_videofile", "frame_number", "person_id"), own.select("id_videofile", "shot_id", "first_frame", "last_frame"), "shot_id").where("shot_id IS NOT NULL")
    per_shot = seen.groupBy("shot_id").agg(F.collect_set("person_id").alias("shot_persons"))
    met = own.join(extra, "scene_id").join(per_shot, "shot_id", "left")
    per_scene = met.groupBy("scene_id").agg(F.array_distinct(F.flatten(F.collect_list("shot_persons"))).alias("scene_persons"))
    empty = F.array().cast("array<bigint>")
    return met.join(per_scene, "scene_id").select("*", F.coalesce("shot_persons", empty).alias("_p")).drop("shot_persons").withColumnRenamed("_p", "shot_persons")


def passing_shots(table: DataFrame, filter_: Group) -> DataFrame:
    return table.where(compiled(filter_))


def passing_scenes(table: DataFrame, filter_: Group) -> DataFrame:
    """scene_id, shots, passed of scenes with at least one shot that passes."""
    n = table.groupBy("scene_id").agg(F.count("*").alias("shots"), F.count_if(compiled(filter_)).alias("passed"))
    return n.where("passed > 0")


def diagnosed(table: DataFrame, filter_: Group) -> DataFrame:
    """One row: shots in all, and how many each part of the root lets pass (part_0, part_1, ...) and the whole does."""
    parts = [F.count_if(compiled(p, 2)).alias(f"part_{i}") for i, p in enumerate(filter_.parts)]
    return table.agg(F.count("*").alias("shots"), *parts, F.count_if(compiled(filter_)).alias("passed"))


def described(part: Group | Condition) -> str:
    """The filter in words."""
    if isinstance(part, Condition):
        value = "" if part.operator.startswith("IS_") else " " + json.dumps(part.value, ensure_ascii=False)
        text = f"{part.subject.lower()} {part.type.lower()} {part.operator.lower().replace('_', ' ')}{value}"
    else:
        text = "(" + f" {part.conjunction.lower()} ".join(map(described, part.parts)) + ")" if part.parts else f"(no {part.conjunction.lower()} part)"
    return f"not {text}" if part.negated else text
