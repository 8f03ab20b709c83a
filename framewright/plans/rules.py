"""Every rule of every relation, over rows made of the events table: each column takes valid, invalid and null values in turn."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, upserts
from .registry import query
from .views import Views

_NAMES, _TEXTS, _HASHES = ("'a'", "'b c'", "' '", "''", "NULL"), ("'why'", "NULL"), ("'" + "0a" * 32 + "'", "'0A'", "''", "NULL")
_COUNTS, _TIMES, _STATES = ("3", "0", "-1", "NULL"), ("'2024-01-02'", "'2024-01-01'", "'2024-01-03'", "NULL"), ("'WAITING'", "'CREATING'", "'WORKING'", "'DONE'", "'ERROR'", "'LOST'", "NULL")

#: What a column takes, as literals of both engines; columns not named here take counts.
VALUES: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("name", "pixel_format", "video_codec", "algorithm_version", "params_hash", "classes", "embedding_model_key", "videofile_name", "key", "property_key", "object_key", "recognizer_key"), _NAMES),
    **dict.fromkeys(("error_text", "artifact_key", "recognized_name", "params", "signing_key_id", "artifact_id"), _TEXTS),
    **dict.fromkeys(("digest", "checksum", "source_sha256", "content_sha256"), _HASHES),
    **dict.fromkeys(("started_at", "finished_at", "created_at", "computed_at"), _TIMES),
    **dict.fromkeys(("is_active", "is_stale"), ("true", "false", "NULL")),
    **dict.fromkeys(("recognize_probability", "detect_confidence", "threshold"), ("0.5D", "0.0D", "1.0D", "1.5D", "-0.5D", "NULL")),
    "state": _STATES,
    "source_root": ("'/media'", "'/media/'", "'media'", "' '", "NULL"),
    "source_path": ("'/media/a'", "'/media/b'", "'b'", "NULL"),
    "relative_path": ("'a/b.mkv'", "'/a'", "'../a'", "'a/../b'", "'a/..'", "'a..b'", "' '", "NULL"),
    "frame_count": ("16", "9", "8", "0", "-1", "NULL"),
    "keyframe_bitmap": ("X'0001'", "X'00'", "X''", "NULL"),
    "level": ("'SCENE'", "'SHOT'", "'shot'", "NULL"),
    "origin": ("'AUTO'", "'OPERATOR'", "'CANCELLED'", "'GUESS'", "NULL"),
    "size": ("'NONE'", "'MS'", "'XLS'", "'HUGE'", "NULL"),
    "size_origin": ("'AUTO'", "'OPERATOR'", "'CANCELLED'", "NULL"),
    "vector": ("array(1.0D)", "array()", "NULL"),
    "conjunction": ("'AND'", "'OR'", "'XOR'", "NULL"),
    "condition_type": ("'PERSON'", "'HAS_FACE'", "'COLOUR'", "NULL"),
    "subject": ("'SCENE'", "'SHOT'", "'FRAME'", "NULL"),
    "operator": ("'IN'", "'BETWEEN'", "'IS_NULL'", "'LIKE'", "NULL"),
    "value": ("'[1]'", "'null'", "NULL"),
    "subject_type": ("'EPISODE'", "'MODEL_VERSION'", "'SCENE'", "NULL"),
    "placement": ("'SSD'", "'HDD'", "NULL"),
    "algorithm": ("'SHA-256'", "'MD5'", "NULL"),
    "signature": ("'QUJD'", "'QUI='", "'not base64!'", "NULL"),
    "person_names": ("""'["a", "b"]'""", "'[]'", "'{}'", "'[broken'", "' [1]'", "NULL"),
    "property_value": ("'v'", "repeat('v', 4001)", "NULL"),
    "recognized_by_model_version_id": ("1", "NULL"),
    **{f"{relation}.kind": (*(f"'{k}'" for k in kinds), "'OTHER'", "NULL") for relation, kinds in {"runs": ("STRUCTURE", "FACES"), "persons": ("PERSON", "UNRECOGNIZED", "NONPERSON"), "jobs": ("ANALYZE", "HASH"), "artifacts": ("MODEL", "RECIPE")}.items()},
    "artifacts.state": ("'WRITING'", "'READY'", "'FAILED'", "'LOST'", "NULL"),
    "settings.key": ("'a'", "'b'", "' '", "NULL"),
    "properties.property_key": ("'a'", "repeat('k', 121)", "' '", "NULL"),
    **dict.fromkeys(("projects.id_project", "locations.location_id", "persons.person_id"), ("1", "2", "3")),
    **dict.fromkeys(("id_project", "location_id", "person_id"), ("1", "2", "3", "4", "NULL")),
}

#: Parts of keys that several rows should hold, but not most: these take some dozens of numbers.
WIDE = ("id_videofile", "frame_number", "recipe_id", "owner_id", "ordinal", "track_index")


def columns_of(relation: str) -> list[str]:
    """The columns that the rules of a relation name."""
    words = {"trim", "length", "size(", "coalesce", "octet_length", "div", "true", "false", "left", "json_array_length"}
    found: dict[str, None] = {}
    for rule in quality.RULES[relation]:
        texts = [rule.predicate] if isinstance(rule, quality.Check) else [*rule.columns, rule.where] if isinstance(rule, quality.Unique) else [rule.column]
        for text in texts:
            found |= dict.fromkeys(w.rstrip("(") for w in re.findall(r"[a-z_][a-z_0-9]*\(?", re.sub(r"'[^']*'", "", text)) if w not in words and w.rstrip("(") not in words)
    keys = {"projects": "id_project", "locations": "location_id", "persons": "person_id"}
    return list(found | dict.fromkeys([keys[relation]] if relation in keys else []))


def _pick(relation: str, column: str) -> tuple[str, tuple[str, ...] | None]:
    """Which of its values a column takes for an event (an index from 0, in both engines), and the values; none: the index itself."""
    h = zlib.crc32(f"{relation}.{column}".encode())
    place = f"((event_id * {h % 97 + 1} + event_id % {h // 97 % 13 + 2} * {h // 1261 % 11 + 1} + {h % 1009}) % 9973)"
    values = VALUES.get(f"{relation}.{column}", VALUES.get(column))
    if values is None and column in WIDE:
        return f"{place} % 60 - 5", None
    values = values or _COUNTS
    return f"{place} % {len(values)}", values


def _in_spark(relation: str, column: str) -> str:
    place, values = _pick(relation, column)
    return f"{place if values is None else f'element_at(array({", ".join(values)}), cast({place} AS int) + 1)'} AS {column}"


def _in_duck(relation: str, column: str) -> str:
    place, values = _pick(relation, column)
    if values is None:
        return f'{place} AS "{column}"'
    own = [re.sub(r"X'(\w*)'", r"unhex('\1')", re.sub(r"(\d)D\b", r"\1::DOUBLE", v)).replace("array(", "list_value(") for v in values]
    if column == "vector":
        own = ["[1.0]::DOUBLE[]", "[]::DOUBLE[]", "NULL"]
    return f'[{", ".join(own)}][{place} + 1] AS "{column}"'


def _predicate_in_duck(text: str) -> str:
    text = re.sub(r"(\w+) RLIKE ('[^']*')", r"regexp_matches(\1, \2)", text).replace(" div ", " // ").replace("size(vector)", "len(vector)").replace("<=>", "IS NOT DISTINCT FROM")
    return re.sub(r"json_array_length\((\w+)\)", r"(CASE WHEN json_valid(\1) THEN json_array_length(\1) END)", text)


def _every_rule_in_duck() -> str:
    made = [f"t_{r} AS (SELECT event_id, {', '.join(_in_duck(r, c) for c in columns_of(r))} FROM events)" for r in quality.RULES]
    found = []
    for relation, rules in quality.RULES.items():
        for rule in rules:
            head = f"SELECT '{relation}' AS relation, '{rule.name}{'_exists' if isinstance(rule, quality.Reference) else ''}' AS rule, "
            if isinstance(rule, quality.Check):
                found.append(f"{head}event_id::VARCHAR AS row_key FROM t_{relation} WHERE NOT ({_predicate_in_duck(rule.predicate)})")
            elif isinstance(rule, quality.Unique):
                own = ", ".join(f'"{c}"' for c in rule.columns)
                known = " AND ".join(f'"{c}" IS NOT NULL' for c in rule.columns)
                found.append(f"{head}concat_ws('|', {own}) AS row_key FROM t_{relation} WHERE ({rule.where}) AND {known} GROUP BY {own} HAVING count(*) > 1")
            else:
                found.append(f'{head}event_id::VARCHAR AS row_key FROM t_{relation} WHERE "{rule.column}" IS NOT NULL AND "{rule.column}" NOT IN (SELECT "{rule.target_column}" FROM t_{rule.target})')
    return f", {', '.join(made)}\nSELECT relation, rule, count(*) AS violations, min(row_key) AS least, max(row_key) AS most FROM ({' UNION ALL '.join(found)}) GROUP BY 1, 2"


@query("every_rule", _every_rule_in_duck())
def _(v: Views):
    """How often each rule of each relation is violated, by which rows from and to."""
    events = v.table("events")
    tables = {r: events.selectExpr("event_id", *[_in_spark(r, c) for c in columns_of(r)]) for r in quality.RULES}
    found = quality.violations(tables, dict.fromkeys(tables, ["event_id"]))
    return found.groupBy("relation", "rule").agg(F.count("*").alias("violations"), F.min("row_key").alias("least"), F.max("row_key").alias("most"))


@query("artifact_upserts", """
, a AS (SELECT event_id, ['PREVIEW_SHEET', 'MODEL', 'RECIPE'][event_id % 3 + 1] AS kind, 'key-' || user_id AS object_key, CASE WHEN event_id % 7 = 0 THEN 'FAILED' ELSE 'READY' END AS state, CASE WHEN event_id % 7 > 0 THEN length(props) END AS byte_size FROM events),
stored AS (SELECT * FROM a WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY kind, object_key ORDER BY event_id) = 1),
fresh AS (SELECT * FROM a WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY kind, object_key ORDER BY event_id) = 1)
SELECT kind, object_key, state, byte_size FROM fresh UNION ALL SELECT kind, object_key, state, byte_size FROM stored s WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.kind = s.kind AND f.object_key = s.object_key)""")
def _(v: Views):
    """Rows of artifacts by kind and key: those written anew replace those there, others stay."""
    n = F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in ("PREVIEW_SHEET", "MODEL", "RECIPE")]), (n % 3).cast("int"))
    rows: DataFrame = v.table("events").select(n, kind.alias("kind"), F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("object_key"), F.when(n % 7 == 0, "FAILED").otherwise("READY").alias("state"), F.when(n % 7 > 0, F.length("props").cast("long")).alias("byte_size"))
    key = ["kind", "object_key"]
    return upserts.upsert(upserts.first_of(rows.where(n % 2 == 0), key, "event_id"), upserts.first_of(rows.where(n % 2 == 1), key, "event_id"), key).drop("event_id")
