"""Hashes with framed parts, canonical JSON, and text forms of ids and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends every part of a hash, so that no two lists of parts run together.
UNIT = "\x1f"
#: Parts an array's elements the same way.
RECORD = "\x1e"


def framed_hash(*parts: Column) -> Column:
    """SHA-256 over the text of every part (null: empty), each ended by a unit separator."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit(UNIT))]), 256)


def hashable(name: str, kind: str) -> Column:
    """A column in a form whose text is stable: binary as hex, arrays by element."""
    c = F.col(name)
    if kind == "binary":
        return F.lower(F.hex(c))
    if kind.startswith("array"):
        return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), RECORD)
    return c


def record_hash(df, *names: str) -> Column:
    """The hash of a row over the columns named, in that order."""
    kinds = dict(df.dtypes)
    return framed_hash(*[hashable(n, kinds[n]) for n in names])


def canonical_text(c: Column) -> Column:
    """A quoted JSON string: line ends are \\n, control characters escaped, all else as it is."""
    out = F.regexp_replace(c, "\r\n?", "\n")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    rest = [i for i in range(32) if chr(i) not in "\n\t\b\f\r"]
    some = out
    for i in rest:
        some = F.replace(some, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike("[\x00-\x1f]"), some).otherwise(out), F.lit('"'))


def canonical_number(c: Column) -> Column:
    """A decimal without zeros at its end and without an exponent."""
    text = c.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(plain == "-0", F.lit("0")).otherwise(plain)


def canonical_list(texts: Column) -> Column:
    """[a, b] from an array of canonical texts."""
    return F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))


def canonical_map(pairs: Column) -> Column:
    """{k: v} from map<string, string> whose values are canonical texts, by key."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(canonical_text(e["key"]), F.lit(": "), e["value"])), ", "), F.lit("}"))


def canonical_object(*fields: tuple[str, Column]) -> Column:
    """An object with its fields in this order, one a line; fields whose canonical text is null are left out."""
    lines = F.array_compact(F.array(*[F.concat(F.lit(f'  "{name}": '), c) for name, c in fields]))
    return F.when(F.size(lines) == 0, F.lit("{\n}")).otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))


def utc_second(ts: Column) -> Column:
    """ISO-8601 in UTC, cut to the second, whatever the session's time zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    return F.date_format(F.date_trunc("SECOND", utc), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def tolerant_timestamp(text: Column) -> Column:
    """A timestamp, or null where the text is blank or none."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def listed(text: Column) -> Column:
    """The distinct non-blank parts of a comma list, trimmed, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def cluster_key(face_id: Column) -> Column:
    return F.concat(F.lit("cl-"), face_id.cast("string"))


def cluster_face(key: Column) -> Column:
    """The face id in a cluster key; null if it is none."""
    return F.when(key.startswith("cl-"), F.substring(key, 4, 20).try_cast("long"))


def stem(name: Column) -> Column:
    """What stands before the last point of a name."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_blank(c: Column) -> Column:
    return F.trim(c) == ""


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n)
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", n.cast("double") / 1024**i)).otherwise(out)
    return out


def human_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a word that a number takes in Slavic languages: 1, 21; 2-4, 22-24; 0, 5-20, 25."""
    last, two = F.abs(n) % 10, F.abs(n) % 100
    return F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)


def one_of(c: Column, values: tuple[str, ...], what: str) -> Column:
    """c where it is null or one of the values; anything else is an error that names it."""
    unknown = F.raise_error(F.concat(F.lit(f"unknown {what}: "), c))
    return F.when(c.isNull() | c.isin(*values), c).otherwise(unknown)


def other_than(c: Column, excluded: Column) -> Column:
    """Whether c differs from what is excluded; where nothing is, everything does."""
    return excluded.isNull() | (c != excluded)


def titled(c: Column, titles: dict[str, str]) -> Column:
    """The title of a literal; literals without one stay as they are."""
    pairs = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def pem(der: Column, label: str = "PUBLIC KEY") -> Column:
    """Binary as PEM: base64 in lines of 64."""
    lines = F.regexp_replace(F.regexp_replace(F.base64(der), r"\s", ""), "(.{64})(?=.)", "$1\n")
    return F.concat(F.lit(f"-----BEGIN {label}-----\n"), lines, F.lit(f"\n-----END {label}-----\n"))


def safe_relative_path(path: Column) -> Column:
    """Whether a path stays inside its tree: relative, forward slashes only, no empty, . or .. segments."""
    bad = F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return ~F.contains(path, F.lit("\\")) & ~bad


def relative_path(path: Column, root: Column) -> Column:
    """The path below root; null outside of it."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), path.substr(F.char_length(root) + 2, F.char_length(path)))


def text_array(json: Column) -> Column:
    """array<string> from JSON; null if it is none."""
    return F.from_json(json, "array<string>")


def json_of_array(values: Column) -> Column:
    """JSON of array<string>, with carriage returns as line feeds."""
    return F.to_json(F.transform(values, lambda v: F.replace(v, F.lit("\r"), F.lit("\n"))))
