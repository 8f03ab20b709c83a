"""Conversation structure repair: the cheapest edits after which roles read ``(s?(ua)+)?``.

Spark deals conversations out by their ids, sorts their rows and judges each row by windows over that one shuffle. In
the tasks a recursive DuckDB query walks all conversations of an Arrow batch at once: each recursion advances one turn
and keeps, for each state of the grammar, the least cost and the first audit of that cost.

Of paths with equal costs that end in one state no audit begins another (the longer one would have paid for its
inserts), so the least audit so far stays the least whatever follows: that makes the walk exact.

A conversation may go on over any number of batches. Between pieces of it the edits that all states agree on are
settled: their rows are hashed (and given, if asked for) and leave memory. The hash of a conversation runs over its rows
in order, so one task reads it whole, but no more of it is held than what isn't settled yet.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from dataclasses import dataclass, field

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: Costs of an edit, and of a truncated row that isn't deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States of the grammar: nothing yet, after s, after u, after a. What states may end, and how many inserts each needs.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDINGS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

#: Turns of one conversation that a walk takes in at most; longer ones go on in the next walk.
PIECE = 400

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = f"{SUMMARY}, edit string, role string, text string"

FAULTS = ("blank", "duplicate", "truncated")


def steps() -> list[tuple[int, str, int, int, str]]:
    """(state, code, next state, cost, letters): one row's edit after the inserts before it that can pay.

    A code is d for a row that must go, else the row's initial in the grammar, x for others; capital if truncated.
    """
    after_insert = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    keeps = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
    out = []
    for first in range(4):
        reached, state = [], first
        while state not in reached:  # a second visit would only cost more
            reached.append(state)
            state = after_insert[state]
        for inserts, at in enumerate(reached):
            cost, letters = INSERT * inserts, "I" * inserts
            for code in "dsSuUaAxX":
                out.append((first, code, at, cost + DELETE, letters + "D"))
                if code == "d":
                    continue
                kind, more = code.lower(), TRUNCATED if code.isupper() else 0
                if at in keeps[kind]:
                    out.append((first, code, keeps[kind][at], cost + KEEP + more, letters + "K"))
                out.append((first, code, after_insert[at], cost + REROLE + more, letters + "R"))
    return out


WALK = """
WITH RECURSIVE walk(g, state, turn, cost, audit) USING KEY (g, state) AS (
    SELECT g, state, 0::BIGINT, cost, audit FROM begun
    UNION
    SELECT g, state, turn + 1, best.cost, best.audit FROM (
        SELECT w.g, e.next AS state, w.turn, min({'cost': w.cost + e.cost, 'audit': w.audit || e.letters}) AS best
        FROM walk w JOIN pieces p ON p.g = w.g JOIN edits e ON e.state = w.state AND e.code = substr(p.codes, w.turn + 1, 1)
        WHERE w.turn < length(p.codes) GROUP BY w.g, e.next, w.turn))
SELECT w.g, w.state, w.cost, w.audit FROM walk w JOIN pieces p ON p.g = w.g WHERE w.turn = length(p.codes) ORDER BY w.g
"""


def connection():
    """A DuckDB that works in the memory of its task alone."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "max_temp_directory_size": "0KB"})
    con.execute("CREATE TABLE edits (state INTEGER, code VARCHAR, next INTEGER, cost BIGINT, letters VARCHAR)")
    con.executemany("INSERT INTO edits VALUES (?, ?, ?, ?, ?)", steps())
    return con


@dataclass
class Conversation:
    """What is known of a conversation whose rows are still coming."""

    key: int | None
    states: list[tuple[int, int, str]] = field(default_factory=lambda: [(START, 0, "")])
    rows: deque = field(default_factory=deque)
    audit: list[str] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(5, dtype=np.int64))  # faults, illegal, turns
    turns: tuple[int, int] | None = None
    system: bool = False
    given: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def apply(self, letters: str) -> list[tuple[str, str, str]]:
        """Hash the rows that settled edits leave: (edit, role, text) of each."""
        out = []
        self.audit.append(letters)
        for edit in letters:
            role, text = ("", "") if edit == "I" else self.rows.popleft()
            if edit == "D":
                continue
            if edit == "K":
                self.system = self.system or not self.given and role[:1] == "s"
            else:
                role = "assistant" if (self.given - self.system) % 2 else "user"
            self.digest.update(((f"\n{role}:" if self.given else f"{role}:") + text).encode("utf-8", "surrogatepass"))
            self.given += 1
            out.append((edit, role, text))
        return out

    def settle(self) -> list[tuple[str, str, str]]:
        """Apply the edits with which the audits of all states begin."""
        common = os.path.commonprefix([audit for _, _, audit in self.states])
        self.states = [(state, cost, audit[len(common) :]) for state, cost, audit in self.states]
        return self.apply(common)

    def end(self) -> tuple[list[tuple[str, str, str]], tuple]:
        """The last rows, and the summary."""
        cost, letters = min((cost + INSERT * ENDINGS[state], audit + "I" * ENDINGS[state]) for state, cost, audit in self.states)
        rows = self.apply(letters)
        gaps = 0 if self.turns is None else self.turns[1] - self.turns[0] + 1 - int(self.counts[4])
        return rows, (self.key, gaps, *map(int, self.counts[:4]), cost, "".join(self.audit), self.digest.hexdigest())


def _repair(turns: bool):
    def run(batches):
        con = connection()
        names = [f.split()[0] for f in REPAIRED.split(", ")]
        kinds = pa.schema([(f.split()[0], pa.int64() if f.endswith(" long") else pa.string()) for f in REPAIRED.split(", ")])
        open_, out = None, []

        def give(conversation, rows, summary=None):
            if turns:
                out.extend((conversation.key, *[None] * 8, *row) for row in rows)
            if summary:
                out.append((*summary, None, None, None))

        def batch_of():
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id")
            ids, unknown = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (unknown[1:] != unknown[:-1])])
            ends = np.r_[starts[1:], n]
            key = lambda i: None if unknown[i] else int(ids[i])  # noqa: E731, B023
            if open_ is not None and open_.key != key(0):
                give(open_, *open_.end())
                open_ = None
            found = [open_ if open_ is not None and not i else Conversation(key(s)) for i, s in enumerate(starts)]
            codes, roles, texts = (batch.column(c).to_pylist() for c in ("code", "role", "text"))
            faults = np.array(batch.column("fault").to_pylist(), dtype=object)
            flags = np.stack([faults == f for f in FAULTS] + [batch.column(c).to_numpy(zero_copy_only=False) for c in ("illegal", "new_turn")]).astype(np.int64)
            sums = np.add.reduceat(flags, starts, axis=1)
            turn = batch.column("turn").to_pylist()
            for i, c in enumerate(found):
                c.counts += sums[:, i]
                span = [t for t, code in zip(turn[starts[i] : ends[i]], codes[starts[i] : ends[i]], strict=True) if t is not None and code]
                if span:
                    c.turns = (min(span[0], c.turns[0]), max(span[-1], c.turns[1])) if c.turns else (span[0], span[-1])
                c.rows.extend((roles[j], texts[j]) for j in range(starts[i], ends[i]) if codes[j])
            lines = ["".join(filter(None, codes[s:e])) for s, e in zip(starts, ends, strict=True)]
            for first in range(0, max(map(len, lines)), PIECE):
                walked = [i for i, line in enumerate(lines) if len(line) > first]
                begun = [(i, *state) for i in walked for state in found[i].states]
                con.register("begun", pa.table({k: pa.array(v, t) for k, v, t in zip(("g", "state", "cost", "audit"), zip(*begun, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)}))
                con.register("pieces", pa.table({"g": pa.array(walked, pa.int64()), "codes": pa.array([lines[i][first : first + PIECE] for i in walked], pa.string())}))
                states = {i: [] for i in walked}
                for g, state, cost, audit in con.execute(WALK).fetchall():
                    states[g].append((state, cost, audit))
                for i in walked:
                    found[i].states = states[i]
                    if len(lines[i]) > first + PIECE or i == len(found) - 1:
                        give(found[i], found[i].settle())
            for c in found[:-1]:
                give(c, *c.end())
            open_ = found[-1]
            yield batch_of()
        if open_ is not None:
            give(open_, *open_.end())
        yield batch_of()

    return run


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, code, illegal, new_turn: every row in its place, one shuffle by conv_id.

    ``rows`` has conv_id, turn, role, text (no null among the last two), nth (which copy of a row it is) and there:
    false for rows that are gone, which only keep their conversation's id known. Rows come by turn (nulls first), of
    equal turns by role, text and nth.
    """
    turn = F.col("turn").asc_nulls_first()
    place = [turn, "role", "text", "nth"]
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy(turn, "nth")
    along = Window.partitionBy("conv_id", "there").orderBy(*place)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(~F.col("there"), F.lit(None)).when(blank, F.lit("blank")).when(F.row_number().over(same) > 1, F.lit("duplicate")).when(~last.isin(".", "!", "?"), F.lit("truncated"))
    initial, before = F.substring("role", 1, 1), F.lag(F.substring("role", 1, 1)).over(along)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("d")).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    dealt = rows.repartition("conv_id").withColumn("fault", fault)
    illegal = F.col("there") & before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")
    new_turn = F.col("there") & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(along))
    out = dealt.select("conv_id", "turn", "role", "text", "nth", "there", "fault", F.when(F.col("there"), code).alias("code"), illegal.alias("illegal"), new_turn.alias("new_turn"))
    return out.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "there", *place).drop("nth", "there")


def repaired(rows: DataFrame, turns: bool = True) -> DataFrame:
    """A summary of each conversation of ``rows`` (see judged): conv_id, gaps, faults, illegal pairs, cost, audit, hash.

    With ``turns`` also the repaired rows, in order, before the summary of theirs: edit, role and text are filled and
    all else but conv_id is null. A null conv_id is a conversation like others. One without rows has zeros, an empty
    audit and the hash of nothing. Very long texts and conversations are read whole; an empty table gives no rows.
    """
    ship(rows.sparkSession)
    return judged(rows).mapInArrow(_repair(turns), REPAIRED)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations (nulls: one space) after damage by crc32(``conv_id:turn``) % 20, as ``repaired`` takes them.

    0 drops a row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 sets role user. Other columns are left out;
    rows with equal conv_id and turn are damaged alike.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), way.alias("way"))
    text = F.when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("way") != 0).alias("there"), F.explode(copies).alias("nth"))


def op13_turns(spark, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), turns=False).select(*[f.split()[0] for f in SUMMARY.split(", ")])


def _sql() -> str:
    """The same by SQL alone: one walk over all conversations, then each letter of an audit meets its row."""
    edits = ", ".join(f"({s}, '{code}', {to}, {cost}, '{letters}')" for s, code, to, cost, letters in steps())
    endings = ", ".join(f"({s}, {INSERT * n}, '{'I' * n}')" for s, n in ENDINGS.items())
    byte = "('0x' || substr(hex(encode(k)), j + 1, 2))::BIGINT"
    crc = f"""xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, 2 * strlen(k), 2), lambda j: {byte}), lambda c, b:
        list_reduce([xor(c, b)] || range(0, 8), lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
    white = r"[\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE given AS MATERIALIZED (
    SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
ways AS (SELECT *, {crc} % 20 AS way FROM given),
rows_ AS (SELECT g, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(0, CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM ways),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, nth) AS i, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, nth) AS time FROM rows_),
told AS MATERIALIZED (SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY g ORDER BY i) AS before,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN time > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?]{white}*\\z') THEN 'truncated' END AS fault FROM placed),
coded AS MATERIALIZED (SELECT g, i, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(kind) ELSE kind END AS code
    FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS kind FROM told)),
edits(state, code, next, cost, letters) AS (VALUES {edits}),
endings(state, cost, letters) AS (VALUES {endings}),
walk(g, i, state, cost, audit) AS (
    SELECT DISTINCT g, 0::BIGINT, {START}, 0::BIGINT, '' FROM given
    UNION ALL
    SELECT g, i, next, best.cost, best.audit FROM (
        SELECT w.g, c.i, e.next, min({{'cost': w.cost + e.cost, 'audit': w.audit || e.letters}}) AS best
        FROM walk w JOIN coded c ON c.g = w.g AND c.i = w.i + 1 JOIN edits e ON e.state = w.state AND e.code = c.code GROUP BY w.g, c.i, e.next)),
ends AS (SELECT w.g, min({{'cost': w.cost + n.cost, 'audit': w.audit || n.letters}}) AS best
    FROM walk w JOIN endings n USING (state) WHERE w.i = (SELECT count(*) FROM coded c WHERE c.g = w.g) GROUP BY w.g),
letters AS (SELECT g, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS p FROM ends),
done AS (SELECT g, p, audit[p] AS edit, length(replace(audit[:p], 'I', '')) AS i, length(replace(audit[:p], 'D', '')) - 1 AS nth, length(replace(audit, 'D', '')) % 2 AS system FROM letters),
hashed AS (SELECT d.g, sha256(string_agg(CASE WHEN edit = 'K' THEN t.role WHEN (d.nth - d.system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY p)) AS h
    FROM done d LEFT JOIN told t ON t.g = d.g AND t.i = d.i WHERE edit <> 'D' GROUP BY d.g),
counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY g)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM given) c JOIN ends USING (g) LEFT JOIN counts USING (g) LEFT JOIN hashed USING (g)
"""


OP13_SQL = _sql()
