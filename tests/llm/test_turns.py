import hashlib
import itertools
import random
import re
import zlib

import pytest

from framewright.llm import turns

from ..compare import differences, duck


def test_same_as_sql(spark, sf_dir):
    assert differences(turns.op13_turns(spark, sf_dir), duck(sf_dir), turns.OP13_SQL) == []


WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """Least (cost, audit) and its rows over all edits of a few rows, inserts of up to two anywhere."""
    best = ((2 * len(rows), "D" * len(rows)), [])
    fault = faults(rows)

    def walk(i, cost, audit, made, inserts):
        nonlocal best
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
            best = min(best, ((cost, audit), made))
        if inserts < 2:
            for role in ("user", "assistant"):
                walk(i, cost + 5, audit + "I", [*made, (role, "")], inserts + 1)
        if i < len(rows):
            role, text = rows[i]
            walk(i + 1, cost + 2, audit + "D", made, 0)
            if fault[i] not in ("blank", "duplicate"):
                more = 5 if fault[i] else 0
                walk(i + 1, cost + more, audit + "K", [*made, (role, text)], 0)
                for to in ("user", "assistant"):
                    walk(i + 1, cost + 1 + more, audit + "R", [*made, (to, text)], 0)

    walk(0, 0, "", [], 0)
    return best[0][0], best[0][1], "\n".join(f"{r}:{t}" for r, t in best[1])


def plain(rows):
    """The same by a walk over the states of the grammar, with the whole rows kept, for longer conversations."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    at = {0: (0, "")}

    def inserted(states):
        out = dict(states)
        for s, (cost, audit) in states.items():
            for n in (1, 2):
                s = after[s]
                out[s] = min(out.get(s, (1 << 60, "")), (cost + 5 * n, audit + "I" * n))
        return out

    for (role, _), f in zip(rows, faults(rows), strict=True):
        now = {}
        for s, (cost, audit) in inserted(at).items():
            edits = [(s, 2, "D")]
            if f not in ("blank", "duplicate"):
                more = 5 if f else 0
                edits.append((after[s], 1 + more, "R"))
                if s in keeps.get(role[:1], {}):
                    edits.append((keeps[role[:1]][s], more, "K"))
            for to, price, letter in edits:
                now[to] = min(now.get(to, (1 << 60, "")), (cost + price, audit + letter))
        at = now
    done = inserted(at)
    cost, audit = min(done[s] for s in (0, 3) if s in done)
    made, left, odd = [], list(rows), len(audit.replace("D", "")) % 2
    for letter in audit:
        role, text = ("", "") if letter == "I" else left.pop(0)
        if letter != "D":
            made.append((role if letter == "K" else ("user", "assistant")[(len(made) - odd) % 2], text))
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)


def damage(rows):
    """Plain damage of (conv, turn, role, text) rows: rows by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(way, text)
        kept += [(turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def expected(kept, solve):
    rows = [(r, t) for _, r, t in kept]
    known = [t for t, _, _ in kept if t is not None]
    f = faults(rows)
    cost, audit, text = solve(rows)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, code string, there int")


def made(rng, conv, n, roles=("user", "assistant", "user", "assistant", "system", "tool", "", None)):
    texts = ["A b.", "Yes!", "no stop", " ", "\t", "", None, "Why?  ", "x" * 50 + ".", "é."]
    return [(conv, None if rng.random() < 0.05 else i + (rng.random() < 0.1), rng.choice(roles), rng.choice(texts)) for i in range(n)]


def test_same_as_all_edits(spark):
    rng = random.Random(11)
    rows = [r for conv in range(150) for r in made(rng, conv if conv else None, rng.randint(1, 4))]
    want = {conv: expected(kept, brute) for conv, kept in damage(rows).items()}
    got = turns.repaired(turns.damaged(frame(spark, rows).repartition(5)), turns=False).collect()
    assert {r["conv_id"]: tuple(r)[1:9] for r in got} == want and len(got) == len(want)
    assert all(r["edit"] is None for r in got)


def test_long_conversations_go_on_over_batches(spark):
    """Conversations of several Arrow batches and pieces, beside short ones, against a plain walk; the rows that are given hash alike."""
    rng = random.Random(3)
    usual = lambda conv, n: [(conv, i, ("user", "assistant")[i % 2] if rng.random() < 0.9 else rng.choice(("system", "tool", "user")), f"text {i}{rng.choice('.!?.. ')}") for i in range(n)]
    rows = usual(1, 1500) + made(rng, 2, 900, ("tool", "user")) + usual(3, 5) + made(rng, 4, 3) + made(rng, 5, 401)
    want = {conv: expected(kept, plain) for conv, kept in damage(rows).items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        got = turns.repaired(turns.damaged(frame(spark, rows))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["conv_id"]: tuple(r)[1:9] for r in got if r["audit"] is not None} == want
    for conv, w in want.items():
        text = "\n".join(f"{r['role']}:{r['text']}" for r in got if r["conv_id"] == conv and r["edit"])
        assert hashlib.sha256(text.encode()).hexdigest() == w[-1]


def test_conversations_without_rows_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = frame(spark, [(gone, 0, "user", "x")])
    got = turns.repaired(turns.damaged(df)).collect()
    assert [tuple(r)[:9] for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert turns.repaired(turns.damaged(df.limit(0))).collect() == []


def test_very_long_text(spark):
    rows = [(1, 5, "user", "word " * 400_000 + "."), (1, 6, "assistant", "." + " " * 300_000)]
    got = turns.repaired(turns.damaged(frame(spark, rows)), turns=False).collect()
    assert tuple(got[0])[1:9] == expected(damage(rows)[1], brute)


def test_edits_reach_every_end():
    """From each state every code can be passed, so no conversation is without a repair."""
    found = {(s, code) for s, code, *_ in turns.steps()}
    assert found == set(itertools.product(range(4), "dsSuUaAxX"))
    assert {s for s, n in turns.ENDINGS.items() if not n} == {turns.START, turns.ASSISTANT}


@pytest.mark.parametrize("column", ["role", "text", "turn"])
def test_nulls_everywhere(spark, column):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "a.") for i in range(6)]
    rows = [tuple(None if n == column else v for n, v in zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows]
    got = turns.repaired(turns.damaged(frame(spark, rows)), turns=False).collect()
    assert tuple(got[0])[1:9] == expected(damage(rows)[1], plain)
