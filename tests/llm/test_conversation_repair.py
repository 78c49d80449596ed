import hashlib
import random
import zlib
from heapq import heappop, heappush

import duckdb
import pytest

from scholarlake.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, copy string, letters string, head int, n int, digest string"
SPACE = " \t\n\v\f\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "x", 1, None, "y") for r in rows], SCHEMA)


def cheapest(rows):
    """Uniform-cost search over (rows read, state); among equal costs the ASCII-least audit comes first. rows: (initial, fault)."""
    todo, seen = [(0, "", 0, "start", ())], set()
    while todo:
        cost, audit, i, state, made = heappop(todo)
        if i == len(rows) and state in ("start", "pair"):
            return cost, audit, made
        if (i, state) in seen:
            continue
        seen.add((i, state))
        wanted = "a" if state == "user" else "u"
        after = {"u": "user", "a": "pair"}[wanted]
        heappush(todo, (cost + 2, audit + "I", i, after, (*made, (None, wanted))))
        if i < len(rows):
            c, fault = rows[i]
            heappush(todo, (cost + 3, audit + "D", i + 1, state, made))
            if fault < 2:
                heappush(todo, (cost + 2 + fault, audit + "R", i + 1, after, (*made, (i, wanted))))
                if c == wanted:
                    heappush(todo, (cost + fault, audit + "K", i + 1, after, (*made, (i, None))))
                if c == "s" and state == "start":
                    heappush(todo, (cost + fault, audit + "K", i + 1, "system", (*made, (i, None))))


def brute(rows, damage=True):
    out, held = {}, {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        seen, coded = set(), []
        for _, role, text in turns:
            bare = text.strip(SPACE)
            coded.append((role[:1], 2 if not bare else 3 if (role, text) in seen else 0 if bare[-1] in ".!?" else 1))
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        cost, audit, made = cheapest([(c if c in ("s", "u", "a") else "o", f) for c, f in coded])
        lines = [f"{ {'u': 'user', 'a': 'assistant'}[w] if w else turns[i][1]}:{'' if i is None else turns[i][2]}" for i, w in made]
        faults = [f for _, f in coded]
        pairs = [a + b for (a, _), (b, _) in zip(coded, coded[1:], strict=False)]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, faults.count(2), faults.count(3), faults.count(1), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n=60):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(0, 9)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.5 else ["user", "assistant"][turn % 2]
            role = r.choice(["system", "tool", None, "", "Ärzte"]) if r.random() < 0.12 else "system" if turn == 0 and r.random() < 0.4 else role
            text = r.choice(["Yes.", "No", "  ", "\t\n\x0b", None, "", "why?  ", "so. \x85", " ", "é!\r\n", "end. x"])
            rows.append((conv if conv % 17 else None, None if r.random() < 0.1 else turn + 2 * (r.random() < 0.2), role, text))
    return rows


def as_dict(found):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_search_over_all_edits(spark, seed):
    rows = conversations(seed)
    turns = frame(spark, rows)
    assert as_dict(C.repair_all(turns, C.damaged(turns))) == brute(rows)
    assert as_dict(C.repair(turns)) == brute(rows, damage=False)


def test_sql_agrees(spark):
    rows = [r for r in conversations(7, 40) if r[2] != "Ärzte"]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute(C.OP13_SQL).fetchall()} == brute(rows)


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_segments_give_what_one_chart_gives(segment):
    r = random.Random(4)
    for _ in range(200):
        rows = [(r.choice("suao"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randrange(0, 12))]
        cost, audit, _ = cheapest(rows)
        assert C.parse("".join(C._LETTERS[f"{c}{f}"] for c, f in rows), segment) == (cost, audit)


def test_a_long_conversation_over_many_tasks(spark, monkeypatch):
    r = random.Random(9)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), f"{t // 3 if r.random() < 0.2 else t}.") for t in range(1500)]
    rows += [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    turns = frame(spark, rows).repartition(7)
    assert as_dict(C.repair(turns)) == brute(rows, damage=False)


def test_repeats_in_great_number(spark):
    rows = [(1, 0, "user", "hi.")] * 400 + [(1, 1, "assistant", "ho.")] * 3 + [(1, None, "user", "hi.")]
    assert as_dict(C.repair(frame(spark, rows))) == brute(rows, damage=False)


def test_empty(spark):
    turns = frame(spark, [])
    assert C.repair_all(turns, C.damaged(turns)).count() == 0
