"""Conversation repair against a search over all strings of edits, whole and in segments."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from lodestar.llm import conversations as C

ROLES = {"u": "user", "a": "assistant"}
VALID = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """(cost, audit, repaired) by a search over paths in order of (cost, letters); the state is the initials that are left."""
    seen_rows, faults = set(), []
    for role, text in rows:
        ink = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen_rows else "truncated" if ink[-1] not in ".!?" else "")
        seen_rows.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and VALID.fullmatch(initials):
            return cost, letters, "\n".join(out), faults
        # What may follow hangs on the last initials alone.
        if (i, initials[-1:], len(initials) > 1) in done:
            continue
        done.add((i, initials[-1:], len(initials) > 1))

        def push(letter, price, role=None, text="", used=0):
            now = initials + (role[:1] if role else "")
            if role is None or any(VALID.fullmatch(now + more) for more in ("", "a", "ua")):
                heapq.heappush(heap, (cost + price, letters + letter, i + used, now, out if role is None else (*out, f"{role}:{text}")))

        for role in ROLES.values():
            push("I", 5, role)
        if i < len(rows):
            role, text = rows[i]
            push("D", 2, used=1)
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                push("K", more, role or " ", text, 1)
                for new in ROLES.values():
                    push("R", 1 + more, new, text, 1)
    raise AssertionError


def expected(rows):
    """Rows of (conv_id, turn, role, text) in file order to the contract's results."""
    by = {}
    for conv, turn, role, text in rows:
        mine = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        cost, audit, text, faults = brute([r[1:] for r in mine])
        turns = {r[0] for r in mine} - {None}
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def made_up(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        for t in range(rng.randrange(1, longest)):
            turn = rng.choice([t, t, t, t, t + 1, None])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((c, turn, role, rng.choice(["Yes.", "No!", "Is it?", "a b.\n", "open", "  ", "", None, f"One {rng.randrange(5)}."])))
    return rows


@pytest.mark.parametrize("longest", [6, 30])
def test_equals_search(spark, longest):
    rows = made_up(longest, 60, longest)
    assert found(C.repaired(spark.createDataFrame(rows, SCHEMA).coalesce(1))) == expected(rows)


@pytest.mark.parametrize("segment", [1, 7])
def test_segments_equal_whole(spark, segment):
    rows = made_up(5, 12, 40)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert found(C.repaired(df, max_rows=0, segment=segment)) == expected(rows)
    assert found(C.repaired(df, max_bytes=20, segment=segment)) == expected(rows)


def test_one_conversation_holds_nearly_all(spark):
    """In segments no task gets more rows of it than a segment; all of its rows are equal, then all differ."""
    for text in (lambda t: "Same.", lambda t: f"Turn {t}."):
        rows = [(7, t, "user" if t % 2 == 0 else "assistant", text(t)) for t in range(600)] + [(8, 0, "user", "A?"), (8, 1, "assistant", "B.")]
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        assert found(C.repaired(df, max_rows=50, segment=64)) == expected(rows)


def test_cases(spark):
    assert C.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Lost."), (None, None, None, None)]
    long = "word " * 200_000 + "end."
    rows += [(5001, 1, "user", long), (5001, 2, "assistant", long)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", __c int, fault string").coalesce(1)
    got = found(C.repaired(df))
    assert got == expected(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_letters_are_least():
    """Two equal ends: deleting both rows (DD) costs as much as two new roles and nothing inserted costs less."""
    assert C.repair([0, 1], ["tool", "tool"], ["A.", "B."], [0, 0])[5:7] == (2, "RR")
    assert C.repair([0], ["user"], ["A."], [0])[5:7] == (2, "D")
    assert C.repair([], [], [], []) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
