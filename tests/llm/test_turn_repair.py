"""Conversation repair against a search over all edits, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import turn_repair as R

KIND = "conv_id long, turn long, role string, text string"
GOAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        pick = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if pick:
            out += [(t, "user" if pick == 4 else role, "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text)] * (2 if pick == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def cheapest(rows):
    """(cost, audit, roles and texts): edits in order of cost, then audit, until one gives legal turns."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, kept = heapq.heappop(heap)
        roles = "".join(r[:1] or "-" for r, _ in kept)
        if i == len(rows) and GOAL.fullmatch(roles):
            return cost, audit, kept
        if (i, roles[-1:]) in done or not re.fullmatch("s?(ua)*u?", roles):
            continue
        done.add((i, roles[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*kept, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, kept))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*kept, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, (*kept, (new, text))))


def brute(rows):
    rows = damaged(rows)
    seen, marked = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        marked.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    cost, audit, kept = cheapest(marked)
    turns = [t for t, _, _ in rows if t is not None]
    count = lambda f: sum(x == f for _, _, x in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def held(spark, rows, **kw):
    got = R.repair(spark.createDataFrame(rows, KIND).repartition(3), **kw).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def of(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return {c: brute(x) for c, x in by.items()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = ["yes.", "no", "why?", " ", "", "\n\t", "é ü.", "ok!  \n", "well"]
    out = []
    for c in range(150):
        n = r.choice([1, 2, 3, 5, 8, 11])
        t = r.randint(-3, 3)
        for i in range(n):
            t += r.choice([1, 1, 1, 1, 2])
            role = ["user", "assistant"][i % 2] if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", "", None, "Usher", "us"])
            if i == 0 and r.random() < 0.3:
                role = "system"
            text = r.choice(texts) + (str(r.randint(0, 4)) + "." if r.random() < 0.6 else "")
            out.append((c, None if r.random() < 0.05 else t, role, None if r.random() < 0.05 else text))
    return out + [(None, 0, "user", "a."), (None, 1, "assistant", "b")]


def test_repair_matches_a_search_over_all_edits(spark, rows):
    got, want = held(spark, rows), of(rows)
    assert got == want
    assert sum(x[5] > 4 for x in want.values()) > 30 and any(not x[6] for x in want.values())


def test_conversations_in_pieces_are_repaired_alike(spark, rows):
    assert held(spark, rows, span=2) == held(spark, rows)


def test_long_conversations_and_rows_of_one_turn(spark):
    r = random.Random(8)
    many = [(1, i, r.choice(["user", "assistant"]), f"text {r.randint(0, 900)}.") for i in range(1500)]
    tied = [(2, None, r.choice(["user", "assistant"]), f"text {i}.") for i in range(60)]
    got = held(spark, many + tied, span=16)
    assert got == of(many + tied)
    assert got == held(spark, many + tied)


def test_solver_uses_each_start_and_end():
    rows = [("u", False, False), ("a", False, True), ("a", True, False), ("s", False, False), ("u", False, True)]
    for a in range(4):
        for b in range(4):
            found = R.solve(rows, a, (b,))
            assert (found is None) == (b == R.START and a != R.START or b == R.SYSTEM and a > R.SYSTEM), (a, b)
    assert R.solve(rows) == min(R.solve(rows, R.START, (e,)) for e in (R.START, R.ASSISTANT))
    assert R.solve([]) == (0, "") and R.solve([], R.USER) == (2, "I")


def test_odd_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert not R.repair(none).count() and len(R.repair(none).columns) == 9
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = R.repair(spark.createDataFrame([(7, gone, "user", "x", 1)], KIND + ", _c long")).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    long = "word " * 400_000
    assert held(spark, [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", long + "!")]) == of([(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", long + "!")])
