"""Conversation repair against a plain best-first search over whole conversations, and awkward tables."""

import hashlib
import heapq
import random
import zlib

import pytest

from causal_panel.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_repair(rows):
    """(cost, audit, repaired lines) of (role, text, must go, truncated) rows: states are settled in order of (cost, audit)."""
    heap, settled = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in settled:
            continue
        settled.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        want = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, want[0], [*lines, want + ":"]))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if not gone:
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, want[0], [*lines, f"{want}:{text}"]))
                if role[:1] == want[0] or role[:1] == "s" and last == "":
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, role[0], [*lines, f"{role}:{text}"]))


def brute_summary(rows):
    """What ``repair_summary`` says of one conversation's (turn, role, text) rows."""
    rows = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()),
    )
    seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = brute_repair([(r, x, f in ("blank", "duplicate"), f == "truncated") for (_, r, x), f in zip(rows, faults)])
    return (gaps, *counts.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def summaries(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    return {r[0]: tuple(r)[1:] for r in repair.repair_summary(turns, turns).collect()}


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def drawn(rng, conv, n):
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "u", "", None], ["Yes.", "No!", "open", "", " \n", "Why?  ", "so.\t\n", None]
    return [(conv, rng.choice([None, *range(12)]) if rng.random() < 0.3 else t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"Line {rng.randrange(n)}.") for t in range(n)]


def test_search_finds_the_cheapest_edits_of_every_entry_and_exit():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice("suaax"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randrange(0, 9))]
        names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
        cost, audit, _ = brute_repair([(names[i], "", f == repair.GONE, f == repair.CUT) for i, f in rows])
        assert repair.cheapest_edits(rows) == (cost, audit)
        cut = rng.randrange(len(rows) + 1)  # through any middle, the same edits
        joined = []
        for state in repair.STATES:
            one, two = repair.cheapest_edits(rows[:cut], repair.START, (state,)), repair.cheapest_edits(rows[cut:], state)
            joined.append((one[0] + two[0], one[1] + two[1]))
        assert min(joined) == (cost, audit)


def test_ties_go_to_the_least_audit():
    assert repair.cheapest_edits([("u", 0)]) == (3, "KI")
    assert repair.cheapest_edits([("a", 0)]) == (3, "IK")
    assert repair.cheapest_edits([("s", 0)]) == (4, "D")
    assert repair.cheapest_edits([("u", 0), ("u", 0)]) == (3, "KR")
    assert repair.cheapest_edits([("u", 0), ("x", 2), ("a", 0)]) == (4, "KDK")
    assert repair.cheapest_edits([]) == (0, "")


def test_conversations_match_the_plain_search(spark):
    rng = random.Random(5)
    rows = [r for conv in [None, *range(60)] for r in drawn(rng, conv, rng.randrange(1, 12))]
    rng.shuffle(rows)
    found = summaries(spark, rows)
    assert found == {conv: brute_summary(mine) for conv, mine in by_conversation(rows).items()}


def test_one_conversation_over_many_ranges_and_one_row_repeated(spark):
    rng = random.Random(7)
    rows = drawn(rng, 1, 900) + [(2, 5, "user", "Same.")] * 300 + [r for c in range(3, 20) for r in drawn(rng, c, 5)]
    rng.shuffle(rows)
    found = summaries(spark, rows)
    assert found == {conv: brute_summary(mine) for conv, mine in by_conversation(rows).items()}
    assert found[2] == (0, 0, 299, 0, 299, 4 * 299 + 3, found[2][6], found[2][7]) and sorted(found[2][6]) == ["D"] * 299 + ["I", "K"]


def test_repaired_turns_are_what_the_digest_is_of(spark):
    rng = random.Random(11)
    turns = spark.createDataFrame([r for conv in range(20) for r in drawn(rng, conv, 7)], SCHEMA)
    repairs = repair.structure_repairs(turns)
    lines = {}
    for r in sorted(repair.repaired_turns(turns, repairs).collect(), key=lambda r: (r.conv_id, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(lines[r.conv_id]) - 1
    for r in repair.repaired_digests(turns, repairs).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest()
    for said in lines.values():
        initials = "".join(line[0] for line in said)
        assert initials.lstrip("s") == "ua" * (len(initials.lstrip("s")) // 2) and initials.count("s") <= 1


def test_damage_and_what_it_leaves_of_nothing(spark):
    die = lambda conv, turn: zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    rows = [(c, t, "assistant", "A. b! c? d") for c in [None, *range(40)] for t in (None, 0, 1)]
    kept = []
    for conv, turn, role, text in rows:
        d = die(conv, turn)
        if d:
            row = (conv, turn, "user" if d == 4 else role, "" if d == 1 else "A b c d" if d == 2 else text)
            kept += [row] * (2 if d == 3 else 1)
    key = lambda r: tuple(map(str, r))
    original = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, repair.damaged(original).collect()), key=key) == sorted(kept, key=key)
    gone = next(c for c in range(10_000) if die(c, 3) == 0)
    lone = spark.createDataFrame([(gone, 3, "user", "Hello.")], SCHEMA)
    assert [tuple(r) for r in repair.repair_summary(lone, repair.damaged(lone)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", None)], [(1, 0, None, "x" * 200_000 + ".")]])
def test_empty_and_awkward_tables(spark, rows):
    clash = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", part int, digest string, cost int")
    found = {r[0]: tuple(r)[1:] for r in repair.repair_summary(clash, clash).collect()}
    assert found == {conv: brute_summary(mine) for conv, mine in by_conversation(rows).items()}
