"""Conversation repair against a search of all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from workpulse.llm import repair

ROWS = "conv_id bigint, turn bigint, role string, text string, audit int, cost int, mark int, copies int"
FULL = re.compile(r"(s?(ua)+)?")


def _all_edits(rows):
    """The cheapest edits of (initial, fault) rows by trying every string of edits in order of (cost, text): nothing but the rules."""
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, roles = heapq.heappop(queue)
        if i == len(rows) and FULL.fullmatch(roles):
            return audit, cost
        # What can still be reached depends on the row, the last role and whether anything stands before it.
        key = (i, roles[-1:], len(roles) > 1)
        if (key, "done") in seen:
            continue
        seen.add((key, "done"))

        def fits(role):
            return re.fullmatch(r"s?(ua)*u?", roles + role)

        for role in "ua":
            if fits(role):
                heapq.heappush(queue, (cost + 2, audit + "I", i, roles + role))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, roles))
            if fault != repair.GONE:
                extra = 1 if fault == repair.TRUNCATED else 0
                if initial in "sua" and fits(initial):
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, roles + initial))
                for role in "ua":
                    if fits(role):
                        heapq.heappush(queue, (cost + 2 + extra, audit + "R", i + 1, roles + role))


def _codes(rows):
    return bytes(3 * "sua?".index(initial) + fault for initial, fault in rows)


def test_every_short_conversation():
    kinds = list(itertools.product("sua?", range(3)))
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert repair.cheapest(_codes(rows)) == _all_edits(rows), rows


def test_longer_conversations():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("suuaaa?"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(4, 14))]
        assert repair.cheapest(_codes(rows)) == _all_edits(rows), rows


def test_a_conversation_of_very_many_rows():
    """All rows out of place, and the work stays linear: every third row is a user beside a user."""
    audit, cost = repair.cheapest(_codes([("u", 0), ("a", 0), ("u", 0)] * 30_000))
    assert len(audit) >= 90_000 and cost <= 3 * 30_000 + 4


WHITE = " \t\n\x0b\x0c\r"


def _expected(rows, damage=True):
    conversations = {}
    for conv_id, turn, role, text in rows:
        kept = conversations.setdefault(conv_id, [])
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv_id, kept in conversations.items():
        kept.sort()
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, _, role, _, text in kept:
            end = text.rstrip(WHITE)
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role[:1] if role[:1] in "sua" and role else "?", {None: 0, 0: 1, 1: 1, 2: 2}[fault]))
        audit, cost = _all_edits(marked)
        lines, at, last = [], 0, ""
        for edit in audit:
            row = kept[at] if edit != "I" else None
            at += edit != "I"
            if edit == "D":
                continue
            role = row[2] if edit == "K" else "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{row[4] if row else ''}")
        turns = [row[1] for row in kept if row[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        out.append((str(conv_id), gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, 3, 4) for row in rows], ROWS).repartition(3)


def _got(frame):
    return sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect())


TEXTS = ["Yes.", "No!", "What?  \n", "cut off", "", " \t\r\n", None, "é.", "é", "... ", "a ", "Long. " * 400]
ROLES = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    rows = [(c if c else None, rng.choice([None, *range(-2, 9)]), rng.choice(ROLES), rng.choice(TEXTS)) for c in range(120) for _ in range(rng.randint(1, 9))]
    return rows + [(500, t, "user", "Same.") for t in range(300)] + [(501, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(300)]


def test_damaged_rows(spark, odd):
    assert _got(repair.digest(repair.damaged(_frame(spark, odd)))) == _expected(odd)


def test_rows_as_they_are(spark, odd):
    assert _got(repair.digest(repair.undamaged(_frame(spark, odd)))) == _expected(odd, damage=False)


def test_rows_of_one_conversation_over_many_batches(spark, odd):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _got(repair.digest(repair.damaged(_frame(spark, odd)))) == _expected(odd)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_rows_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert _got(repair.digest(repair.damaged(_frame(spark, [(gone, 0, "user", "Hello.")])))) == [
        (str(gone), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]


def test_no_rows(spark):
    assert repair.digest(repair.damaged(_frame(spark, []))).collect() == []
    assert repair.repaired(repair.damaged(_frame(spark, []))).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "What"), (1, 2, "user", ""), (2, 0, "system", "Be kind."), (3, 5, "tool", "x.")]
    got = sorted(tuple(r) for r in repair.repaired(repair.undamaged(_frame(spark, rows))).collect())
    assert [row[2] for row in got if row[0] == 1] == list(_all_edits([("a", 0), ("u", 2), ("u", 1)])[0])
    kept = [row[3] for row in got if row[0] == 1 and row[2] != "D"]
    assert FULL.fullmatch("".join(role[0] for role in kept))
    assert [row[2:] for row in got if row[0] == 2] == [("D", "system", "Be kind.")]
    assert [row[2:] for row in got if row[0] == 3] == [("D", "tool", "x.")]
