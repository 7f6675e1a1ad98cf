"""Conversation repair against a recursion over all edits, also where blocks are of one row."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest

from evalforge.llm import conversation_repair as repair

BLANKS = " \t\n\x0b\x0c\r"
SPEC = "conv_id long, turn long, role string, text string, n long, pos long, kind string, op string"


def follows(out: str, q: str) -> bool:
    return q == "s" and out == "" or q == "u" and out in ("", "s", "a") or q == "a" and out == "u"


def brute(rows: list[tuple]) -> tuple:
    """The digest of one conversation's (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, r, x in rows:
        core = x.rstrip(BLANKS)
        faults.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((r, x))

    @functools.cache
    def best(i: int, out: str, inserts: int) -> tuple:
        ways = [(0, "", ())] if i == len(rows) and out in ("", "a") else []
        if i < len(rows):
            cost, audit, lines = best(i + 1, out, 3)
            ways.append((cost + 4, "D" + audit, lines))
            for name, base, letter in [(rows[i][1], 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")]:
                if faults[i] in ("", "truncated") and follows(out, name[:1]):
                    cost, audit, lines = best(i + 1, name[:1], 3)
                    ways.append((cost + base + 3 * (faults[i] == "truncated"), letter + audit, ((name, rows[i][2]), *lines)))
        for name in ("user", "assistant") if inserts else ():
            if follows(out, name[0]):
                cost, audit, lines = best(i, name[0], inserts - 1)
                ways.append((cost + 3, "I" + audit, ((name, ""), *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 3)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()


def damaged(rows: list[tuple]) -> dict:
    said = lambda v: " " if v is None else str(v)
    out: dict = {}
    for c, t, r, x in rows:
        out.setdefault(c, [])
        kind, r, x = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20, said(r), said(x)
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out[c] += [(t, "user" if kind == 4 else r, x)] * (1 + (kind == 3))
    return out


def made() -> list[tuple]:
    draw, rows = random.Random(5), []
    for c in [None, *range(40)]:
        for t in range(draw.choice([1, 2, 3, 5, 9, 40])):
            turn = draw.choice([t, t, t, t, None, t + 3, 0])
            role = draw.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""])
            rows.append((c, turn, role, draw.choice(["Hello.", "What?", "cut off", " \t", "", None, f"Hi {draw.random()}.", "é ", "Fine!\n", "x" * 20000])))
    return rows


@pytest.mark.parametrize("block_rows", [None, 1, 3])
def test_digests(spark, block_rows):
    rows = made()
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SPEC).repartition(3)
    want = {c: brute(r) for c, r in damaged(rows).items()}
    got = {r[0]: tuple(r)[1:] for r in repair.digests(repair.damage(df), df, block_rows=block_rows).collect()}
    assert got == want


def test_repaired_turns(spark):
    rows = made()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = repair.repaired(repair.damage(df), block_rows=2)
    assert out.columns == ["conv_id", "place", "turn", "role", "text", "fault", "edit"]
    by: dict = {}
    for r in sorted(out.collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        by.setdefault(r["conv_id"], []).append(r)
    for c, given in damaged(rows).items():
        lines = by.get(c, [])
        assert [r["place"] for r in lines] == list(range(1, len(lines) + 1))
        want = brute(given)
        assert "".join(r["edit"] for r in lines) == want[-2]
        stay = [r for r in lines if r["edit"] != "D"]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in stay).encode()).hexdigest() == want[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in stay))
        assert [sum(r["fault"] == f for r in lines) for f in ("blank", "duplicate", "truncated")] == list(want[1:4])


def test_one_conversation_of_many_rows_and_empty_tables(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"Line {t // 2}." if t % 7 else "open") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    few, many = (repair.digests(df, df, block_rows=b).collect() for b in (None, 50))
    assert few == many and len(few) == 1 and few[0]["duplicate"] > 0
    assert repair.digests(df.limit(0), df.limit(0)).count() == 0
    alone = repair.digests(df.limit(0), df).first()
    assert tuple(alone) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
