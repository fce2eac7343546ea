"""Conversation repair against exhaustive search, and split conversations against whole ones."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from keelson.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")
OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Least (cost, audit, repaired) over all edit sequences not dearer than deleting everything."""
    best = None

    def go(i, cost, audit, roles, lines):
        nonlocal best
        if cost > 3 * len(rows) or best is not None and cost > best[0]:
            return
        if i == len(rows) and LEGAL.fullmatch(roles):
            found = (cost, audit, lines)
            best = found if best is None or found[:2] < best[:2] else best
        for r in ("user", "assistant"):
            go(i, cost + 2, audit + "I", roles + r[0], (*lines, f"{r}:"))
        if i < len(rows):
            _, role, text, fault = rows[i]
            t = fault == "truncated"
            go(i + 1, cost + 3, audit + "D", roles, lines)
            if fault in ("", "truncated"):
                go(i + 1, cost + t, audit + "K", roles + (role[:1] or "?"), (*lines, f"{role}:{text}"))
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + t, audit + "R", roles + r[0], (*lines, f"{r}:{text}"))

    go(0, 0, "", "", ())
    return best


def by_turn(rows):
    """The least edits of a long conversation, from the end, straight from the rules."""
    rows = list(rows)

    @lru_cache(None)
    def least(i, last, inserted):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        forced = "assistant" if last == "u" else "user"
        if inserted < 3:
            c, a, t = least(i, forced[0], inserted + 1)
            found.append((c + 2, "I" + a, (f"{forced}:", *t)))
        if i < len(rows):
            _, role, text, fault = rows[i]
            c, a, t = least(i + 1, last, 0)
            found.append((c + 3, "D" + a, t))
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                if last + role[:1] in ("s", "u", "su", "ua", "au") and len(role):
                    c, a, t = least(i + 1, role[0], 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = least(i + 1, forced[0], 0)
                found.append((c + 2 + extra, "R" + a, (f"{forced}:{text}", *t)))
        return min(found, default=(10 ** 9, "", ()), key=lambda x: x[:2])

    for i in range(len(rows), 0, -1):
        for last in ("", "s", "u", "a"):
            least(i, last, 0)
    return least(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for turn, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        f = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, f))
    return out


def model(conversations, search=by_turn):
    """What the query returns, by the contract."""
    convs = {}
    for conv, turn, role, text in conversations:
        kept = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        kept.extend([row] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for conv, rows in convs.items():
        rows = faults(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
        turns = [r[0] for r in rows if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, lines = search(rows) if rows else (0, "", ())
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *(sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == OUT
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edits(rows):
    runs = repair.runs_of([repair.symbol(r, f) for _, r, _, f in rows])
    return "".join(e for e, _ in repair.unroll(runs, repair._END, repair.NONE, True)), int((repair.matrix(runs) + repair._END).min(axis=1)[0])


def test_edits_equal_exhaustive_search():
    rnd = random.Random(3)
    for _ in range(400):
        rows = [(0, rnd.choice(["system", "user", "assistant", "tool", ""]), "x", rnd.choice(["", "", "blank", "truncated", "duplicate"]))
                for _ in range(rnd.randint(0, 4))]
        cost, audit, lines = cheapest(rows)
        assert (cost, audit) == by_turn(rows)[:2]
        assert edits(rows) == (audit, cost), rows


def test_runs_equal_single_steps():
    """Long runs go through binary powers; the audit stays that of the row-by-row model."""
    rnd = random.Random(4)
    for _ in range(60):
        rows = []
        for _ in range(rnd.randint(1, 4)):
            rows += [(0, rnd.choice(["system", "user", "assistant", "tool"]), "x", rnd.choice(["", "blank", "truncated"]))] * rnd.randint(1, 60)
        cost, audit, _ = by_turn(rows)
        assert edits(rows) == (audit, cost)
    audit, cost = edits([(0, "user", "x", "")] * 5000)
    assert cost == 5000 and len(audit) == 5000


def _rows(seed, convs, size):
    rnd = random.Random(seed)
    words = ["Yes.", "No", "what?", "", "  ", "a. ", "b\n", "c!", None, "é."]
    out = [(c, rnd.choice([None, *range(size)]) if rnd.random() < .2 else t, rnd.choice(["system", "user", "assistant", None, "tool", "User", "stranger", ""]),
            rnd.choice(words) if rnd.random() < .4 else f"text {rnd.random()}.") for c in [*range(convs), None] for t in range(rnd.randint(1, size))]
    return out + out[:3]


def _frame(spark, rows):
    full = [(*r, "x", 1, "y") for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, edit string, part long, fault string")


@pytest.mark.parametrize("range_bytes", [1 << 24, 300])
def test_damaged_conversations_equal_model(spark, monkeypatch, range_bytes):
    """Small ranges split most conversations; nulls, ties, repeated rows, foreign roles and clashing columns included."""
    monkeypatch.setattr(repair, "RANGE_BYTES", range_bytes)
    rows = _rows(5, 25, 12)
    got = result(repair.report(repair.damage(_frame(spark, rows)), live_col="live"))
    assert got == model(rows)


def test_one_hot_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "RANGE_BYTES", 2000)
    rows = [(7, t, "user" if t % 3 else "assistant", f"t{t % 50}." if t % 7 else "cut") for t in range(600)] + _rows(6, 5, 6)
    got = result(repair.report(repair.damage(_frame(spark, rows)), live_col="live"))
    assert got == model(rows)


def test_edits_rebuild_the_report(spark, monkeypatch):
    """``repair`` returns the repaired turns themselves."""
    monkeypatch.setattr(repair, "RANGE_BYTES", 400)
    rows = _rows(8, 8, 8)
    convs = {}
    for r in sorted(repair.repair(repair.damage(_frame(spark, rows)), live_col="live").collect(), key=lambda r: (r.part, r.step)):
        convs.setdefault(r.conv_id, []).append(r)
    want = {m[0]: m for m in model(rows)}
    assert set(convs) == set(want)
    for conv, found in convs.items():
        assert "".join(r.edit for r in found if r.edit != "X") == want[conv][7]
        text = "\n".join(f"{r.role}:{r.text}" for r in found if r.role is not None)
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv][8]


def test_empty_table(spark):
    assert result(repair.report(repair.damage(_frame(spark, [])), live_col="live")) == []


def test_extreme_turns(spark):
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    got = result(repair.report(_frame(spark, rows)))
    assert got[0][1] == (1 << 63) - 1 and got[0][7] == "KK"
