"""Turn repair: audits against every possible edit, blocks against whole conversations, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from pagewright.llm import turn_repair as repair

LEGAL = re.compile("(s?(ua)+)?")


def cheapest(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """The least (cost, audit) by trying every way to edit and insert; turns are (initial, fault)."""
    ways = [((0, "", ""),)]
    for initial, fault in turns:
        stays = [] if fault in (1, 2) else [(3 * (fault == 3), "K", initial), *((3 + 3 * (fault == 3), "R", x) for x in "ua")]
        inserts = [(3 * n, "I" * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
        ways.append([(a + b, i + e, x + y) for a, i, x in inserts for b, e, y in [(4, "D", ""), *stays]])
    ways.append([(3 * n, "I" * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)])
    return min((sum(w[0] for w in way), "".join(w[1] for w in way)) for way in itertools.product(*ways) if LEGAL.fullmatch("".join(w[2] for w in way)))


def coded(turns: list[tuple[str, int]]) -> bytes:
    return bytes(repair.INITIALS.get(i, 9) + (0, 1, 1, 2)[f] for i, f in turns)


def test_audits_against_every_edit():
    rnd = random.Random(2)
    cases = [[(rnd.choice("suax"), rnd.choice((0, 0, 0, 1, 3))) for _ in range(rnd.randint(0, 3))] for _ in range(150)]
    n = len(cases)
    found, cost, _ = repair.audits([coded(c) for c in cases], np.tile(repair.ENDS, (n, 1)), np.zeros(n, int), np.ones(n, bool))
    for case, audit, least in zip(cases, found, cost):
        assert (least, audit) == cheapest(case), case


def plain(rows: list[tuple]) -> tuple:
    """Result of one conversation's (turn, role, text) rows by a forward search over (state, audit)."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    numbers = [t for known, t, _, _ in rows if known]
    faults, seen, judged = [0, 0, 0, 0], set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3
        seen.add((role, text))
        faults[fault] += 1
        judged.append((role[:1], fault))
    moves = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    best = {0: (0, "", ())}

    def relaxed(best):
        for _ in range(2):
            for q, (c, a, out) in list(best.items()):
                to, role = (3, "assistant") if q == 2 else (2, "user")
                if to not in best or (c + 3, a + "I") < best[to][:2]:
                    best[to] = (c + 3, a + "I", (*out, (role, "")))
        return best

    for (initial, fault), (_, _, role, text) in zip(judged, rows):
        after: dict = {}
        for q, (c, a, out) in relaxed(best).items():
            options = [(q, c + 4, "D", ())]
            if fault in (0, 3):
                options.append((3, c + 3 + fault, "R", (("assistant", text),)) if q == 2 else (2, c + 3 + fault, "R", (("user", text),)))
                if (initial, q) in moves:
                    options.append((moves[initial, q], c + fault, "K", ((role, text),)))
            for to, cost, letter, more in options:
                if to not in after or (cost, a + letter) < after[to][:2]:
                    after[to] = (cost, a + letter, (*out, *more))
        best = after
    cost, audit, out = min(v for q, v in relaxed(best).items() if q in (0, 3))
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(judged, judged[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *faults[1:], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def random_rows(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", " ", "", "Well!", "é…", "a\nb.", "Hm"]
    roles = ["user", "assistant", "system", "tool", "", "umbrella"]
    rows = [(c, rnd.choice([None, *range(9), 40]), rnd.choice(roles[:3] * 3 + roles), rnd.choice(texts) + str(rnd.randint(0, 3)) * rnd.randint(0, 1)) for c in [None, *range(60)] for _ in range(rnd.randint(1, 12))]
    # One conversation that holds a third of the rows, and one that is all the same turn.
    rows += [(99, n, ("user", "assistant")[n * 7 % 3 > 0], f"Turn {n % 50}{'.!?,'[n % 4]}") for n in range(200)] + [(98, 1, "user", "Same.")] * 60
    return rows


@pytest.mark.parametrize("long, chars", [(4096, 8 << 20), (5, 8 << 20), (0, 8 << 20), (7, 12)])
def test_repair_whole_and_in_blocks(spark, monkeypatch, long, chars):
    monkeypatch.setattr(repair, "LONG", long)
    monkeypatch.setattr(repair, "BLOCK_CHARS", chars)
    rows = random_rows(long)
    given = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(given).collect()}
    want = {c: plain([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_rows_that_are_gone_leave_their_conversation(spark, monkeypatch):
    for long in (4096, 0):
        monkeypatch.setattr(repair, "LONG", long)
        given = spark.createDataFrame([(1, 0, "user", "Hi.", True), (1, None, None, None, True), (2, None, None, None, False)], "conv_id long, turn long, role string, text string, gone boolean")
        got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(given).collect()}
        empty = hashlib.sha256(b"").hexdigest()
        assert got == {1: (0, 0, 0, 0, 0, 0, "", empty), 2: (0, 1, 0, 0, 0, 4, "D", empty)}
    assert repair.repair(given.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", f"Text. {t}? Yes!") for c in (1, 2, None) for t in (*range(60), None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [str((c, t, "user" if kind == 4 else role, text, kind == 0))] * (1 + (kind == 3))
    assert sorted(str(tuple(r)) for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()) == sorted(want)


def test_very_long_text_and_a_long_conversation(spark):
    rows = [(1, n, ("user", "assistant")[n % 2], "word " * 200_000 + ".") for n in range(3)] + [(2, n, ("user", "assistant")[n % 2], f"t{n}.") for n in range(9000)]
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert (got[1]["audit"], got[1]["cost"], got[1]["duplicate"]) == ("KKD", 4, 1)
    assert got[2]["audit"] == "K" * 9000 and got[2]["cost"] == 0
    assert got[2]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[3:]).encode()).hexdigest()
