"""Repaired conversations against an exhaustive search, whatever the blocks."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tracelake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, pos string, block string, code string"
WS = " \t\n\v\f\r"


def brute(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, lines) of rows (role, text) in order."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.strip(WS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for r, _ in rows]

    def put(state, initial):
        """The state after a line: '' at first, else the last initial; None if it may not stand there."""
        return initial if (initial == "s" and state == "") or (initial == "u" and state in ("", "s", "a")) or (initial == "a" and state == "u") else None

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for role in ("user", "assistant"):
                if put(state, role[0]):
                    c, a, out = best(i, role[0], inserts + 1)
                    found.append((c + 2, "I" + a, ((role, ""), *out)))
        if i < len(rows):
            c, a, out = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                t = faults[i] == "truncated"
                for edit, role, cost in (("K", rows[i][0], 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if put(state, role[:1]) and role[:1] in "sua":
                        c, a, out = best(i + 1, role[:1], 0)
                        found.append((c + cost + t, edit + a, ((role, rows[i][1]), *out)))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, lines


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (kind != 0) * (2 if kind == 3 else 1)
    return out


def expected(rows):
    after = damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        turns = [r[1] for r in mine if r[1] is not None]
        *counts, lines = brute(tuple((r[2], r[3]) for r in mine))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def some_rows(rng, convs, most):
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"], ["Yes.", "No", "Ok!", "", " \n", None, "Why?  ", "ok.\x1f", "é", "a" * 70 + ".", "a" * 70 + "b."]
    return [(rng.choice(convs), rng.choice([None, *range(most)]), rng.choice(roles), rng.choice(texts)) for _ in range(most * 2)]


@pytest.mark.parametrize("seed", range(30))
def test_walk_against_search(seed):
    rng = random.Random(seed)
    rows = tuple((rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!", "d?", "e"])) for _ in range(rng.randrange(1, 14)))
    blank, duplicate, truncated, _, cost, audit, lines = brute(rows)
    seen, codes = set(), ""
    for role, text in rows:
        fault = 2 if not text else 3 if (role, text) in seen else int(text[-1] not in ".!?")
        seen.add((role, text))
        codes += f"{('sua'.find(role[0]) % 4) * 4 + fault:x}"
    got = repair.walk(codes, repair._END, repair.NONE, True)
    assert (got[4], got[0]) == (cost, audit)
    assert len(got[1]) == len(lines)
    # parts of it give the same: matrices, checkpoints and walks from each state
    for cut in range(1, len(codes)):
        after = tuple(np.minimum((repair.block_matrix(codes[cut:]) + np.array(repair._END)).min(1), repair._FAR).tolist())
        one = repair.walk(codes[:cut], after, repair.NONE, False)
        two = repair.walk(codes[cut:], repair._END, one[3], True)
        assert one[0] + two[0] == audit and one[4] + two[4] == cost


@pytest.mark.parametrize("bits", [1, 10])
def test_repair_query_against_search(spark, tmp_path, monkeypatch, bits):
    rng = random.Random(bits)
    rows = some_rows(rng, [1, 2, 3, None], 12) + [(9, t, "user" if t % 2 else "assistant", f"t{t}" + "." * (t % 3)) for t in range(40)] + [(100 + i, i, "user", "Hi.") for i in range(60)]
    rows += rows[:5]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(*r, "p", "b", "c") for r in rows], SCHEMA).repartition(3).write.parquet(path)
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(repair.repair, "__defaults__", (bits,))
    got = repair.op13_repair(spark, str(tmp_path)).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_repair_of_no_rows(spark):
    done = repair.repair(spark.createDataFrame([], SCHEMA))
    assert done.report.count() == 0 and repair.digests(done.turns).count() == 0
