import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """(role, text) in order -> blank, duplicate, truncated or '' each."""
    out, seen = [], set()
    for r in rows:
        said = r[1].rstrip(SPACE)
        out.append("blank" if not said else "duplicate" if r in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add(r)
    return out


def plain(rows):
    """Cost, audit and repaired turns by carrying the least (cost, audit) back from the end."""
    bad, n = faults(rows), len(rows)
    want = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserted=0):
        options = [(0, "", ())] if i == n and last in ("", "a") else []

        def add(cost, letter, turn, rest):
            options.append((cost + rest[0], letter + rest[1], turn + rest[2]))

        full = {"u": "user", "a": "assistant"}[want[last]]
        if inserted < 2:
            add(3, "I", ((full, ""),), best(i, want[last], inserted + 1))
        if i < n:
            role, text = rows[i]
            add(4, "D", (), best(i + 1, last))
            if bad[i] not in ("blank", "duplicate"):
                extra = 3 * (bad[i] == "truncated")
                first = role[:1]
                if first == want[last] or first == "s" and last == "":
                    add(extra, "K", ((role, text),), best(i + 1, first))
                add(3 + extra, "R", ((full, text),), best(i + 1, want[last]))
        return min(options, default=(10 ** 9, "", ()))

    return best(0, "")


def expected(rows):
    """Report of a conversation's (turn, role, text), null turns None."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    said = [(role, text) for _, role, text in rows]
    bad, turns = faults(said), {t for t, _, _ in rows if t is not None}
    cost, audit, fixed = plain(said)
    text = "\n".join(f"{r}:{t}" for r, t in fixed)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"),
            sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def measured(got):
    hashed = repair.digests(got.turns, F.concat("role", F.lit(":"), "text"))
    rows = repair.join_id(got.report, hashed, "conv_id", "conv_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.digest or empty) for r in rows}


def check(spark, rows):
    by_id: dict = {}
    for c, *rest in rows:
        by_id.setdefault(c, []).append(tuple(x if k == 0 else x or "" for k, x in enumerate(rest)))
    got = measured(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert got == {c: expected(r) for c, r in by_id.items()}


def some_rows(rnd, conv, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", ""]
    texts = ["Hello.", "yes", "No!", "", " \t", "what?", "hm", "ok. \n", "end,"]
    return [(conv, t if rnd.random() < .9 else None, rnd.choice(roles), rnd.choice(texts)) for t in sorted(rnd.choices(range(2 * n), k=n))]


def test_plain_version_equals_all_edit_scripts():
    """All scripts of small conversations, checked by the pattern itself."""
    rnd = random.Random(1)
    for _ in range(60):
        rows = [(r, t) for _, _, r, t in some_rows(rnd, 0, rnd.randint(0, 3))]
        bad, best = faults(rows), None
        stack = [(0, 0, "", "")]
        while stack:
            i, cost, audit, initials = stack.pop()
            if cost > 4 * len(rows) or best and cost > best[0]:
                continue
            if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
                best = min(best or (10 ** 9, ""), (cost, audit))
            stack += [(i, cost + 3, audit + "I", initials + c) for c in "ua"]
            if i < len(rows):
                stack.append((i + 1, cost + 4, audit + "D", initials))
                if bad[i] not in ("blank", "duplicate"):
                    extra = 3 * (bad[i] == "truncated")
                    stack.append((i + 1, cost + extra, audit + "K", initials + (rows[i][0][:1] or "-")))
                    stack += [(i + 1, cost + 3 + extra, audit + "R", initials + c) for c in "ua"]
        assert plain(rows)[:2] == best


def test_least_paths_in_a_block():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        length = rnd.integers(1, 9, rnd.integers(1, 6))
        start = np.cumsum(length) - length
        initial, fault = rnd.integers(0, 4, length.sum()), rnd.integers(0, 4, length.sum())
        ends = np.tile(np.array(repair.ENDS), (len(length), 1))
        cost, exits, steps, edit, row, state = repair.least_paths(initial, fault, start, length, ends, [(s, 0) for s in range(len(length))])
        m = [repair.matrix(initial[a:a + n], fault[a:a + n]) for a, n in zip(start, length)]
        assert cost.tolist() == [int((x[0] + np.array(repair.ENDS)).min()) for x in m]
        assert set(exits.tolist()) <= {0, 3} and len(edit) == steps.sum()
        assert all(sorted(row[(row >= a) & (row < a + n)].tolist()) == list(range(a, a + n)) for a, n in zip(start, length))


@pytest.mark.parametrize("bits", [2, 4, 13])
def test_equals_plain_version(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rnd = random.Random(bits)
    rows = list(itertools.chain(*[some_rows(rnd, c, rnd.randint(1, 9)) for c in range(60)]))
    rows += [r for r in some_rows(rnd, 1000, 150)] + some_rows(rnd, None, 20)
    check(spark, rows)


def test_hot_conversation_over_many_blocks(spark, monkeypatch):
    """One conversation of 20,000 rows in blocks of 256: every block is a part with entries to find."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 8)
    n = 20_000
    roles, texts = ["user", "assistant", "user", "system"], ["One.", "Two!", "", "no end"]
    rnd = random.Random(5)
    rows = [(7, t, rnd.choice(roles), f"{t % 900} {rnd.choice(texts)}") for t in range(n)] + [(8, 0, "user", "Hi.")]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA))
    r = {x.conv_id: x for x in got.report.collect()}
    said = [(role, text) for _, _, role, text in rows[:n]]
    bad = faults(said)
    ends, start = np.array([repair.ENDS]), np.array([0])
    code = np.array([{"u": 1, "a": 2, "s": 0}[x[0][0]] for x in said])
    fault = np.array([{"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[b] for b in bad])
    cost, _, _, edit, _, _ = repair.least_paths(code, fault, start, np.array([n]), ends, [(0, 0)])
    assert r[7].cost == int(cost[0]) and r[7].audit == "".join(repair.LETTERS[e] for e in edit) and (r[8].cost, r[8].audit) == (3, "KI")
    initials = "".join(x.role[0] for x in got.turns.where("conv_id = 7").orderBy("seg", "n").collect())
    assert re.fullmatch("(s?(ua)+)?", initials) and len(initials) == len(r[7].audit.replace("D", ""))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 5, "user", " "), (2, 3, "user", "x" * 200_000 + "."), (2, 4, None, "A."), (3, 1, "assistant", "Same."), (3, 1, "assistant", "Same."),
            (None, None, "system", "Rules."), (None, 2, "user", "Q?"), (4, 9, "ünïcode", "Ä.")]
    check(spark, rows)
    clash = spark.createDataFrame([(1, 0, "user", "Hi.", 3, "x")], SCHEMA + ", pos int, conv string")
    assert measured(repair.repair(clash))[1][5:7] == (3, "KI")
    none = repair.repair(spark.createDataFrame([], SCHEMA))
    assert none.report.count() == 0 and none.turns.count() == 0
    named = spark.createDataFrame([("c", 0, "user", "Hi."), ("c", 1, "assistant", "Yes.")], SCHEMA.replace("conv_id long", "conv_id string"))
    assert measured(repair.repair(named))["c"][5:7] == (0, "KK")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def test_query(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(10_000 + i, None if i % 3 == 0 else i, None, "Alone.") for i in range(40)] + [(None, 1, "user", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    by_id: dict = {r[0]: [] for r in rows}
    for c, *rest in damaged(rows):
        by_id[c].append(tuple(rest))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert any(not r for r in by_id.values())
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: expected(r) if r else nothing for c, r in by_id.items()} and len(got) == len(by_id)
