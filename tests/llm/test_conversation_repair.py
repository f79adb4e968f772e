import hashlib
import itertools
import random
import re
import zlib

import pytest

from kinfold.llm import conversation_repair as repair
from kinfold.llm import queries

GOOD = re.compile("(s?(ua)+)?")
CODES = "suaxSUA_="


def by_trial(codes):
    """Every list of edits with up to two insertions at a place, tried."""
    best = None
    for choice in itertools.product("DKR", repeat=len(codes)):
        if any(c in "_=" and e != "D" for c, e in zip(codes, choice, strict=True)) or any(c.lower() == "x" and e == "K" for c, e in zip(codes, choice, strict=True)):
            continue
        cost = sum({"D": 4, "K": 0, "R": 3}[e] + (3 if c.isupper() and e != "D" else 0) for c, e in zip(codes, choice, strict=True))
        for more in itertools.product(range(3), repeat=len(codes) + 1):
            audit = "".join("I" * n + e for n, e in zip(more, [*choice, ""], strict=True))
            roles = ["I" if e == "I" else e for e in audit]
            at = 0
            options = []
            for e in roles:
                if e == "I":
                    options.append("ua")
                else:
                    options += [codes[at].lower()] if e == "K" else ["ua"] if e == "R" else []
                    at += 1
            if any(GOOD.fullmatch("".join(x)) for x in itertools.product(*options)):
                way = (cost + 3 * sum(more), audit)
                best = way if best is None else min(best, way)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_against_trial(seed):
    pick = random.Random(seed)
    codes = "".join(pick.choice(CODES) for _ in range(seed % 4))
    assert repair.cheapest(codes) == by_trial(codes)


@pytest.mark.parametrize("seed", range(30))
def test_stretches_join_to_the_same(seed):
    pick = random.Random(100 + seed)
    codes = "".join(pick.choice(CODES) for _ in range(pick.randrange(0, 40)))
    front = {repair.START: (0, "")}
    for k in range(0, len(codes), 7):
        front = repair.joined(front, repair.crossings(codes[k : k + 7]))
    assert min(front[s] for s in (repair.START, repair.ASSISTANT) if s in front) == repair.cheapest(codes)


def expected(rows):
    """Report by plain Python of the rows (turn, role, text) of a conversation, none of them tied."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, codes, count = set(), "", {"_": 0, "=": 0, "t": 0}
    for _, role, text in rows:
        code = repair.coded(role, text, (role, text) in seen)
        seen.add((role, text))
        codes += code
        count["t" if code.isupper() else code] = count.get("t" if code.isupper() else code, 0) + 1
    cost, audit = repair.cheapest(codes)
    out, at = [], 0
    for e in audit:
        state = out[-1][0] if out else ""
        turn = "a" if state == "u" else "u"
        if e == "I":
            out.append((turn, {"u": "user", "a": "assistant"}[turn] + ":"))
            continue
        _, role, text = rows[at]
        at += 1
        if e == "K":
            out.append((role[0], f"{role}:{text}"))
        elif e == "R":
            out.append((turn, {"u": "user", "a": "assistant"}[turn] + ":" + text))
    assert GOOD.fullmatch("".join(s for s, _ in out))
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count["_"], count["="], count["t"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(x for _, x in out).encode()).hexdigest())


def talk(pick, n):
    texts = ["yes.", "no", "", " \t\n", "what?", "long words " * 20 + ".", "naïve 漢字!"]
    return [(t, pick.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), pick.choice(texts) if pick.random() < 0.4 else f"line {t}{pick.choice(['.', ''])}") for t in range(n) if pick.random() < 0.9]


@pytest.mark.parametrize("segment", [5, 512])
def test_repair(spark, segment):
    """A conversation with a third of all rows, many short ones, gaps and null turns, under any cut into stretches."""
    pick = random.Random(segment)
    talks = {c: talk(pick, pick.randrange(1, 12)) for c in range(60)} | {1000: talk(pick, 400), None: [(None, "user", "hi."), (3, "assistant", "ho.")]}
    rows = [(c, t, r, x, 1, "x") for c, said in talks.items() for t, r, x in said]
    pick.shuffle(rows)
    known = spark.createDataFrame([*rows, (77, 0, "user", "gone.", 0, "y")], "conv_id long, turn long, role string, text string, copies int, audit string")
    got = {r[0]: tuple(r)[1:] for r in repair.repair(known, copies_col="copies", digests_only=True, segment=segment).collect()}
    assert got == {c: expected(said) for c, said in talks.items() if said} | {77: expected([])}
    held = repair.repair(known, copies_col="copies", segment=segment).collect()
    for c, report in got.items():
        lines = [f"{r.role}:{r.text}" for r in sorted((r for r in held if r.conv_id == c), key=lambda r: r.position)]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == report[-1]
        assert "".join(r.edit for r in sorted((r for r in held if r.conv_id == c), key=lambda r: r.position)) == report[-2].replace("D", "")


def test_hard_rows(spark):
    """Null roles and texts are one space, repeated rows are duplicates, a megabyte of text is one row."""
    big = "word " * 1_000_000 + "."
    rows = [(1, 0, None, None), (1, 1, "user", big), (1, 2, "assistant", "ok."), (1, 2, "assistant", "ok."), (2, None, "user", "a."), (2, None, "assistant", "b.")]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), digests_only=True).collect()}
    assert (got[1].blank, got[1].duplicate, got[1].audit, got[1].cost) == (1, 1, "DKKD", 8)
    assert got[2].gaps == 0 and got[2].audit in ("KK", "KRI", "DKD", "IKK", "IKD", "DKI")
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repair(empty).count() == 0 and repair.repair(empty, digests_only=True).count() == 0


def test_query_counts_all_conversations(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn").collect()
    got = queries.op11_repair(spark, sf).collect()
    assert sorted(r.conv_id for r in got) == sorted({r[0] for r in rows})
    dropped = [c for c in {r[0] for r in rows} if all(zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 0 for r in rows if r[0] == c)]
    assert all(r.audit == "" and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got if r.conv_id in dropped)
